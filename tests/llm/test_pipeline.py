"""corpus_pipeline against a brute-force version on a small fixture."""

from collections import Counter

import corpus_pipeline
from helpers import sentences, shingles
from test_texts import brute_copies, brute_repeats, toxic_corpus


def fixture(spark, path):
    rows, labels = toxic_corpus()
    bad = {d for d, _, toxic in labels if toxic}
    docs = {d: t for d, t in rows}
    docs |= {1000 + k: docs[1 + 6 * k] + (" extra" if k % 2 else "") for k in range(20)}
    passage, item = sentences(30, 5001, 10**6), sentences(25, 5002, 10**6)
    docs |= {1100 + k: f"{sentences(40, 6000 + k, 10**6)} {passage} {sentences(40, 7000 + k, 10**6)}" for k in range(10)}
    docs |= {1200 + k: f"{sentences(60, 8000 + k, 10**6)} {item}" for k in range(1)} | {1300: None, 1301: "", 1302: "short text"}
    source = {d: "ab"[d % 5 == 0] for d in docs}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", source[d], None if t is None else len(t)) for d, t in docs.items()], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, sentences(30, 5003))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, bad, source, item


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, bad, source, item = fixture(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    terms = ("grubna", "flozz")
    docs = {d: t for d, t in docs.items() if not any(x in (t or "") for x in terms)}
    sets = {d: shingles(t) for d, t in docs.items()}
    kept = {}
    for d in sorted(docs):  # the fixture's groups are pairs, so the first of a group is linked to all of it
        if not any(sets[d] and sets[e] and 10 * len(sets[d] & sets[e]) >= 8 * len(sets[d] | sets[e]) for e in kept):
            kept[d] = docs[d]
    cut = {d: n - gone for d, n, gone, _, _ in brute_repeats(list(kept.items()))}
    want_item = shingles(item)
    clean = {d: t for d, t in kept.items() if len(want_item & shingles(t)) < 0.8 * len(want_item)}
    counts = Counter(source[d] for d in clean)
    mean = {s: 1 / len(counts) * len(clean) / n for s, n in counts.items()}
    want = Counter({d: n for d in clean if (n := brute_copies(d, mean[source[d]]))})
    assert Counter(r.doc_id for r in got) == want
    assert {r.doc_id: len((r.text or "").encode()) for r in got} == {d: cut[d] for d in want}
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in got)
    assert not {r.doc_id for r in got} & bad


def test_scopes_delete_what_is_left_in_them(spark):
    from pathlib import Path

    from blockloom.llm.tables import delete, materialize, scope

    with scope(spark) as made:
        first, second = (materialize(spark.range(n), "t") for n in (3, 5))
        kept = made.pop()
    gone = Path(made[0].removeprefix("file:"))
    assert second.count() == 5 and not gone.exists() and Path(kept.removeprefix("file:")).exists()
    delete(spark, [kept])


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns[:5] == docs.columns[:5] and (len(after.columns) == 5 or k == 4)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
