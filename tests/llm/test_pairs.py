"""Operators 1, 5 and 7 against brute force, with edge cases."""

import random

import numpy as np
import pyarrow as pa
from helpers import documents, sentences, shingles, words

from blockloom.llm import decontamination, graph, near_text, near_vectors, text


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def changed(base, share, seed):
    rng = random.Random(seed)
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in base.split())


def corpus():
    rows = [(k, sentences(120, k)) for k in range(40)]
    base = sentences(300, 777)
    rows += [(100 + k, changed(base, 0.001 * k, k)) for k in range(30)]
    rows += [(200, rows[3][1].upper() + "!"), (201, rows[3][1]), (202, None), (203, ""), (204, " ?! "), (205, "one two"), (206, "One, two."), (207, "one two three"), (208, "É è ñ ß"), (209, "é È Ñ ß!"), (210, sentences(30000, 9)), (211, sentences(30000, 9) + " end")]
    random.Random(4).shuffle(rows)
    return rows


def test_words_follow_the_regular_expression():
    texts = [t for _, t in corpus()] + ["a_b c-d e—f ×g÷h 日本 2½", "naïve “quote” ǅ"]
    hashes, offsets = text.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = hashes[offsets[i] : offsets[i + 1]].tolist()
        mine = words(t)
        assert len(own) == len(mine), t
        for w, h in zip(mine, own, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_jaccard_links_equal_brute_force(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    label = components(sets, [(a, b) for a in links for b in links[a]])
    got = {r.doc_id: r for r in near_text.jaccard_links(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_links, got[i].class_id, got[i].kept) == (len(links[i]), label[i], label[i] == i), i
        assert got[i].copy_of == min([i, *(j for j in links[i] if sets[j] == sets[i])])
    assert sum(len(x) for x in links.values()) > 100


def test_jaccard_links_of_large_groups_in_blocks(spark, monkeypatch):
    rows = corpus()
    want = sorted(map(tuple, near_text.jaccard_links(documents(spark, rows)).collect()))
    monkeypatch.setattr(near_text, "BLOCK", 4)
    assert sorted(map(tuple, near_text.jaccard_links(documents(spark, rows)).collect())) == want
    monkeypatch.setattr(near_text, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(graph, "HOT_SHARE", 0.1)
    assert sorted(map(tuple, near_text.jaccard_links(documents(spark, rows)).collect())) == want


def test_jaccard_links_of_repeated_rows(spark):
    base = sentences(60, 5).split()
    near, other = " ".join([*base, "more"]), sentences(60, 6)
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, near), (2, near), (2, near), (1, other), (3, other + " x"), (4, near + " q"), (4, other)]
    sets = [shingles(t) for _, t in rows]
    linked = [[k for k in range(len(rows)) if k != i and 10 * len(sets[i] & sets[k]) >= 8 * len(sets[i] | sets[k])] for i in range(len(rows))]
    label = components(range(len(rows)), [(i, k) for i, own in enumerate(linked) for k in own])
    smallest = {x: min(rows[i][0] for i in label if label[i] == x) for x in label.values()}
    want = sorted((rows[i][0], len(linked[i]), smallest[label[i]]) for i in label)
    for n in (1, 3):
        assert sorted((r.doc_id, r.n_links, r.class_id) for r in near_text.jaccard_links(documents(spark, rows).repartition(n)).collect()) == want


def test_blocks_of_a_chain_grow_linearly(spark):
    """Templates that each share buckets with the next are not compared all with all."""
    rng = random.Random(6)
    work = {}
    for n in (200, 800):
        words_, rows = [f"c{rng.randrange(10**6)}" for _ in range(100)], []
        for k in range(n):  # a fifth of the words changes from one to the next
            words_ = words_[8:] + [f"c{rng.randrange(10**6)}" for _ in range(8)]
            rows.append((k, " ".join(words_)))
        classes = near_text.sketches(documents(spark, rows)).withColumnRenamed("doc_id", "cid")
        home, pairs = near_text.blocks(classes)
        work[n] = pairs.join(home, "block").count()
    assert work[800] <= 6 * work[200]


def test_jaccard_edges(spark):
    assert near_text.jaccard_links(documents(spark, [])).count() == 0
    assert near_text.keep_first(documents(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    kept = near_text.keep_first(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "")]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in range(32, 161, 32):
        least = near_text.least_matches(n, 0.8)
        assert (rng.binomial(n, 0.8, 100_000) < least).mean() < 1e-4
        assert (rng.binomial(n, 0.3, 1000) >= least).mean() < 0.6


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(100)] + [(5000, 5000 + k) for k in range(1, 200)]
    links = [(a, b) for a, b in links if a != b]
    want = components({x for p in links for x in p}, links)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    nodes = spark.createDataFrame([((a, 1), (b, 1)) for a, b in links], "a struct<x:bigint,y:bigint>, b struct<x:bigint,y:bigint>")
    assert {r.id.x: r.component.x for r in graph.components(nodes).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(120)]
    base = rng.standard_normal(16)
    rows += [(300 + k, (base + 0.15 * rng.standard_normal(16)).tolist()) for k in range(60)]
    rows += [(400, rows[5][1]), (401, (10 * np.array(rows[5][1])).tolist()), (402, None), (403, []), (404, [0.0] * 16), (405, [float("nan")] + [1.0] * 15), (406, [None] + [1.0] * 15), (407, [float("inf")] * 16), (408, [1.0] * 8), (409, [1.0] * 8), (410, [1e-30] * 16), (411, [1e30] * 16)]
    return rows


def test_cosine_links_equal_brute_force(spark, monkeypatch):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors()]
    good = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _ in rows}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a] / np.abs(good[a]).max(), good[b] / np.abs(good[b]).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                    links[a].add(b)
                    links[b].add(a)
    label = components(links, [(a, b) for a in links for b in links[a]])
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, copies string")
    for block in (2048, 8):
        monkeypatch.setattr(near_vectors, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.cosine_links(df).collect()}
        assert got == {i: (len(links[i]), label[i], label[i] == i) for i in links}
    assert near_vectors.cosine_links(df.limit(0)).count() == 0


def test_containment_equals_brute_force(spark):
    items = [(k, sentences(n, 50 + k)) for k, n in enumerate((5, 6, 9, 15, 40, 100, 700))] + [(20, None), (21, ""), (22, "just four words here"), (23, sentences(15, 53)), (24, "x x x x x x x x")]
    rng = random.Random(1)
    rows = [(k, sentences(rng.randrange(1, 400), 500 + k)) for k in range(40)]
    for k, (_, t) in enumerate(items[:7]):
        w = t.split()
        rows += [(100 + k, f"{sentences(3000, 900 + k)} {t} {sentences(2000, 901 + k)}"), (120 + k, t.upper()), (140 + k, " ".join(w[: int(0.9 * len(w))] + ["q"])), (160 + k, " ".join(w[: len(w) // 2]) + " gap " + sentences(50, k) + " " + " ".join(w[len(w) // 2 :]))]
    rows += [(300, None), (301, ""), (302, "just four words here"), (303, "x x x x x x"), (304, rows[-1][1]), (304, rows[-1][1])]
    got = sorted((r.doc_id, r.item_id, r.item_shingles, r.found_shingles) for r in decontamination.find(documents(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")).collect())
    full = lambda t: shingles(t) if len(words(t)) >= 5 else set()
    want = []
    for d, t in rows:
        own = full(t)
        want += [(d, i, len(s), len(s & own)) for i, x in items if (s := full(x)) and len(s & own) >= 0.8 * len(s)]
    assert got == sorted(want)


def test_containment_of_scattered_items_in_very_long_texts():
    rng = random.Random(11)
    items = [sentences(60, 40_000 + k, 10**7).split() for k in range(60)]
    index = decontamination.Index(list(range(60)), [np.unique(text.shingles(*text.words(pa.array([" ".join(w)])))[0]) for w in items], 0.8)
    texts = []
    for w in items:  # two pieces, far apart, hold 54 of the 56 shingles that the item has at most
        cut = rng.randrange(20, 40)
        texts.append(f"{sentences(9000, rng.random(), 10**7)} {' '.join(w[: cut + 2])} {sentences(9000, rng.random(), 10**7)} {' '.join(w[cut - 2 :])} {sentences(2000, rng.random(), 10**7)}")
    rows, found, _ = index.search(pa.array(texts))
    assert list(zip(rows.tolist(), found.tolist(), strict=True)) == [(k, k) for k in range(60)]


def test_containment_in_blocks_and_edges(spark):
    items = spark.createDataFrame([(k, sentences(20, k)) for k in range(30)], "item_id long, text string")
    docs = documents(spark, [(k, sentences(300, 99) + " " + sentences(20, k)) for k in range(30)] + [(50, "clean words only in this one"), (51, None)])
    whole = sorted(map(tuple, decontamination.find(docs, items).collect()))
    assert [r[:2] for r in whole] == [(k, k) for k in range(30)]
    blocks = list(decontamination.indexes(items, block_items=7))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids) == list(range(30))
    small = list(decontamination.indexes(items.unionByName(items.where("item_id = 3")), block_bytes=500))
    assert len(small) > 5 and sorted(i for b in small for i in b.ids) == sorted([*range(30), 3])
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [50, 51]
    assert decontamination.find(docs, items.limit(0)).count() == 0
    assert decontamination.drop_leaks(docs, items.limit(0)).count() == 32
    assert decontamination.find(docs.limit(0), items).count() == 0


def test_hashes_of_long_words_differ():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [word[:n] for n in (8, 64, 65, 1024, 2048)] + [other[:n] for n in (8, 64, 65, 1024, 2048)]
    hashes, _ = text.words(pa.array(rows))
    assert len(set(hashes.tolist())) == len(rows)
