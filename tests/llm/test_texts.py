"""Operators 2, 3, 6, 8, 9 and 10: brute force, held-out accuracy and edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from helpers import documents, sentences, words
from oracle import DATA
from pyspark.sql import functions as F

from blockloom.llm import backoff, html_text, mixing, suffixes, token_counts, toxicity


# 2
def toxic_corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        w = sentences(60, k, 400).split()
        bad = k % 6 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["grubnakor", "grubnazim", "grubnalel", "flozz"]))
        for i in range(9, len(w), 10):
            w[i] += "."
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grammar = toxicity.fit(docs, known)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = toxicity.score(docs, grammar).where(held).join(known, "doc_id").collect()
    assert len(got) > 100
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_harmless(docs, grammar)
    assert kept.columns == docs.columns and kept.count() < 520


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = known.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, turned)
    assert (a.terms, a.slope, a.offset) == (b.terms, b.slope, b.offset)


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar()
    score = lambda *t: grammar.evidence(pa.array(t)).tolist()
    plain, aimed, denied, told, nothing, none, empty = score("what an idiot", "you idiot", "he is not an idiot", "she said he is an idiot", "you are nice. not bad", None, "")
    assert aimed > plain > denied > 0 and told < aimed and nothing == none == empty == 0
    threat, idle = score("I will kill you", "I kill time")
    assert threat > idle
    split, joined = score("not good. idiot", "not good idiot")
    assert split > joined


def test_toxicity_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (2, ""), (None, "you idiot"), (3, "x " * 200_000)])
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    grammar = toxicity.fit(docs, none)
    assert toxicity.score(docs, grammar).count() == 5
    assert toxicity.score(docs.limit(0), grammar).count() == 0


def brute_evidence(grammar, text):
    """The clauses' sum with the component transducers one by one, on Python strings."""
    total = 0.0
    for clause in regex.split(r"[.!?;\n]", (text or "").lower()):
        scope = said = aim = held = 0
        weight = 0.0
        for m in regex.finditer(r"[\p{L}\p{N}\p{M}_]+", clause):
            w, before = m[0], clause[: m.start()]
            found = [(x, -len(t), tag) for t, (tag, x) in grammar.terms.items() if (w == t or t[-1] == "*" and w.startswith(t[:-1]) and len(w.encode()) > len(t[:-1].encode()))]
            x, _, tag = max(found, key=lambda f: f[0], default=(0.0, 0, toxicity.OTHER))
            if w == "t" and before.endswith(("n'", "n’")):
                tag = toxicity.NEGATION
            if tag in (toxicity.INSULT, toxicity.THREAT):
                weight += x
            rewritten = tag + 8 if scope and tag in (toxicity.INSULT, toxicity.THREAT) else tag
            scope, said, aim, held = toxicity.negation(scope, tag), toxicity.reported(said, tag), toxicity.target(aim, tag), toxicity.insult(held, rewritten)
        total += weight * toxicity.factor((scope, said, aim, held))
    return total


MIXED = ["you said hello friend. they are not here. what an idiot move", "x — y", "“you” idiot! 日本 idiot。 not。idiot", "you aren’t an idiot; you don't kill. idiot\nkill you", "ÉCRIT “imbécile” – töten İ ǅ idiot", "×idiot÷ ½idiot idiot_ you", "не idiot́ you.", None, "", "’t idiot n't idiot can't idiot", "t idiot 't"]


def test_scores_equal_a_brute_force_scorer(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if DATA.exists() else []
    docs, known = (documents(spark, rows), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")) if rows else (None, None)
    learned = toxicity.fit(docs, known) if rows else toxicity.Grammar()
    grammar = toxicity.Grammar({t: x for t, (tag, x) in list(learned.terms.items())[:300] if tag == toxicity.INSULT} | {"frien*": 1.5, "friend": 0.5, "moveme*": 2.0})
    texts = MIXED + [t for _, t in rows]
    assert np.allclose(grammar.evidence(pa.array(texts, pa.string())), [brute_evidence(grammar, t) for t in texts])


def test_scores_do_not_depend_on_the_batch(spark):
    grammar = toxicity.Grammar({"frien*": 1.5})
    alone = [grammar.evidence(pa.array([t], pa.string()))[0] for t in MIXED]
    assert len({x for x in alone if x}) > 4
    assert grammar.evidence(pa.array(MIXED, pa.string())).tolist() == alone
    for n in (1, 2, 7):
        got = {r.doc_id: r.evidence for r in toxicity.score(documents(spark, list(enumerate(MIXED))).repartition(n), grammar).collect()}
        assert got == dict(enumerate(alone))


def test_contractions_are_negations():
    score = lambda t: toxicity.Grammar().evidence(pa.array([t]))[0]
    assert score("don't idiot") == score("don’t idiot") == score("aren't idiot") == score("not idiot") < score("t idiot")


# 3
def test_backoff_equals_brute_force(spark):
    rows = [(k, sentences(random.Random(k).randrange(0, 80), k, 25)) for k in range(60)] + [(70, None), (71, ""), (72, "one"), (73, "one two"), (74, "one two"), (74, "one two"), (75, sentences(60_000, 75, 25))]
    counts = [Counter(), Counter(), Counter()]
    for _, t in rows:
        w = words(t)
        for n in (1, 2, 3):
            counts[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(counts[0].values())

    def score(w, i):
        factor = 0.0
        for n in (3, 2):
            if i >= n - 1:
                gram = tuple(w[i - n + 1 : i + 1])
                if counts[n - 1][gram] >= 2:
                    return factor + math.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]])
                factor += math.log(0.4)
        return factor + math.log(counts[0][(w[i],)] / total)

    want = sorted((d, len(w), round(math.fsum(score(w, i) for i in range(len(w))), 5)) for d, t in rows for w in [words(t)])
    got = sorted((r.doc_id, r.n_words, round(r.log_score, 5)) for r in backoff.score_documents(documents(spark, rows)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-5)
    means = {r.doc_id: r.mean_log_score for r in backoff.score_documents(documents(spark, rows)).collect()}
    assert means[70] is None and means[71] is None and means[72] < 0
    assert backoff.score_documents(documents(spark, [])).count() == 0


# 6
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies. Accept them, please.</div><div id=main><div class="post-body"><h1>A title</h1><p>First&nbsp;paragraph, which is &lt;long&gt; enough; it goes on,
and on.<p>Second <b>bold</b> one &amp; more.<div class="ad-slot"><p>Buy this, now. Cheap.</p></div><ul><li>item one<li>item two</ul><p>Last.</div><aside>Side text, here. More.</aside></div>
<form><p>Sign up, please. It is free.</p></form><div id="comments"><p>Great article, thanks. I agree with it all.</p></div><footer>Copyright, all rights.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["A title", "First paragraph, which is <long> enough; it goes on, and on.", "Second bold one & more.", "item one", "item two", "Last."]


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>", ""), ("<p>a < b</p>", "a < b"), ("<p>x<br>y</p>", "x y"), ("<p>&eacute;&#233;&#xE9;</p>", "ééé"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<script>never closed", ""), ("<div><h1>A</h1><p>Text, of the page. And more.</p><div><h3>Comments (2)</h3><p>Nice, very nice. Yes.</p></div></div><div>Copyright 2020, me.</div>", "A\nText, of the page. And more."), ("<article><p>one<p>two</article><p>three, and four, and five. Six.</p>", "one\ntwo")],
)
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


A, B, JUNK = "The first part, as it is. It goes on, and on.", "The second part, as it is. It ends here, at last.", "Some other words, not of the article. Really."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<p>{A}</p><h2>Related</h2><p>{JUNK}</p><h3>{JUNK}</h3><h2>Next</h2><p>{B}</p>", [A, "Next", B]),
        (f"<p>{A}</p><h3>Responses</h3><p>{JUNK}</p><section><h2>Next</h2><p>{B}</p></section>", [A, "Next", B]),
        (f"<p>{A}</p><h3>Advertisement</h3><p>{B}</p>", [A, B]),
        (f"<p>{A}</p><div><h3>Advertisement</h3><p>{JUNK}</p></div><p>{B}</p>", [A, B]),
        (f"<p>{A}</p><h2>Share</h2><h2>Next</h2><p>{B}</p><h2>Comments (2)</h2><p>{JUNK}</p>", [A, "Next", B]),
        (f"<p>{A}</p><h2>Related</h2><p>{JUNK}</p><h2>Replies</h2><p>{JUNK}</p>", [A]),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_an_article_goes_on_after_an_added_part(tag, body, want):
    assert html_text.main_text(f"<{tag}><h1>Title</h1>{body}</{tag}>").split("\n") == ["Title", *want]


LONG_A, LONG_B = "This is the story as it was told, with all that belongs to it; it takes its time. " * 3, "And so it went on, for many days, until it came to its end, which nobody had seen coming. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{LONG_A}</p><p>Copyright law protects authors, as it should.</p><p>{LONG_B}</p></div><div>© 2020 The Paper</div><div>Copyright 2021 by us. All rights reserved.</div>", [LONG_A, "Copyright law protects authors, as it should.", LONG_B]),
        (f"<article><p>{LONG_A}</p><h2>Responses</h2><section><h2>What they did</h2><p>{LONG_B}</p></section></article>", [LONG_A, "What they did", LONG_B]),
        *((f"<div><p>{LONG_A}</p><{tag}>Go<p>{LONG_B}</p><p>{LONG_A}</p></div>", [LONG_A, LONG_B, LONG_A]) for tag in "select textarea object canvas svg math video template".split()),
        (f"<div><button>Menu<section><p>{LONG_A}</p><p>{LONG_B}</p></section><button>Send</button></div>", [LONG_A, LONG_B]),
        (f"<article><p>{LONG_A}</p><template><article><h1>no</h1><p>{LONG_B}</p></article></template><noscript><section>no</section></noscript><p>{LONG_B}</p></article>", [LONG_A, LONG_B]),
        (f"<div><p>{LONG_A}</p><p>{LONG_B} <button>Copy</button><select><option>no</select><svg><title>no</title></svg></p></div>", [LONG_A, LONG_B]),
        (f'<article><h1>T</h1><p>{LONG_A}</p><section class="discussion"><h2>Discussion</h2><p>{LONG_B}</p></section></article>', ["T", LONG_A, "Discussion", LONG_B]),
        (f'<article><p>{LONG_A}</p><div class="related"><a href=x>One more</a> <a href=y>Two more</a></div><p>{LONG_B}</p></article>', [LONG_A, LONG_B]),
        (f"<article><h3>Teaser</h3><p>Read this, too.</p></article><div><p>{LONG_A}</p><p>{LONG_B}</p><p>{LONG_A}</p></div>", [LONG_A, LONG_B, LONG_A]),
    ],
)
def test_nothing_of_the_article_is_lost(page, want):
    got = [x for x in html_text.main_text(page).split("\n") if x not in ("Menu", "Go", "Teaser")]
    assert got == [x.strip() for x in want]


@pytest.mark.parametrize(("line", "notice"), [("©2020 The Paper", True), ("(c) 2019 us", True), ("Copyright (c) by us", True), ("Copyright 2021, me.", True), ("All rights reserved.", True), ("The Paper, 2020. All rights reserved", True), ("(c) the third case, as it was held, goes on.", False), ("Copyright is a right, as it was held.", False), ("All rights reserved to the king were lost, in the end.", False)])
def test_notices_outside_an_article(line, notice):
    got = html_text.main_text(f"<div><p>{LONG_A}</p><p>{line}</p><p>{LONG_B}</p></div>").split("\n")
    assert got == [LONG_A.strip(), *([] if notice else [line]), LONG_B.strip()]


def generated_page(rng):
    """A page whose names say nothing, and its article's blocks."""
    name = lambda: "".join(rng.choice("bcdfghklmnprtvz") for _ in range(6))
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(6, 16))).capitalize() + rng.choice([".", ".", "!", "; so be it."])
    linked = lambda n: f'<ul class="{name()}">' + "".join(f'<li class={name()}><a href="/{word()}">{word()} {word()}</a></li>' for _ in range(n)) + "</ul>"
    blocks = [f"{word()} {word()} {word()}".capitalize()]
    parts = [f"<h1>{blocks[0]}</h1>"]
    for _ in range(rng.randrange(3, 12)):
        blocks.append(" ".join(sentence() for _ in range(rng.randrange(2, 6))))
        parts.append(f"<p>{blocks[-1]}</p>")
    shell = f'<div class="{name()}">{linked(6)}</div><div class="{name()}"><div class="{name()}">{"".join(parts)}</div><div class="{name()}">{linked(9)}</div></div><div class="{name()}">{linked(5)}<span>{word()} {word()}</span></div>'
    return f"<html><body>{shell}</body></html>", blocks


def test_generated_pages_with_names_that_say_nothing():
    rng = random.Random(12)
    for _ in range(60):
        page, blocks = generated_page(rng)
        assert html_text.main_text(page).split("\n") == blocks


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "<p>" + "word, " * 100_000 + "</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 1, 2, 3]
    assert all(r.n_chars == len(r.text) for r in got) and got[2].text == "" and got[3].n_chars == 6 * 100_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


# 8
def brute_repeats(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if d is not None:
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_corpus():
    rng = random.Random(5)
    line, passage = "The shared line of every document that has it. ", sentences(40, 77)
    rows = [(k, sentences(80, k)) for k in range(30)]
    rows += [(100 + k, line * (1 + k % 3) + sentences(30, 200 + k)) for k in range(30)]
    rows += [(200 + k, sentences(20, 300 + k) + passage[k : 120 + k * 3] + sentences(20, 400 + k)) for k in range(30)]
    rows += [(300 + k, "a" * (40 + k)) for k in range(20)] + [(330 + k, "ab" * (20 + k) + "é" * k) for k in range(20)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (401, rows[1][1]), (402, None), (403, ""), (404, "x" * 49), (405, "x" * 50), (406, "x" * 51), (407, "\0" * 60 + "ü" * 60), (408, "\0" * 70 + "ü" * 70), (None, rows[2][1])]
    rows += [(500 + k, "".join(rng.choice("ab") for _ in range(300))) for k in range(10)] + [(600, sentences(20000, 1) + rows[500 % 90][1]), (601, sentences(20000, 2) + rows[4][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_equal_brute_force(spark, hot):
    rows = repeats_corpus()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    docs = documents(spark, rows).repartition(5)
    got = [tuple(r) for r in suffixes.report(docs, hot=hot, chunk_bytes=1 << 12).collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)


def test_merged_transforms_sort_all_suffixes():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 99, n).astype(np.uint8) for n in (200, 60, 333)]
    g, (ranks, rest) = suffixes._symbols(texts)
    built = [suffixes.transform(r, rest[k] if rest else None, g) for k, r in enumerate(ranks)]
    place, new = suffixes.merge([(b[1], b[2]) for b in built], g)
    circles = [[bytes(np.roll(t, -p)[:50]) if len(t) >= 50 else b"" for p in b[0]] for t, b in zip(texts, built, strict=True)]
    strings = [s for c in circles for s in c]
    merged = [strings[p] for p in place]
    assert merged == sorted(merged)
    assert [a != b for a, b in zip(merged, merged[1:], strict=False)] == new[1:].tolist()


def test_cut_keeps_characters_whole(spark):
    rows = repeats_corpus()
    docs = documents(spark, rows)
    got = suffixes.cut(docs)
    assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
    want = {d: (n, gone) for d, n, gone, _, _ in brute_repeats(rows)}
    for r in got.collect():
        assert (r.text is None) == (r.doc_id == 402) and r.chunk == "c" and r.label == "l"
        assert r.n_chars == (None if r.text is None else len(r.text))
        if r.doc_id not in (401, None):
            n, gone = want[r.doc_id]
            assert n - gone <= len((r.text or "").encode()) <= n - gone + 8 * (gone > 0)
    assert suffixes.report(documents(spark, [])).count() == 0
    assert suffixes.cut(documents(spark, [])).count() == 0


# 9
def brute_copies(doc_id, mean, seed=7):
    parts = max(1, math.ceil(mean / 32))
    total = 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean / parts)
        k = 0
        while c <= u:
            k += 1
            p *= mean / parts / k
            c += p
        total += k
    return total


def test_mixing_equals_brute_force(spark):
    rows = [(k, f"t{k}", "abcd"[min(k % 7, 3)]) for k in range(700)] + [(800 + k, None, None) for k in range(4)]
    docs = documents(spark, [r[:2] + (r[2],) for r in rows])
    target = {"a": 5.0, "b": 1.0, "d": 2.0, None: 1.0, "absent": 9.0}
    counts = Counter(r[2] for r in rows)
    weight = {s: target.get(s, 0) for s in counts}
    whole, share = len([r for r in rows if weight[r[2]]]), sum(weight.values())
    mean = {s: weight[s] / share * whole / counts[s] for s in counts}
    got = Counter(r.doc_id for r in mixing.mix_sources(docs, target).collect())
    assert got == Counter({r[0]: n for r in rows if weight[r[2]] and (n := brute_copies(r[0], mean[r[2]]))})
    assert max(mean.values()) > 10


def test_mixing_shares_and_edges(spark):
    docs = documents(spark, [(k, "t", "big" if k % 10 else "small") for k in range(5000)])
    out = mixing.mix_sources(docs)
    n = Counter(r.source for r in out.collect())
    assert abs(n["big"] / (n["big"] + n["small"]) - 0.5) < 0.03
    assert set(docs.columns) <= set(out.columns)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    same = documents(spark, [(1, "t", "s"), (1, "t", "s"), (None, None, "s")] * 3).withColumn("copy", F.lit("x"))
    out = mixing.mix_sources(same).collect()
    assert all(isinstance(r.copy, int) for r in out)


def test_mixing_of_rare_and_many_sources(spark, monkeypatch):
    rows = [(k, f"t{k}", "big" if k else "rare") for k in range(3000)] + [(5000, "n", None)]
    docs = documents(spark, rows).withColumn("__source", F.lit("x")).withColumn("__parts", F.lit("y")).withColumn("__row", F.lit(1))
    whole = sorted((r.doc_id, r.copy, r.shuffle_key, r.text) for r in mixing.mix_sources(docs).collect())
    assert sum(r[0] == 0 for r in whole) == brute_copies(0, 3001 / 3)
    assert [r[1] for r in whole if r[0] == 0] == list(range(1, 1 + brute_copies(0, 3001 / 3)))
    monkeypatch.setattr(mixing, "SLICE", 4)
    assert sorted((r.doc_id, r.copy, r.shuffle_key, r.text) for r in mixing.mix_sources(docs).collect()) == whole
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    out = mixing.mix_sources(docs)
    assert sorted((r.doc_id, r.copy, r.shuffle_key, r.text) for r in out.collect()) == whole
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]


# 10
def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["'re", "'ve", "'ll", "'s", "'S", "'", " '", "re", "l", "v", " ", "  ", "\n", "\t", " ", " ", "é", "ß", "日", "1", "²", "½", "!", "?!", "<|endoftext|>", "<|", "word", " word", "́", "😀", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)] + [None, "", "a" * 5000, " " * 5000 + "x", "'r" * 300, "<|endoftext|>", "x" * 200_000]
    docs = documents(spark, list(enumerate(texts)) + [(5, texts[5])])
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    want = sorted((i, len((t or "").encode()), count(t), count(t) > 512) for i, t in [*enumerate(texts), (5, texts[5])])
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_merge_transducer_equals_the_library():
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), token_counts.Transducer(path)
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(9)
    texts = [word, other, word * 3, "x" * 255, "x" * 256, "x" * 257, "aaab" * 100, "-" * 1000, " " * 700, "=" * 65 + " " + "=" * 64, "é" * 400, "日本語" * 200, "\0" * 90]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("=-*#_ \n") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30))).decode("utf-8", "replace") for _ in range(1500)]
    want = [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(pa.array(texts)).tolist() == want
    assert [int(machine.count(pa.array([t]))[0]) for t in texts[:40]] == want[:40]
    machine._forget()
    assert machine.count(pa.array(texts[::-1])).tolist() == want[::-1]


def test_token_counts_survive_equal_hashes(monkeypatch):
    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    texts = ["one two three 1234 5678", "three, two; one! abcdefghijklmnop qwertyuiop", "zzzzqqqq x", "one"]
    want = token_counts.Transducer(path).count(pa.array(texts)).tolist()
    monkeypatch.setattr(token_counts.Spans, "hashes", lambda self, a, b: (b - a).astype(np.uint64) % np.uint64(2))
    machine = token_counts.Transducer(path)
    assert machine.count(pa.array(texts)).tolist() == want and [int(machine.count(pa.array([t]))[0]) for t in texts] == want


def test_scan_equals_a_single_walk():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000, 20_000):
        kinds = rng.integers(0, 11, n).astype(np.uint8)
        state, marks = 0, []
        for c in kinds.tolist():
            x = int(token_counts.STEP[state, c])
            marks.append(x)
            state = x & 15
        starts = np.array([x & token_counts.STARTS_HERE for x in marks]) > 0
        starts[:-1] |= np.array([x & token_counts.STARTS_BEFORE for x in marks[1:]], int) > 0
        assert np.array_equal(token_counts.run_transducer(kinds), starts)


def test_units_of_work_grow_with_the_root_of_the_input(spark, tmp_path):
    from blockloom.llm.tables import growth

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert growth(small) == 1.0 and growth(documents(spark, [(1, "x")])) == 1.0
    large = small.crossJoin(spark.range(1 << 21))  # the optimizer's estimate of the product is over 16 GB
    assert growth(large) == 4.0 and growth(large, 2.0) == 2.0
