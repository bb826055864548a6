"""Operator 2: toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to tags (insult, threat, target, negation, reported speech) and
weights. Four small transducers read the tags of a clause: *negation* and *reported speech* rewrite what
they hold in their scope, *target* and *insult/threat* collect. `compose` builds their product once, as one
deterministic table; running it over a clause ends in a state that names the pattern matched, and the clause's score is
the weight of its insults or threats times that pattern's factor. A document's evidence is
the sum over its clauses, and a logistic curve maps it to a score. A word outside any matching clause counts nothing.

Clauses end at BREAK characters of the text itself, so a row's score depends on that row alone, whatever else its batch holds. The
second half of a contraction ("don't", with either apostrophe) is a negation.

The lexicon holds seed words of four languages and terms learned from labelled rows: all words and word
beginnings that toxic rows have significantly more often. Learning and the curve use at most `max_labelled` rows of each label,
those with the smallest hash of doc_id (MAX_LABELLED by default); scoring covers every whole text.

Defined results: null and empty texts have no clause and get the curve's value at no evidence; rows with equal
doc_id are scored one by one, those with a null doc_id like any other; labels that are null or have a null doc_id teach nothing, of several labels of a doc_id the
largest counts; without rows of both labels the seed grammar and a fixed curve are used; an empty table gives no row. Columns
of docs beyond id and text are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize, pieces
from .text import Spans, hash_spans, mix, shingles, words, words_and_spans

#: Rows of each label that learning reads at most.
MAX_LABELLED = 5000
#: A term is significant from this log-likelihood ratio, and counts from this log odds ratio.
LEAST_G2, LEAST_ODDS = 24.0, 2.0
PREFIXES = range(4, 8)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS: dict[int, str] = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers clown pathetic worthless disgusting imbecile dumbass jerk dumm trottel abschaum versager widerlich wertlos idiote imbécile ordure minable débile dégoûtant estúpido basura escoria perdedor asqueroso imbécil",
    THREAT: "kill destroy hurt murder beat shoot stab töten umbringen vernichten tuer détruire frapper matar destruir golpear",
    TARGET: "you your yourself u he she they them these those people du dich euch ihr sie dein vous toi tu ton votre eux ils tú te ti usted ustedes ellos vosotros",
    NEGATION: "not no never none nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says wrote called quoted according claims claimed sagte sagt schrieb laut dit écrit selon dijo dice escribió según",
}
SEED_WEIGHT = 3.0
NEGATION_SCOPE = 3
BREAK = np.zeros(256, bool)
BREAK[list(b".!?;\n")] = True
APOSTROPHES = (b"'", "’".encode())


# The component transducers: state x tag -> state. A clause begins in state 0 of each.
def negation(state: int, tag: int) -> int:
    """Words left in the scope of a negation."""
    return NEGATION_SCOPE if tag == NEGATION else max(state - 1, 0)


def reported(state: int, tag: int) -> int:
    """1 from a verb of saying to the clause's end."""
    return 1 if tag == REPORT else state


def target(state: int, tag: int) -> int:
    """1 once someone is addressed or named."""
    return 1 if tag == TARGET else state


def insult(state: int, tag: int) -> int:
    """Bit 1: a plain insult, 2: a negated one, 4: a plain threat, 8: a negated one; tags + 8 are negated."""
    return state | {INSULT: 1, INSULT + 8: 2, THREAT: 4, THREAT + 8: 8}.get(tag, 0)


def compose() -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The product of the four as one table of the reachable states, and these states."""
    states, table = [(0, 0, 0, 0)], []
    number = {states[0]: 0}
    for state in states:
        row = []
        for tag in range(6):
            scope, said, aim, held = state
            rewritten = tag + 8 if scope and tag in (INSULT, THREAT) else tag
            after = (negation(scope, tag), reported(said, tag), target(aim, tag), insult(held, rewritten))
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        table.append(row)
    return np.array(table, np.int32), states


TABLE, STATES = compose()


def factor(state: tuple[int, int, int, int]) -> float:
    """What a clause that ends in this state multiplies its weight by."""
    _, said, aim, held = state
    kind = 1.0 if held & 1 else 1.2 if held & 4 and aim else 0.4 if held & 2 else 0.1 if held & 4 else 0.02 if held & 8 else 0.0
    return kind * (1.4 if aim else 1.0) * (0.5 if said else 1.0)


FACTORS = [factor(s) for s in STATES]


def contracted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words that are the t of a contraction: a single t, and before it an apostrophe and an n."""
    some = np.flatnonzero((ends - starts == 1) & (data[starts] == ord("t")))
    found = [some[:0]]
    for mark in APOSTROPHES:
        before = b"n" + mark
        at = starts[some] - len(before)
        own, at = some[at >= 0], at[at >= 0]
        found.append(own[np.logical_and.reduce([data[at + k] == x for k, x in enumerate(before)])])
    return np.concatenate(found)


class Grammar:
    """terms: {word, or beginning with a final '*': (tag, weight)}; slope and offset of the curve."""

    def __init__(self, learned: dict[str, float] | None = None, slope: float = 2.0, offset: float = -3.0):
        self.terms = {w: (tag, SEED_WEIGHT if tag in (INSULT, THREAT) else 0.0) for tag, line in SEEDS.items() for w in line.split()}
        for term, weight in (learned or {}).items():
            self.terms[term] = (INSULT, weight)
        self.slope, self.offset = slope, offset
        self.lexicon: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # byte length (0: whole word), hashes, tags, weights
        groups: dict[int, list[tuple[bytes, int, float]]] = {}
        for term, (tag, weight) in self.terms.items():
            b = term.rstrip("*").encode()
            groups.setdefault(len(b) if term.endswith("*") else 0, []).append((b, tag, weight))
        for length, own in sorted(groups.items()):
            data, ends = np.frombuffer(b"".join(x[0] for x in own), np.uint8), np.cumsum([len(x[0]) for x in own])
            keys = hash_spans(data, np.concatenate([[0], ends[:-1]]), ends)
            order = np.argsort(keys)
            self.lexicon.append((length, keys[order], np.array([x[1] for x in own], np.uint8)[order], np.array([x[2] for x in own])[order]))

    def tag(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lexicon transducer: tag and weight of each word; of several entries the heaviest holds, of equal ones the first."""
        tags, weights = np.zeros(len(starts), np.uint8), np.full(len(starts), -1.0)
        if not len(starts):
            return tags, weights
        runs = Spans(data)
        for length, keys, kinds, own in self.lexicon:
            some = np.arange(len(starts)) if not length else np.flatnonzero(ends - starts > length)
            if not len(some):
                continue
            h = runs.hashes(starts[some], ends[some] if not length else starts[some] + length)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            some, at = some[hit], at[hit]
            better = own[at] > weights[some]
            some, at = some[better], at[better]
            tags[some], weights[some] = kinds[at], own[at]
        tags[contracted(data, starts, ends)] = NEGATION
        return tags, weights

    def evidence(self, column: pa.Array) -> np.ndarray:
        """The sum of the clause scores of each row."""
        _, offsets, starts, ends, data = words_and_spans(column)
        total = np.zeros(len(column))
        tags, weights = self.tag(data, starts, ends)
        hits = np.flatnonzero((tags == INSULT) | (tags == THREAT))
        if not len(hits):
            return total
        breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
        row = np.searchsorted(offsets, np.arange(len(starts)), side="right") - 1
        clause = np.concatenate([[0], np.cumsum((breaks[starts[1:]] != breaks[ends[:-1]]) | (row[1:] != row[:-1]))])
        firsts = np.searchsorted(clause, np.unique(clause[hits]))
        lasts = np.searchsorted(clause, clause[firsts], side="right")
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            state, weight = 0, 0.0
            for t, w in zip(tags[a:b].tolist(), weights[a:b].tolist(), strict=True):
                state = TABLE[state, t]
                if t in (INSULT, THREAT):
                    weight += w
            total[row[a]] += weight * FACTORS[state]
        return total

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -40, 40)))


def log_odds(all_pos: int, all_neg: int) -> Column:
    """The log odds ratio of a term that `pos` of all_pos and `neg` of all_neg rows have."""
    odds = lambda n, rows: F.log((F.col(n) + 0.5) / (F.lit(rows) - F.col(n) + 0.5))
    return odds("pos", all_pos) - odds("neg", all_neg)


def likelihood_ratio(all_pos: int, all_neg: int) -> Column:
    """Log-likelihood ratio of the 2 x 2 table of rows with and without the term."""
    share = (F.col("pos") + F.col("neg")) / (all_pos + all_neg)
    part = lambda n, expected: F.when(n > 0, 2 * n * F.log(n / expected)).otherwise(0.0)
    return sum((part(F.col(n), rows * share) + part(rows - F.col(n), rows * (1 - share)) for n, rows in (("pos", all_pos), ("neg", all_neg))), F.lit(0.0))


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most max_labelled rows of each label outside the held-out quarter, and the labels' counts.

    Of rows that share one of three MinHash values of their word shingles, copies mostly, one stays: a text copied
    often says no more about its words than once.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = take(0).unionByName(take(1)).select(F.col("doc_id").alias("__id"), "toxic")  # at most 2 * max_labelled rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("id", "text", "toxic")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, offsets = shingles(*words(batch.column(1)))
            some = np.flatnonzero(np.diff(offsets))
            lows = [np.minimum.reduceat(mix(hashes + np.uint64(k)), offsets[some]).view(np.int64) if len(some) else np.empty(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *map(pa.array, lows)], names=["id", "a", "b", "c"])

    kind = dict(rows.dtypes)["id"]
    seen: set[int] = set()
    copies = []
    for r in sorted(rows.mapInArrow(sketch, f"id {kind}, a long, b long, c long").collect()):  # at most 2 * max_labelled rows of four numbers
        own = set(r[1:])
        if own & seen:
            copies.append((r[0],))
        seen |= own
    if copies:
        gone = docs.sparkSession.createDataFrame(copies, f"id {kind}")
        rows = rows.join(F.broadcast(gone), "id", "left_anti")
    return rows.select("text", "toxic"), counts


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learn terms and the curve; see the module's text for what is read."""
    rows, counts = labelled(docs, labels, max_labelled, id_col, text_col)
    if not counts.get(0) or not counts.get(1):
        return Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in pieces(batches, "text"):
            _, offsets, starts, ends, data = words_and_spans(batch.column(0))
            whole, cuts = data.tobytes(), list(zip(starts.tolist(), ends.tolist(), strict=True))
            for toxic, first, last in zip(batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = {whole[a:b].decode() for a, b in cuts[first:last]}
                seen[toxic].update(words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n})
                seen[toxic][""] += 1
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    found = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = materialize(found, "terms")
    size = found.where("term = ''").first()  # the empty term counts the rows themselves
    if not size or not size["pos"] or not size["neg"]:
        return Grammar()
    odds, g2 = log_odds(size["pos"], size["neg"]), likelihood_ratio(size["pos"], size["neg"])
    told = found.where("term <> ''").select("term", odds.alias("odds"), g2.alias("g2")).where((F.col("odds") >= LEAST_ODDS) & (F.col("g2") >= LEAST_G2))
    learned = {r["term"]: min(r["odds"], 6.0) for r in told.collect()}  # significant in a sample of 2 * max_labelled rows
    grammar = Grammar(learned)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(grammar.evidence(batch.column(0))), batch.column(1)], names=["x", "y"])

    points = rows.mapInArrow(measure, "x double, y int").collect()  # at most 2 * max_labelled pairs of numbers
    x, y = np.log1p([p["x"] for p in points]), np.array([p["y"] for p in points], float)
    weight = np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1))
    design, beta, ridge = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([1e-3, 1e-2]) * weight.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    grammar.offset, grammar.slope = float(beta[0]), float(max(beta[1], 0))
    return grammar


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted (score >= threshold) and evidence of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            x = grammar.evidence(batch.column(text_col))
            s = grammar.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(x)], names=[id_col, "score", "predicted", "evidence"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, evidence double")


def keep_harmless(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            yield batch.filter(pa.array(grammar.score(grammar.evidence(batch.column(text_col))) < threshold))

    return docs.mapInArrow(run, docs.schema)
