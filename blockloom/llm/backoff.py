"""Operator 3: stupid-backoff language-model scores of documents, from the corpus's own n-gram counts.

The count tables of n-grams of ORDER words and fewer are partitioned by hash range and joined to each chunk's exploded n-grams
(see chunks); a chunk asks for each distinct n-gram once and gets its count over all documents. The score of
a word after its context is count(context word) / count(context) for the longest n-gram that the corpus holds
`min_count` times or more, times BACKOFF for each word of context given up; a single word has its share of all words. A document's
score is the sum of the logarithms of its words' scores.

N-grams never reach over a document's ends. Keys are the top KEY_BITS of 64-bit hashes, unverified: of n distinct n-grams about
n * n / 2 ** (KEY_BITS + 1) pairs have one count together, a hundred or so of five thousand million.

Defined results: texts without words (null and empty ones among them) have n_words 0, log_score 0 and mean_log_score
null; rows with equal doc_id are scored one by one; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, Chunks, deltas, exchange, pack, pack_ids, range_count, ranges, sender, small, unpack, unpack_ids
from .tables import growth
from .text import shingles, words

ORDER = 3
BACKOFF = 0.4
KEY_BITS = 56
#: Words for each key range, times tables.growth.
RANGE_WORDS = 1_500_000


def ngram_keys(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all n-grams and the row offsets."""
    grams, own = shingles(hashes, offsets, n)
    return grams & np.uint64(2**64 - 2 ** (64 - KEY_BITS)), own


def chunk_words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    lengths, dictionary, index = unpack(row["words"])
    return dictionary[index], np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])


def answer(blobs: list[bytes]) -> list[bytes]:
    """Sum the counts of equal keys over all chunks, and tell each chunk the sums of its keys."""
    parts = [unpack(b) for b in blobs]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
    counts = np.concatenate([c.astype(np.int64) for _, c in parts])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    out = np.empty(len(keys), np.int64)
    out[order] = sums[np.cumsum(new) - 1]
    return [pack(small(x)) for x in np.split(out, np.cumsum([len(k) for k, _ in parts])[:-1])]


def log_scores(counts: list[np.ndarray], offsets: np.ndarray, total: int, min_count: int) -> np.ndarray:
    """The logarithm of each word's score. counts[n - 1]: the corpus counts of a chunk's n-grams, in their order."""
    lengths = np.diff(offsets)
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    score = np.log(counts[0] / total) + np.log(BACKOFF) * np.minimum(place, ORDER - 1)
    for n in range(2, ORDER + 1):
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths - n + 1, 0))])
        before = np.concatenate([[0], np.cumsum(np.maximum(lengths - n + 2, 0))])
        some = np.flatnonzero(place >= n - 1)
        own = counts[n - 1][starts[row[some]] + place[some] - n + 1]
        context = counts[n - 2][before[row[some]] + place[some] - n + 1]
        seen = own >= min_count
        some = some[seen]
        score[some] = np.log(own[seen] / context[seen]) + np.log(BACKOFF) * (np.minimum(place[some], ORDER - 1) - n + 1)
    return score


def score_documents(docs: DataFrame, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every whole text."""
    kind = dict(docs.dtypes)[id_col]
    ids_type = pa.string() if kind == "string" else pa.int64()

    def make(batches: list[pa.RecordBatch]) -> dict:
        parts = [words(b.column(1)) for b in batches]
        lengths = np.concatenate([np.diff(o) for _, o in parts])
        dictionary, index = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        ids = pa.chunked_array([b.column(0) for b in batches]).cast(ids_type).combine_chunks()
        return {"words": pack(small(lengths), dictionary, small(index), level=3), "n_words": int(lengths.sum()), "ids": pack_ids(ids)}

    chunks = Chunks(docs, text_col, make, "ids binary, words binary, n_words long", [id_col, text_col])
    total = chunks.total("n_words")
    count = range_count(total, RANGE_WORDS * growth(docs))

    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        hashes, offsets = chunk_words(row)
        for n in range(1, ORDER + 1):
            keys, times = np.unique(ngram_keys(hashes, offsets, n)[0], return_counts=True)
            for b, start, stop in ranges(keys, count):
                yield n * count + b, pack(deltas(keys[start:stop]), small(times[start:stop]))

    answers = exchange(chunks.table.select("chunk", "words").mapInArrow(sender(emit), SENT), answer)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                hashes, offsets = chunk_words(row)
                told: dict[int, list[np.ndarray]] = {n: [] for n in range(1, ORDER + 1)}
                for a in row["answers0"] or []:
                    told[a["bucket"] // count].append(unpack(a["blob"])[0].astype(np.int64))
                keys = [ngram_keys(hashes, offsets, n)[0] for n in range(1, ORDER + 1)]
                counts = [np.concatenate(told[n])[np.unique(x, return_inverse=True)[1]] if len(x) else np.empty(0, np.int64) for n, x in enumerate(keys, 1)]
                sums = np.concatenate([[0.0], np.cumsum(log_scores(counts, offsets, total, min_count))]) if len(hashes) else np.zeros(1)
                lengths = np.diff(offsets)
                scores = sums[offsets[1:]] - sums[offsets[:-1]]
                with np.errstate(invalid="ignore"):
                    mean = pa.array(np.round(scores / lengths, 6), mask=lengths == 0)
                yield pa.RecordBatch.from_arrays([unpack_ids(row["ids"]), pa.array(lengths), pa.array(np.round(scores, 6)), mean], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    out = chunks.with_answers(answers).select("ids", "words", "answers0").mapInArrow(finish, f"doc_id {'string' if kind == 'string' else 'long'}, n_words long, log_score double, mean_log_score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))

