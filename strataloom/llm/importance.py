"""Resampling of documents towards a target: array-scored weights and an exact histogram of integer scores.

Features are runs of words, hashed into buckets.  A bucket's gain is the log
ratio of its share in the target to its share in the corpus; a document's weight
is the sum over its features, looked up in one array of the buckets.  With
Gumbel noise from the doc_id added, the highest scores are a weighted sample
without replacement.  Scores are integers, so ranks need no sort of the corpus:
rows are counted by score, suffix sums of the counts say how many rows lie
above each score, and rows are numbered only inside a score that survives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.tokens import slices
from strataloom.session import durable, ship

#: Bits of a score that one step of the suffix sums covers: no task sums more than 2 ** BITS counts, but at the top.
BITS = 10
#: Bytes that words do not have, after A-Z are lowered: all of ASCII but digits and small letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def _table() -> np.ndarray:
    """What CRC-32 makes of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _table()


def _feed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes start..end of each, a byte of all words at a time."""
    state, left, at = state.copy(), np.arange(len(start)), 0
    while len(left := left[end[left] - start[left] > at]):
        s = state[left]
        state[left] = _CRC[(s ^ data[start[left] + at]) & np.uint32(255)] ^ (s >> np.uint32(8))
        at += 1
    return state


def _features(found, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of all runs of 1 to ``longest`` words of a slice."""
    n, doc = len(found.start), found.doc()
    state, first = np.full(n, 0xFFFFFFFF, np.uint32), np.arange(n)
    for more in range(longest):
        first = first[first + more < n]
        first = first[doc[first + more] == doc[first]] if more else first
        state = state[: len(first)] if not more else state[first]
        if more:
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        full = np.zeros(n, np.uint32)
        full[first] = _feed(state, found.data, found.start[first + more], found.end[first + more])
        state = full
        yield ((full[first] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), doc[first]


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in slices(batch.column("text"), lower=True, between=_BETWEEN):
                for bucket, _ in _features(found, longest, buckets):
                    held += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.record_batch({"bucket": pa.array(some), "n": pa.array(held[some])})

    return run


def _weighed(longest: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, found in slices(batch.column("text"), lower=True, between=_BETWEEN):
                words[lo:hi] = found.counts()
                for bucket, doc in _features(found, longest, len(gains)):
                    features[lo:hi] += np.bincount(doc, minlength=hi - lo)
                    sums = np.concatenate([[0], np.cumsum(gains[bucket])])  # doc is sorted
                    bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                    weight[lo:hi] += sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.record_batch([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; each task hands on one row a bucket at most, and the driver gets the buckets."""
    ship(texts.sparkSession)
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    held = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        held[bucket] = n
    return held


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, by bucket."""
    size, total, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (total + size) / ((s + 1.0) * (wanted + size)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Integer Gumbel noise that follows from the doc_id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def above(scores: DataFrame) -> DataFrame:
    """(score, above): for each integer score, the rows with a higher one; suffix sums of an exact histogram.

    A score is read as digits of BITS bits under a first one.  Counts are summed
    up digit by digit, and the sums over what lies above within each digit add up,
    so a task never holds more than 2 ** BITS counts (at the top, the range of
    all scores over 2 ** (2 * BITS)).
    """
    fine = scores.groupBy("score").agg(F.count("*").alias("c"))
    levels = [fine.withColumn("up", F.shiftright("score", BITS))]
    levels.append(levels[-1].groupBy(F.col("up").alias("score")).agg(F.sum("c").alias("c")).withColumn("up", F.shiftright("score", BITS)))
    levels.append(levels[-1].groupBy(F.col("up").alias("score")).agg(F.sum("c").alias("c")).withColumn("up", F.lit(0).cast("long")))
    found = None
    for level in reversed(levels):
        over = Window.partitionBy("up").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        here = level.withColumn("within", F.coalesce(F.sum("c").over(over), F.lit(0)))
        if found is None:
            found = here.select("score", F.col("within").alias("above"))
        else:
            top = found.select(F.col("score").alias("up"), F.col("above").alias("base"))
            found = here.join(top, "up").select("score", (F.col("base") + F.col("within")).alias("above"))
    return found


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words, as like the target as chance allows.

    Returns doc_id, n_words, n_features, weight, score and rank for every row of
    docs (doc_id, text); rank counts the drawn ones from the highest score,
    ties from the smallest doc_id (a null first; repeated rows in either order),
    and is null for the others.  A null text has no words, weight 0 and is never
    drawn; empty tables give no rows, or gains of the corpus alone; other columns
    are left alone.

    All texts are read twice: for the counts of the buckets and for the weights.
    Copies of one text get different noise, so no score holds more than about
    0.04 percent of them, and the numbering inside a score stays small.
    """
    array = gains(counts(docs, longest, buckets), counts(target, longest, buckets))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = thin.mapInArrow(_weighed(longest, array), "doc_id long, n_words long, n_features long, weight long")
    scored = durable(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    offsets = durable(above(able.select("score")).filter(F.col("above") < drawn), "offsets")
    cut = offsets.agg(F.min("score")).first()[0]
    survives = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(cut).cast("long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    ranked = scored.filter(survives).join(offsets, "score").withColumn("rank", F.col("above") + place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~F.coalesce(survives, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
