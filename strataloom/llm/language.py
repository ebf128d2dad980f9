"""Sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of cells.
Inverse document frequencies come from all learning documents; the weights from
a bounded number of them, by follow-the-regularised-leader with elastic-net
penalties, which leaves most weights at zero; a temperature is then fitted on
rows set apart.  Characters that are no letters count as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import tokens
from strataloom.session import ship

#: Learning rows whose texts a fit may use (those with the smallest hash of doc_id), and cells for n-grams.
FIT_ROWS = 6_000
#: Rows of a rare language that are fitted besides.
LEAST = 40
CELL_BITS = 12
CELLS = 1 << CELL_BITS
GRAMS = 3
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 2
UNKNOWN = "und"
DOCS_AT_ONCE = 256


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form or a space, and whether it is a letter."""
    fold = np.full(0x110000, 32, np.uint32)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            fold[i], letter[i] = ord(low) if len(low) == 1 else i, True
    return fold, letter


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, matrix of n-gram counts, whether a document has a letter) for runs of documents."""
    if not len(column):
        return
    fold, letter = _folding()
    data, offsets = tokens.text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, lo + DOCS_AT_ONCE, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + tokens.SLICE_BYTES, "right")) - 1))
        part = data[offsets[lo] : offsets[hi]]
        chars = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        first = begins[offsets[lo : hi + 1] - offsets[lo]]
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        has = np.bincount(doc, letter[chars], hi - lo) > 0
        c = fold[chars].astype(np.uint64)
        if len(c):  # runs of spaces count as one
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (doc[1:] != doc[:-1])
            c, doc = c[keep], doc[keep]
        out = np.zeros((hi - lo) * CELLS)
        got = np.zeros(len(c), np.uint64)
        for g in range(GRAMS):
            if len(c) <= g:
                break
            got = got[: len(c) - g] * np.uint64(0x9E3779B97F4A7C15) + c[g:] + np.uint64(g + 1)
            inside = doc[g:] == doc[: len(c) - g]
            at = (tokens.mix(got) >> np.uint64(64 - CELL_BITS)).astype(np.int64)[inside]
            out += np.bincount(doc[: len(c) - g][inside] * CELLS + at, minlength=len(out))
        yield lo, hi, out.reshape(hi - lo, CELLS), has
        lo = hi


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + ln tf) * idf, of length one."""
    x = np.where(x > 0, 1.0 + np.log(np.maximum(x, 1.0)), 0.0) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weight: np.ndarray
    temperature: float

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        best, score = [UNKNOWN] * len(column), np.zeros(len(column))
        if not self.langs:
            return best, score
        for lo, hi, x, has in counts(column):
            p = softmax(add_one(weighted(x, self.idf)) @ self.weight / self.temperature)
            top = p.argmax(1)
            for i in np.flatnonzero(has):
                best[lo + i], score[lo + i] = self.langs[top[i]], p[i, top[i]]
        return best, score


def add_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, y: np.ndarray, langs: list[str], idf: np.ndarray) -> Model:
    """Follow the regularised leader, a row at a time, then fit the temperature on every fifth row."""
    apart = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    z, n = np.zeros((CELLS + 1, len(langs))), np.zeros((CELLS + 1, len(langs)))

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~apart)):
            at = np.concatenate([np.flatnonzero(x[i]), [CELLS]])
            value = np.concatenate([x[i][at[:-1]], [1.0]])
            w = weights(at)
            p = softmax((value @ w)[None])[0]
            p[y[i]] -= 1.0
            g = value[:, None] * p[None]
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    weight = weights(np.arange(CELLS + 1))
    temperature = 1.0
    if apart.any():
        margin, truth = add_one(x[apart]) @ weight, y[apart]
        loss = lambda t: -np.log(np.maximum(softmax(margin / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        temperature = float(min(np.exp(np.linspace(-3, 2, 101)), key=loss))
    return Model(langs, idf, weight, temperature)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, _, x, _ in counts(batch.column("text")):
            total += (x > 0).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS, dtype=np.int32)), pa.array(total)], ["cell", "n"])


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, x, has in counts(batch.column("text")):
            at = [np.flatnonzero(r).astype("<i4") for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), pa.array(has), pa.array([a.tobytes() for a in at]), pa.array([r[a].astype("<f4").tobytes() for r, a in zip(x, at)])],
                ["doc_id", "lang", "has", "cells", "counts"],
            )


def train(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from documents (doc_id, text, lang); rows with a null text or lang teach nothing.

    Document frequencies are counted over all of them, weights are fitted on at
    most ``rows``, and LEAST more of each language that is too rare to have so
    many among those: every language of the learning rows is learned.
    """
    ship(docs.sparkSession)
    order = [F.xxhash64("doc_id"), "doc_id"]
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text", "lang")
    total = known.count()
    df = np.zeros(CELLS)
    for r in known.select("text").mapInArrow(_frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        df[r["cell"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    taken = known.select("doc_id").orderBy(*order).limit(rows)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    rare = [x for x, n in sizes.items() if n * rows < LEAST * total]
    if rare:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        taken = taken.union(known.filter(F.col("lang").isin(rare)).select("doc_id", "lang", place.alias("i")).filter(F.col("i") <= LEAST).select("doc_id"))
    taken = taken.distinct()
    got = (
        known.join(F.broadcast(taken), "doc_id")
        .mapInArrow(_matrix, "doc_id long, lang string, has boolean, cells binary, counts binary")
        .filter("has")
        .orderBy(*order, "lang", "cells")
        .limit(rows + LEAST * len(rare))
        .collect()
    )
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), CELLS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["cells"], "<i4")] = np.frombuffer(r["counts"], "<f4")
    y = np.array([langs.index(r["lang"]) for r in got], int)
    for at in range(0, len(x), 512):
        x[at : at + 512] = weighted(x[at : at + 512], idf)
    return learn(x, y, langs, idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, the calibrated probability of lang_pred, of every whole text.

    A null text or one without a letter is ``und`` with score 0, as is every
    text if nothing was learned; repeated rows are judged each for itself; a null
    doc_id stays null; an empty table gives no rows; columns other than doc_id
    and text are not used.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
