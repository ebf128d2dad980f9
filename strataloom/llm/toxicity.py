"""Factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the terms i of a
text.  The factors v let two terms together count for more than the sum of
their weights, as an insult next to the name of a group does.  Terms are the
distinct words of letters, lower-cased in ASCII, and their beginnings, hashed
into a fixed number of cells; beginnings catch inflected and compound forms that
the fitting rows do not have.  Only cells that go with the label in the fitting
rows get weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import tokens
from strataloom.session import durable, ship

#: Labelled rows that a fit may collect (those with the smallest hash of doc_id), and cells for terms.
FIT_ROWS = 20_000
CELL_BITS = 20
#: Least G statistic and least number of fitting rows of a cell that gets weights, and most such cells.
LEAST_G, LEAST_ROWS, MOST_CELLS = 12.0, 3, 50_000
#: Lengths in bytes of the beginnings that are terms.
BEGINNINGS = (4, 5, 6)
FACTORS, EPOCHS, BATCH, RATE, DECAY, SHRINK = 4, 8, 256, 0.02, 1e-4, 100.0
THRESHOLD = 0.7


def cells(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, cell, document) of the distinct terms of runs of documents."""
    for lo, hi, words in tokens.slices(column, True, tokens.NO_LETTER):
        doc = words.doc()
        long = [(np.flatnonzero(words.end - words.start > k), k) for k in BEGINNINGS]
        terms = np.concatenate([words.hashes(), *[words.hashes(k)[at] for at, k in long]])
        doc = np.concatenate([doc, *[doc[at] for at, _ in long]])
        cell, doc = tokens.ragged_unique(terms >> np.uint64(64 - CELL_BITS), doc)
        yield lo, hi, cell.astype(np.int64), doc


@dataclass
class Machine:
    """Weights by slot; slot 0 is for cells without weights and stays zero."""

    cell: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def slot(self, cell: np.ndarray) -> np.ndarray:
        if not len(self.cell):
            return np.zeros(len(cell), np.int64)
        at = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
        return np.where(self.cell[at] == cell, at + 1, 0)

    def margin(self, slot: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each document, and the sums of factors that gradients need."""
        line = np.bincount(doc, self.weight[slot], n)
        v = self.factor[slot]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(v.shape[1])], 1)
        squares = np.bincount(doc, (v * v).sum(1), n)
        return self.bias + line + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi, cell, doc in cells(column):
            slot = self.slot(cell)
            out[lo:hi] = sigmoid(self.margin(slot, doc, hi - lo)[0])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def select(cells: DataFrame) -> np.ndarray:
    """The cells that go with the label, in order: rows of (label, cells) are counted where they are.

    The statistic is that of a likelihood ratio test of independence.  At most
    MOST_CELLS cells, those with the largest statistics, come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hits = np.zeros(1 << CELL_BITS, np.int32), np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for label, data in zip(batch.column("label").to_pylist(), batch.column("cells")):
                at = np.frombuffer(data.as_buffer(), "<i4")
                held[at] += 1
                if label:
                    hits[at] += 1
        at = np.flatnonzero(held)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.astype(np.int32), held[some], hits[some])], ["cell", "held", "hits"])

    n, positive = cells.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not positive or positive == n:
        return np.zeros(0, np.int64)
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    held, hits, share = F.col("held"), F.col("hits"), positive / n
    g = 2 * (part(hits, held * share) + part(held - hits, held * (1 - share)) + part(positive - hits, (n - held) * share) + part(n - held - positive + hits, (n - held) * (1 - share)))
    counted = cells.mapInArrow(count, "cell int, held int, hits int").groupBy("cell").agg(F.sum("held").alias("held"), F.sum("hits").alias("hits"))
    # a cell that all rows have tells nothing
    chosen = counted.filter((held >= LEAST_ROWS) & (held < n)).withColumn("g", g).filter(F.col("g") >= LEAST_G)
    return np.sort(np.array([r["cell"] for r in chosen.orderBy(F.desc("g"), "cell").limit(MOST_CELLS).collect()], np.int64))


def fit(rows: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray) -> Machine:
    """Fit to rows of distinct chosen cells with labels 0 or 1, by minibatches with per-weight rates."""
    n = len(rows)
    positive = int(labels.sum())
    if not n or not positive or positive == n:
        p = (positive + 0.5) / (n + 1.0)
        return Machine(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(1), np.zeros((1, FACTORS)))
    share = positive / n
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(7)
    m = Machine(chosen, bias, np.zeros(len(chosen) + 1), rng.normal(0, 0.1, (len(chosen) + 1, FACTORS)))
    m.factor[0] = 0
    slots = [s[s > 0] for s in (m.slot(r) for r in rows)]
    held = sum((np.bincount(s, minlength=len(chosen) + 1) for s in slots), np.zeros(len(chosen) + 1))
    hits = sum((np.bincount(s, minlength=len(chosen) + 1) for s, y in zip(slots, labels) if y), np.zeros(len(chosen) + 1))
    # the start: each term's own log odds, shrunk by how often it was seen, so that one known
    # insult suffices; what terms share is then learned away
    m.weight[1:] = ((np.log((hits + 0.5) / (held - hits + 0.5)) - bias) * held / (held + SHRINK))[1:]
    first = [np.zeros_like(x) for x in (m.weight, m.factor)] + [0.0]
    second = [np.zeros_like(x) for x in (m.weight, m.factor)] + [0.0]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            take = order[at : at + BATCH]
            slot = np.concatenate([slots[i] for i in take])
            mine = np.repeat(np.arange(len(take)), [len(slots[i]) for i in take])
            margin, sums = m.margin(slot, mine, len(take))
            error = sigmoid(margin) - labels[take]
            e = error[mine]
            dw = np.bincount(slot, e, len(m.weight)) / len(take) + DECAY * m.weight
            each = e[:, None] * (sums[mine] - m.factor[slot])
            dv = np.stack([np.bincount(slot, each[:, f], len(m.weight)) for f in range(FACTORS)], 1) / len(take) + DECAY * m.factor
            db = error.mean()
            step += 1
            moves = []
            for k, grad in enumerate((dw, dv, db)):  # steps by running means of gradients and their squares
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                moves.append(RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            m.weight -= moves[0]
            m.factor -= moves[1]
            m.bias -= moves[2]
            m.weight[0], m.factor[0] = 0, 0
    return m


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label")
        for lo, hi, cell, doc in cells(batch.column("text")):
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            held = [cell[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([labels.slice(lo, hi - lo), pa.array(held, pa.binary())], ["label", "cells"])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents.

    A document with several labels has the largest, and of several rows with one
    doc_id the least text is taken, so that copies of rows change nothing; null
    labels, null doc_ids and labels without a document are left out.
    """
    ship(docs.sparkSession)
    taken = (
        labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    cells = durable(found.mapInArrow(_rows, "label int, cells binary"), "cells")
    chosen = select(cells)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.intersect1d(np.frombuffer(c.as_buffer(), "<i4"), chosen).astype("<i4").tobytes() for c in batch.column("cells")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(held, pa.binary())], ["label", "cells"])

    got = cells.mapInArrow(few, cells.schema).orderBy("label", "cells").collect()  # at most ``rows``
    return fit([np.frombuffer(r["cells"], "<i4").astype(np.int64) for r in got], np.array([r["label"] for r in got], float), chosen)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every whole text.

    A null text counts as an empty one, which gets the score of no known term;
    repeated rows are scored each for itself; a null doc_id stays null; an empty
    table gives no rows; columns other than doc_id and text are not used.  The
    machine has at most 2**CELL_BITS cells, whatever the corpus.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = machine.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
