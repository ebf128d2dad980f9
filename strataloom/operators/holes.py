"""Holes of a set of grid cells, by components within blocks that are merged over the blocks' faces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import graphs
from strataloom.session import discard, durable, ship

#: Cells along each side of a block.
SIDE = 16


def labelled(free: np.ndarray) -> np.ndarray:
    """For each free cell the least place of those that faces join it with, and -1 for the others."""
    label = np.where(free, np.arange(free.size).reshape(free.shape), -1)
    while True:
        new = label.copy()
        for axis in range(free.ndim):
            a, b = (tuple(s if d == axis else slice(None) for d in range(free.ndim)) for s in (slice(1, None), slice(None, -1)))
            both = free[a] & free[b]
            low = np.minimum(new[a], new[b])
            new[a] = np.where(both, low, new[a])
            low = np.minimum(new[a], new[b])
            new[b] = np.where(both, low, new[b])
        flat = new.ravel()
        new = np.where(free, flat[np.maximum(new, 0)], -1)  # the least place that the least place knows
        if (new == label).all():
            return label
        label = new


def _blocks(lo: list[int], size: list[int], side: int):
    """Blocks (block, cells) -> their labels, those on the rim of the box, and the labels on their faces."""
    counts = [math.ceil(n / side) for n in size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rims, lows, highs = [], [], [], []
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                corner = np.array(np.unravel_index(block, counts)) * side
                free = np.ones([side] * len(size), bool)
                if cells:
                    free.ravel()[cells] = False
                for axis, n in enumerate(size):  # what lies beyond the box is none of it
                    free[tuple(slice(max(0, n - corner[axis]), None) if d == axis else slice(None) for d in range(len(size)))] = False
                label = labelled(free).astype(np.int32)
                face = lambda axis, at: label[tuple(at if d == axis else slice(None) for d in range(len(size)))]
                rim = [face(a, 0) for a in range(len(size)) if corner[a] == 0] + [face(a, n - 1 - corner[a]) for a, n in enumerate(size) if corner[a] <= n - 1 < corner[a] + side]
                rims.append(sorted({int(x) for f in rim for x in np.unique(f) if x >= 0}))
                held.append(label.tobytes())
                lows.append([face(a, 0).tobytes() for a in range(len(size))])
                highs.append([face(a, side - 1).tobytes() for a in range(len(size))])
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.record_batch([batch.column("block"), *(pa.array(c, k) for c, k in zip((held, rims, lows, highs), kinds))], ["block", "labels", "rim", "lows", "highs"])

    return run


def _seams(cells: int):
    """Faces that lie against each other -> the labels (as nodes) that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for one, two, high, low in zip(*(batch.column(c).to_pylist() for c in ("block", "next", "high", "low"))):
                x, y = np.frombuffer(high, np.int32).astype(np.int64), np.frombuffer(low, np.int32).astype(np.int64)
                pairs = np.unique(np.stack([x, y])[:, (x >= 0) & (y >= 0)], axis=1)
                a.append(pairs[0] + one * cells)
                b.append(pairs[1] + two * cells)
            yield pa.record_batch({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return run


def _cells(lo: list[int], size: list[int], side: int, axes: list[str]):
    counts = [math.ceil(n / side) for n in size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, labels, wanted in zip(*(batch.column(c).to_pylist() for c in ("block", "labels", "wanted"))):
                corner = np.array(np.unravel_index(block, counts)) * side
                at = np.flatnonzero(np.isin(np.frombuffer(labels, np.int32), wanted))
                places = np.array(np.unravel_index(at, [side] * len(size))) + (corner + np.array(lo))[:, None]
                yield pa.record_batch([pa.array(p) for p in places], axes)

    return run


def enclosed(cells: DataFrame, axes: list[str], side: int = SIDE) -> DataFrame:
    """Cells (axes, as longs) that are not in the set and that no way across faces leads out of its box from.

    The box is one cell wider than the set.  Each block of it is labelled by
    itself; a component is a group of labels that meet on faces, so the rounds
    that join them depend on blocks and not on how many cells wide a hole is.
    Rows with a null are left out, repeated cells count once; without cells there
    are none.
    """
    spark = cells.sparkSession
    ship(spark)
    whole = cells.select(*[F.col(a).cast("long").alias(a) for a in axes]).dropna().distinct()
    ends = whole.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    schema = ", ".join(f"{a} long" for a in axes)
    if ends[0] is None:
        return spark.createDataFrame([], schema)
    lo = [ends[2 * i] - 1 for i in range(len(axes))]
    size = [ends[2 * i + 1] + 2 - lo[i] for i in range(len(axes))]
    counts = [math.ceil(n / side) for n in size]
    strides = [math.prod(counts[i + 1 :]) for i in range(len(axes))]
    inner = [side ** (len(axes) - 1 - i) for i in range(len(axes))]
    from_lo = [F.col(a) - low for a, low in zip(axes, lo)]
    block = sum(F.floor(x / side) * s for x, s in zip(from_lo, strides))
    local = sum(x % side * s for x, s in zip(from_lo, inner))
    held = whole.select(block.alias("block"), local.cast("int").alias("cell")).groupBy("block").agg(F.collect_list("cell").alias("cells"))  # side ** axes at most
    every = spark.range(math.prod(counts)).select(F.col("id").alias("block")).join(held, "block", "left")
    made = durable(every.mapInArrow(_blocks(lo, size, side), "block long, labels binary, rim array<int>, lows array<binary>, highs array<binary>"), "blocks")
    total = side ** len(axes)
    place = [F.floor(F.col("block") / s) % n for s, n in zip(strides, counts)]
    ahead = F.array(*[F.when(p + 1 < n, F.struct(F.lit(i).alias("axis"), (F.col("block") + s).alias("next"), F.col("highs")[i].alias("high"))) for i, (p, n, s) in enumerate(zip(place, counts, strides))])
    high = made.select("block", F.inline(F.filter(ahead, lambda x: x.isNotNull())))
    low = made.select(F.col("block").alias("next"), F.posexplode("lows").alias("axis", "low"))
    seams = durable(high.join(low, ["next", "axis"]).select("block", "next", "high", "low").mapInArrow(_seams(total), "a long, b long"), "seams")
    rim = made.select("block", F.explode("rim").alias("label")).select((F.col("block") * total + F.col("label")).alias("node"))
    nodes = made.mapInArrow(_nodes(total), "node long")
    found = graphs.connected(nodes, seams, "node")
    out = found.join(rim, "node", "left_semi").select("component").distinct()
    inside = found.join(out, "component", "left_anti")
    wanted = inside.groupBy(F.floor(F.col("node") / total).alias("block")).agg(F.collect_list((F.col("node") % total).cast("int")).alias("wanted"))
    result = durable(made.select("block", "labels").join(wanted, "block").mapInArrow(_cells(lo, size, side, axes), schema), "enclosed")
    discard(made, seams)
    return result


def _nodes(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for block, labels in zip(batch.column("block").to_pylist(), batch.column("labels").to_pylist()):
                label = np.unique(np.frombuffer(labels, np.int32)).astype(np.int64)
                found.append(label[label >= 0] + block * cells)
            yield pa.record_batch({"node": pa.array(np.concatenate(found))})

    return run
