"""Nearest points by blocks of equal count, whatever their density.

Points and references are put in a space-filling order over cells that hold
about as many references along each axis; runs of the order are halved along
their widest axis into blocks of at most BLOCK rows with a box around each.  A
block of points walks down a tree over the blocks of references: the farthest
that anything in the nearest box can be bounds how far its points have to look,
and boxes beyond that are left out.  It meets the SEEDS nearest blocks first; of
the others, only those meet it that are nearer than what its points have then.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.session import discard, durable, ship

#: Rows of a block, cells along each axis (a power of two), how much narrower each level of the tree is (in bits), and nodes of the top one.
BLOCK, CELLS, FAN, TOP = 128, 64, 4, 256
#: Blocks of references that a block of points is compared with before the others.
SEEDS = 8
#: Pairs of blocks that a Python worker is sent at a time (each some 8 kB), and rows it sends back at a time.
PAIRS, FOUND = 256, 65_536
#: Room for rounding in comparisons of bounds.
SLACK = 1 + 1e-9


def _interleaved(splits: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """The place of each point's cell on a Z-shaped curve over the cells between ``splits``."""
    place = np.zeros(len(points), np.int64)
    at = [np.searchsorted(s, points[:, i], "right") for i, s in enumerate(splits)]
    for bit in range(CELLS.bit_length() - 1):
        for i, a in enumerate(at):
            place |= (a >> bit & 1).astype(np.int64) << bit * len(at) + i
    return place


def _halved(points: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in groups of ``most`` (one may be smaller), halved along the widest axis."""
    if len(rows) <= most:
        return [rows]
    here = points[rows]
    left = most * (-(-len(rows) // most) // 2)
    order = np.argpartition(here[:, np.argmax(np.ptp(here, axis=0))], left - 1)
    return _halved(points, rows[order[:left]], most) + _halved(points, rows[order[left:]], most)


def _sides(prefix: str, axes: int) -> tuple[list[str], list[str]]:
    return [f"{prefix}low{i}" for i in range(axes)], [f"{prefix}high{i}" for i in range(axes)]


def _blocks(rows: DataFrame, id_: str, axes: list[str], splits: list[np.ndarray], label: str) -> DataFrame:
    """(part, no, ids, low and high of each axis, points): the rows in order, cut into blocks with rising ids; a table."""
    kind = rows.schema[id_].dataType.simpleString()
    names = [f"__x{i}" for i in range(len(axes))]
    most, (lows, highs) = BLOCK, _sides("", len(axes))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in names], 1)
            yield pa.record_batch([*batch.columns, pa.array(_interleaved(splits, points))], [*batch.schema.names, "__z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            points, ids = np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in names], 1), batch.column("__id")
            place = np.empty(len(points), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(points))
            groups = [rows[np.argsort(place[rows])] for rows in _halved(points, np.arange(len(points)), most)]
            order, ends = np.concatenate(groups), np.cumsum([0, *map(len, groups)])
            points, starts = points[order], ends[:-1]
            low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(order)))
            columns = [pa.array(np.full(len(starts), part, np.int64)), pa.array(no + np.arange(len(starts))), held, *map(pa.array, (*low.T.copy(), *high.T.copy())), pa.array([points[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())]
            no += len(starts)
            yield pa.record_batch(columns, ["part", "no", "ids", *lows, *highs, "points"])

    double = lambda names: ", ".join(f"{n} double" for n in names)
    plain = rows.select(F.col(id_).alias("__id"), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, names)])
    order = ["__z", *names]
    dealt = plain.mapInArrow(placed, f"__id {kind}, {double(names)}, __z long").repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(dealt.mapInArrow(cut, f"part long, no long, ids array<{kind}>, {double([*lows, *highs])}, points binary"), label)


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers are sent at most so many rows at a time by what is written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bounds(axes: int) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance between the boxes of a block of points (p_) and one of references (r_)."""
    sides = [[F.col(c) for c in names] for names in (*_sides("p_", axes), *_sides("r_", axes))]
    ahead, behind = ([high - low for low, high in zip(a, b)] for a, b in ((sides[0], sides[3]), (sides[2], sides[1])))
    squares = lambda v: sum((x * x for x in v), F.lit(0.0))
    return squares(F.greatest(-a, -b, F.lit(0.0)) for a, b in zip(ahead, behind)), squares(F.greatest(a, b) for a, b in zip(ahead, behind))


def _compared(axes: int, carried: tuple[str, ...] = ()):
    """The nearest of the block of references for each point, if it is within ``far``; the first one on ties, so ids rise."""

    def made(found: list[list]) -> pa.RecordBatch:
        keys, refs, far, *others = zip(*found)
        return pa.record_batch([pa.concat_arrays(keys), pa.concat_arrays(refs), pa.array(np.concatenate(far)), *map(pa.concat_arrays, others)], ["key", "ref", "distance", *carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            others = [batch.column(c) for c in carried]
            for at, (mine, theirs, x, y, most) in enumerate(zip(*(batch.column(c) for c in ("ids", "r_ids", "points", "r_points", "far")))):
                a, b = (np.frombuffer(v.as_buffer(), np.float64).reshape(-1, axes).T for v in (x, y))
                d2 = sum((p[:, None] - q) ** 2 for p, q in zip(a, b))
                least = d2.min(axis=1)
                near = d2 <= np.where(least <= most.as_py() * SLACK + 1e-300, least * SLACK, -1.0)[:, None]
                i, j = np.nonzero(near)
                distance = np.sqrt(d2[i, j])
                if len(i) > near.any(axis=1).sum():  # ties are those of distances
                    order = np.lexsort((j, distance, i))
                    order = order[np.unique(i[order], return_index=True)[1]]
                    i, j, distance = i[order], j[order], distance[order]
                if not len(i):
                    continue
                found.append([mine.values.take(pa.array(i)), theirs.values.take(pa.array(j)), distance, *(c.take(pa.array(np.full(len(i), at))) for c in others)])
                held += len(i)
                if held >= FOUND:
                    yield made(found)
                    found, held = [], 0
            if found:
                yield made(found)

    return run


class Index(NamedTuple):
    """Blocks of references, the splits of their order, and the boxes of a tree over them, from its leaves to its top."""

    blocks: DataFrame
    splits: list[np.ndarray]
    levels: list[DataFrame]
    node: Column
    ref: str
    axes: list[str]


def _finite(rows: DataFrame, id_: str, axes: list[str]) -> DataFrame:
    return rows.select(id_, *axes).filter(" and ".join(f"`{a}` is not null and not isnan(`{a}`) and abs(`{a}`) < double('infinity')" for a in axes))


def index(refs: DataFrame, ref: str, axes: list[str]) -> Index | None:
    """What ``search`` looks points up in, until its blocks are discarded; None without refs.  Of refs at one place the smallest is held."""
    ship(refs.sparkSession)
    refs = _finite(refs, ref, axes)
    shares = [(i + 1) / CELLS for i in range(CELLS - 1)]
    ends = refs.agg(*[F.percentile_approx(F.col(a).cast("double"), shares, 1000) for a in axes]).first()
    if ends[0] is None:
        return None
    splits = [np.array(e) for e in ends]
    places = refs.groupBy(*[F.col(a).cast("double").alias(a) for a in axes]).agg(F.min(ref).alias(ref))
    blocks = _blocks(places, ref, axes, splits, "refs")
    wide = (blocks.agg(F.max("no")).first()[0] or 0).bit_length()
    node = F.shiftleft("part", wide) + F.col("no")
    lows, highs = _sides("", len(axes))
    levels = [blocks.select(node.alias("node"), *[F.col(c).alias(f"r_{c}") for c in (*lows, *highs)])]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top >= TOP:
        sides = [f(f"r_{c}").alias(f"r_{c}") for names, f in ((lows, F.min), (highs, F.max)) for c in names]
        levels.append(levels[-1].groupBy(F.shiftright("node", FAN).alias("node")).agg(*sides))
        top >>= FAN
    return Index(blocks, splits, levels, node, ref, axes)


def search(held: Index, points: DataFrame, key: str) -> DataFrame:
    """(key, ref, distance): the nearest row of an index for each point, as ``nearest`` finds it."""
    spark, axes, ref = points.sparkSession, held.axes, held.ref
    points = _finite(points, key, axes)
    types = [points.schema[key].dataType.simpleString(), held.blocks.schema["ids"].dataType.elementType.simpleString()]
    mine = _blocks(points, key, axes, held.splits, "points")
    lows, highs = _sides("", len(axes))
    boxes = [f"p_{c}" for c in (*lows, *highs)]
    block = Window.partitionBy("part", "no")
    near = mine.select("part", "no", *[F.col(c).alias(p) for c, p in zip((*lows, *highs), boxes)]).crossJoin(F.broadcast(held.levels[-1]))  # TOP rows at most
    least, most = _bounds(len(axes))
    for level in [None, *reversed(held.levels[:-1])]:
        if level is not None:
            near = near.select("part", "no", *boxes, F.col("node").alias("up")).join(level.withColumn("up", F.shiftright("node", FAN)), "up").drop("up")
        near = near.withColumns({"least": least, "most": most}).withColumn("far", F.min("most").over(block)).filter(F.col("least") <= F.col("far") * SLACK)
    place = F.row_number().over(block.orderBy("most", "node"))
    near = durable(near.select("part", "no", "node", "least", "far", place.alias("place")), "near")
    theirs = held.blocks.select(held.node.alias("node"), F.col("ids").alias("r_ids"), F.col("points").alias("r_points"))

    def compared(pairs: DataFrame, *carried: str) -> DataFrame:
        pairs = pairs.select("part", "no", "node", "far").join(theirs, "node").join(mine.select("part", "no", "ids", "points"), ["part", "no"])
        names = "".join(f", {c} long" for c in carried)
        return pairs.select(*carried, "ids", "r_ids", "points", "r_points", "far").mapInArrow(_compared(len(axes), carried), f"key {types[0]}, ref {types[1]}, distance double{names}")

    best = lambda met, *by: met.groupBy("key", *by).agg(F.min(F.struct("distance", "ref")).alias("m")).select("key", "m.ref", "m.distance", *by)
    with _batches(spark, PAIRS):
        first = durable(best(compared(near.filter(F.col("place") <= SEEDS), "part", "no"), "part", "no"), "seeds")
        reach = first.groupBy("part", "no").agg((F.max("distance") ** 2).alias("far"))
        left = near.filter(F.col("place") > SEEDS).drop("far").join(reach, ["part", "no"]).filter(F.col("least") <= F.col("far") * SLACK)
        met = best(first.select("key", "ref", "distance").unionByName(compared(left)))
        found = durable(met.select(F.col("key").alias(key), F.col("ref").alias(ref), "distance"), "nearest")
    discard(mine, near, first)
    return found


def nearest(points: DataFrame, refs: DataFrame, key: str, ref: str, axes: list[str]) -> DataFrame:
    """(key, ref, distance): the nearest row of refs for each point; the smaller ref on ties.

    Points and refs with a null or a number that is not finite are left out;
    without refs there are no rows; of rows with one key the nearest counts.  A
    block holds BLOCK rows at most, in a dense place as in an empty one, and one
    far point widens one block and no other.  A worker holds PAIRS pairs of blocks
    and about FOUND results at a time, whatever the rows.
    """
    held = index(refs, ref, axes)
    if held is None:
        types = [rows.schema[c].dataType.simpleString() for rows, c in ((points, key), (refs, ref))]
        return points.sparkSession.createDataFrame([], f"`{key}` {types[0]}, `{ref}` {types[1]}, distance double")
    found = search(held, points, key)
    discard(held.blocks)
    return found
