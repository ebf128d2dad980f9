"""Near-duplicate vectors by the epsilon grid order join.

Unit vectors with a cosine of c lie sqrt(2 - 2c) apart; call that epsilon.  A
grid of that edge is laid over the leading principal dimensions and the vectors
are sorted by their cells, so that a stretch of the order (an interval) fills a
small box.  Intervals are joined with each other from the largest down: a pair
whose boxes are further apart than epsilon is skipped whole, one whose balls are
so close that all vectors must be linked is counted whole, and any other is cut
on, between tables of intervals first and inside a task at the end.  What is
left is compared vector by vector in double precision.

Principal axes come from a bounded sample and only decide the order: distances
along orthonormal axes never exceed the distances themselves, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.components import components
from strataloom.session import durable, ship

#: Vectors (those of smallest hash) that the principal axes are taken from, and the axes that the grid has.
SAMPLE, AXES = 2_000, 8
#: Vectors of one interval that a task holds at most, of one row that is moved, and of the smallest interval.
TILE, BLOCK, LEAF = 16_384, 256, 64
#: Intervals that one of the level above is cut into: 2 ** FAN.
FAN = 3
#: Room for rounding in bounds, and the distance from the threshold within which a cosine is computed exactly.
SLACK = 1e-9

_KEYS = ["label", "size"]
_BALL = "low array<double>, high array<double>, centre binary, radius double"


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length of the usable vectors of a list column, scaled by a power of two."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        part = column.take(pa.array(rows))
        values = part.flatten().cast(pa.float64())
        v = values.fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
        top = np.abs(v).max(axis=1)
        ok = np.isfinite(v).all(axis=1) & (top > 0)
        yield size, rows[ok], np.ldexp(v[ok], -np.frexp(top[ok])[1][:, None])


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes of the unit vectors of a bounded sample, by length."""
    some = vectors.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    found = {}
    for size, _, v in _matrix(some):
        u = _units(v)
        _, turned = np.linalg.eigh(np.cov(u.T).reshape(size, size) if len(u) > 1 else np.eye(size))
        found[size] = np.ascontiguousarray(turned[:, ::-1][:, :AXES])
    return found


def _leading(u: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates along the axes; lengths that the sample did not have use their own first dimensions."""
    along = u @ basis[u.shape[1]] if u.shape[1] in basis else u[:, :AXES]
    return np.pad(along, ((0, 0), (0, AXES - along.shape[1])))


def _placed(basis: dict[int, np.ndarray], epsilon: float):
    kinds = {"size": pa.int32(), "cell": pa.list_(pa.int32()), "scaled": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, cell, scaled = [None] * n, [None] * n, [None] * n
            usable = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for length, rows, v in _matrix(batch.column("vector")):
                cells = np.floor(_leading(_units(v), basis) / epsilon).astype(np.int32)
                for r, c, x in zip(rows.tolist(), cells.tolist(), v):
                    if usable[r]:
                        size[r], cell[r], scaled[r] = length, c, x.tobytes()
            more = [pa.array(c, t) for c, t in zip((size, cell, scaled), kinds.values())]
            yield pa.record_batch([batch.column("row"), batch.column("vec_id"), batch.column("label"), *more], ["row", "vec_id", "label", *kinds])

    return run


def _cut(basis: dict[int, np.ndarray]):
    """Blocks of at most BLOCK neighbours of a sorted partition, numbered by tiles of at most TILE."""

    def block(rows: list, part: int, tile: int) -> dict:
        label, size = rows[0][2], rows[0][3]
        v = np.frombuffer(b"".join(r[4] for r in rows), np.float64).reshape(-1, size)
        u = _units(v)
        along, centre = _leading(u, basis), u.mean(axis=0)
        radius = float(np.sqrt(((u - centre) ** 2).sum(axis=1).max()))
        ids = (np.array([r[k] for r in rows], np.int64).tobytes() for k in (0, 1))
        return dict(zip(("rows", "ids"), ids)) | {
            "label": label, "size": size, "part": part, "tile": tile, "n": len(rows), "vectors": v.tobytes(), "least": min(r[1] for r in rows),
            "low": along.min(axis=0).tolist(), "high": along.max(axis=0).tolist(), "centre": centre.tobytes(), "radius": radius,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tile, count, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            made = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "size", "scaled"))):
                other = bool(held) and held[0][2:4] != row[2:4]
                if other or len(held) == BLOCK:
                    made.append(block(held, part, tile))
                    count, held = count + len(held), []
                    if other or count + BLOCK > TILE:
                        tile, count = tile + 1, 0
                held.append(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=_BLOCKS)
        if held:
            yield pa.RecordBatch.from_pylist([block(held, part, tile)], schema=_BLOCKS)

    return run


_BLOCKS = pa.schema(
    [("label", pa.string()), ("size", pa.int32()), ("part", pa.int32()), ("tile", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())]
    + [("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("centre", pa.binary()), ("radius", pa.float64())]
)
_BLOCK_KINDS = f"label string, size int, part int, tile int, n long, least long, rows binary, ids binary, vectors binary, {_BALL}"


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances between the vectors of two binary columns."""
    for batch in batches:
        far = [float(np.sqrt(((np.frombuffer(a) - np.frombuffer(b)) ** 2).sum())) for a, b in zip(batch.column("centre").to_pylist(), batch.column("other").to_pylist())]
        keep = [c for c in batch.schema.names if c not in ("centre", "other")]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(far, pa.float64())], [*keep, "far"])


def distances(pairs: DataFrame) -> DataFrame:
    """pairs with the distance of its columns centre and other, as far, in their place."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("centre", "other"))
    return pairs.mapInArrow(_apart, f"{kinds}, far double")


def _parents(level: DataFrame) -> DataFrame:
    """Intervals of the level above: boxes around the boxes, and balls around the first centre that hold the balls."""
    up = F.shiftright("seq", FAN)
    box = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(AXES)]
    whole = level.groupBy(*_KEYS, up.alias("seq")).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min_by("centre", "seq").alias("other"), *box)
    inner = level.select(*_KEYS, up.alias("seq"), "centre", "radius").join(whole.select(*_KEYS, "seq", "other"), [*_KEYS, "seq"])
    radius = distances(inner).groupBy(*_KEYS, "seq").agg(F.max(F.col("far") + F.col("radius")).alias("radius"))
    sides = [F.array(*[F.col(f"{c}{i}") for i in range(AXES)]).alias(c) for c in ("low", "high")]
    return whole.join(radius, [*_KEYS, "seq"]).select(*_KEYS, "seq", "n", "least", *sides, F.col("other").alias("centre"), "radius")


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    one = F.zip_with(f"{b}_low", f"{a}_high", lambda x, y: x - y)
    two = F.zip_with(f"{a}_low", f"{b}_high", lambda x, y: x - y)
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)


def interval_pairs(tiles: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of tiles to be compared, pairs of intervals of which all vectors are linked).

    tiles: label, size, seq, n, least and their boxes and balls.  Both have the
    keys, a and b (a <= b, places in the order); the second also the level, the
    rows and the least id of each side.
    """
    levels = [tiles]
    top = tiles.agg(F.max("seq")).first()[0] or 0
    while top:
        levels.append(durable(_parents(levels[-1]), "intervals"))
        top >>= FAN
    columns = ["seq", "n", "least", "low", "high", "centre", "radius"]
    named = lambda level, side: level.select(*_KEYS, *[F.col(c).alias(f"{side}_{c}") for c in columns])
    pairs = levels[-1].select(*_KEYS, F.col("seq").alias("a"), F.col("seq").alias("b"))
    linked = []
    for k in range(len(levels) - 1, -1, -1):
        one, two = named(levels[k], "a"), named(levels[k], "b")
        if k == len(levels) - 1:
            met = pairs.join(one, _KEYS).filter("a = a_seq").join(two, _KEYS).filter("b = b_seq")
        else:  # the children of each side
            met = pairs.join(one.withColumn("a", F.shiftright("a_seq", FAN)), [*_KEYS, "a"]).join(two.withColumn("b", F.shiftright("b_seq", FAN)), [*_KEYS, "b"])
        near = met.filter((F.col("a_seq") <= F.col("b_seq")) & (_gap("a", "b") <= epsilon**2 + SLACK))
        told = near.select(*_KEYS, F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), "a_n", "b_n", "a_least", "b_least", (F.col("a_radius") + F.col("b_radius")).alias("wide"), F.col("a_centre").alias("centre"), F.col("b_centre").alias("other"))
        found = durable(distances(told).withColumn("all", F.col("far") + F.col("wide") <= epsilon - SLACK), "pairs")
        linked.append(found.filter("all").withColumn("level", F.lit(k)))
        pairs = found.filter("not all").select(*_KEYS, "a", "b")
    return pairs, reduce(DataFrame.unionByName, linked)


class _Tree:
    """Boxes and balls of the dyadic intervals of one tile, from its leaves up."""

    def __init__(self, u: np.ndarray, along: np.ndarray):
        starts = np.arange(0, len(u), LEAF)
        self.bounds = np.append(starts, len(u))
        sizes = np.diff(self.bounds)
        centre = np.add.reduceat(u, starts) / sizes[:, None]
        spread = ((u - np.repeat(centre, sizes, axis=0)) ** 2).sum(axis=1)
        self.levels = [(np.minimum.reduceat(along, starts), np.maximum.reduceat(along, starts), centre, np.sqrt(np.maximum.reduceat(spread, starts)))]
        while len(self.levels[-1][0]) > 1:
            low, high, centre, radius = self.levels[-1]
            pairs = np.arange(0, len(low), 2)
            middle = centre[pairs]
            reach = np.sqrt(((centre - np.repeat(middle, 2, axis=0)[: len(centre)]) ** 2).sum(axis=1)) + radius
            self.levels.append((np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs), middle, np.maximum.reduceat(reach, pairs)))

    def span(self, level: int, i: int) -> tuple[int, int]:
        return int(self.bounds[min(i << level, len(self.bounds) - 1)]), int(self.bounds[min((i + 1) << level, len(self.bounds) - 1)])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one reachable over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def compare(x: np.ndarray, y: np.ndarray | None, basis: dict[int, np.ndarray], at_least: float) -> tuple[np.ndarray, np.ndarray, dict]:
    """Links between the rows of x and y (y None: within x): counts of all rows, the smallest row reachable, and how pairs were met.

    Both trees are walked down together, a level at a time.
    """
    epsilon, own = math.sqrt(2 - 2 * at_least), y is None
    u = _units(x)
    w = u if own else _units(y)
    tree = _Tree(u, _leading(u, basis))
    other = tree if own else _Tree(w, _leading(w, basis))
    shift = 0 if own else len(u)
    counts, ones, twos = np.zeros(shift + len(w), np.int64), [], []
    tally = {"skipped": 0, "whole": 0, "compared": 0}
    level = max(len(tree.levels), len(other.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        la, lb = min(level, len(tree.levels) - 1), min(level, len(other.levels) - 1)
        low, high, centre, radius = tree.levels[la]
        low2, high2, centre2, radius2 = other.levels[lb]
        gap = np.maximum(np.maximum(low2[j] - high[i], low[i] - high2[j]), 0)
        near = (gap * gap).sum(axis=1) <= epsilon * epsilon + SLACK
        tally["skipped"] += int((~near).sum())
        i, j = i[near], j[near]
        sure = np.sqrt(((centre[i] - centre2[j]) ** 2).sum(axis=1)) + radius[i] + radius2[j] <= epsilon - SLACK
        for p, q in zip(i[sure].tolist(), j[sure].tolist()):
            (a, b), (c, d) = tree.span(la, p), other.span(lb, q)
            tally["whole"] += 1
            if own and p == q:
                counts[a:b] += b - a - 1
            else:
                counts[a:b] += d - c
                counts[shift + c : shift + d] += b - a
            nodes = np.concatenate([np.arange(a, b), shift + np.arange(c, d)])
            ones.append(nodes)
            twos.append(np.full(len(nodes), a))
        i, j = i[~sure], j[~sure]
        if level == 0 or not len(i):
            break
        level -= 1
        la, lb = la - (la > level), lb - (lb > level)
        halves = lambda v, of: v[:, None] * 2 + [0, 1] if len(of.levels) - 1 > level else v[:, None]
        ci, cj = halves(i, tree), halves(j, other)
        i, j = np.repeat(ci, cj.shape[1], axis=1).ravel(), np.tile(cj, (1, ci.shape[1])).ravel()
        ok = (i < len(tree.levels[la][0])) & (j < len(other.levels[lb][0]))
        if own:
            ok &= i <= j
        i, j = i[ok], j[ok]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    for p in np.unique(i).tolist():
        a, b = tree.span(0, p)
        cols = np.concatenate([np.arange(*other.span(0, q)) for q in j[i == p].tolist()])
        cosine = u[a:b] @ w[cols].T
        tally["compared"] += cosine.size
        hit = cosine >= at_least
        for r, c in np.argwhere(np.abs(cosine - at_least) < SLACK).tolist():
            hit[r, c] = _exact(x[a + r], (x if own else y)[cols[c]]) >= at_least
        if own:  # pairs of a leaf with itself once, and no vector with itself
            hit &= np.arange(a, b)[:, None] < cols[None, :]
        r, c = np.nonzero(hit)
        counts[a:b] += hit.sum(axis=1)
        np.add.at(counts, shift + cols, hit.sum(axis=0))
        ones.append(a + r)
        twos.append(shift + cols[c])
        if sum(map(len, ones)) > 1 << 20:  # keep one link to each node's smallest
            label = forest(np.concatenate(ones), np.concatenate(twos), len(counts))
            some = np.flatnonzero(label != np.arange(len(label)))
            ones, twos = [some], [label[some]]
    none = np.zeros(0, np.int64)
    return counts, forest(np.concatenate([none, *ones]), np.concatenate([none, *twos]), len(counts)), tally


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    dot = lambda a, b: math.fsum((a * b).tolist())
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))


_FOUND = "row long, vec_id long, n long, root long"


def _compared(basis: dict[int, np.ndarray], at_least: float):
    def run(group: pa.Table) -> pa.Table:
        sides = []
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        group = group.to_pylist()
        for tile in dict.fromkeys((a, b)):
            mine = [r for r in group if r["tile_seq"] == tile]
            read = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in mine])
            sides.append((read("rows", np.int64), read("ids", np.int64), read("vectors", np.float64).reshape(-1, mine[0]["size"])))
        rows, ids = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
        counts, label, _ = compare(sides[0][2], sides[1][2] if len(sides) > 1 else None, basis, at_least)
        some = np.flatnonzero(counts)
        return pa.table([pa.array(v[some]) for v in (rows, ids, counts, ids[label])], ["row", "vec_id", "n", "root"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks with what intervals around them add."""
    for batch in batches:
        for rows, ids, n, root in zip(*(batch.column(c).to_pylist() for c in ("rows", "ids", "n", "root"))):
            row = np.frombuffer(rows, np.int64)
            yield pa.record_batch([pa.array(row), pa.array(np.frombuffer(ids, np.int64)), pa.array(np.full(len(row), n)), pa.array(np.full(len(row), root))], ["row", "vec_id", "n", "root"])


def near(vectors: DataFrame, at_least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id and kept.

    Two rows with equal labels, neither null, are linked if the cosine of their
    vectors is ``at_least`` or more; n_links counts a row's links and component_id
    is the smallest vec_id that links reach, itself included.  kept: the vec_id is
    its own component_id.  Vectors that are null, empty or all zero, that hold a
    null or a number that is not finite, of different lengths, or with a null
    label or vec_id are linked with nothing (a null vec_id has a null component
    and is not kept).  Rows that repeat a vec_id are vectors of their own in one
    component.  Other columns are left alone; an empty table gives no rows.

    The sorted vectors are cut into tiles; tables of intervals say which pairs of
    tiles can hold links, and each such pair is one group.  A tile holds at most
    TILE rows whatever its label or cell, and a pair passes on a count and a root
    for each vector, never its links.
    """
    if not 0 < at_least < 1:
        raise ValueError("at_least lies between 0 and 1")
    spark = vectors.sparkSession
    ship(spark)
    epsilon = math.sqrt(2 - 2 * at_least)
    thin = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    basis = axes(thin.filter(F.col("vector").isNotNull()))
    marked = durable(thin.mapInArrow(_placed(basis, epsilon), "row long, vec_id long, label string, size int, cell array<int>, scaled binary"), "placed")
    usable = marked.filter(F.col("scaled").isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(usable.count() / (4 * TILE)))
    keys = [*_KEYS, "cell", "vec_id", "row"]
    ordered = usable.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("row", "vec_id", *_KEYS, "scaled")
    cut = durable(ordered.mapInArrow(_cut(basis), _BLOCK_KINDS), "blocks")
    box = [F.array(*[f(F.col(c)[i]) for i in range(AXES)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    inside = [F.max_by("centre", "n").alias("other"), F.sum("n").alias("n"), F.min("least").alias("least"), *box]
    held = cut.groupBy(*_KEYS, "part", "tile").agg(*inside)
    reach = distances(cut.select(*_KEYS, "part", "tile", "centre", "radius").join(held.select(*_KEYS, "part", "tile", "other"), [*_KEYS, "part", "tile"]))
    balls = reach.groupBy(*_KEYS, "part", "tile").agg(F.max(F.col("far") + F.col("radius")).alias("radius"))
    seq = (F.row_number().over(Window.partitionBy(*_KEYS).orderBy("part", "tile")) - 1).cast("long")  # rows for tiles, not vectors
    tiles = durable(held.withColumn("seq", seq).join(balls, [*_KEYS, "part", "tile"]).withColumnRenamed("other", "centre"), "tiles")
    pairs, whole = interval_pairs(tiles.drop("part", "tile"), epsilon)
    blocks = cut.join(tiles.select(*_KEYS, "part", "tile", "seq"), [*_KEYS, "part", "tile"])
    sides = pairs.select(*_KEYS, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile_seq"))
    moved = blocks.select(*_KEYS, F.col("seq").alias("tile_seq"), "rows", "ids", "vectors").join(sides, [*_KEYS, "tile_seq"])
    compared = moved.groupBy(*_KEYS, "a", "b").applyInArrow(_compared(basis, at_least), _FOUND)
    # what pairs of intervals add to each row of either side, and one vector that all of them reach
    root = F.least("a_least", "b_least")
    one = whole.select(*_KEYS, "level", F.col("a").alias("node"), F.when(F.col("a") == F.col("b"), F.col("b_n") - 1).otherwise(F.col("b_n")).alias("n"), root.alias("root"))
    two = whole.filter("a < b").select(*_KEYS, "level", F.col("b").alias("node"), F.col("a_n").alias("n"), root.alias("root"))
    added = one.unionByName(two)
    top = (added.agg(F.max("level")).first()[0] or 0) + 1
    ladder = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("seq", FAN * k).alias("node")) for k in range(top)]))
    given = blocks.select(*_KEYS, "seq", "rows", "ids").withColumn("up", ladder).select(*_KEYS, "rows", "ids", "up.*")
    sums = added.groupBy(*_KEYS, "level", "node").agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    credits = given.join(sums, [*_KEYS, "level", "node"]).filter("n > 0").select("rows", "ids", "n", "root").mapInArrow(_opened, _FOUND)
    links = durable(compared.unionByName(credits), "found")
    ends = whole.filter("a < b").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
    joined = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(ends).distinct())
    counts = links.groupBy("row").agg(F.sum("n").alias("n_links"))
    found = marked.select("row", "vec_id").join(counts, "row", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
