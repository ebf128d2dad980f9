"""Sequential kernels: best paths, greedy separation, and colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import ship


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """l, a, b of an sRGB colour with parts from 0 to 1, under the D65 white."""
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
    xyz = [sum(m * c for m, c in zip(row, linear)) / row[3] for row in rows]
    x, y, z = (F.when(c > 0.008856, F.cbrt(c)).otherwise(7.787 * c + 16.0 / 116) for c in xyz)
    return [(116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b")]


def separated(least: float):
    """Rows taken (1) if they lie ``least`` or more from all taken before them, else 0."""

    def start():
        held: list[tuple] = []

        def advance(row: dict) -> dict:
            p = (row["l"], row["a"], row["b"])
            ok = all(sum((x - y) ** 2 for x, y in zip(p, q)) >= least * least for q in held)
            if ok:
                held.append(p)
            return {**row, "taken": int(ok)}

        return advance

    return start


def viterbi(rows: DataFrame, key: str, step: str, place: str, score: str, penalty: float, places: int) -> DataFrame:
    """(key, step, place) of the path with the largest sum of scores less ``penalty`` times squared moves.

    Steps of a key come in order; places run from 0; places without a row score
    0; of equal paths the one through smaller places.  A key's steps are held at
    once, its places as one vector a step.
    """
    ship(rows.sparkSession)

    def best(found: list[tuple]) -> list[tuple]:
        steps: dict[int, np.ndarray] = {}
        for s, p, v in found:
            steps.setdefault(s, np.zeros(places))[p] = v
        cost = penalty * (np.arange(places)[:, None] - np.arange(places)[None]) ** 2
        total, back = np.zeros(places), []
        for i, s in enumerate(steps):
            if i:
                reach = total[None] - cost
                back.append(reach.argmax(1))
                total = reach.max(1)
            total = total + steps[s]
        at = int(total.argmax())
        out = [at]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return list(zip(steps, reversed(out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, out = None, [], []

        def flush():
            if held:
                out.extend((known, s, p) for s, p in best(held))
                held.clear()

        for batch in batches:
            for k, s, p, v in zip(*[batch.column(c).to_pylist() for c in (key, step, place, score)]):
                if k != known:
                    flush()
                    known = k
                held.append((s, p, v))
            if len(out) > 4096:
                yield _give(out)
                out = []
        flush()
        yield _give(out)

    def _give(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], [key, step, place])

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_ = rows.select(F.col(key).cast("long"), F.col(step).cast("long"), F.col(place).cast("int"), F.col(score).cast("double")).repartition(count, key).sortWithinPartitions(key, step, place)
    return sorted_.mapInArrow(run, f"{key} long, {step} long, {place} int")


#: Fixed values (inventory row WIN16): least and most gap after a name, in heights of that name.
GAPS = (0.45, 1.75)


def assigned(rows: DataFrame, key: str, place: str, score: str, heights: tuple[float, ...], names: tuple[str, ...], spread: float, most: int | None = None) -> DataFrame:
    """(key, name, place): ``names`` put in order on places from 0 of each key, with the largest total.

    A name earns the score of its place (0 where there is no row); a gap between
    neighbours is in the range GAPS of the height of the first and costs half its
    squared departure from it, in units of ``spread`` times the height.  Places
    end before ``most``, or behind the key's last row, or where the smallest gaps
    need more, there.  Of equal totals the one through smaller places counts.  A
    key is one vector of places; rows before place 0 or without one are left out.
    """
    ship(rows.sparkSession)
    limits = [(int(round(GAPS[0] * h)), int(round(GAPS[1] * h))) for h in heights]

    def best(found: list[tuple]) -> list[int]:
        at, value = (np.array(c) for c in zip(*found))
        size = most or max(int(at.max()), sum(low for low, _ in limits)) + 1
        inside = (at >= 0) & (at < size)
        gain = np.bincount(at[inside].astype(int), value[inside].astype(float), size)
        # row p of a table holds the totals of all places from which a name can be followed by one at p
        ends, chosen = gain, []
        for h, (low, high) in zip(heights, limits):
            table = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(high, -np.inf), ends]), high - low + 1)[:size]
            departure = (np.arange(high, low - 1, -1) - h) / (spread * h)
            worth = table - departure**2 / 2
            column = worth.argmax(axis=1)
            chosen.append(np.arange(size) - high + column)
            ends = np.take_along_axis(worth, column[:, None], axis=1)[:, 0] + gain
        way = [int(ends.argmax())]
        while chosen:
            way.insert(0, int(chosen.pop()[way[0]]))
        return way

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, out = None, [], []

        def flush():
            if held:
                out.extend((known, n, p) for n, p in zip(names, best(held)))
                held.clear()

        for batch in batches:
            for k, p, v in zip(*[batch.column(c).to_pylist() for c in (key, place, score)]):
                if k != known:
                    flush()
                    known = k
                held.append((p, v))
        flush()
        columns = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32()))], [key, "name", place])

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.select(F.col(key).cast("long"), F.col(place).cast("int"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias(score)).filter(F.col(place) >= 0)
    dealt = dealt.repartition(count, key).sortWithinPartitions(key, place)
    return dealt.mapInArrow(run, f"{key} long, name string, {place} int")
