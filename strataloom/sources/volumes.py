"""NIfTI-1 rasters as a data source of Spark: one partition a slab, and only the slabs that a filter can meet.

    spark.dataSource.register(RasterSource)
    spark.read.format("rasters").load("file:///data").filter("k between 10 and 12")

Headers are read as the first bytes of each file, and a slab of a plain file by
its range of bytes; of a gzipped one what lies before the slab is unpacked and
thrown away.  Files are opened through Arrow's file systems (local and shared
folders, HDFS, object stores), on the driver for their headers and on executors
for their slabs.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from strataloom.session import ship
from strataloom.sources import rasters

SCHEMA = "file string, i int, j int, k int, x double, y double, z double, value double"
#: Bytes that a look at a file's beginning reads at most, packed and unpacked.
HEAD, SLAB = 4096, 8
#: Names of files that belong to no raster.
JUNK = re.compile(r"(^|/)(\._[^/]*|__MACOSX/.*)$")


def _opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def beginning(uri: str) -> tuple[bytes, bool]:
    """The first bytes of a file, unpacked if it is gzipped, and whether it is; at most HEAD bytes are read."""
    system, path = _opened(uri)
    with system.open_input_file(path) as f:
        raw = f.read_at(min(HEAD, f.size()), 0)
    if raw[:2] != b"\x1f\x8b":
        return raw, False
    import zlib

    return zlib.decompressobj(wbits=31).decompress(raw, HEAD), True


def files(uri: str) -> list[str]:
    """Files below a folder, or the one named, without junk, in order."""
    system, path = _opened(uri)
    prefix = uri[: uri.index(path)] if path in uri else ""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [prefix + path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not JUNK.search(f.path))


@dataclass
class Slab(ds.InputPartition):
    """Planes first..last - 1 of the slowest stored axis of a file."""

    file: str
    first: int
    last: int


class RasterReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.planes = options["path"], int(options.get("planes", SLAB))
        self.limits = {"i": [0, None], "j": [0, None], "k": [0, None]}

    def pushFilters(self, filters):
        """Bounds on i, j and k choose slabs; Spark still looks at every row."""
        for f in filters:
            axis = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if axis in self.limits and not isinstance(f, (ds.IsNotNull, ds.IsNull)):
                low, high = self.limits[axis]
                value = getattr(f, "value", None)
                if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)) and isinstance(value, int):
                    bounds = (value, value)
                elif isinstance(f, ds.GreaterThan):
                    bounds = (value + 1, None)
                elif isinstance(f, ds.GreaterThanOrEqual):
                    bounds = (value, None)
                elif isinstance(f, ds.LessThan):
                    bounds = (None, value - 1)
                elif isinstance(f, ds.LessThanOrEqual):
                    bounds = (None, value)
                elif isinstance(f, ds.In) and f.value and all(isinstance(v, int) for v in f.value):
                    bounds = (min(f.value), max(f.value))
                else:
                    bounds = (None, None)
                low = low if bounds[0] is None else max(low, bounds[0])
                high = high if bounds[1] is None else bounds[1] if high is None else min(high, bounds[1])
                self.limits[axis] = [low, high]
            yield f

    def partitions(self):
        found = []
        for name in files(self.path):
            if not re.search(r"\.nii(\.gz)?$", name):
                continue
            try:
                head = rasters.header(beginning(name)[0])
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from e
            axes, back = rasters.axes_of(head.affine)
            world = axes.index(2)  # the axis of the world that the slowest stored axis runs along
            low, high = self.limits["ijk"[world]]
            n = head.dims[2]
            high = n - 1 if high is None else min(high, n - 1)
            first, last = (n - 1 - high, n - 1 - low) if back[world] else (low, high)
            start = first - first % self.planes
            found += [Slab(name, at, min(at + self.planes, n)) for at in range(start, last + 1, self.planes) if first <= last]
        return found or [Slab("", 0, 0)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if not slab.file:
            return
        raw, packed = beginning(slab.file)
        head = rasters.header(raw)
        plane = head.dims[0] * head.dims[1]
        at, size = head.start + slab.first * plane * head.kind.itemsize, (slab.last - slab.first) * plane * head.kind.itemsize
        system, path = _opened(slab.file)
        with system.open_input_file(path) as f:
            if packed:
                with gzip.open(f) as unpacked:
                    left = at
                    while left:  # what lies before is not kept
                        left -= len(unpacked.read(min(left, 1 << 20))) or left
                    data = unpacked.read(size)
            else:
                data = f.read_at(size, at)
        if len(data) < size:
            raise ValueError(f"{slab.file}: {at + len(data)} bytes are too few for {list(head.dims)} cells")
        flat = head.scaled(np.frombuffer(data, head.kind))
        axes, back = rasters.axes_of(head.affine)
        where = np.flatnonzero(flat)
        for lo in range(0, len(where), rasters.BATCH):
            some = where[lo : lo + rasters.BATCH]
            stored = np.stack([some % head.dims[0], some // head.dims[0] % head.dims[1], some // plane + slab.first])
            place = head.affine[:3, :3] @ stored + head.affine[:3, 3:]
            cell = [(head.dims[a] - 1 - stored[a] if r else stored[a]).astype(np.int32) for a, r in zip(axes, back)]
            columns = [pa.array([slab.file] * len(some)), *map(pa.array, cell), *map(pa.array, place), pa.array(flat[some].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "i", "j", "k", "x", "y", "z", "value"])


class RasterSource(ds.DataSource):
    """Cells other than 0 of the rasters below a path: file, i, j, k in RAS order, x, y, z in the world, value."""

    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, with pruning by filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def discovered(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """Files below a path by what their first bytes say: path, kind, side, stem, resolution, dims, bytes_read.

    kind: label (a raster of whole numbers), volume (of others), gzip or other.
    resolution is the mean cell size, with one decimal where that is exact or else
    two; side (l, r) and stem come from the name.  Junk is left out; a header that
    does not parse makes a file of kind gzip or other, not an error.
    """
    ship(spark)
    from strataloom.sources.files import side_and_stem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                raw, packed = beginning(name)
                kind, size, dims = "gzip" if packed else "other", None, None
                try:
                    head = rasters.header(raw)
                    kind = "label" if head.kind.kind in "iu" and head.slope in (0.0, 1.0) else "volume"
                    size, dims = float(np.linalg.norm(head.affine[:3, :3], axis=0).mean()), list(head.dims)
                except ValueError:
                    pass
                rows.append((name, kind, None if not size else f"{size:g}" if abs(size - round(size, 1)) < 1e-3 else f"{size:.2f}", dims, len(raw)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "kind", "resolution", "dims", "bytes_read"])

    listed = spark.createDataFrame([(f,) for f in files(path)], "path string").repartition(partitions)
    found = listed.mapInArrow(run, "path string, kind string, resolution string, dims array<int>, bytes_read int")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(\.nii)?(\.gz)?$|\.[^.]*$", "")
    return found.select("path", "kind", *side_and_stem(name), "resolution", "dims", "bytes_read")
