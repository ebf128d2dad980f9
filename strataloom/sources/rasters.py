"""Reader of rasters in NIfTI-1 files (one file, plain or gzipped), as rows of voxels in RAS order."""

from __future__ import annotations

import gzip
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The format's codes of data types, and the places of its header fields.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER_BYTES, DIM, DATATYPE, PIXDIM, OFFSET, SLOPE, QFORM, QUATERNION, SROWS, MAGIC = 348, 40, 70, 76, 108, 112, 252, 256, 280, 344
#: Voxels of an output batch.
BATCH = 1 << 18


@dataclass(frozen=True)
class Header:
    """What the first bytes of a file say: cells along each axis, their type and first byte, scaling, matrix to the world."""

    dims: tuple[int, int, int]
    kind: np.dtype
    start: int
    slope: float
    shift: float
    affine: np.ndarray

    def scaled(self, stored: np.ndarray) -> np.ndarray:
        if self.slope and np.isfinite(self.slope) and (self.slope, self.shift) != (1.0, 0.0):
            return stored * self.slope + (self.shift if np.isfinite(self.shift) else 0.0)
        return stored


def header(raw: bytes, affine: np.ndarray | None = None) -> Header:
    """The header in the first HEADER_BYTES of a file; ``affine`` stands in for a broken one."""
    if len(raw) < HEADER_BYTES or raw[MAGIC : MAGIC + 3] != b"n+1":
        raise ValueError("not a NIfTI-1 file")
    order = "<" if int.from_bytes(raw[:4], "little") == HEADER_BYTES else ">"
    field = lambda at, kind, n=1: np.frombuffer(raw, order + kind, n, at)
    rank, *sides = (int(x) for x in field(DIM, "i2", 8))
    dims = [max(x, 1) for x in sides[:rank]] + [1] * (3 - rank)
    code = int(field(DATATYPE, "i2")[0])
    if code not in TYPES or any(x != 1 for x in dims[3:]):
        raise ValueError(f"data type {code} of {dims} cells is not a scalar raster")
    slope, shift = (float(x) for x in field(SLOPE, "f4", 2))
    matrix = _matrix(field, dims) if affine is None else np.asarray(affine, float)
    return Header(tuple(dims[:3]), np.dtype(TYPES[code]).newbyteorder(order), int(field(OFFSET, "f4")[0]), slope, shift, matrix)


def decoded(content: bytes, affine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(voxels by i, j, k, matrix from voxel to world) of a file; ``affine`` stands in for a broken one of the header."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    head = header(raw, affine)
    size = int(np.prod(head.dims))
    if len(raw) < head.start + size * head.kind.itemsize:
        raise ValueError(f"{len(raw)} bytes are too few for {list(head.dims)} cells")
    voxels = np.frombuffer(raw, head.kind, size, head.start).reshape(head.dims, order="F")
    return head.scaled(voxels), head.affine


def _matrix(field, dims: list[int]) -> np.ndarray:
    """The stored rows if there are any, else the rotation, else the cell sizes around the middle with x reversed."""
    out = np.eye(4)
    by_rotation, by_rows = (int(x) for x in field(QFORM, "i2", 2))
    turn, *size = (float(x) for x in field(PIXDIM, "f4", 4))
    if by_rows > 0:
        out[:3] = field(SROWS, "f4", 12).reshape(3, 4)
    elif by_rotation > 0:
        b, c, d, *shift = (float(x) for x in field(QUATERNION, "f4", 6))
        v = np.array([b, c, d])
        a = np.sqrt(max(0.0, 1.0 - v @ v))
        cross = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])
        rotation = (a * a - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * a * cross
        out[:3, :3] = rotation * [size[0], size[1], size[2] * (-1.0 if turn < 0 else 1.0)]
        out[:3, 3] = shift
    else:
        scale = np.array([-size[0], size[1], size[2]])
        out[:3, :3] = np.diag(scale)
        out[:3, 3] = -scale * (np.array(dims[:3]) - 1) / 2
    return out


def axes_of(affine: np.ndarray) -> tuple[tuple[int, int, int], tuple[bool, bool, bool]]:
    """The stored axis that runs along each axis of the world, and whether it runs back, as nearly as can be."""
    lengths = np.linalg.norm(affine[:3, :3], axis=0)
    u, _, vt = np.linalg.svd(affine[:3, :3] / np.where(lengths > 0, lengths, 1.0))
    near = u @ vt  # the rotation closest to the matrix
    axes = max(itertools.permutations(range(3)), key=lambda p: sum(abs(near[w, a]) for w, a in enumerate(p)))
    return axes, tuple(bool(near[w, a] < 0) for w, a in enumerate(axes))


def canonical(voxels: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The raster with axes swapped and reversed so that they run right, anterior and superior as nearly as can be."""
    axes, back = axes_of(affine)
    out, move = voxels.transpose(axes), np.zeros((4, 4))
    move[3, 3] = 1.0
    for world, axis in enumerate(axes):
        move[axis, world], move[axis, 3] = (-1.0, voxels.shape[axis] - 1) if back[world] else (1.0, 0.0)
        if back[world]:
            out = np.flip(out, world)
    return out, affine @ move


def nifti(spark: SparkSession, path: str, affine: list[list[float]] | None = None, dtype: str | None = None) -> DataFrame:
    """Cells other than 0 of the files below path: file, i, j, k in RAS order, x, y, z in the world, value.

    ``dtype`` casts the values.  A file is decoded in one task and its cells leave
    in batches; one that is no raster is an error that names it; cells that are
    not a number are kept.
    """
    fixed = None if affine is None else np.array(affine, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    voxels, matrix = canonical(*decoded(content.as_py(), fixed))
                except (ValueError, OSError, EOFError) as e:
                    raise ValueError(f"{name}: {e}") from e
                flat = (voxels if dtype is None else voxels.astype(dtype)).ravel(order="F")
                at = np.flatnonzero(flat)
                for lo in range(0, len(at), BATCH):
                    some = at[lo : lo + BATCH]
                    cell = np.stack(np.unravel_index(some, voxels.shape, order="F"))
                    world = matrix[:3, :3] @ cell + matrix[:3, 3:]
                    arrays = [pa.array([name] * len(some)), *[pa.array(c.astype(np.int32)) for c in cell], *[pa.array(w) for w in world], pa.array(flat[some].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["file", "i", "j", "k", "x", "y", "z", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "file string, i int, j int, k int, x double, y double, z double, value double")
