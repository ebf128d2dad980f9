"""Bounded-space online packing of token streams into fixed windows.

Every partition keeps a fixed number of open windows.  A document is cut into
full windows and a remainder; the remainder goes into the open window that it
fills best; when none has room, the fullest open window is emitted and an empty
one takes its place.  What is open when a partition ends is merged: groups of
partitions repack their left pieces in the same way, cutting pieces where that
fills a window to the last token.

The pieces are written to the shared folder before the merge, so texts are
tokenised once and a lost executor cannot change a decision already used.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import durable, ship

WINDOW = 1024
OPEN_WINDOWS = 64
#: Partitions whose left windows one task merges; they hold at most OPEN_WINDOWS windows each.
MERGE = 4
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, seq long, offset long, left boolean, ids binary"


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(exact: str, ranks: str):
    """text -> ids of the tokenizer file ``exact``.

    ``ranks`` is the same vocabulary for a faster byte-pair encoder; it serves
    texts of Latin-1 characters, on which both are tested to agree character
    class by character class.  All other texts, and those that hold an added
    token of the file, which is one id, go through the tokenizer file.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary_path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    whole = Tokenizer.from_file(vocabulary_path(exact))
    added = [x.content for x in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole.encode(text, add_special_tokens=False).ids
        if any(x in text for x in added):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Packer:
    """Open windows of one partition; ``place`` returns (sequence, offset) of a piece."""

    def __init__(self, window: int, width: int):
        self.window, self.width = window, width
        self.fill: dict[int, int] = {}
        self.by_fill: dict[int, list[int]] = {}
        self.next = 0

    def _put(self, seq: int, fill: int) -> None:
        if fill < self.window:
            self.fill[seq] = fill
            self.by_fill.setdefault(fill, []).append(seq)

    def _take(self, fill: int) -> int:
        held = self.by_fill[fill]
        seq = held.pop()
        if not held:
            del self.by_fill[fill]
        del self.fill[seq]
        return seq

    def room(self) -> int:
        """The largest free space of an open window, 0 without one."""
        return self.window - min(self.by_fill) if self.by_fill else 0

    def place(self, size: int) -> tuple[int, int]:
        fits = [f for f in self.by_fill if f + size <= self.window]
        if fits:
            fill = max(fits)
            seq = self._take(fill)
        else:
            if len(self.fill) >= self.width:
                self._take(max(self.by_fill))  # emitted: nothing more goes into it
            seq, fill, self.next = self.next, 0, self.next + 1
        self._put(seq, fill + size)
        return seq, fill

    def open(self) -> set[int]:
        return set(self.fill)


def _pack(exact: str, ranks: str, window: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(exact, ranks), Packer(window, width), []
        part = None
        waiting: dict[int, list] = {}  # pieces in open windows, by sequence

        def give(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            part = batch.column("part")[0].as_py() if batch.num_rows and part is None else part
            for doc, text in zip(ids_of, batch.column("text")):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                ids = np.asarray(ids, "<u4")
                total = len(ids)
                for start in range(0, total, window):
                    piece = ids[start : start + window].tobytes()
                    size = len(piece) // 4
                    seq, offset = packer.place(size)
                    row = [doc, start, size, zlib.crc32(piece), total, part, seq, offset, False, None]
                    if seq in packer.fill:
                        waiting.setdefault(seq, []).append((row, piece))
                    else:
                        rows.append(row)
                        rows.extend(r for r, _ in waiting.pop(seq, ()))
                if len(waiting) > width:
                    for seq in [s for s in waiting if s not in packer.fill]:
                        rows.extend(r for r, _ in waiting.pop(seq))
            if len(rows) >= 4096:
                yield give(rows)
                rows = []
        for seq, held in waiting.items():
            still = seq in packer.fill
            for row, piece in held:
                rows.append([*row[:8], still, piece if still else None])
        yield give(rows)

    return run


def _merge(window: int):
    """Repack the pieces of open windows: fill each window to its last token, cutting where needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # at most MERGE * OPEN_WINDOWS windows of ids
        rows, seq, offset = [], 0, 0
        order = np.lexsort((table.column("start").to_numpy(), table.column("seq").to_numpy(), table.column("part").to_numpy())) if table.num_rows else []
        found = table.to_pylist()
        for i in order:
            x = found[i]
            ids, start = x["ids"], x["start"]
            while ids:
                room = window - offset
                piece, ids = ids[: 4 * room], ids[4 * room :]
                size = len(piece) // 4
                rows.append((x["doc_id"], start, size, zlib.crc32(piece), x["doc_tokens"], x["group"], seq, offset))
                start, offset = start + size, offset + size
                if offset == window:
                    seq, offset = seq + 1, 0
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset"])

    return run


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    width: int = OPEN_WINDOWS,
    exact: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A null text is an empty one and still has its end id;
    repeated rows are packed as often as they stand; a null doc_id stays null;
    an empty table gives no rows; other columns are not used.  Sequences are
    padded to ``window`` by whoever writes them, unless their length is a power
    of two.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    pieces = durable(plain.mapInArrow(_pack(exact, ranks, window, width), PIECES), "pieces")
    number = lambda part, seq: (part.cast("long") * F.lit(1 << 32) + seq)
    done = pieces.filter(~F.col("left")).withColumn("sequence_id", number(F.col("part"), F.col("seq")))
    left = pieces.filter(F.col("left")).withColumn("group", F.floor(F.col("part") / MERGE).cast("int"))
    merged = (
        left.select("doc_id", "start", "doc_tokens", "part", "seq", "ids", "group")
        .groupBy("group")
        .applyInArrow(lambda t: pa.Table.from_batches(_merge(window)(iter(t.to_batches()))), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, seq long, offset long")
        .withColumn("sequence_id", number(F.col("part") + F.lit(1 << 30), F.col("seq")))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return done.select(*columns).unionByName(merged.select(*columns))
