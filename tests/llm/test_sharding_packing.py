import zlib
from collections import defaultdict

import pytest

from helpers import SMALL, awkward, frame, table_rows
from strataloom.llm import packing, queries, sharding


def jump_by_hand(key, shards):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def check_shards(rows, n=16):
    slots = defaultdict(list)
    for r in rows:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == jump_by_hand(key, n) and r["grown_shard"] == jump_by_hand(key, n + 1)
        assert r["grown_shard"] in (r["shard"], n)
        slots[r["shard"]].append(r["slot"])
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))


def test_shards(spark):
    rows = queries.op1_sharding(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in table_rows(spark, "documents")}
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "key"
    check_shards(rows)


def test_shards_awkward(spark):
    got = sharding.shard(awkward(spark)).collect()
    assert len(got) == 8
    check_shards(got)
    assert sharding.shard(frame(spark, [])).count() == 0


def rebuilt(rows, texts):
    encode = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids = encode(text or "") + [0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return sum(r["length"] for r in rows) / (1024 * len(windows))


def test_packing(spark):
    texts = {r["doc_id"]: r["text"] for r in table_rows(spark, "documents")}
    assert rebuilt(queries.op6_packing(spark, SMALL).collect(), texts) > 0.97


def test_packing_awkward(spark):
    assert packing.pack(awkward(spark)).filter("doc_id = 4").count() == 2
    rows = packing.pack(frame(spark, [(1, None), (2, ""), (3, "x" * 50000), (None, "null id"), (5, "中文 mixed \U0001f600"), (6, "<|endoftext|>")])).collect()
    rebuilt(rows, {1: None, 2: "", 3: "x" * 50000, None: "null id", 5: "中文 mixed \U0001f600", 6: "<|endoftext|>"})
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("width", [1, 3])
def test_packing_few_windows(spark, width):
    texts = {i: "word " * (37 * i % 900) for i in range(60)}
    rebuilt(packing.pack(frame(spark, list(texts.items())).repartition(3), width=width).collect(), texts)


def test_fast_encoder_agrees():
    """Both encoders give the same ids for every pair of Latin-1 characters in context."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    fast = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    chars = [chr(i) for i in range(256)]
    for a in chars:
        text = "".join(f"{a}{b} {a}x{b}1 {b}{b}{a}" for b in chars)
        assert fast(text) == exact.encode(text, add_special_tokens=False).ids, repr(a)


def test_added_tokens_are_those_of_the_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "<|endoftext|><|endoftext|>中文", "<|endoftext|", "no such token"]
    want = [exact.encode(t, add_special_tokens=False).ids for t in texts]
    encode = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    assert [encode(t) for t in texts] == want and [len(x) for x in want[:2]] == [4, 1]
    rows = packing.pack(frame(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(x) + 1 for i, x in enumerate(want)}
