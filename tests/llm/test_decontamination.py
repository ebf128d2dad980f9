import math
import random
from collections import Counter

from helpers import SMALL, WORD, awkward, frame, table_rows
from strataloom.llm import decontamination as D
from strataloom.llm import queries


def bag(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def low(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, least=0.8):
    """The best similarity of each (document, item) over all windows of the item's length, without fingerprints."""
    bags, seen = {}, set()
    for i, t in sorted(items):
        if t not in seen and bag(low(t)):
            seen.add(t)
            bags[i] = (len(low(t)), bag(low(t)))
    df = Counter(s for _, b in bags.values() for s in b)
    n = len(bags)
    weight = lambda s: math.log1p(n / df[s]) / math.log1p(n) if s in df else 1.0
    out = {}
    for d, t in docs:
        words = low(t)
        have = set(bag(words))
        for i, (size, b) in bags.items():
            if not have & set(b):
                continue
            span = min(size, len(words))
            for s in range(len(words) - span + 1):
                got = D.weighted_jaccard(bag(words[s : s + span]), b, weight)
                if got >= least - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), got)
    return out


def test_against_all_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in table_rows(spark, "documents")]
    items = [(r["item_id"], r["text"]) for r in table_rows(spark, "benchmark")]
    want = by_hand(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op7_decontamination(spark, SMALL).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_recall_on_edited_passages(spark):
    """Passages with words changed, dropped or added: every window at 0.8 or more is found, and nothing else."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))) for i in range(60)] + [(99, "one two"), (98, None), (97, "  ")]
    docs = []
    for d in range(400):
        words = items[d % 60][1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randrange(60))] for _ in range(2))
        docs.append((d, " ".join(before + words + after)))
    docs += [(1000, "one TWO"), (1001, "one two three")]
    want = by_hand(docs, [(i, t) for i, t in items])
    index = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame(spark, docs), index).collect()}
    assert got <= want.keys() and len(got) >= 0.99 * len(want) and (1000, 99) in got


def test_blocks_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "INDEX_BYTES", 40)
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j k l m n o p q"), (3, "a b c d e f g h"), (None, None)], "item_id long, text string")
    docs = awkward(spark, [(10, "x a b c d e f g h y"), (11, "i j k l m n o p q")])
    assert len(D.blocks_of(items)) == 1 and {(r[0], r[1]) for r in D.leaks(docs, items).collect()} == {(10, 1), (11, 2)}
    monkeypatch.setattr(D, "INDEX_BYTES", 10)
    assert len(D.blocks_of(items)) == 2 and {(r[0], r[1]) for r in D.leaks(docs, items).collect()} == {(10, 1), (11, 2)}
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6]
    assert D.leaks(frame(spark, []), items).count() == 0
    assert D.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_blocks_reach_the_radius():
    rng = random.Random(2)
    index = D.Index.of([(i, " ".join(f"q{rng.randrange(999)}" for _ in range(12))) for i in range(50)], {})
    for _ in range(300):
        p = int(index.prints[rng.randrange(50)])
        for bit in rng.sample(range(64), rng.randrange(30)):
            p ^= 1 << bit
        want = sorted((d, i) for i in range(50) if (d := (p ^ int(index.prints[i])).bit_count()) <= D.RADIUS)
        assert index.near(p) == want


def test_cuts_of_the_benchmark_change_nothing(spark, monkeypatch):
    """Weights are counted over all items, so any cut into blocks finds the same rows; and all ids of a text are reported."""
    rng = random.Random(6)
    shared = " ".join(f"c{i}" for i in range(12))
    items = [(i, " ".join([shared, *(f"v{rng.randrange(60)}" for _ in range(rng.randrange(4, 30)))])) for i in range(40)]
    items += [(100 + i, t) for i, t in items[:5]]
    docs = []
    for d in range(40):
        words = items[d][1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((d, " ".join(["before", *words, "after"])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = by_hand(docs, items)
    for size in (1 << 20, 900, 1):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.leaks(frame(spark, docs), benchmark).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(D, "INDEX_BYTES", 900)
    every = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame(spark, docs), benchmark, every_id=True).collect()}
    assert every == want.keys() | {(d, 100 + i) for d, i in want if i < 5}


def test_recall_at_the_limit(spark):
    """Windows whose similarity is just above the limit: at least 0.95 of them are found, and nothing below it."""
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60)))) for i in range(80)]
    docs = []
    for d in range(1600):
        words = items[d % 80][1].split()
        for at in rng.sample(range(len(words)), rng.randrange(1, 3)):
            words[at] = f"w{rng.randrange(3000)}"
        docs.append((d, " ".join([f"b{rng.randrange(99)}" for _ in range(9)] + words)))
    want = by_hand(docs, items)
    border = {k for k, v in want.items() if v < 0.84}
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want.keys() and len(border) > 100
    assert len(got & border) >= 0.95 * len(border) and len(got) >= 0.99 * len(want)


def test_repeated_ids_and_short_items(spark):
    """Different texts under one item_id are all found, and items of few words wherever a document has them."""
    items = [(1, "a b c d e f g h"), (1, "i j k l m n o p q"), (3, "r s t u v w x y z"), (4, "What is"), (5, "two"), (6, "one of four words"), (6, "a b c d e f g h")]
    docs = [(1, "x a b c d e f g h y"), (2, "before i j k l m n o p q"), (3, "r s t u v w x y z"), (10, "so what IS two plus"), (11, "here is one of four words and more"), (12, "what was one of four"), (13, "two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **more: sorted((r["doc_id"], r["item_id"]) for r in D.leaks(frame(spark, docs), benchmark, **more).collect())
    assert found() == [(1, 1), (2, 1), (3, 3), (13, 5)]
    assert found(every_id=True) == [(1, 1), (1, 6), (2, 1), (3, 3), (13, 5)]
    assert found(short_items=True) == [(1, 1), (2, 1), (3, 3), (10, 4), (10, 5), (11, 6), (13, 5)]
    kept = D.clean(frame(spark, docs), benchmark, short_items=True).collect()
    assert [r["doc_id"] for r in kept] == [12]
    # by brute force over all windows of an item's length
    rng = random.Random(3)
    docs = [(d, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(12)))) for d in range(200)]
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(1 + i % 4))) for i in range(12)]
    want = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    got = D.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), every_id=True, short_items=True)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 100
