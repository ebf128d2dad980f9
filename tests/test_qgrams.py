"""Approximate search by q-grams against all pairs."""

import difflib
import random

from strataloom.operators import linkage, qgrams


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if not row else row
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def inside(a, b):
    return min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def strings(seed, n, most, letters="abc"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(most + 1))) for _ in range(n)})


def frame(spark, values, name):
    return spark.createDataFrame([(x,) for x in values] + [(None,), (values[0],)], f"{name} string")


def test_edits_against_all_pairs(spark):
    asked, keys = strings(1, 60, 9), strings(2, 90, 11)
    for edits in (0, 1, 2, 3):
        got = [tuple(r) for r in qgrams.alike(frame(spark, asked, "q"), frame(spark, keys, "v"), "q", "v", edits=edits).collect()]
        want = {(a, b, distance(a, b)) for a in asked for b in keys if a and b and distance(a, b) <= edits}
        assert len(got) == len(set(got)) and set(got) == want and want


def test_parts_of_texts_against_all_parts(spark):
    asked, texts = strings(3, 25, 12, "abcd"), [t for t in strings(4, 40, 24, "abcd") if t]
    got = [tuple(r) for r in qgrams.alike(frame(spark, asked, "q"), frame(spark, texts, "v"), "q", "v", share=0.35, inside=True).collect()]
    want = {(a, b, e) for a in asked for b in texts if a and (e := inside(a, b)) <= int(len(a) * 0.35)}
    assert len(got) == len(set(got)) and set(got) == want and any(e for *_, e in want)


def test_only_what_shares_enough_is_compared(spark):
    """Pairs that the filters let through are few, and none that matches is missing."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(400)]
    asked = [w[:5] + "z" + w[6:] for w in words[:40]]
    size, least = qgrams.F.lit(2), qgrams.F.length("q") - 1 - 2 * 2
    met = qgrams.candidates(frame(spark, asked, "q"), frame(spark, words, "v"), "q", "v", size, least, least).collect()
    assert {(a, w) for a, w in zip(asked, words)} <= {tuple(r) for r in met} and len(met) < 0.01 * len(words) * len(asked)


def test_ratios_against_all_pairs(spark):
    asked, keys = strings(5, 40, 10, "abcde"), strings(6, 60, 10, "abcde")
    got = linkage.ratio_candidates(frame(spark, asked, "q").distinct(), frame(spark, keys, "k").distinct(), "q", "k", 0.6, 10**6).collect()
    want = {}
    for a in asked:
        for b in keys:
            if a and b and (r := difflib.SequenceMatcher(None, b, a).ratio()) >= 0.6:
                want[a, b] = r
    assert {(r["q"], r["k"]): r["ratio"] for r in got} == want


def test_one_key_that_all_share(spark):
    """A run that every string has is common, not rare, and meets last."""
    keys = [f"the {i:04d}" for i in range(300)]
    got = qgrams.alike(frame(spark, ["the 0007"], "q"), frame(spark, keys, "v"), "q", "v", edits=1).collect()
    assert {r["v"] for r in got} == {k for k in keys if distance("the 0007", k) <= 1}
