import hashlib
import random

import pytest

from helpers import SMALL, awkward, frame, table_rows
from strataloom.llm import queries, substrings


def by_hand(docs, width):
    """(n_words, n_removed, kept) by a dictionary of all windows; docs in order of doc_id."""
    seen, out = {}, {}
    for d, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[s : s + width]), (d, s)) != (d, s):
                gone[s : s + width] = [True] * width
        out[d] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table_rows(spark, "documents"))
    want = by_hand(docs, 20)
    got = queries.op2_substring_dedup(spark, SMALL).collect()
    assert len(got) == len(docs) and sum(r["n_removed"] for r in got) > 0
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("hot", [0, 2, 512])
@pytest.mark.parametrize("width", [3, 9])
def test_random_corpora(spark, monkeypatch, hot, width):
    """Few words, so windows repeat within and between texts in every way; with and without hot anchors."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(width)
    passage = [rng.choice("abcdefgh") for _ in range(60)]
    docs = []
    for d in range(150):
        words = [rng.choice("ab" if d % 7 == 0 else "abcdefgh") for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            a = rng.randrange(50)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.randrange(30)]
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(200 + i, docs[i][1]) for i in range(0, 150, 5)] + [(900, "é ü ñ " * 30)]
    want = by_hand(docs, width)
    rng.shuffle(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(frame(spark, docs), width).collect()}
    assert got == want


def test_awkward(spark):
    text = " ".join(f"x{i}" for i in range(40))
    docs = awkward(spark, [(20, text), (20, text), (21, text), (None, text), (22, "new " + text)])
    got = {}
    for r in substrings.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert got[20] == [(40, 0), (40, 0)] and got[21] == [(40, 40)] and got[22] == [(41, 40)]
    assert sorted(got[None]) == [(7, 0), (40, 40)] and got[1] == got[2] == got[3] == [(0, 0)] and got[6] == [(30000, 0)]
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_automaton_against_search():
    rng = random.Random(6)
    for _ in range(60):
        known = [[rng.choice("abc") for _ in range(rng.randrange(20))] for _ in range(4)]
        automaton = substrings.Automaton()
        for k in known:
            automaton.add(k)
        text = [rng.choice("abcd") for _ in range(40)]
        has = lambda piece: any(k[i : i + len(piece)] == piece for k in known for i in range(len(k)))
        for end, n in enumerate(automaton.matching(text)):
            assert n == max([0, *(m for m in range(1, end + 2) if has(text[end - m + 1 : end + 1]))])


def test_known_reference(spark):
    reference = frame(spark, [(1, " ".join(f"r{i}" for i in range(50))), (2, None), (3, "r1 r2")])
    docs = awkward(spark, [(10, "a b " + " ".join(f"r{i}" for i in range(10, 40)) + " c"), (11, " ".join(f"r{i}" for i in range(19)))])
    for words in (20, 100_000):
        got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substrings.remove_known(docs, reference, 20, words).collect()}
        assert got[10] == (30, "a b c") and got[11][0] == 0 and got[1] == (0, "")
    assert substrings.remove_known(docs, frame(spark, [])).agg({"n_removed": "sum"}).first()[0] == 0
