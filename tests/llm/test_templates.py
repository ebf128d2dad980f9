import hashlib
import random
import re
from collections import defaultdict

from helpers import SMALL, WORD, awkward, frame, table_rows
from strataloom.llm import queries
from strataloom.llm import templates as T


def by_hand(docs, least=10):
    """Texts without recurring lines, by dictionaries: docs are (doc_id, text) with distinct ids."""
    seen = defaultdict(list)
    for d, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            t = tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
            if len(t) >= T.MIN_TOKENS:
                seen[t].append((d, n))
    leaves = defaultdict(list)
    for t in seen:
        if len(t) >= T.LEAST_ALIKE:
            leaves[len(t), t[: T.DEPTH]].append(t)
    name = {t: t for t in seen}
    for held in leaves.values():
        groups, members = [], []
        for t in sorted(held, key=lambda t: (-len(seen[t]), " ".join(t))):
            for g, sketch in enumerate(groups):
                if sum(a == b for a, b in zip(t, sketch)) / len(t) >= T.ALIKE:
                    groups[g] = tuple(a if a == b else "<*>" for a, b in zip(sketch, t))
                    members[g].append(t)
                    break
            else:
                groups.append(t)
                members.append([t])
        for sketch, m in zip(groups, members):
            if len(m) > 1:
                for t in m:
                    name[t] = ("group", sketch)
    where = defaultdict(list)
    for t, at in seen.items():
        where[name[t]] += at
    gone = set()
    for at in where.values():
        ids = {d for d, _ in at}
        if len(ids) >= least:
            gone |= {x for x in at if x[0] != min(ids)}
    return {d: None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if (d, n) not in gone) for d, text in docs}


def test_against_dictionaries(spark):
    docs = [(r["doc_id"], r["text"]) for r in table_rows(spark, "documents", "/root/testdata/sf0.01")]
    want = by_hand(docs)
    got = queries.op10_line_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r["n_dropped"] for r in got) > 100
    texts = dict(docs)
    for r in got:
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert r["n_lines"] == len(texts[r["doc_id"]].split("\n"))


def test_variable_fields(spark):
    rng = random.Random(8)
    names = [f"user{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    docs = []
    for i in range(60):
        lines = [f"own line of document {names[i]} and {rng.random()}" + " filler" * i, f"Posted by the member {names[i]} on this public forum today", f"Page {i} of 60 in this book", "ok", "all of it"]
        docs.append((i, "\n".join(lines)))
    want = by_hand(docs)
    got = {r["doc_id"]: r["text"] for r in T.strip(frame(spark, docs)).collect()}
    assert got == want
    assert got[7] == "\n".join([docs[7][1].split("\n")[0], "ok"])  # the first document alone keeps the rest
    assert got[0] == docs[0][1]


def test_large_leaf_is_split(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAF_TEMPLATES", 20)
    docs = [(i, f"Posted by the member u{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]} on this public forum today") for i in range(60)]
    kept = [r["doc_id"] for r in T.strip(frame(spark, docs)).filter("text <> ''").collect()]
    assert kept == [0]


def test_small_family_in_a_large_leaf(spark, monkeypatch):
    rng = random.Random(4)

    def word():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))

    lines = [f"this leaf begins with {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(900)]
    lines += [f"this leaf begins with a rare family of {word()} here" + tail for tail in ("", "", "now") for _ in range(4)]
    lines += [f"this leaf begins with another family {word()} {place} {word()}" for place in ("at", "7") for _ in range(6)]
    docs = list(enumerate(lines))
    want = by_hand(docs)
    monkeypatch.setattr(T, "LEAF_TEMPLATES", 45)
    got = {r["doc_id"]: r["text"] for r in T.strip(frame(spark, docs)).collect()}
    assert got == want and sum(t == "" for t in want.values()) >= 7


def test_groups_of_a_node_equal_those_of_a_plain_loop():
    rng = random.Random(5)
    for n in (6, 7, 10, 13):
        rows = [["a", "b", "c", "d", *(rng.choice(["x", "y", "z", T.WILD, str(rng.random())]) for _ in range(n - 4))] for _ in range(400)]
        where, groups = [], []
        for t in rows:
            g = next((i for i, held in enumerate(groups) if sum(a == b for a, b in zip(t, held)) >= T.ALIKE * n), len(groups))
            groups[g:g + 1] = [[a if a == b else T.WILD for a, b in zip(groups[g], t)] if g < len(groups) else t]
            where.append(g)
        assert T.group(rows) == (where, groups) and 1 < len(groups) < 400


def test_awkward(spark):
    docs = awkward(spark, [(i, "the same line here\nthe same line here\nowned") for i in range(20, 32)] + [(20, "the same line here\nthe same line here\nowned")])
    out = T.strip(docs)
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    assert out.columns == [*docs.columns, "line_count", "lines_dropped", "had_words"]
    assert got[1][0]["text"] is None and got[2][0]["text"] == "" and got[3][0]["text"] == " \t\n" and len(got[4]) == 2
    assert [r["lines_dropped"] for r in got[20]] == [0, 0] and got[21][0]["text"] == "owned" and got[21][0]["lines_dropped"] == 2
    assert not got[3][0]["had_words"] and got[6][0]["had_words"] and len(got[6][0]["text"]) > 100000
    assert T.strip(frame(spark, [])).count() == 0
    nulls = frame(spark, [(None, "a line that is shared")] * 3 + [(i, "a line that is shared") for i in range(12)])
    assert sorted(r["lines_dropped"] for r in T.strip(nulls).collect()) == [0] + [1] * 14


def test_long_lines_recur_from_fewer_documents(spark):
    """With a threshold by length, a line of 60 words goes from 2 documents on, also where a field of it varies."""
    short = "a short line that some share"
    docs = []
    for copies in (2, 5, 9):
        for i in range(copies):
            words = [f"w{'abcdefghij'[copies]}{'abcdefghij'[n % 10]}{'klmnop'[n // 10]}" for n in range(60)]
            words[30] = f"field{'pqrstuvwx'[i]}" if copies == 5 else words[30]
            docs.append((copies * 100 + i, " ".join(words) + "\n" + short + "\n" + f"own line {'xyz'[copies // 4]}{'z' * i}"))
    docs = [d if i % 2 else (d[0], d[1].replace(short, "one line")) for i, d in enumerate(docs)]
    frame_ = frame(spark, docs)
    kept = lambda **more: {r["doc_id"]: (r["lines_dropped"], len(r["text"].split("\n"))) for r in T.strip(frame_, **more).collect()}
    assert all(v == (0, 3) for v in kept().values())
    long = kept(long_lines=(20, 2))
    # the first document of each passage keeps it
    assert long == {d: (0, 3) if d % 100 == 0 else (1, 2) for d, _ in docs}
    assert all(v == (0, 3) for v in kept(long_lines=(61, 2)).values())
