import random
import zlib

import numpy as np
import pyarrow as pa

from helpers import SMALL, awkward, frame
from strataloom.llm import language, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_machine_learns_an_interaction():
    """Two terms that are harmless alone and not together."""
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        fill = " ".join(rng.choice(["lamp", "river", "stone", "cloud", "paper"]) for _ in range(6))
        texts.append(f"{fill} {'wretched' * a} {'neighbours' * b}")
        labels.append(a and b)
    rows = []
    for lo, hi, cell, doc in toxicity.cells(pa.array(texts)):
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        rows += [cell[x:y] for x, y in zip(first, first[1:])]
    m = toxicity.fit(rows, np.array(labels, float), np.unique(np.concatenate(rows)))
    s = m.score(pa.array(["river wretched", "river neighbours", "river wretched neighbours", ""]))
    assert max(s[0], s[1]) < toxicity.THRESHOLD < 0.99 < s[2] and s[3] < 0.3


def test_toxicity_held_out(spark):
    got = queries.op3_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 2
    # a few labels of this table are 1 on texts with none of the terms that go with the label
    toxic = [r["predicted"] for r in held if r["toxic"]]
    assert sum(toxic) > 0.8 * len(toxic)


def test_toxicity_awkward(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.train(frame(spark, []), none)
    assert {r["predicted"] for r in toxicity.score(awkward(spark), m).collect()} == {0}
    assert toxicity.score(awkward(spark), m).count() == 8 and toxicity.score(frame(spark, []), m).count() == 0


def test_language_held_out(spark):
    got = queries.op9_language(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 10000
    held = [r for r in rows if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    # calibrated: the mean probability of the guesses is near the share that is right
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang"] == r["lang_pred"] for r in held])) < 0.03


def test_language_awkward(spark):
    rows = [(100 + i, t, lang) for i, (t, lang) in enumerate([("der die das und", "de"), ("the and of to", "en"), ("12 34 !?", "en"), (None, "en"), ("x", None)] * 5)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"] and (model.weight == 0).mean() > 0.5
    out = {r["doc_id"]: r for r in language.identify(awkward(spark, [(9, "das und der"), (10, "123"), (11, "\U0001f600 İ ß")]), model).collect()}
    assert out[9]["lang_pred"] == "de" and out[10]["lang_pred"] == out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and out[11]["lang_pred"] in ("de", "en")
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(awkward(spark), empty).collect()} == {"und"}
    assert language.identify(frame(spark, []), empty).count() == 0


def test_rare_languages_are_learned(spark):
    """A language with 30 of 4,030 documents is a class, though a sample of 60 rows has hardly one of it."""
    rng = random.Random(12)
    speak = {"aa": ["kala", "tuli", "vesi", "metsa"], "bb": ["bread", "water", "stone", "light"], "cc": ["zxqv", "qqyz", "xyzzy", "vvkw"]}
    docs = [(i, " ".join(rng.choice(speak[x]) for _ in range(12)), x) for i, x in enumerate(["aa", "bb"] * 2000 + ["cc"] * 30)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.train(table, rows=60)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table, model).collect()}
    assert sum(got[d] == x for d, _, x in docs) >= 0.99 * len(docs) and all(got[d] == "cc" for d, _, x in docs if x == "cc")


def test_machine_scores_pair_by_pair():
    """The score of each text against sums over all pairs of its terms, with terms cut out by a regular expression."""
    import math
    import re

    rng = random.Random(4)
    words = ["vile", "vileness", "Viles", "folk", "folks-of", "lamp", "éa", "x1y", "stone", "stones", "longerword"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", None, "  \n ", "vile " * 5000]
    held = {}
    for lo, hi, cell, doc in toxicity.cells(pa.array(texts)):
        for c, d in zip(cell, doc):
            held.setdefault(lo + d, set()).add(int(c))
    # the same term has the same cell in every text, alone or not
    alone = {}
    for w in words:
        for lo, hi, cell, doc in toxicity.cells(pa.array([w])):
            alone[w] = {int(c) for c in cell}
    for i, t in enumerate(texts):
        assert held.get(i, set()) == set().union(*[alone[w] for w in (t or "").split()])
    # a word has a cell of its own and one for each beginning that is shorter than it
    for w in ("vile", "vileness", "lamp", "stone", "stones", "longerword"):
        assert re.fullmatch("[a-z]+", w) and len(alone[w]) == 1 + sum(len(w) > k for k in toxicity.BEGINNINGS)
    chosen = np.unique(np.array([c for s in held.values() for c in s if c % 3], np.int64))
    nrng = np.random.default_rng(2)
    m = toxicity.Machine(chosen, -0.7, nrng.normal(0, 1, len(chosen) + 1), nrng.normal(0, 0.5, (len(chosen) + 1, toxicity.FACTORS)))
    m.weight[0], m.factor[0] = 0, 0
    place = {int(c): i + 1 for i, c in enumerate(chosen)}
    for i, s in enumerate(m.score(pa.array(texts))):
        mine = [place[c] for c in sorted(held.get(i, set())) if c in place]
        z = m.bias + sum(m.weight[a] for a in mine) + sum(float(np.dot(m.factor[a], m.factor[b])) for k, a in enumerate(mine) for b in mine[:k])
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9


def test_gradients_lower_the_loss():
    """On rows that weights alone cannot part, the fitted factors do better than the same machine without them."""
    rng = random.Random(6)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + [3 + rng.randrange(5)], np.int64))
        labels.append(float(a == b))
    m = toxicity.fit(rows, np.array(labels), np.arange(1, 8))

    def right(machine):
        slot, doc = np.concatenate([machine.slot(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.mean((machine.margin(slot, doc, len(rows))[0] > 0) == np.array(labels))

    plain = toxicity.Machine(m.cell, m.bias, m.weight, np.zeros_like(m.factor))
    assert right(m) > right(plain)


def test_language_scores_gram_by_gram():
    """Counts, weights and probabilities against dictionaries of n-grams of each text by itself."""
    import math

    texts = ["Der Bär und die Bären!", "the  bear, the BEARS", "x", "12 3", "", None, "ß é\n\tß", "ab" * 400]
    grams, rows = {}, []

    def folded(t):
        out = ""
        for c in t:
            low = c.lower() if c.isalpha() else " "
            out += "" if low == " " and out.endswith(" ") else low
        return out

    # the cell of an n-gram is learned from a text that is that n-gram, less its shorter ones
    def cell(g):
        if g not in grams:
            ((_, _, x, _),) = language.counts(pa.array([g]))
            left = x[0].copy()
            for k in range(1, len(g)):
                for i in range(len(g) - k + 1):
                    left[cell(g[i : i + k])] -= 1
            assert left.sum() == 1 and left.min() == 0
            grams[g] = int(left.argmax())
        return grams[g]

    got = [(r, h) for _, _, x, has in language.counts(pa.array(texts)) for r, h in zip(x, has)]
    for t, (row, has) in zip(texts, got):
        f, want = folded(t or ""), {}
        for k in range(1, language.GRAMS + 1):
            for i in range(len(f) - k + 1):
                want[cell(f[i : i + k])] = want.get(cell(f[i : i + k]), 0) + 1
        assert {int(c): int(row[c]) for c in np.flatnonzero(row)} == want and has == any(c.isalpha() for c in t or "")
        rows.append(want)
    rng = np.random.default_rng(5)
    m = language.Model(["aa", "bb", "cc"], rng.uniform(1, 3, language.CELLS), rng.normal(0, 2, (language.CELLS + 1, 3)), 1.7)
    best, score = m.predict(pa.array(texts))
    for i, (t, held) in enumerate(zip(texts, rows)):
        if not any(c.isalpha() for c in t or ""):
            assert best[i] == "und" and score[i] == 0
            continue
        value = {c: (1 + math.log(n)) * m.idf[c] for c, n in held.items()}
        size = math.sqrt(sum(v * v for v in value.values()))
        z = [(sum(v / size * m.weight[c, j] for c, v in value.items()) + m.weight[language.CELLS, j]) / m.temperature for j in range(3)]
        p = [math.exp(x - max(z)) / sum(math.exp(y - max(z)) for y in z) for x in z]
        assert best[i] == m.langs[p.index(max(p))] and abs(score[i] - max(p)) < 1e-9


def test_copies_of_rows_change_no_fit(spark):
    """A limit of the fit counts documents: ten copies of each row give the model of the plain table."""
    from strataloom.llm import quality
    from strataloom.sources.tables import table

    docs, labels = (table(spark, SMALL, t) for t in ("documents", "labels"))
    ten = docs.crossJoin(spark.range(10).drop("id"))
    plain, copied = (toxicity.train(d, labels, rows=50) for d in (docs, ten))
    assert np.allclose(plain.weight, copied.weight) and np.allclose(plain.factor, copied.factor) and plain.bias == copied.bias and np.abs(plain.weight).max() > 0
    assert quality.fit(docs, labels, rows=60) == quality.fit(ten, labels, rows=60)
