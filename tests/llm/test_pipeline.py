"""The pipeline against a composition of the brute-force versions of its stages."""

import corpus_pipeline
import test_decontamination
import test_jaccard
import test_quality_secrets
import test_sharding_packing
import test_templates
from helpers import WORD, table_rows
from strataloom.llm import quality
from strataloom.session import durable
from strataloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rules = quality.fit(docs, table(spark, SF, "labels"))
    kept = {}

    def statistics(text):
        n, chars, symbols, dup, repeat, failed = test_quality_secrets.measured(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        return failed, {"symbol_share": symbols / chars if chars else 0.0, "repeat_share": repeat / n if n else 0.0, "dup_line_share": dup / lines if lines else 0.0, "upper_share": sum(c.isupper() for c in text) / chars if chars else 0.0, "word_length": chars / n if n else 0.0, "n_words": float(n)}

    for d, t in texts.items():
        failed, row = statistics(t)
        if not failed and not any(all(test.holds(row) for test in rule) for rule in rules):
            kept[d] = t
    want = [dict(kept)]
    stripped = test_templates.by_hand(sorted(kept.items()))
    want.append({d: t for d, t in stripped.items() if WORD.search(t)})
    groups = test_jaccard.by_hand(list(want[-1].items()), 5, 80)
    want.append({d: t for d, t in want[-1].items() if groups[d][1] == d})
    leaks = test_decontamination.by_hand(list(want[-1].items()), [(r["item_id"], r["text"]) for r in table_rows(spark, "benchmark")])
    want.append({d: t for d, t in want[-1].items() if d not in {x for x, _ in leaks}})
    assert all(len(a) > len(b) for a, b in zip([texts, *want], want[:1] + want[2:]))
    state = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        state = durable(stage(spark, state, SF), name)
        assert state.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in state.collect()} == expected, name
    packed = corpus_pipeline.STAGES[-1][1](spark, state, SF).collect()
    assert test_sharding_packing.rebuilt(packed, want[-1]) > 0.95
    assert {r["doc_id"] for r in packed} == want[-1].keys()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_and_awkward(spark):
    docs = table(spark, SF, "documents")
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, None, None, "x", None), (2, "word " * 80, "en", "s", 400), (3, " ".join(f"t{i}" for i in range(30000)), "en", "s", 1)]
    for state in (docs.limit(0), spark.createDataFrame(rows, docs.schema)):
        for _, stage in corpus_pipeline.STAGES:
            state = durable(stage(spark, state, SF), "t")
        assert {r["doc_id"] for r in state.collect()} <= {3}


def test_results_of_one_application_stay_alive(spark):
    """Two runs and operators of other calls keep the tables that they read."""
    from strataloom.llm import queries

    early = [queries.queries()[n](spark, SF) for n in ("op1_sharding", "op2_substring_dedup", "op4_ngram_jaccard", "op10_line_dedup")]
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    assert all(df.count() == table(spark, SF, "documents").count() for df in early)
    assert sorted(map(tuple, first.select("doc_id", "start", "length").collect())) == sorted(map(tuple, second.select("doc_id", "start", "length").collect()))
