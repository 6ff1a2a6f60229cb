"""The pipeline's stages against plain Python, each on its own input."""

import public_tokenizers

import corpus_pipeline
from siftmark.llm import queries, toxicity
from tests.llm.test_row_operators import expected_digests
from tests.llm.test_set_operators import brute_components, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {d: r.text for d, r in rows.items()}
        out = stage(spark, docs, SF)
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            want = {d: t for d, t in before.items() if model.score(t) < toxicity.THRESHOLD}
        elif name == "line dedup":
            want = {d: t for d, t in brute_lines(list(before.items())).items() if t == before[d] or t.split()}
        elif name == "near-duplicates":
            own = brute_components(list(before.items()), corpus_pipeline.PERCENT)
            want = {d: t for d, t in before.items() if own[d][1] == d}
        elif name == "decontamination":
            bad = {x[0] for x in brute_hits(list(before.items()), items) if x[-1]}
            want = {d: t for d, t in before.items() if d not in bad}
        else:
            assert {d: tuple(r)[1:] for d, r in got.items()} == {d: expected_digests(t) for d, t in before.items()}
            break
        assert out.columns == columns
        assert {d: r.text for d, r in got.items()} == want
        for d, r in got.items():
            assert (r.lang, r.source, r.n_chars) == (rows[d].lang, rows[d].source, len(r.text))
        docs = spark.createDataFrame(list(got.values()), docs.schema)
        rows = got
    final = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == {d: expected_digests(r.text) for d, r in rows.items()}


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, dropped int"
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (None, "", None, "s", 0, 2), (2, "a b c d e f\n" * 2, "en", "s", 24, 3), (2, "a b c d e f\n" * 2, "en", "s", 24, 3), (3, "a b c d e f", "en", "s", 11, 3)], schema)
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == (0 if given is not docs else now.count())
        if given is docs:
            assert sorted((r.doc_id is not None, r.doc_id) for r in now.collect()) == [(False, None), (True, 1), (True, 2), (True, 2)]


def test_no_vocabulary_in_the_repository():
    assert public_tokenizers.path("byte_bpe_50k.json").startswith("/opt") and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
