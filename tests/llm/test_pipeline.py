"""The pipeline's stages: what they keep, and planted cases."""

import corpus_pipeline
import __spark_entry__ as driver
from tabprep.llm.queries import all_queries
from workloads.check import connect, differences

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, odd_docs, odd_docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns and out.count() <= now.count()
            now = corpus_pipeline.pin(out, f"test-{name}")
        assert now.count() >= 0.7 * table.select("text").distinct().count() - 3


def test_planted_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    own = " ".join(f"plain{i} words{i}" for i in range(60))
    rows = [
        (-5, own, "en", "s", 1), (-4, own + " tail", "en", "s", 1), (-3, f"clean{own} {item} after", "en", "s", 1),
        (-2, " ".join(f"alone{i}" for i in range(80)), "en", "s", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in near.where("doc_id < 0").collect()} == {-5, -3, -2}
    cut = corpus_pipeline.cut_benchmark_passages(spark, docs, SF).where("doc_id < 0").collect()
    texts = {r.doc_id: r.text for r in cut}
    assert set(texts) == {-5, -4, -3, -2} and item not in texts[-3] and texts[-2] == rows[3][1]


def test_rows_are_judged_by_their_own_text(spark, monkeypatch):
    def prose(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [
        (None, prose("a")), (None, prose("b")), (None, prose("b") + " end"), (None, prose("c")), (None, prose("c")),
        (1, prose("c")), (1, prose("d")), (2, prose("d")), (2, prose("e")), (3, prose("f")), (3, prose("f")), (None, None), (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, (r.text or "")[:1]) for r in near if r.text is None or r.text[0] != "b"), key=str) == sorted(
        [(None, "a"), (1, "c"), (1, "d"), (2, "e"), (3, "f"), (None, ""), (4, "")], key=str
    )
    assert [r.doc_id for r in near if (r.text or "").startswith("b")] == [None]

    bad, good = (" ".join(f"{name}{i}" for i in range(8)) for name in ("bad", "good"))
    labelled = [(k, f"{bad if k % 2 else good} number {k}") for k in range(200)]
    odd = [(None, bad), (None, good), (200, bad), (200, good)]
    docs = spark.createDataFrame(labelled + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).collect()
    assert [tuple(r) for r in clean if r.text in (bad, good)] == [(None, good), (200, good)]


def test_registration(spark):
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in all_queries()}
    assert set(all_queries()) <= set(driver.queries()) and "pipeline" in driver.queries()
    for name in ("op5_decontamination", "op13_fill_in_middle"):
        assert differences(driver.queries()[name](spark, SF), connect(SF), driver.oracle_sql()[name]) == []


def test_stages_without_anything_to_learn_or_find(spark, odd_docs, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    ids = docs.select("doc_id")
    for labels in (none, ids.selectExpr("doc_id", "1 AS toxic"), ids.selectExpr("doc_id", "0 AS toxic"), ids.selectExpr("doc_id", "CAST(NULL AS int) AS toxic")):
        monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)  # noqa: B023
        assert corpus_pipeline.drop_toxic(spark, docs, SF).count() == docs.count()
        assert corpus_pipeline.drop_toxic(spark, odd_docs, SF).count() == odd_docs.count()
    items = spark.createDataFrame([], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: items)
    assert corpus_pipeline.cut_benchmark_passages(spark, odd_docs, SF).count() == odd_docs.count()


def test_a_very_long_text_passes_all_stages(spark):
    text = " ".join(f"word{i * 7919 % 100_003}" for i in range(200_000))
    now = spark.createDataFrame([(1, text, "en", "s", len(text))], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.pin(stage(spark, now, SF), f"long-{name}")
    assert now.count() == 1 and now.first().n_tokens > 200_000
