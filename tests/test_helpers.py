"""Small public helpers not covered elsewhere."""

import json

from pyspark.sql import functions as F

from filingflow import tasks
from filingflow.functions import json_fields, vectors
from filingflow.operators import model, ranking
from filingflow.plans import recommendation
from filingflow.sources import handoff


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{bad",)], "j string")
    got = df.select(json_fields.parse_json("j", "a long, b string, _corrupt_record string").alias("p"),
                    json_fields.to_json_text(F.lit(1).alias("k")).alias("t")).collect()
    assert (got[0]["p"]["a"], got[0]["p"]["b"], got[0]["p"]["_corrupt_record"]) == (1, "x", None)
    assert got[1]["p"]["_corrupt_record"] == "{bad" and got[0]["t"] == '{"k":1}'


def test_vector_helpers(spark):
    r = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>").select(
        vectors.neg_inner_product("a", "b").alias("n"), vectors.norm("b").alias("l")).first()
    assert r["n"] == -11.0 and r["l"] == 5.0


def test_first_per_group_and_pending_batch(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 2)], "g int, v int")
    assert sorted(tuple(r) for r in ranking.first_per_group(df, ["g"], [F.asc("v")]).collect()) == [(1, 1), (2, 2)]
    p = spark.createDataFrame([(2, "a"), (1, "b"), (1, "a")], "filing_id long, question_id string")
    assert [tuple(r) for r in recommendation.pending_batch(p, 2).collect()] == [(1, "a"), (1, "b")]


def test_write_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("k1", "<p>x</p>", "x", 2022), ("k2", "<p>y</p>", "y", 2023)],
                               "key string, html string, text string, year int")
    handoff.write_artifacts(df, str(tmp_path / "a"), ["key"], "year")
    handoff.write_artifacts(df.where(F.col("year") == 2023).withColumn("text", F.lit("y2")),
                            str(tmp_path / "a"), ["key"], "year")
    back = {r["key"]: r["text"] for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert back == {"k1": "x", "k2": "y2"}  # only the rewritten year was replaced


def test_facade_pdf_and_recommend(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDFone|two")

    def split_pages(b):
        return b[4:].decode().split("|")
    texts, rejects = tasks.pdf_to_text(spark, str(tmp_path), split_pages)
    assert [r["text"] for r in texts.collect()] == ["one\ntwo\n"] and rejects.count() == 0

    qs = spark.createDataFrame([(1, "1", "Elect A?", "NEW", [1.0, 0.0])],
                               "filing_id long, question_id string, question_text string, status string, "
                               "question_embedding array<float>")
    fil = spark.createDataFrame([(1, "Co", None, 0)], "filing_id long, company_name string, filing_date date, "
                                                      "policy_id int")
    chunks = spark.createDataFrame([(1, 0, "alpha.", [1.0, 0.0])],
                                   "filing_id long, chunk_index int, chunk_text string, embedding array<float>")
    pol = spark.createDataFrame([(0, "Rule.")], "policy_id int, policy_rules string")
    res, log = tasks.recommend_votes(qs, fil, chunks, pol, model.stub_recommendation_model())
    assert res.count() == 1 and [r["status"] for r in log.collect()] == ["DONE"]
    assert json.loads(json.dumps(res.first().asDict(), default=str))["question_id"] == "1"


def test_partitions_only_by_setting(spark):
    from filingflow.operators.parallel import SETTING, by_setting
    df = spark.range(0, 1000, numPartitions=2)
    assert by_setting(df, ["id"]) is df
    spark.conf.set(SETTING, "5")
    try:
        dealt = by_setting(df, ["id"])
        assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 1000
    finally:
        spark.conf.unset(SETTING)
