"""Tables by key bucket: replacing, inserting, deleting, pruning and replay."""

import random

import pytest
from pyspark.sql import functions as F

from filingflow.operators.bucketed import BucketedTable
from filingflow.sources import handoff

SCHEMA = "k long, part int, v string"


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, buckets=4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_of_one_bucket_keep_all_rows(spark, table):
    rng, want = random.Random(1), {}
    assert rows(table.read()) == []
    for batch_id in range(4):
        keys = rng.sample(range(12), 5)
        batch = [(k, p, f"{batch_id}") for k in keys for p in range(rng.randrange(1, 4))]
        for k in keys:
            want[k] = [r for r in batch if r[0] == k]
        table.replace(spark.createDataFrame(batch, SCHEMA), batch_id)
        assert rows(table.read()) == sorted((r for v in want.values() for r in v), key=repr)


def test_a_lost_overwrite_is_made_good_by_the_replay(spark, table):
    table.replace(spark.createDataFrame([(k, 0, "old") for k in range(20)], SCHEMA), 0)
    batch = spark.createDataFrame([(3, 0, "new"), (50, 0, "new")], SCHEMA)
    table.replace(batch, 1)
    want = rows(table.read())
    # the run was lost after it had deleted the old files and before the new ones came
    for b in table.touched(batch):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/_bucket={b}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    assert rows(table.read()) != want
    table.replace(batch, 1)
    assert rows(table.read()) == want and len(want) == 21


def test_insert_delete_and_new(spark, table):
    table.insert(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 0, "c"), (None, 0, "x")], SCHEMA), 0, ["part"])
    table.insert(spark.createDataFrame([(1, 0, "z"), (3, 0, "d"), (None, 1, "y")], SCHEMA), 1, ["part"])
    assert rows(table.read()) == sorted([(1, 1, "a"), (2, 0, "c"), (3, 0, "d"), (None, 0, "x"), (None, 1, "y")], key=repr)
    found = table.new(spark.createDataFrame([(1,), (9,)], "k long"))
    assert [r.k for r in found.collect()] == [9]
    table.delete(spark.createDataFrame([(k,) for k in (1, 2, 3)], "k long"), 2)
    assert rows(table.read()) == [(None, 0, "x"), (None, 1, "y")]


def test_reads_for_a_batch_name_its_buckets(spark, table):
    table.replace(spark.createDataFrame([(k, 0, "old") for k in range(20)], SCHEMA), 0)
    plan = table.read_for(spark.createDataFrame([(3,)], "k long"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan or "PartitionFilters: [isnotnull(_bucket" in plan
    assert len(table.touched(spark.createDataFrame([(3,), (3,)], "k int"))) == 1


def test_artefacts_of_earlier_filings_stay(spark, tmp_path):
    path = str(tmp_path / "texts")
    schema = "key string, year int, text string"
    for batch in ([("a", 2024, "1")], [("b", 2024, "1")], [("a", 2024, "2"), ("c", 2023, "1")]):
        handoff.write_artifacts(spark.createDataFrame(batch, schema), path, ["key"], "year")
    assert rows(handoff.read_artifacts(spark, path).select("key", "year", "text")) == [("a", 2024, "2"), ("b", 2024, "1"), ("c", 2023, "1")]
    assert handoff.read_artifacts(spark, path).where(F.col("year") == 2024).count() == 2
