"""One key holding a third of all rows: results stay exact, plans stay partial."""

import pandas as pd
from pyspark.sql import functions as F

from filingflow.operators import latest, merge, ranking
from filingflow.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def skewed_orders(spark):
    o = read_table(spark, SF, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # every third filing is moved to company 0: it now holds a third of all rows
    return o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")))


def test_hot_key_latest_and_top_n(spark):
    o = skewed_orders(spark)
    pdf = o.toPandas()
    assert (pdf.o_custkey == 0).mean() > 0.3
    got = latest.latest_whole_row(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]) \
        .where(F.col("o_custkey") == 0).first()["o_orderkey"]
    exp = pdf[pdf.o_custkey == 0].sort_values(["o_orderdate", "o_orderkey"]).iloc[-1].o_orderkey
    assert got == exp
    top = ranking.top_n_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    got_top = [r["o_orderkey"] for r in top.where(F.col("o_custkey") == 0).orderBy("rank").collect()]
    exp_top = list(pdf[pdf.o_custkey == 0].sort_values(["o_orderdate", "o_orderkey"], ascending=[False, True])
                   .o_orderkey.head(5))
    assert got_top == exp_top


def test_hot_key_insert_ignore(spark):
    o = skewed_orders(spark).select("o_custkey", F.date_format("o_orderdate", "yyyy").alias("y"),
                                    "o_orderkey", "o_orderstatus")
    target = o.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    batch = o.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    merged, _ = merge.insert_ignore(target, batch, ["o_custkey", "y"], ["o_orderkey"])
    m = merged.toPandas()
    t, b = target.toPandas(), batch.toPandas()
    keys_t = set(zip(t.o_custkey, t.y))
    first = b.sort_values("o_orderkey").drop_duplicates(["o_custkey", "y"])
    new = first[[k not in keys_t for k in zip(first.o_custkey, first.y)]]
    exp = pd.concat([t, new]).sort_values(["o_custkey", "y", "o_orderkey"]).reset_index(drop=True)
    assert m.sort_values(["o_custkey", "y", "o_orderkey"]).reset_index(drop=True).equals(exp)
