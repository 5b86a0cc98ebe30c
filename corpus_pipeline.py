"""From raw documents to tokens: five stages, applied one after the other.

Every stage is (spark, docs, sf_dir) -> DataFrame.  ``run`` writes each result
as Parquet in the shared folder and gives the reread table to the next stage.
All stages but the last return the columns of ``documents``, any others among
them; names that clash with an operator's own are no matter.

1. ``quality``: documents that the quality classifier rejects go, among them
   texts that are null or have no words.
2. ``near-dedup``: one document of each group of near duplicates stays, the one
   with the least id.  Rows equal in id and text are one document; texts that
   share an id are documents of their own.  Documents without an id are linked
   with nothing and stay.
3. ``suffix-dedup``: strings of 200 bytes or more that occur again are removed
   from all texts that hold them; characters that are cut in part go as well,
   others stay, and ``n_chars`` is counted anew.  Documents without a word left go.
4. ``decontamination``: documents that leak a benchmark item go.
5. ``tokens``: the texts become token ids, with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm import bpe_rank_queue, latent_decontamination, near_duplicates, quality_bayes, suffix_dedup
from filingflow.llm.store import Scratch


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and text, and all columns but text as one: names that an operator uses can't clash."""
    rest = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text")).alias("row")
    return docs.select(*names, "text", rest)


def _unpacked(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs``, text and those given anew."""
    new = {"text": F.col("text"), **new}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_bayes.train(docs.select("doc_id", "text"), labels, "doc_id", "text", "quality")
    return _unpacked(quality_bayes.score(_packed(docs, "source", "lang"), model, "text", "source", "lang").where("keep"), docs)


def _numbers(scratch: Scratch, several: DataFrame, single: DataFrame) -> Column:
    """A hash of id and text that differs for all rows of ``several`` and from the numbers of ``single``."""
    for seed in range(100):
        number = F.xxhash64(F.lit(seed), "doc_id", "text")
        used = scratch.put(several.select(number.alias("vertex")), f"numbers{seed}")
        apart = used.groupBy("vertex").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and used.join(single, "vertex", "left_semi").isEmpty()
        scratch.drop(f"numbers{seed}")
        if apart:
            return number
    raise ValueError("no hash tells the texts that share an id apart")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch, rows = Scratch(spark, "near-dedup"), _packed(docs, "doc_id")
    named, nameless = rows.where("doc_id is not null"), docs.where("doc_id is null")
    shared = scratch.put(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        kept = near_duplicates.near_duplicates(named, "doc_id", "text").where("kept").select("doc_id")
        return _unpacked(named.join(kept, "doc_id", "left_semi"), docs).unionByName(nameless)
    # texts that share an id get numbers of their own; of a group the one with the least id stays, then with the least number
    single = named.join(shared, "doc_id", "left_anti").withColumn("vertex", F.col("doc_id").cast("long"))
    several = named.join(shared, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min("row").alias("row"))
    vertices = scratch.put(single.unionByName(several.select("doc_id", "text", "row", _numbers(scratch, several, single).alias("vertex"))), "vertices")
    component = near_duplicates.near_duplicates(vertices, "vertex", "text").select("vertex", "component_id")
    order = F.struct("doc_id", "vertex")
    kept = component.join(vertices.select("doc_id", "vertex"), "vertex").groupBy("component_id").agg(F.min(order).alias("first")).select("first.vertex")
    return _unpacked(vertices.join(kept, "vertex", "left_semi"), docs).unionByName(nameless)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_packed(docs, "doc_id"), "doc_id", "text", characters=True)
    cut = F.size("spans") > 0
    out = out.withColumn("text", F.make_valid_utf8(F.col("kept_bytes").cast("string"))).where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(cut, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _unpacked(out, docs, n_chars=n_chars)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _packed(docs).withColumn("text_key", F.xxhash64("text"))  # equal texts, with an id or without, share their verdict
    leaking = latent_decontamination.leaks(keyed, benchmark, "text_key", "text").select("text_key").distinct()
    return _unpacked(keyed.join(leaking, "text_key", "left_anti"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_rank_queue.encode(docs, path, public_tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("near-dedup", near_dedup), ("suffix-dedup", suffix_array_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: Sketches, byte-level suffix matching and rank merges are beyond SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
