"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A document's set holds the hashes of its distinct word shingles.  The sketch
(Dahlgaard, Knudsen and Thorup, 2017) has ``COORDINATES`` bins.  In round i
every element is hashed to one bin with a value in [i, i + 1), and a bin keeps
its least value; rounds go on until no bin is empty, and from round
``COORDINATES`` on all elements go to the bin that the round names, so every
bin fills.  Equal coordinates estimate the Jaccard similarity with the
concentration of sampling without replacement.

``ROWS`` coordinates make a band.  A pair at the threshold of 0.75 misses all
bands with probability (1 - 0.75^4)^32, about 5 in a million.

Groups of copies are never expanded into pairs:

1. equal sets are one representative, found by a grouped minimum of a 128-bit
   digest of the set;
2. in each band bucket all representatives are checked against two hubs, the
   least id and the least mixed id, on the full sets; links found that way are
   merged into components;
3. in large buckets that still have several components all members are checked
   against a third hub, the member with the least share of rare elements, and
   merged again;
4. only pairs of one bucket that are still in different components are checked
   after that.  In a large bucket, two members that share a rare element meet
   by that element, which only few have; others are paired only if their sets
   without the rare elements could reach the threshold.  One-bit sketches rule
   out more.

So every pair that shares a bucket is either in one component, checked exactly,
or excluded: by a bound, or by 128 one-bit coordinates (more than 5.5 standard
deviations below what a pair at the threshold has).  A bucket is joined with
itself on its key, which Spark's skew splitting deals out; none is capped.

Defined results: null or empty texts, and texts without words, have no set and
are linked with nothing; rows without an id neither, and are kept; rows that
share an id are one vertex; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm.components import components
from filingflow.llm.store import Scratch
from filingflow.llm.textblocks import LOWER, blocks, mix, prefix_hash, span_hash, word_spans

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: One-bit coordinates that must agree: 128 * (1 + 0.75) / 2 = 112 are expected at the threshold, with deviation 3.7.
AGREEING_BITS = 91
#: Buckets of more members are large; an element is rare among their members if at most RARE have it.
SMALL, RARE = 32, 16
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of the distinct shingles, sorted by text and hash."""
    buf = LOWER[buf]
    start, end, owner = word_spans(buf, offs)
    word = span_hash(prefix_hash(buf), start, end)
    per_text = np.bincount(owner, minlength=len(offs) - 1)
    first = np.cumsum(per_text) - per_text
    long = per_text >= words
    # a shingle starts at each word that has words - 1 more after it in its text
    ok = np.flatnonzero((np.arange(len(word)) - first[owner] + words <= per_text[owner])) if len(word) else np.empty(0, np.int64)
    h = np.full(len(ok), words, np.uint64)
    for k in range(words):
        h = mix(h + word[ok + k], k + 1)
    hashes, texts = [h], [owner[ok]]
    for t in np.flatnonzero(~long & (per_text > 0)):
        x = np.array([per_text[t]], np.uint64)
        for k in range(per_text[t]):
            x = mix(x + word[first[t] + k:first[t] + k + 1], k + 1)
        hashes.append(x)
        texts.append(np.array([t]))
    h, t = np.concatenate(hashes), np.concatenate(texts)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def sketches(h: np.ndarray, t: np.ndarray, texts: int) -> np.ndarray:
    """texts x COORDINATES; every coordinate of a text with elements is filled."""
    out = np.full(texts * COORDINATES, _EMPTY)
    bits = np.uint64(64 - COORDINATES.bit_length() + 1)
    for i in range(2 * COORDINATES):
        x = mix(h, i + 11)
        place = (x >> bits).astype(np.int64) if i < COORDINATES else np.int64(i - COORDINATES)
        value = (np.uint64(i) << np.uint64(56)) | ((x << np.uint64(7)) >> np.uint64(8))
        np.minimum.at(out, t * COORDINATES + place, value)
        open_ = (out.reshape(texts, COORDINATES) == _EMPTY).any(1)
        left = open_[t]
        h, t = h[left], t[left]
        if not len(h):
            break
    return out.reshape(texts, COORDINATES)


def _summaries(id_col: str, text_col: str, words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(id_col)
            for a, b, buf, offs in blocks(batch.column(text_col)):
                h, t = shingle_sets(buf, offs, words)
                n = np.bincount(t, minlength=b - a)
                s = sketches(h, t, b - a)
                band = np.zeros((b - a, BANDS), np.uint64)
                for k in range(ROWS):
                    band = mix(band + s[:, k::ROWS], k + 1)
                band = mix(band + np.arange(BANDS, dtype=np.uint64), 9)
                one_bit = np.packbits((mix(s, 5) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                digest = np.zeros((2, b - a), np.uint64)
                has = np.flatnonzero(n)
                if len(has):
                    first = (np.cumsum(n) - n)[has]
                    for k in range(2):
                        digest[k, has] = np.add.reduceat(mix(h, 77 + k), first)
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(d.view(np.int64)) for d in digest), *(pa.array(one_bit[:, k]) for k in range(2)),
                     pa.ListArray.from_arrays(cuts, pa.array(band[n > 0].ravel().view(np.int64)))],
                    ["id", "n", "d1", "d2", "b1", "b2", "bands"])
    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for a, b, buf, offs in blocks(batch.column("text")):
                h, t = shingle_sets(buf, offs, words)
                cuts = pa.array(np.searchsorted(t, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64)))], ["id", "s"])
    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    a = sets.select(F.col("id").alias("u"), F.col("s").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _mixed(side: DataFrame, forest: DataFrame) -> DataFrame:
    """The members of buckets that have several components, with component c and the size of the bucket."""
    side = side.join(forest.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = side.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low < high")
    return side.join(mixed.select("band", "key", "size"), ["band", "key"])


def _rare(sets: DataFrame) -> DataFrame:
    """(id, e): the elements that RARE of the sets have at most."""
    elements = sets.select("id", F.explode("s").alias("e"))
    return elements.join(elements.groupBy("e").agg(F.count("*").alias("times")).where(F.col("times") <= RARE).select("e"), "e").select("id", "e")


def _common(sets: DataFrame, rare: DataFrame) -> DataFrame:
    """(id, n, m): elements of each set, and those that are not rare; null for an id with several sets."""
    sizes = sets.groupBy("id").agg(F.count("*").alias("times"), F.max(F.size("s")).alias("n"))
    own = rare.groupBy("id").agg(F.count("*").alias("own"))
    one = F.col("times") == 1
    return sizes.join(own, "id", "left").select("id", F.when(one, F.col("n")).alias("n"), F.when(one, F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))


def _with_sizes(side: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bucket members with n, m and all bands, if there are any; joined once per id, not once per bucket."""
    buckets = side.groupBy("id").agg(F.collect_list(F.struct(*(c for c in side.columns if c != "id"))).alias("buckets"))  # BANDS a set
    return buckets.join(sizes, "id", "left").select("id", "n", "m", "bands", F.inline("buckets"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    scratch = Scratch(df.sparkSession, "near-duplicates")
    rows = scratch.put(df.select(id_col, text_col).mapInArrow(_summaries(id_col, text_col, words), f"id long, n long, d1 long, d2 long, b1 long, b2 long, bands array<long>"), "rows")
    # 1. equal sets
    with_set = rows.where("n > 0 and id is not null")
    first = with_set.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    copies = with_set.select("id", "d1", "d2", "n").join(first, ["d1", "d2", "n"]).where("id > rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = with_set.join(first.select("d1", "d2", "n", F.col("rep").alias("id")), ["d1", "d2", "n", "id"], "left_semi").dropDuplicates(["id", "d1", "d2"])
    members = reps.select("id", "b1", "b2", F.posexplode("bands").alias("band", "key"))
    hubs = members.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.min(F.struct(F.xxhash64("id").alias("x"), "id")).alias("second")).where("hub < last")
    shared = scratch.put(members.join(hubs.select("band", "key", "hub", F.col("second.id").alias("second")), ["band", "key"]), "buckets")
    # 2. hubs
    candidates = shared.select("id").distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = scratch.put(texts.join(candidates, "id").mapInArrow(_sets(words), "id long, s array<long>"), "sets")
    pairs = shared.select("id", F.explode(F.array("hub", "second")).alias("v")).where("id <> v").select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()
    links = scratch.put(_linked(pairs, sets, percent), "hub-links")
    forest = scratch.put(components(links, Scratch(df.sparkSession, "near-duplicates-hubs")), "forest")
    # 3. central hubs of large buckets that still have several components
    mixed = scratch.put(_mixed(shared.select("band", "key", "id", "b1", "b2"), forest), "mixed")
    in_large = sets.join(mixed.where(F.col("size") > SMALL).select("id").distinct(), "id")
    rare = scratch.put(_rare(in_large), "rare")
    sizes = _common(in_large, rare).join(reps.select("id", "bands"), "id")
    sizes = scratch.put(sizes.withColumn("bands", F.when(F.col("n").isNotNull(), F.col("bands"))).dropDuplicates(["id"]), "common")
    large = _with_sizes(mixed.where(F.col("size") > SMALL), sizes)
    centre = large.groupBy("band", "key").agg(F.max(F.struct(F.coalesce(F.col("m") / F.col("n"), F.lit(0.0)).alias("x"), (-F.col("id")).alias("y"))).alias("centre"))
    pairs = large.join(centre, ["band", "key"]).select("id", (-F.col("centre.y")).alias("v")).where("id <> v").select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()
    links = forest.unionByName(_linked(pairs, sets, percent))
    forest2 = scratch.put(components(links, Scratch(df.sparkSession, "near-duplicates-centres")), "forest2")
    # 4. what is left between components
    side = scratch.put(_with_sizes(_mixed(mixed.drop("c", "size"), forest2), sizes), "rest")
    x, y = (side.select("band", "key", "size", *(F.col(c).alias(c + e) for c in ("id", "b1", "b2", "c", "n", "m", "bands"))) for e in "xy")
    differing = F.bit_count(F.col("b1x").bitwiseXOR(F.col("b1y"))) + F.bit_count(F.col("b2x").bitwiseXOR(F.col("b2y")))
    most = F.least("mx", "my")  # bounds the intersection of sets that share no rare element
    possible = F.when(F.col("size") > SMALL, 100 * most >= percent * (F.col("nx") + F.col("ny") - most))
    # a pair of large buckets meets in the first band it shares
    earlier = F.exists(F.zip_with(F.slice("bandsx", F.lit(1), F.col("band")), F.slice("bandsy", F.lit(1), F.col("band")), lambda a, b: a == b), lambda equal: equal)
    first = F.coalesce(~earlier, F.lit(True))
    in_bucket = x.join(y.drop("size"), ["band", "key"]).where((F.col("cx") > F.col("cy")) & F.coalesce(possible, F.lit(True)) & (differing <= COORDINATES - AGREEING_BITS) & first)
    of_large = rare.join(side.where(F.col("size") > SMALL).select("id", "c").distinct(), "id")
    x, y = (of_large.select("e", F.col("id").alias("id" + k), F.col("c").alias("c" + k)) for k in "xy")
    by_element = x.join(y, "e").where("cx > cy")  # at most RARE sets an element
    rest = in_bucket.select("idx", "idy").unionByName(by_element.select("idx", "idy")).select(F.greatest("idx", "idy").alias("u"), F.least("idx", "idy").alias("v")).distinct()
    more = _linked(rest, sets, percent)
    final = components(forest2.unionByName(more).unionByName(copies), Scratch(df.sparkSession, "near-duplicates-all"))
    out = rows.select("id", "n").join(final.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left")
    component = F.coalesce("c", "id")
    out = scratch.put(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")), "out")
    scratch.drop("rows", "buckets", "sets", "hub-links", "forest", "mixed", "rare", "common", "forest2", "rest")
    return out


def op8_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, "doc_id", "text")
