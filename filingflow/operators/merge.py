"""Join-based merges for parquet tables (SNK-4..SNK-7, SNK-10, JN-2, JN-4, JN-8).

Parquet tables have no MERGE INTO, so every upsert flavour is expressed as
joins against the (small) batch key set:

- the big target is only ever *semi/anti joined* with the batch keys, so when
  the batch is small AQE broadcasts the keys and the target is streamed
  without a shuffle;
- the batch is reduced per key with map-side-combined aggregates before it
  meets the target (a key repeated many times in a batch costs nothing);
- rows with a null key never conflict (SQL unique-constraint semantics).

Results are new DataFrames; the caller writes them where readers of the old
table are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLACE = "replace"
KEEP_IF_NULL = "keep_if_null"


def _any_null(key_cols: list[str]) -> Column:
    c = F.lit(False)
    for k in key_cols:
        c = c | F.col(k).isNull()
    return c


def _keys(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Non-null keys of ``df``.  Only ever the build side of semi / anti
    joins, where duplicates change nothing, so no extra distinct shuffle."""
    return df.select(*key_cols).where(~_any_null(key_cols))


def skip_done(candidates: DataFrame, done: DataFrame, key_cols: list[str],
              redo: DataFrame | None = None) -> DataFrame:
    """JN-2 / SO-2 / ST-6: candidates whose key is not already done.

    ``redo`` (optional key set) re-admits done keys -- the ``delete_existing``
    path; pair it with ``delete_keys`` on the target.
    """
    d = _keys(done, key_cols)
    if redo is not None:
        d = d.join(_keys(redo, key_cols), key_cols, "left_anti")
    return candidates.join(d, key_cols, "left_anti")


def delete_keys(target: DataFrame, keys: DataFrame, key_cols: list[str]) -> DataFrame:
    """SNK-10: target without the given keys."""
    return target.join(_keys(keys, key_cols), key_cols, "left_anti")


def first_per_key(batch: DataFrame, key_cols: list[str], order_cols: list[str],
                  last: bool = False) -> DataFrame:
    """One row per non-null key: the first (or last) by ``order_cols``.

    Null-key rows pass through untouched.
    """
    cols = [c for c in batch.columns if c not in key_cols]
    pick = F.max_by if last else F.min_by
    keyed = batch.where(~_any_null(key_cols))
    red = keyed.groupBy(*key_cols).agg(pick(F.struct(*cols), F.struct(*order_cols)).alias("_r")) \
        .select(*key_cols, "_r.*")
    return red.unionByName(batch.where(_any_null(key_cols)).select(*key_cols, *cols))


def insert_ignore(target: DataFrame, batch: DataFrame, key_cols: list[str],
                  order_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """SNK-4: existing keys win, then the first batch row per key in arrival
    order.  Returns ``(merged, inserted)``."""
    present = target.join(_keys(batch, key_cols), key_cols, "left_semi").select(*key_cols)
    dedup = first_per_key(batch, key_cols, order_cols)
    inserted = dedup.join(present, key_cols, "left_anti").select(*target.columns)
    return target.unionByName(inserted), inserted


def reduce_batch(batch: DataFrame, key_cols: list[str], order_col: str,
                 rules: dict[str, str]) -> DataFrame:
    """Apply a batch's rows in ``order_col`` order per key: for ``replace``
    columns the last value wins, for ``keep_if_null`` the last non-null.
    Null-key rows pass through untouched."""
    aggs = []
    for c, rule in rules.items():
        if rule == REPLACE:
            aggs.append(F.max_by(c, order_col).alias(c))
        elif rule == KEEP_IF_NULL:
            aggs.append(F.expr(f"max_by(`{c}`, `{order_col}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c))
        else:
            raise ValueError(f"unknown rule {rule!r} for {c}")
    reduced = batch.where(~_any_null(key_cols)).groupBy(*key_cols).agg(*aggs)
    return reduced.unionByName(batch.where(_any_null(key_cols)).select(*reduced.columns))


def upsert(target: DataFrame, batch: DataFrame, key_cols: list[str],
           rules: dict[str, str], order_col: str | None = None) -> DataFrame:
    """SNK-5 / SNK-7: insert new keys, update existing ones column by column.

    ``rules`` maps every non-key column to ``replace`` (batch value, even null,
    overwrites) or ``keep_if_null`` (``coalesce(batch, old)``).  When
    ``order_col`` is given, duplicate keys in the batch are applied in that
    order (last wins); otherwise the batch must be unique per key.
    """
    value_cols = list(rules)
    b = reduce_batch(batch, key_cols, order_col, rules) if order_col else \
        batch.select(*key_cols, *value_cols)
    bkeys = _keys(batch, key_cols)
    untouched = target.join(bkeys, key_cols, "left_anti")
    old = target.join(bkeys, key_cols, "left_semi").select(
        *key_cols, *[F.col(c).alias(f"_old_{c}") for c in value_cols])
    joined = b.join(old, key_cols, "left")
    merged_cols = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if rules[c] == KEEP_IF_NULL
                   else F.col(c) for c in value_cols]
    updated = joined.select(*key_cols, *merged_cols)
    return untouched.select(*key_cols, *value_cols).unionByName(updated)


def replace_by_key(target: DataFrame, batch: DataFrame, key_cols: list[str]) -> DataFrame:
    """SNK-6: every target row of a key present in the batch is replaced by
    the batch's rows for that key (delete + insert in one result)."""
    return delete_keys(target, batch, key_cols).unionByName(batch.select(*target.columns))
