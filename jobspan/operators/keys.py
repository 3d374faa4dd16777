"""First row per key and lookups, written so that one hot key does not end in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ids(df: DataFrame, keys: list[str], order: list[str | Column], row_id: str) -> DataFrame:
    """Keys and the id of the first row of each, by (order, id). An aggregate, so it combines before the shuffle; by id
    alone it is a hash aggregate."""
    if not order:
        return df.groupBy(*keys).agg(F.min(row_id).alias(row_id))
    best = F.min(F.struct(*order, F.col(row_id).alias("__id"))).alias("__first")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("__first.__id").alias(row_id))


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column], row_id: str) -> DataFrame:
    """Whole first row of every key. Only ids and order columns are aggregated; the rows are fetched by their unique
    id, which spreads evenly whatever the keys look like."""
    return df.join(first_ids(df, keys, order, row_id).select(row_id), row_id, "left_semi")


def carry_forward(df: DataFrame, value: str, out: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds the last value that is not null up to each row. ``by`` are small groups, such as the lines of a text."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def salted_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], how: str = "left",
                  salts: int = 16) -> DataFrame:
    """Join to a table unique on ``keys`` when few keys may hold most rows: every key is spread over ``salts`` tasks.

    The rows' keys are made distinct first, and only the part of the table that they need is copied, however large it is.
    """
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    needed = lookup.join(df.select(*keys).distinct(), keys, "left_semi")
    right = needed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def optional_lookup(df: DataFrame, lookup: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join to a table unique on ``key`` where many rows have no key; those rows spread by their id instead of
    meeting in the task of the null key."""
    own = F.concat(F.lit("\x00"), F.col(row_id).cast("string"))
    left = df.withColumn("__key", F.coalesce(F.col(key).cast("string"), own))
    right = lookup.withColumn("__key", F.col(key).cast("string")).drop(key)
    return left.join(right, "__key", "left").drop("__key")


def _flagged(df: DataFrame, known: DataFrame, key: str, row_id: str | None) -> DataFrame:
    """Rows with ``__known``: a salted lookup of their key, so a key that a third of the rows share is no task of its own, and rows
    without a key are spread like any other. Rows are spread by ``row_id``; without one by all that they hold, which reads and moves
    all of it, texts too."""
    spread = [row_id] if row_id else [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    keys = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__known", F.lit(True))
    return salted_lookup(df, keys, [key], spread)


def known_only(df: DataFrame, known: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
    return _flagged(df, known, key, row_id).where(F.col("__known")).select(*df.columns)


def unknown_only(df: DataFrame, known: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
    """Rows whose key is not known yet (a null key counts as unknown)."""
    return _flagged(df, known, key, row_id).where(F.col("__known").isNull()).select(*df.columns)


def unknown_in_source(df: DataFrame, stored: DataFrame, source: str, key: str = "link", row_id: str | None = None) -> DataFrame:
    """Rows not stored yet under one source."""
    return unknown_only(df, stored.where(F.col("source") == source), key, row_id)


def without_known_candidates(df: DataFrame, known: DataFrame, row_id: str, candidates: str, key: str) -> DataFrame:
    """Rows none of whose candidate keys is known."""
    pairs = df.select(row_id, F.explode(candidates).alias(key)).distinct()
    return df.join(known_only(pairs, known, key).select(row_id).distinct(), row_id, "left_anti")


def merge_named(curated: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """Both lists by key; the curated name wins. Sorted by the key in lower case."""
    a = curated.groupBy(key).agg(F.min(name).alias("__a"))
    b = found.groupBy(key).agg(F.min(name).alias("__b"))
    return (
        a.join(b, key, "full_outer").select(key, F.coalesce("__a", "__b").alias(name)).orderBy(F.lower(key), key)
    )


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Table plus those rows whose key it lacks. ``rows`` is unique on the key."""
    return table.unionByName(unknown_only(rows, table, key), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str, update: list[str]) -> DataFrame:
    """New keys are added whole; for present ones only the ``update`` columns change."""
    new = rows.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in rows.columns if c != key])
    old = table.withColumn("__old", F.lit(True))
    both = old.join(new, key, "full_outer")
    out = [F.col(key)]
    for c in table.columns:
        if c == key:
            continue
        if c not in rows.columns:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c))
    return both.select(*out)


def new_keys(found: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys found but not existing, sorted."""
    return found.select(key).distinct().join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti").orderBy(key)


def apply_updates(base: DataFrame, updates: DataFrame, key: str, cols: list[str], only_found: bool = False
                  ) -> DataFrame:
    """Base with the columns of the updates, by key (unique in both); ``only_found`` keeps old values where the new
    one is null."""
    new = updates.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__n_{c}") for c in cols])
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    both = base.join(new, key, "left")
    changed = {
        c: (F.coalesce(F.col(f"__n_{c}"), F.col(c)) if only_found
            else F.when(hit, F.col(f"__n_{c}")).otherwise(F.col(c)))
        for c in cols
    }
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in base.columns])
