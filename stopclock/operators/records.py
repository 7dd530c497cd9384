"""Keyed record tables: merge by key, replace by group, and checks on incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
OWNER_KEYS = ("cadastral", "owner_name", "owner_id", "owner_type")
MAX_OWNER_ROWS = 100


def merge_records(
    existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None, supplied: str | None = None
) -> DataFrame:
    """Upsert by key: a supplied column replaces the stored one, others stay.

    Every incoming column counts as supplied, nulls included. With ``supplied``, an array column
    of names, each row supplies only those. Several rows of one key apply in ``order``; without an
    order they are an error.
    """
    columns = [c for c in incoming.columns if c not in (key, order, supplied)]

    def given(name: str) -> Column:
        """The value in a struct where the row supplies it, so that a supplied null is kept."""
        value = F.struct(F.col(name).alias("value"))
        return F.when(F.array_contains(supplied, name), value) if supplied else value

    def last(name: str) -> Column:
        if order is None:
            several = F.raise_error(F.lit("several incoming rows of one key need an order"))
            return F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first(given(name)))
        return F.max_by(given(name), F.when(given(name).isNotNull(), F.col(order)))

    latest = incoming.groupBy(key).agg(*[last(c).alias(f"_new_{c}") for c in columns])
    joined = existing.join(latest, key, "full_outer")

    def merged(name: str) -> Column:
        old = F.col(name) if name in existing.columns else F.lit(None)
        if name not in columns:
            return old.alias(name)
        new = F.col(f"_new_{name}")
        return F.when(new.isNotNull(), new["value"]).otherwise(old).alias(name)

    kept = [c for c in existing.columns if c != key]
    return joined.select(key, *[merged(c) for c in kept + [c for c in columns if c not in kept]])


def replace_groups(existing: DataFrame, incoming: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Deletes every stored row of the replaced keys, then inserts the incoming rows.

    Replaced are the keys of the incoming rows and those of ``keys``, so a group can also become empty.
    """
    replaced = incoming.select(key)
    replaced = (replaced if keys is None else replaced.union(keys.select(key))).distinct()
    kept = existing.join(replaced, key, "left_anti").select(*existing.columns)
    return kept.unionByName(incoming, allowMissingColumns=True)


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT<"))


def _has_text_key(value: Column) -> Column:
    code = F.try_variant_get(value, "$.cadastral", "variant")
    return F.coalesce(F.schema_of_variant(code) == "STRING", F.lit(False))


def check_owner_batches(batches: DataFrame) -> DataFrame:
    """Accepts a batch (``batch_id, body``) that is a JSON array of at most 100 rows, every one an
    object with a text ``cadastral`` and no keys beyond the four allowed.

    Output: batch_id, n_rows, accepted.
    """
    rows = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    allowed = F.array(*[F.lit(k) for k in OWNER_KEYS])

    def valid(row: Column) -> Column:
        keys = F.json_object_keys(F.to_json(row))
        known = F.coalesce(F.size(F.array_except(keys, allowed)) == 0, F.lit(False))
        return _is_object(row) & known & _has_text_key(row)

    return batches.withColumn("_rows", rows).select(
        "batch_id",
        F.size("_rows").alias("n_rows"),
        F.coalesce(
            (F.size("_rows") <= MAX_OWNER_ROWS) & F.forall("_rows", lambda r: F.coalesce(valid(r), F.lit(False))),
            F.lit(False),
        ).alias("accepted"),
    )


def check_parcels(rows: DataFrame) -> DataFrame:
    """Adds ``accepted``: the ``body`` is a JSON object with a text ``cadastral``."""
    parsed = F.try_parse_json("body")
    return rows.withColumn("accepted", F.coalesce(_is_object(parsed) & _has_text_key(parsed), F.lit(False)))
