"""Changes on immutable tables: each gives the table's next state, to be written to a fresh path."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listing import latest


def merge(base: DataFrame, changes: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = (), ordinal: str | None = None) -> DataFrame:
    """Update all, insert all: rows of ``changes`` replace those with their keys; of equal keys the last wins.

    ``keep`` columns stay as the base has them (a creation time, say).  Keys compare null-safely.
    """
    columns = base.columns
    new = changes
    if ordinal:
        new = latest(changes, list(keys), [F.col(ordinal).desc()])
    new = new.select(*columns)
    on = [base[k].eqNullSafe(new[k]) for k in keys]
    if keep:
        old = base.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_old_{c}") for c in keep))
        joined = new.join(old, [new[k].eqNullSafe(old[f"_k_{k}"]) for k in keys], "left")
        new = joined.select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in columns))
        on = [base[k].eqNullSafe(new[k]) for k in keys]
    return base.join(new, on, "left_anti").unionByName(new)


def insert_missing(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns))


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true stay, also those for which it is unknown."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def update_where(base: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return base.select(*(F.when(F.coalesce(condition, F.lit(False)), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns))


#: Tables of a document from the leaves to the root: the order in which a cascade deletes.
CASCADE = ("embeddings", "chunks", "parses", "main_pointers", "ingestion_runs", "documents")
#: Which tables a scope reaches.
SCOPES = {"document": CASCADE, "parse": ("embeddings", "chunks", "parses"), "chunk": ("embeddings", "chunks"), "embeddings": ("embeddings",), "pointers": ("main_pointers",)}


def cascade_plan(tables: dict[str, DataFrame], condition: Column, scope: str = "document") -> DataFrame:
    """``step, table, n``: what a cascade would delete, in its order."""
    parts = [tables[t].agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("n")).select(F.lit(k).alias("step"), F.lit(t).alias("table"), "n") for k, t in enumerate(x for x in SCOPES[scope] if x in tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade(tables: dict[str, DataFrame], condition: Column, scope: str = "document", *, confirm: bool = False, preview: bool = True) -> dict[str, DataFrame]:
    """The tables' next states; unchanged unless confirmed and not a preview."""
    if not confirm or preview:
        return dict(tables)
    return {t: delete_where(df, condition) if t in SCOPES[scope] else df for t, df in tables.items()}


def promote(pointers: DataFrame, pointer: DataFrame, tables: dict[str, DataFrame], condition: Column, scope: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Set the main pointer, keep its creation time, and drop the versions that it supersedes."""
    merged = merge(pointers, pointer, ["collection", "doc_id", "step_type", "model_tag"], keep=["created_at"])
    return merged, cascade(tables, condition, scope, confirm=True, preview=False)


def semantic_id(step: Column, strategy: Column, size: Column, technical_id: Column) -> Column:
    return F.concat_ws("_", step, F.coalesce(strategy, F.lit("unknown")), F.coalesce(size.cast("string"), F.lit("unknown")), F.substring(technical_id, 1, 8))


def next_version(templates: DataFrame, name: str, changes: dict[str, Column]) -> DataFrame:
    """Add a version one above the highest, and make it the latest."""
    mine = templates.where(F.col("name") == name)
    new = mine.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).select(*(F.lit(name).alias(c) if c == "name" else F.lit(True).alias(c) if c == "is_latest" else F.col(c) if c == "version" else changes.get(c, F.lit(None)).alias(c) for c in templates.columns))
    return update_where(templates, F.col("name") == name, {"is_latest": F.lit(False)}).unionByName(new)


def delete_version(templates: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """Without one version (none: all), with the highest that is left as the latest."""
    gone = (F.col("name") == name) & (F.lit(True) if version is None else F.col("version") == version)
    left = delete_where(templates, gone)
    top = F.max("version").over(Window.partitionBy("name"))
    return left.withColumn("is_latest", F.when(F.col("name") == name, F.col("version") == top).otherwise(F.col("is_latest"))).select(*templates.columns)


def add_string_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def cast_owner(df: DataFrame, column: str = "user_id") -> DataFrame:
    """Owner ids as long; the job fails at the first that isn't one."""
    value = F.col(column).cast("string").try_cast("long")
    bad = F.raise_error(F.concat(F.lit(f"{column} is not an integer: "), F.col(column).cast("string")))
    return df.withColumn(column, F.when(F.col(column).isNull() | value.isNotNull(), value).otherwise(bad.cast("long")))


def restore(current: DataFrame, snapshot: DataFrame, keys: Sequence[str], scope: Column) -> DataFrame:
    """The snapshot's rows, and the current rows outside the scope that it doesn't replace."""
    outside = delete_where(current, scope)
    return outside.join(snapshot.select(*keys).distinct(), list(keys), "left_anti").select(*current.columns).unionByName(snapshot.select(*current.columns))


def unique_name(names: DataFrame, wanted: DataFrame, *, longest: int = 200) -> DataFrame:
    """``wanted, name``: the wanted name, or the first free one of it with 2, 3, ...; case doesn't count.

    The numbers taken are read off the names themselves, by stem and number of digits (a longer number leaves less
    room for the stem); the first gap among a stem's numbers is free.
    """
    taken = names.select(F.lower("name").alias("_l")).distinct()
    tail = r"(?s)^(.*) ([1-9][0-9]{0,9})$"
    numbers = taken.where(F.col("_l").rlike(tail)).select(F.regexp_extract("_l", tail, 1).alias("_stem"), F.regexp_extract("_l", tail, 2).alias("_k"))
    numbers = numbers.select("_stem", F.length("_k").alias("_digits"), F.col("_k").cast("long").alias("_k")).where("_k > 1")
    wanted = wanted.select("wanted").distinct()
    stem = lambda digits: F.substring("wanted", F.lit(1), F.lit(longest - 1) - digits)
    plain = wanted.select("wanted", F.substring("wanted", F.lit(1), F.lit(longest)).alias("_plain")).join(taken, F.lower("_plain") == taken["_l"], "left")
    each = plain.where("_l is not null").select("wanted", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("_digits")).withColumn("_stem", F.lower(stem(F.col("_digits"))))
    used = each.join(numbers, ["_stem", "_digits"]).select("wanted", "_k")
    in_order = Window.partitionBy("wanted").orderBy("_k")
    run = used.withColumn("_n", F.row_number().over(in_order) + 1).groupBy("wanted").agg((F.count_if(F.col("_k") == F.col("_n")) + 2).alias("_next"))
    out = plain.join(run, "wanted", "left").withColumn("_next", F.coalesce("_next", F.lit(2)).cast("string"))
    numbered = F.concat(stem(F.length("_next")), F.lit(" "), F.col("_next"))
    return out.select("wanted", F.when(F.col("_l").isNull(), F.col("_plain")).otherwise(numbered).alias("name"))


def clean_table_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)
