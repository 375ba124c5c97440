"""Latest-per-key, top-k and keyed merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.plans.scratch import Scratch


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """the first row of each key in the given order.

    Spark plans the rank filter as a group limit, so every map task sends at
    most one row a key; a hot key does not meet in one task in full.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank_col: str = "rank") -> DataFrame:
    """the first ``k`` rows of each key, numbered from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def page_with_total(df: DataFrame, order: Sequence[Column | str], *, limit: int, offset: int = 0) -> DataFrame:
    """One page of rows in order, with the total before paging beside each row.

    The total is a one-row aggregate, not a window over the whole table.
    """
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # total is one row


#: Caps up to so many rows are taken by a top-k; greater ones by numbering the rows.
TOP_ROWS = 100_000


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """``df`` with the place of each row in a total order, from 1.

    Rows are dealt by ranges, numbered inside their range, and moved on by the
    rows of the ranges before (one row a range), so that no task sees them all.
    The dealt rows are written once, since both steps have to see the same ranges.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "numbered").table(ranged, "rows")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count("*").alias("__rows"))
    offsets = offsets.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = ranged.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    joined = inside.join(F.broadcast(offsets), "__part")  # one row a range
    return joined.withColumn(name, (F.col("__before") + F.col(name)).cast("bigint")).drop("__part", "__before")


def cap_rows(df: DataFrame, order: Sequence[Column | str], cap: int | None) -> DataFrame:
    """the first ``cap`` rows in order; None keeps all."""
    if cap is None:
        return df
    if cap <= TOP_ROWS:
        return df.orderBy(*order).limit(cap)
    return numbered(df, order, "__n").where(F.col("__n") <= cap).drop("__n")


Rule = Callable[[Column, Column], Column]


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def take_new(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep_greatest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def keep_least(old: Column, new: Column) -> Column:
    return F.least(old, new)


def merge_on_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Rule]) -> DataFrame:
    """Upsert: rows of either side, columns of rows in both settled by their rule.

    Columns without a rule take the new side's value, null included, where the
    new side has the row.  Keys are compared null-safe; ``new`` has to be unique
    on them.
    """
    left, right = old.alias("o"), new.alias("n")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    left = old.withColumn("__old", F.lit(True)).alias("o")
    right = new.withColumn("__new", F.lit(True)).alias("n")
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            out.append(F.when(F.col("o.__old"), a).otherwise(b).alias(c))
        elif c in rules:
            both = F.col("o.__old") & F.col("n.__new")
            out.append(F.when(both, rules[c](a, b)).when(F.col("n.__new"), b).otherwise(a).alias(c))
        else:
            out.append(F.when(F.col("n.__new"), b).otherwise(a).alias(c))
    return left.join(right, match, "full_outer").select(*out)


def replace_on_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those rows of ``old`` whose key is not in it."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merge_candidate_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rule and labels win over new ones; the greater confidence stays."""
    rules = {
        "pair_id": keep_old,
        "candidate_source": keep_old,
        "label_source": keep_old,
        "label_value": keep_old,
        "confidence": lambda o, n: F.greatest(F.coalesce(o, F.lit(0.0)), F.coalesce(n, F.lit(0.0))),
    }
    return merge_on_keys(old, new, ["source_a", "source_id_a", "source_b", "source_id_b"], rules)


def merge_search_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """The smaller rank stays, text and strategy follow the smaller or equal rank."""
    lead = F.col("n.search_rank") <= F.col("o.search_rank")
    rules = {
        "search_rank": keep_least,
        "query_text": lambda o, n: F.when(lead, n).otherwise(o),
        "query_strategy": lambda o, n: F.when(lead, n).otherwise(o),
        "confidence": keep_greatest,
    }
    return merge_on_keys(old, new, ["source_name", "source_game_id", "igdb_id"], rules)


def delete_rows(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows that the condition does not hold for (null keeps); None deletes all."""
    return df.limit(0) if condition is None else df.where(~F.coalesce(condition, F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")
