"""Mixing sources to target weights.

Word counts are summed per source; the budget is dealt to the sources by
weight, each source stopping at ``cap`` times its size and the excess going to
the others by weight (computed in closed form by sorting sources by cap over
weight).  A document is then taken floor(rate) times plus one hash-seeded
Bernoulli copy with probability equal to the fraction.

Digests of the document's id give ``DRAWS`` draws of 32 bits that share none of
them.  Each source uses the draw whose total lies nearest its target, found in
the same kind of aggregation; that keeps a source of few, long documents near
its target and depends on nothing but ids, sizes and the seed.  A copy's
probability is the fraction in every single draw; after the choice it is so only
nearly, as totals far from the target are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.llm.carry import original_columns, packed
from marlstone.plans.scratch import Scratch

SPACED = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
#: Draws of 32 bits, eight to a SHA-256.
DRAWS = 32
SEED = "mix"
#: Per-source figures are broadcast for up to so many sources (under 100 bytes each).
BROADCAST_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(SPACED), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> plus (target); one row per source, null a source of its own."""
    # Byte order of UTF-8 is code point order.  The tables here have one row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))))
    every = Window.orderBy(F.col("full") / F.col("weight"), F.col("rank"))
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight.cast("long"))
        .withColumn("full", F.col("source_size") * F.lit(cap))
        .withColumn("total", total)
        .withColumn("spent", F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") * F.lit(budget) - F.col("spent")) / F.col("left_weight"))
    )
    # The first source (in order) that is not filled to its cap sets the level for it and all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("full_by_weight", "rank", "level")))
    filled = filled.withColumn("full_by_weight", F.col("full") / F.col("weight"))
    level = level.over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("level", level["level"]).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("full").cast("double"), F.col("level") * F.col("weight")), F.col("full").cast("double")).alias("target"),
    )


def digest(doc_id: Column, seed: str, number: int | Column) -> Column:
    """Hex digest that holds draws ``8 * number`` to ``8 * number + 7`` of a document."""
    number = F.lit(number) if isinstance(number, int) else number
    return F.sha2(F.concat(F.lit(f"{seed}:"), number.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def draw(of: Column, k: int | Column) -> Column:
    """The k-th uniform draw in [0, 1) of a digest."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.conv(F.substring(of, k * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def _rates(sized: DataFrame, scratch: Scratch, seed: str, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """(of, source_size, target, rate, k) of each source, from (doc_id, source, size) rows."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    small = scratch.table(source_targets(sizes, weights, budget, cap).withColumn("rate", rate).withColumnsRenamed({"source": "of"}), "targets")
    # Which draw comes nearest: sums per source, combined map-side.
    joined = sized.where("size > 0").join(_near(small), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumns({f"d{j}": digest(F.col("doc_id"), seed, j) for j in range(DRAWS // 8)})
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(draw(F.col(f"d{k // 8}"), k % 8) < part, F.col("size")).otherwise(0)).alias(f"e{k}") for k in range(DRAWS)]
    miss = [F.struct(F.abs(F.col("source_size") * whole + F.col(f"e{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k")) for k in range(DRAWS)]
    figures = [F.first(c).alias(c) for c in ("source_size", "target", "rate")]
    best = joined.groupBy("source").agg(*figures, *extra).select("source", F.array_min(F.array(*miss))["k"].alias("k"))
    chosen = small.join(best, F.col("of").eqNullSafe(F.col("source")), "left").select("of", "source_size", "target", "rate", F.coalesce("k", F.lit(0)).alias("k"))
    return scratch.table(chosen, "chosen")


def _near(side: DataFrame) -> DataFrame:
    """A written table of one row a source, broadcast if it is small."""
    return F.broadcast(side) if side.count() <= BROADCAST_SOURCES else side


def _copies(rows: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source and others) with source_size, target and copies."""
    value = draw(digest(F.col("doc_id"), seed, F.floor(F.col("k") / 8)), F.pmod(F.col("k"), F.lit(8)))
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    joined = rows.join(_near(rates), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", (whole + F.when(value < part, 1).otherwise(0)).cast("long")).drop("of", "k", "rate")


def _sized(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size), written: texts are counted once."""
    return scratch.table(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size")), "sized")


def mix(
    documents: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), one row per input row.

    ``taken`` is ``size * copies``; ``mixed_documents`` turns the counts into
    rows.  Sources are ranked by code point, null last and a source of its own,
    and weigh ``weights`` in turn.  Null, empty or blank texts have size 0 and
    take no words.  Rows that repeat an id are drawn alike; a null id draws as
    the text ''.  A source of size 0 has target 0.  Other columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    sized = _sized(documents, scratch)
    drawn = _copies(sized, _rates(sized, scratch, seed, weights, budget, cap), seed)
    return drawn.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(
    documents: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    cap: int = CAP,
    seed: str = SEED,
    copy_col: str = "copy",
) -> DataFrame:
    """The rows of ``documents`` as often as ``mix`` takes them, numbered from 1 in ``copy_col``."""
    scratch = Scratch(documents.sparkSession, "mix")
    rates = _rates(_sized(documents, scratch), scratch, seed, weights, budget, cap)
    drawn = _copies(packed(documents).withColumn("source", F.col("rest.source")), rates, seed)
    rows = drawn.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*original_columns(documents), F.col("nth").alias(copy_col))
