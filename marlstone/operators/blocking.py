"""Candidate pairs: identifier matches and blocking rules, the first rule winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlstone.functions.similarity import length_band, with_gestalt_ratio
from marlstone.operators.rank import first_per_key

PAIR = ["source_a", "source_id_a", "source_b", "source_id_b"]
RULES = ("external_id_positive", "same_normalized_name", "same_release_year_and_similar_name", "shared_alias")
LABEL_SOURCE = "wikidata_rawg_external_id"
MIN_RATIO = 0.75


def external_id_matches(records: DataFrame, source_a: str = "rawg", source_b: str = "wikidata") -> DataFrame:
    """Hub entities (source_b) whose id for source_a is the id or slug of such an entity.

    A slug that equals another entity's id belongs to the slug's entity.  The
    pairs carry the weak label '1' with confidence 1.
    """
    left = records.where(F.col("source") == source_a).select("source_id", F.try_element_at("external_ids", F.lit(source_a)).alias("slug"))
    names = left.select(F.col("source_id").alias("name"), F.lit(1).alias("place"), "source_id").unionByName(
        left.where("slug is not null").select(F.col("slug").alias("name"), F.lit(0).alias("place"), "source_id")
    )
    names = first_per_key(names, ["name"], ["place", F.desc("source_id")]).select("name", F.col("source_id").alias("source_id_a"))
    hub = records.where(F.col("source") == source_b).select(F.col("source_id").alias("source_id_b"), F.try_element_at("external_ids", F.lit(source_a)).alias("name"))
    return hub.join(names, "name").select(
        F.lit(source_a).alias("source_a"),
        "source_id_a",
        F.lit(source_b).alias("source_b"),
        "source_id_b",
        F.lit("external_id").alias("candidate_source"),
        F.lit(LABEL_SOURCE).alias("label_source"),
        F.lit("1").alias("label_value"),
        F.lit(1.0).alias("confidence"),
    )


def pair_id(*columns: str):
    """A stable id of a pair: the MD5 of its four keys."""
    return F.md5(F.concat_ws("\u0001", *(columns or PAIR)))


def candidate_pairs(records: DataFrame, source_a: str = "rawg", source_b: str = "wikidata", *, rule: str = "all", limit: int | None = None) -> DataFrame:
    """Pairs of the two sources by identifier, equal name, year and first word, or shared alias.

    Every rule is an equi-join; a pair keeps the first rule that finds it.  Year
    and first word need a gestalt ratio of the names of at least 0.75; names whose
    lengths rule that out do not meet (bands of lengths are part of the key), and
    the ratio is computed on distinct name pairs.  ``limit`` keeps the first pairs
    by rule and key.
    """
    a = records.where(F.col("source") == source_a)
    b = records.where(F.col("source") == source_b)
    side = lambda df, s, *cols: df.select(F.col("source_id").alias(f"source_id_{s}"), *cols)
    none = F.lit(None).cast("string")
    found = []
    if rule in ("all", RULES[0]):
        found.append(external_id_matches(records, source_a, source_b).select("source_id_a", "source_id_b", F.lit(0).alias("rule"), "label_source", "label_value", "confidence"))
    if rule in ("all", RULES[1]):
        named = "name_normalized is not null and name_normalized <> ''"
        same = side(a.where(named), "a", "name_normalized").join(side(b.where(named), "b", "name_normalized"), "name_normalized")
        found.append(same.select("source_id_a", "source_id_b", F.lit(1).alias("rule"), none.alias("label_source"), none.alias("label_value"), F.lit(0.8).alias("confidence")))
    if rule in ("all", RULES[2]):
        band = length_band("name_normalized")
        left = side(a, "a", "release_year", "first_token", F.col("name_normalized").alias("name_a"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
        right = side(b, "b", "release_year", "first_token", F.col("name_normalized").alias("name_b"), band.alias("band"))
        near = left.join(right, ["release_year", "first_token", "band"])
        long, short = F.greatest(F.length("name_a"), F.length("name_b")), F.least(F.length("name_a"), F.length("name_b"))
        near = near.where(2 * short >= (MIN_RATIO - 1e-6) * (long + short))
        near = with_gestalt_ratio(near, "name_a", "name_b", "confidence", least=MIN_RATIO).where(F.col("confidence") >= MIN_RATIO)
        found.append(near.select("source_id_a", "source_id_b", F.lit(2).alias("rule"), none.alias("label_source"), none.alias("label_value"), "confidence"))
    if rule in ("all", RULES[3]):
        word = lambda df, s: side(df, s, F.explode("comparison_names").alias("alias")).where(F.regexp_like("alias", F.lit("(?i)[a-z0-9]")))
        shared = word(a, "a").join(word(b, "b"), "alias").select("source_id_a", "source_id_b").distinct()
        found.append(shared.select("*", F.lit(3).alias("rule"), none.alias("label_source"), none.alias("label_value"), F.lit(0.7).alias("confidence")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = first_per_key(every, ["source_id_a", "source_id_b"], ["rule", F.desc("confidence")])
    if limit is not None:
        best = best.orderBy("rule", "source_id_a", "source_id_b").limit(limit)
    pairs = best.select(
        F.lit(source_a).alias("source_a"),
        "source_id_a",
        F.lit(source_b).alias("source_b"),
        "source_id_b",
        F.get(F.array(*map(F.lit, RULES)), F.col("rule")).alias("candidate_source"),
        "label_source",
        "label_value",
        "confidence",
    )
    return pairs.select(pair_id().alias("pair_id"), "*")


def joined_pairs(records: DataFrame, source_a: str = "rawg", source_b: str = "wikidata", *, rules: tuple[str, ...] = (RULES[0], RULES[1], RULES[3])) -> DataFrame:
    """(pair_id, keys, rule, a, b): pairs by identifier, equal name or shared alias with both records, each pair once.

    Records are dealt by what they are blocked on, with all their columns, and
    pairs are made last: whether an earlier rule or a smaller shared alias finds
    a pair too is read off its two records, so that no pair is shuffled or
    written.  Records are unique by source and id.
    """
    matched = external_id_matches(records, source_a, source_b).select("source_id_b", F.col("source_id_a").alias("own"))
    left = records.where(F.col("source") == source_a).select(F.col("source_id").alias("source_id_a"), F.struct(*records.columns).alias("a"))
    right = records.where(F.col("source") == source_b).select(F.col("source_id").alias("source_id_b"), F.struct(*records.columns).alias("b"))
    if RULES[0] in rules:
        right = right.join(matched, "source_id_b", "left")
    else:
        right = right.withColumn("own", F.lit(None).cast("string"))
    earlier = F.col("own").eqNullSafe(F.col("source_id_a"))
    found = []
    if RULES[0] in rules:
        found.append((RULES[0], right.where("own is not null").join(left, F.col("own") == F.col("source_id_a"))))
    if RULES[1] in rules:
        named = lambda df, s: df.withColumn("name", F.nullif(f"{s}.name_normalized", F.lit(""))).where("name is not null")
        found.append((RULES[1], named(left, "a").join(named(right, "b"), "name").where(~earlier)))
        earlier = earlier | F.coalesce((F.col("a.name_normalized") == F.col("b.name_normalized")) & (F.col("a.name_normalized") != ""), F.lit(False))
    if RULES[3] in rules:
        plain = lambda x: F.regexp_like(x, F.lit("(?i)[a-z0-9]"))
        word = lambda df, s: df.withColumn("alias", F.explode(f"{s}.comparison_names")).where(plain("alias"))
        first = F.array_min(F.filter(F.array_intersect("a.comparison_names", "b.comparison_names"), plain))
        found.append((RULES[3], word(left, "a").join(word(right, "b"), "alias").where(~earlier).where(F.col("alias") == first)))
    every = None
    for rule, df in found:
        part = df.select(F.lit(source_a).alias("source_a"), "source_id_a", F.lit(source_b).alias("source_b"), "source_id_b", F.lit(rule).alias("candidate_source"), "a", "b")
        every = part if every is None else every.unionByName(part)
    return every.select(pair_id().alias("pair_id"), "*")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """(metric, key, value): pairs in all and by rule, weak positives, unlabelled confident pairs."""
    metric = lambda name, df, key=F.lit(""): df.select(F.lit(name).alias("metric"), key.cast("string").alias("key"), F.col("n").alias("value"))
    whole = pairs.agg(
        F.count("*").alias("candidate_pair_count"),
        F.count_if(F.col("label_value") == "1").alias("positive_weak_label_count"),
        F.count_if(F.col("label_value").isNull() & (F.coalesce("confidence", F.lit(0.0)) >= 0.7)).alias("manual_review_candidate_count"),
    )
    wide = whole.select(F.explode(F.create_map(*[x for c in whole.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    wide = wide.select("metric", F.lit("").alias("key"), "value")
    by = pairs.groupBy(F.coalesce("candidate_source", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
    return wide.unionByName(metric("candidate_pair_count_by_source", by, F.col("key")))
