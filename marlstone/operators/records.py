"""One wide record for each entity from its long attribute tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.text import ascii_title

KEY = ["source", "source_id"]
ARRAYS = ("aliases", "genres", "themes", "platforms", "tags", "developers", "publishers", "url_types", "description_languages", "evidence_sources")


def _set(column: Column) -> Column:
    return F.array_sort(F.collect_set(column))


def _gather(entities: DataFrame, child: DataFrame | None, name: str, value: Column, where: Column | None = None) -> DataFrame:
    if child is None:
        return entities.withColumn(name, F.array().cast("array<string>"))
    rows = child if where is None else child.where(where)
    sets = rows.select(*KEY, value.alias("v")).where("v is not null").groupBy(*KEY).agg(_set(F.col("v")).alias(name))
    return entities.join(sets, KEY, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def build_records(
    entities: DataFrame,
    *,
    aliases: DataFrame | None = None,
    external_ids: DataFrame | None = None,
    genres: DataFrame | None = None,
    themes: DataFrame | None = None,
    platforms: DataFrame | None = None,
    tags: DataFrame | None = None,
    companies: DataFrame | None = None,
    descriptions: DataFrame | None = None,
    urls: DataFrame | None = None,
) -> DataFrame:
    """Entities with sorted, distinct attribute arrays and an external-id map.

    Names of attributes are compared in ASCII normal form, those without any
    character left are dropped.  The slug stands in the map under the entity's
    own source unless an external id of that source is known; of several ids of
    one source the greatest is taken.  Evidence is the own source, the sources
    of external ids, and ``wikipedia`` for sitelinks or pages.
    """
    base = entities.select(*KEY, "name", "name_normalized", F.col("release_year").cast("int").alias("release_year"), "slug")
    base = _gather(base, aliases, "aliases", ascii_title("alias") if aliases is not None else F.lit(None))
    for name, table in (("genres", genres), ("themes", themes), ("platforms", platforms), ("tags", tags)):
        base = _gather(base, table, name, ascii_title("value"))
    for role in ("developer", "publisher"):
        base = _gather(base, companies, f"{role}s", ascii_title("company_name"), F.col("company_role") == role)
    base = _gather(base, urls, "url_types", F.col("url_type"))
    if descriptions is not None:
        told = descriptions.where("description_text is not null and description_text <> ''")
        base = _gather(base, told, "description_languages", F.col("language"))
        has = told.select(*KEY).distinct().withColumn("has_description", F.lit(True))
        base = base.join(has, KEY, "left").withColumn("has_description", F.coalesce("has_description", F.lit(False)))
    else:
        base = _gather(base, None, "description_languages", F.lit(None)).withColumn("has_description", F.lit(False))
    if external_ids is not None:
        ids = external_ids.groupBy(*KEY, "external_source").agg(F.max("external_id").alias("external_id"))
        maps = ids.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("external_source", "external_id")))).alias("given"))
        base = base.join(maps, KEY, "left")
    else:
        base = base.withColumn("given", F.lit(None).cast("map<string,string>"))
    given = F.coalesce("given", F.create_map().cast("map<string,string>"))
    own = F.when(
        F.col("slug").isNotNull() & (F.col("slug") != "") & ~F.map_contains_key(given, F.col("source")), F.create_map("source", "slug")
    ).otherwise(F.create_map().cast("map<string,string>"))
    wiki = F.when(F.arrays_overlap("url_types", F.array(*map(F.lit, ("ruwiki", "enwiki", "page")))), F.array(F.lit("wikipedia"))).otherwise(
        F.array().cast("array<string>")
    )
    base = base.withColumn("evidence_sources", F.array_sort(F.array_distinct(F.concat(F.array("source"), F.map_keys(given), wiki))))
    base = base.withColumn("external_ids", F.map_concat(given, own)).drop("given")
    names = F.filter(F.array_distinct(F.concat(F.array("name_normalized"), "aliases")), lambda x: x.isNotNull() & (x != ""))
    return base.withColumns({"comparison_names": F.array_sort(names), "first_token": F.nullif(F.split_part("name_normalized", F.lit(" "), F.lit(1)), F.lit(""))})


def alias_language_counts(aliases: DataFrame) -> DataFrame:
    """Normal aliases a language (``unknown`` for none), each counted once an entity."""
    rows = aliases.select(*KEY, F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language"), ascii_title("alias").alias("alias"))
    return rows.where("alias is not null").distinct().groupBy("language").agg(F.count("*").alias("alias_count"))
