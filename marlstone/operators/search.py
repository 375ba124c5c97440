"""Seeds for searches of another source, and their results as candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.dates import epoch_release_date
from marlstone.functions.scoring import search_confidence
from marlstone.functions.text import Text, as_column, slug_title, unicode_title
from marlstone.operators.rank import first_per_key, numbered


def search_queries(name: Text, slug: Text, aliases: Text, alias_limit: int = 2) -> Column:
    """Array of (query_text, query_strategy): name, slug words, aliases; one for each normal form."""
    row = lambda text, strategy: F.struct(F.trim(text).alias("query_text"), F.lit(strategy).alias("query_strategy"))
    taken = F.slice(F.coalesce(as_column(aliases), F.array().cast("array<string>")), 1, max(0, alias_limit))
    every = F.concat(F.array(row(as_column(name), "source_name"), row(slug_title(slug), "rawg_slug")), F.transform(taken, lambda a: row(a, "wikidata_alias")))
    usable = F.filter(every, lambda q: F.coalesce(q["query_text"] != "", F.lit(False)) & unicode_title(q["query_text"]).isNotNull())
    forms = F.transform(usable, lambda q: unicode_title(q["query_text"]))
    return F.filter(usable, lambda q, i: F.array_position(forms, unicode_title(q["query_text"])) == i + 1)


def linked_aliases(entities: DataFrame, external_ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source_id, aliases): hub aliases of the entities that a hub id names by slug.

    Aliases are distinct by normal form, in the order of hub id and alias.
    """
    slugs = entities.where("source = 'rawg'").select("source_id", F.trim("slug").alias("slug")).where("slug <> ''")
    hub = external_ids.where("source = 'wikidata' and external_source = 'rawg'").select(F.col("source_id").alias("hub"), F.trim("external_id").alias("slug"))
    named = aliases.where("source = 'wikidata'").select(F.col("source_id").alias("hub"), F.trim("alias").alias("alias"), unicode_title("alias").alias("form")).where("form is not null")
    rows = first_per_key(slugs.join(hub, "slug").join(named, "hub"), ["source_id", "form"], ["hub", "alias"])
    packed = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("hub", "alias"))).alias("x"))
    return packed.select("source_id", F.transform("x", lambda r: r["alias"]).alias("aliases"))


def search_seeds(
    entities: DataFrame,
    external_ids: DataFrame,
    aliases: DataFrame,
    existing: DataFrame | None = None,
    *,
    limit: int | None = None,
    alias_limit: int = 2,
    unmatched_only: bool = False,
    missing_only: bool = False,
) -> DataFrame:
    """Entities to search for, with their queries, by priority, date and id.

    ``unmatched_only`` leaves out those that the hub links, ``missing_only``
    those with candidates already; both are semi or anti joins on keys.
    """
    rows = entities.where("source = 'rawg' and trim(source_id) <> '' and trim(name) <> ''")
    linked = external_ids.where("source = 'wikidata' and external_source = 'rawg'").select(F.trim("external_id").alias("slug")).where("slug <> ''").distinct()
    rows = rows.withColumn("slug", F.nullif(F.trim("slug"), F.lit("")))
    rows = rows.join(linked.withColumn("matched_to_wikidata", F.lit(True)), "slug", "left").withColumn("matched_to_wikidata", F.coalesce("matched_to_wikidata", F.lit(False)))
    if unmatched_only:
        rows = rows.where("not matched_to_wikidata")
    if missing_only and existing is not None:
        rows = rows.join(existing.where("source_name = 'rawg'").select(F.col("source_game_id").alias("source_id")).distinct(), "source_id", "left_anti")
    rows = rows.join(linked_aliases(entities, external_ids, aliases), "source_id", "left")
    rows = rows.withColumn("queries", search_queries("name", "slug", "aliases", alias_limit)).where(F.size("queries") > 0)
    ordered = rows.orderBy(F.desc(F.coalesce("source_priority", F.lit(0))), F.coalesce(F.col("release_date").cast("string"), F.lit("")), "source_id")
    ordered = ordered.select("source", "source_id", "name", "slug", "release_year", "matched_to_wikidata", "queries")
    return ordered if limit is None else ordered.limit(limit)


def attempted_ids(raw: DataFrame, column: str = "response_json") -> DataFrame:
    """Ids of anchors that were searched for already."""
    anchor = lambda k: F.trim(F.get_json_object(column, f"$.anchor.{k}"))
    return raw.where((anchor("source") == "rawg") & (anchor("source_game_id") != "")).select(anchor("source_game_id").alias("source_id")).distinct()


ENVELOPE = (
    "anchor struct<source:string,source_game_id:string,name:string,slug:string,release_year:string,matched_to_wikidata:boolean>, "
    "query struct<text:string,strategy:string,rank:string>, candidate struct<id:string,name:string,slug:string,first_release_date:string>"
)


def search_candidates(raw: DataFrame, column: str = "response_json") -> DataFrame:
    """The least-ranked result of each (anchor, candidate), the first one on ties.

    ``raw`` has the envelope as JSON, ``request_hash`` and an order column
    ``seq``.  Envelopes without ids, text, strategy or a positive rank are left
    out.
    """
    rows = raw.withColumn("e", F.from_json(column, ENVELOPE))
    text = lambda c: F.trim(F.col(c))
    year = epoch_release_date("e.candidate.first_release_date")["year"]
    rank, anchor_year = F.col("e.query.rank").try_cast("int"), F.col("e.anchor.release_year").try_cast("int")
    flat = rows.select(
        text("e.anchor.source").alias("source_name"),
        text("e.anchor.source_game_id").alias("source_game_id"),
        F.lit("igdb").alias("candidate_source"),
        text("e.candidate.id").alias("igdb_id"),
        rank.alias("search_rank"),
        text("e.query.text").alias("query_text"),
        text("e.query.strategy").alias("query_strategy"),
        search_confidence(rank, text("e.query.strategy"), anchor_year, year).alias("confidence"),
        F.struct(
            F.col("e.anchor.name").alias("anchor_name"), F.col("e.anchor.slug").alias("anchor_slug"), anchor_year.alias("anchor_release_year"),
            F.coalesce("e.anchor.matched_to_wikidata", F.lit(False)).alias("matched_to_wikidata"), F.col("e.candidate.name").alias("candidate_name"),
            year.alias("candidate_release_year"), F.col("e.candidate.slug").alias("candidate_slug"), F.col("request_hash").alias("retrieved_from_request_hash"),
        ).alias("metadata"),
        "seq",
    )
    usable = flat.where(
        "source_name <> '' and source_game_id <> '' and igdb_id <> '' and query_text <> '' and query_strategy <> '' and search_rank > 0"
    )
    return first_per_key(usable, ["source_name", "source_game_id", "igdb_id"], ["search_rank", "seq"]).drop("seq")


def candidates_as_pairs(candidates: DataFrame) -> DataFrame:
    """Search results as unlabelled pairs of the search lane."""
    return candidates.select(
        F.col("source_name").alias("source_a"), F.col("source_game_id").alias("source_id_a"), F.lit("igdb").alias("source_b"), F.col("igdb_id").alias("source_id_b"),
        F.lit("igdb_search").alias("candidate_source"), F.lit(None).cast("string").alias("label_source"), F.lit(None).cast("string").alias("label_value"), "confidence",
    )


def candidate_summary(candidates: DataFrame, *keys: str) -> DataFrame:
    """Candidates, anchors and rank and confidence figures by source, strategy or rank."""
    return candidates.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"),
        F.count_distinct("source_game_id").alias("anchor_count"),
        F.round(F.avg("search_rank"), 6).alias("avg_search_rank"),
        F.min("search_rank").alias("min_search_rank"),
        F.max("search_rank").alias("max_search_rank"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def select_external_ids(external_ids: DataFrame, external_source: str, *, limit: int | None = None, order: str = "source_id") -> DataFrame:
    """Distinct ids that the hub knows of a source, in order of first appearance."""
    rows = external_ids.where((F.col("source") == "wikidata") & (F.col("external_source") == external_source)).select(F.trim("external_id").alias("external_id"), F.col(order).alias("o"))
    first = rows.where("external_id <> ''").groupBy("external_id").agg(F.min("o").alias("o")).orderBy("o", "external_id").select("external_id")
    return first if limit is None else first.limit(limit)


def url_title(url: Text) -> Column:
    """Page title of an article URL: after /wiki/, else the last segment; decoded, underscores as spaces.

    A path that is not valid percent-encoding stays as it is.
    """
    path = F.regexp_extract(as_column(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    after = F.regexp_extract(path, r"/wiki/(.*)$", 1)
    title = F.when(F.contains(path, F.lit("/wiki/")), after).otherwise(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))
    decoded = F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title)
    return F.replace(decoded, F.lit("_"), F.lit(" "))


def title_url(language: Text, title: Text) -> Column:
    """Article URL of a title; blank titles have none."""
    t = as_column(title)
    return F.when(t != "", F.concat(F.lit("https://"), as_column(language), F.lit(".wikipedia.org/wiki/"), F.replace(t, F.lit(" "), F.lit("_"))))


def url_language(url_type: Text) -> Column:
    """Language of a sitelink type."""
    t = as_column(url_type)
    return F.when(t == "ruwiki", "ru").when(t == "enwiki", "en")


def select_pages(urls: DataFrame, *, languages: set[str] | None = None, limit: int | None = None) -> DataFrame:
    """Distinct (language, title) pages of the hub's sitelinks, by hub id and type."""
    rows = urls.where("source = 'wikidata' and trim(url) <> ''").withColumns({"language": url_language("url_type"), "url": F.trim("url")})
    rows = rows.where(F.col("language").isNotNull() if not languages else F.col("language").isin(*sorted(languages))).withColumn("title", url_title("url"))
    pages = first_per_key(rows, ["language", "title"], ["source_id", "url_type", "url"]).orderBy("source_id", "url_type", "url")
    pages = pages.select("source_id", F.col("source_id").alias("qid"), "language", "title", "url", "url_type")
    return pages if limit is None else pages.limit(limit)


def select_missing_pages(urls: DataFrame, descriptions: DataFrame, *, limit: int | None = None) -> DataFrame:
    """C17: one page, Russian before English, of each hub entity without an article summary."""
    covered = descriptions.where("source = 'wikipedia' and description_type = 'summary' and trim(description_text) <> ''").select("source_id").distinct()
    rows = urls.where("source = 'wikidata' and url_type in ('ruwiki', 'enwiki') and trim(url) <> '' and trim(source_id) <> ''").join(covered, "source_id", "left_anti")
    priority = F.when(F.col("url_type") == "ruwiki", 0).otherwise(1)
    best = first_per_key(rows.withColumn("__p", priority), ["source_id"], ["__p", "url"]).orderBy("__p", "source_id", "url")
    best = best.select("source_id", F.col("source_id").alias("qid"), url_language("url_type").alias("language"), url_title("url").alias("title"), F.trim("url").alias("url"), "url_type")
    return best if limit is None else best.limit(limit)


def slugs_in_batches(entities: DataFrame, size: int, *, source: str = "rawg") -> DataFrame:
    """Non-blank slugs in order, numbered into batches of ``size``."""
    slugs = entities.where((F.col("source") == source) & (F.trim("slug") != "")).select(F.trim("slug").alias("slug")).distinct()
    return numbered(slugs, ["slug"]).select("slug", F.floor((F.col("n") - 1) / size).cast("bigint").alias("batch"))
