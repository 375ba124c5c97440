"""Catalog pages, details and statistics; search seeds and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scoring import search_confidence
from marlstone.operators import catalog, search
from marlstone.operators.rank import first_per_key, page_with_total
from marlstone.operators.review import best_urls, latest_predictions
from marlstone.plans.demo import base, table, tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@_query(with_tables("canonical", "links", "genres", "platforms") + """, p AS (SELECT *, count(*) OVER () AS total_count FROM canonical WHERE contains(lower(canonical_name), 'bolt') ORDER BY canonical_name, canonical_id LIMIT 25 OFFSET 5)
SELECT p.canonical_id, canonical_name, release_year, total_count, (SELECT count(*) FROM links l WHERE l.canonical_id = p.canonical_id) AS source_count,
coalesce((SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM links l JOIN genres g ON g.source = l.source AND g.source_id = l.source_id WHERE l.canonical_id = p.canonical_id), '') AS genres,
coalesce((SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM links l JOIN platforms g ON g.source = l.source AND g.source_id = l.source_id WHERE l.canonical_id = p.canonical_id), '') AS platforms FROM p""")
def g03_list_entities(spark, sf_dir):
    t = tables(spark, sf_dir, "canonical", "links", "genres", "platforms")
    out = catalog.list_entities(t["canonical"], t["links"], genres=t["genres"], platforms=t["platforms"], search="BOLT", limit=25, offset=5)
    return out.withColumns({c: F.array_join(c, ",") for c in ("genres", "platforms")})


@_query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total_count FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 10")
def f03_page_with_total(spark, sf_dir):
    rows = base(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return page_with_total(rows, [F.desc("c_acctbal"), "c_custkey"], limit=30, offset=10).select("c_custkey", "c_name", "total_count")


_DETAIL = ("canonical", "links", "entities", "descriptions", "genres", "platforms", "companies", "ratings")


@_query(with_tables(*_DETAIL) + """, b AS (SELECT l.canonical_id, description_text FROM links l JOIN descriptions d ON d.source = l.source AND d.source_id = l.source_id WHERE description_text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l.canonical_id ORDER BY CASE l.source WHEN 'wikipedia' THEN 0 WHEN 'rawg' THEN 1 WHEN 'steam' THEN 2 WHEN 'igdb' THEN 3 ELSE 4 END, length(description_text) DESC, description_text) = 1),
agg AS (SELECT l.canonical_id, min(e.release_date) AS release_date, string_agg(l.source || ':' || l.source_id, ',' ORDER BY l.source, l.source_id) AS sources FROM links l LEFT JOIN entities e ON e.source = l.source AND e.source_id = l.source_id GROUP BY l.canonical_id)
SELECT c.canonical_id, c.canonical_name, agg.release_date, b.description_text AS description, agg.sources,
coalesce((SELECT string_agg(DISTINCT company_name, ',' ORDER BY company_name) FROM links l JOIN companies x ON x.source = l.source AND x.source_id = l.source_id WHERE l.canonical_id = c.canonical_id AND company_role = 'developer'), '') AS developers,
coalesce((SELECT string_agg(k || '=' || v::VARCHAR, ',' ORDER BY k) FROM (SELECT rating_type AS k, max(rating_value) AS v FROM links l JOIN ratings x ON x.source = l.source AND x.source_id = l.source_id WHERE l.canonical_id = c.canonical_id GROUP BY 1)), '') AS ratings
FROM canonical c LEFT JOIN agg ON agg.canonical_id = c.canonical_id LEFT JOIN b ON b.canonical_id = c.canonical_id""")
def d10_entity_details(spark, sf_dir):
    t = tables(spark, sf_dir, *_DETAIL)
    out = catalog.entity_details(t["canonical"], t["links"], t["entities"], **{n: t[n] for n in ("descriptions", "genres", "platforms", "companies", "ratings")})
    entry = F.transform(F.map_entries("ratings"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select(
        "canonical_id", "canonical_name", "release_date", "description", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["source_id"])), ",").alias("sources"),
        F.array_join("developers", ",").alias("developers"), F.coalesce(F.array_join(F.array_sort(entry), ","), F.lit("")).alias("ratings"),
    )


_NAMES = ["red bolt 3", "Small ring", "no such thing", "blue"]


@_query(with_tables("canonical") + f""", a AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_NAMES))}) t(position, asked))
SELECT position, asked, canonical_id, canonical_name FROM a JOIN canonical ON contains(lower(canonical_name), lower(asked))
QUALIFY row_number() OVER (PARTITION BY position ORDER BY CASE WHEN lower(canonical_name) = lower(asked) THEN 0 ELSE 1 END, length(canonical_name), canonical_name, canonical_id) = 1""")
def g04_find_by_names(spark, sf_dir):
    return catalog.find_by_names(table(spark, sf_dir, "canonical"), _NAMES).select("position", "asked", "canonical_id", "canonical_name")


_STATS = ("entities", "canonical", "links", "aliases", "ratings")


@_query(with_tables(*_STATS) + """, al AS (SELECT l.canonical_id, language FROM aliases a JOIN links l ON l.source = a.source AND l.source_id = a.source_id)
SELECT 'source_games' AS metric, '' AS key, count(*) AS value FROM entities UNION ALL SELECT 'source_count', '', count(DISTINCT source) FROM entities UNION ALL SELECT 'canonical_games', '', count(*) FROM canonical
UNION ALL SELECT 'canonical_game_sources', '', count(*) FROM links UNION ALL SELECT 'recommendations_count', '', count(*) FROM ratings UNION ALL SELECT 'games_with_ru_name', '', count(DISTINCT canonical_id) FROM al WHERE language = 'ru'
UNION ALL SELECT 'source_games_by_source', source, count(*) FROM entities GROUP BY source""")
def e20_catalog_stats(spark, sf_dir):
    t = tables(spark, sf_dir, *_STATS)
    named = t["aliases"].join(t["links"], ["source", "source_id"]).select("canonical_id", "language")
    return catalog.catalog_stats(t["entities"], t["canonical"], t["links"], t["ratings"], named)


@_query(with_tables("view") + """ SELECT 'labeled_pairs' AS metric, '' AS key, count(*) FILTER (WHERE review_status = 'reviewed') AS value FROM view UNION ALL SELECT 'manual_positive_labels', '', count(*) FILTER (WHERE review_status = 'reviewed' AND review_label) FROM view
UNION ALL SELECT 'manual_negative_labels', '', count(*) FILTER (WHERE review_status = 'reviewed' AND NOT review_label) FROM view UNION ALL SELECT 'candidate_pairs', '', count(*) FROM view UNION ALL SELECT 'model_decisions', model_decision, count(*) FROM view GROUP BY model_decision""")
def e20_model_stats(spark, sf_dir):
    v = table(spark, sf_dir, "view")
    return catalog.model_stats(v, v, v.withColumnRenamed("model_decision", "decision"))


@_query("SELECT o_orderpriority AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS value FROM orders GROUP BY 1")
def e21_artifact_stats(spark, sf_dir):
    rows = base(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("n/a").alias("row_count"))
    return catalog.artifact_stats(rows, "name")


@_query("""SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def f01_latest_per_key(spark, sf_dir):
    return first_per_key(base(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "ts", "user_id", "event_type")


@_query("""SELECT user_id AS pair_id, event_type AS model_name, event_id::VARCHAR AS model_version, value AS same_game_probability FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_type DESC, event_id::VARCHAR DESC) = 1""")
def f01_latest_predictions(spark, sf_dir):
    e = base(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("pair_id"), F.date_trunc("day", "ts").alias("predicted_at"), F.col("event_type").alias("model_name"), F.col("event_id").cast("string").alias("model_version"), F.col("value").alias("same_game_probability"))
    return latest_predictions(rows).drop("predicted_at")


@_query(with_tables("urls") + """ SELECT source, source_id, url AS rawg_url FROM urls WHERE source = 'rawg' AND url_type IN ('rawg', 'website', 'background_image') QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY CASE WHEN url_type = 'rawg' THEN 0 ELSE 1 END, url_type, url) = 1""")
def f02_best_urls(spark, sf_dir):
    return best_urls(table(spark, sf_dir, "urls"), "rawg", "rawg", ("website", "background_image"), "rawg_url")


# --- search ----------------------------------------------------------------------------------------

_CONF = """round(greatest(0.1::DOUBLE, least(0.85::DOUBLE - least(greatest(r - 1, 0) * 0.1::DOUBLE, 0.4::DOUBLE) + CASE WHEN st = 'wikidata_alias' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN abs(ay - cy) = 0 THEN 0.1::DOUBLE WHEN abs(ay - cy) <= 1 THEN 0.05::DOUBLE ELSE 0 END, 0.99::DOUBLE)), 4)"""
_ENV = f"""WITH s AS (SELECT o_orderkey AS seq, (o_custkey % 40)::VARCHAR AS sid, (o_orderkey % 25)::VARCHAR AS gid, (o_orderkey % 7)::INT AS r, CASE WHEN o_orderkey % 3 = 0 THEN 'wikidata_alias' ELSE 'source_name' END AS st,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (1990 + o_custkey % 5)::INT END AS ay, (1990 + o_orderkey % 6)::INT AS cy, o_orderpriority AS q FROM orders)"""


@_query(f"""{_ENV} SELECT 'rawg' AS source_name, sid AS source_game_id, gid AS igdb_id, r AS search_rank, q AS query_text, st AS query_strategy, {_CONF} AS confidence, ay AS anchor_release_year, cy AS candidate_release_year
FROM s WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY sid, gid ORDER BY r, seq) = 1""")
def f05_search_candidates(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    year = F.when(F.col("o_orderkey") % 5 != 0, (1990 + F.col("o_custkey") % 5).cast("int"))
    start = F.unix_seconds(F.make_timestamp((1990 + F.col("o_orderkey") % 6).cast("int"), F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    envelope = F.to_json(
        F.struct(
            F.struct(F.lit("rawg").alias("source"), (F.col("o_custkey") % 40).cast("string").alias("source_game_id"), year.alias("release_year")).alias("anchor"),
            F.struct(F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderkey") % 3 == 0, "wikidata_alias").otherwise("source_name").alias("strategy"), (F.col("o_orderkey") % 7).alias("rank")).alias("query"),
            F.struct((F.col("o_orderkey") % 25).alias("id"), start.alias("first_release_date")).alias("candidate"),
        )
    )
    raw = o.select(F.col("o_orderkey").alias("seq"), F.lit("h").alias("request_hash"), envelope.alias("response_json"))
    out = search.search_candidates(raw)
    return out.select("source_name", "source_game_id", "igdb_id", "search_rank", "query_text", "query_strategy", "confidence", F.col("metadata.anchor_release_year").alias("anchor_release_year"), F.col("metadata.candidate_release_year").alias("candidate_release_year"))


@_query(f"{_ENV} SELECT seq, {_CONF} AS confidence FROM s WHERE r > 0")
def i20_search_confidence(spark, sf_dir):
    o = base(spark, sf_dir, "orders").selectExpr("o_orderkey as seq", "o_orderkey % 7 as r", "case when o_orderkey % 3 = 0 then 'wikidata_alias' else 'source_name' end as st", "case when o_orderkey % 5 = 0 then null else 1990 + o_custkey % 5 end as ay", "1990 + o_orderkey % 6 as cy").where("r > 0")
    return o.select("seq", search_confidence("r", "st", "ay", "cy").alias("confidence"))


@_query(with_tables("view") + """ SELECT igdb_query_strategy AS query_strategy, count(*) AS candidate_count, count(DISTINCT source_id_a) AS anchor_count, round(avg(igdb_search_rank), 6) AS avg_search_rank, min(igdb_search_rank) AS min_search_rank, max(igdb_search_rank) AS max_search_rank, round(avg(igdb_search_confidence), 6) AS avg_confidence
FROM view WHERE candidate_source = 'igdb_search' GROUP BY 1""")
def e06_search_summary(spark, sf_dir):
    v = table(spark, sf_dir, "view").where("candidate_source = 'igdb_search'")
    rows = v.select(F.col("igdb_query_strategy").alias("query_strategy"), F.col("source_id_a").alias("source_game_id"), F.col("igdb_search_rank").alias("search_rank"), F.col("igdb_search_confidence").alias("confidence"))
    return search.candidate_summary(rows, "query_strategy")


@_query("""SELECT p_partkey, lower(p_name) || '|' || lower(p_type || ' ' || p_size::VARCHAR) AS queries FROM part""")
def i37_search_queries(spark, sf_dir):
    p = base(spark, sf_dir, "part").withColumns({"slug": F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), "alias": F.array(F.upper("p_name"), F.concat_ws(" ", "p_type", "p_size"), F.lit("third"))})
    found = search.search_queries("p_name", "slug", "alias", 2)
    return p.select("p_partkey", F.lower(F.array_join(F.transform(found, lambda q: q["query_text"]), "|")).alias("queries"))


@_query(with_tables("entities", "external_ids") + """, hub AS (SELECT DISTINCT trim(external_id) AS slug FROM external_ids WHERE source = 'wikidata' AND external_source = 'rawg')
SELECT source_id, name, slug, slug IN (SELECT slug FROM hub) AS matched_to_wikidata FROM entities WHERE source = 'rawg' AND slug NOT IN (SELECT slug FROM hub) ORDER BY source_priority DESC, coalesce(release_date, ''), source_id LIMIT 100""")
def d15_search_seeds(spark, sf_dir):
    t = tables(spark, sf_dir, "entities", "external_ids", "aliases")
    return search.search_seeds(t["entities"], t["external_ids"], t["aliases"], limit=100, unmatched_only=True).select("source_id", "name", "slug", "matched_to_wikidata")


@_query(with_tables("external_ids") + " SELECT external_id FROM (SELECT trim(external_id) AS external_id, min(source_id) AS o FROM external_ids WHERE source = 'wikidata' AND external_source = 'steam' GROUP BY 1) ORDER BY o, external_id LIMIT 50")
def c15_external_ids(spark, sf_dir):
    return search.select_external_ids(table(spark, sf_dir, "external_ids"), "steam", limit=50)


_TITLE = "replace(url_decode(regexp_extract(url, '/wiki/(.*)$', 1)), '_', ' ')"


@_query(with_tables("urls") + f""" SELECT source_id, CASE url_type WHEN 'ruwiki' THEN 'ru' ELSE 'en' END AS language, {_TITLE} AS title, url FROM urls WHERE source = 'wikidata' AND url_type IN ('ruwiki', 'enwiki')
QUALIFY row_number() OVER (PARTITION BY CASE url_type WHEN 'ruwiki' THEN 'ru' ELSE 'en' END, {_TITLE} ORDER BY source_id, url_type, url) = 1""")
def c16_pages(spark, sf_dir):
    return search.select_pages(table(spark, sf_dir, "urls")).select("source_id", "language", "title", "url")


@_query(with_tables("urls", "descriptions") + f""" SELECT source_id, CASE url_type WHEN 'ruwiki' THEN 'ru' ELSE 'en' END AS language, {_TITLE} AS title FROM urls WHERE source = 'wikidata' AND url_type IN ('ruwiki', 'enwiki')
AND source_id NOT IN (SELECT source_id FROM descriptions WHERE source = 'wikipedia' AND description_type = 'summary' AND trim(description_text) <> '')
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY CASE url_type WHEN 'ruwiki' THEN 0 ELSE 1 END, url) = 1""")
def c17_missing_pages(spark, sf_dir):
    t = tables(spark, sf_dir, "urls", "descriptions")
    return search.select_missing_pages(t["urls"], t["descriptions"]).select("source_id", "language", "title")


@_query(with_tables("entities") + " SELECT slug, ((row_number() OVER (ORDER BY slug) - 1) // 50)::BIGINT AS batch FROM (SELECT DISTINCT trim(slug) AS slug FROM entities WHERE source = 'rawg' AND trim(slug) <> '')")
def c18_slug_batches(spark, sf_dir):
    return search.slugs_in_batches(table(spark, sf_dir, "entities"), 50)


@_query("SELECT DISTINCT (o_custkey % 40)::VARCHAR AS source_id FROM orders WHERE o_orderkey % 2 = 0")
def i38_attempted_ids(spark, sf_dir):
    anchor = F.struct(F.struct(F.when(F.col("o_orderkey") % 2 == 0, "rawg").otherwise("igdb").alias("source"), (F.col("o_custkey") % 40).cast("string").alias("source_game_id")).alias("anchor"))
    return search.attempted_ids(base(spark, sf_dir, "orders").select(F.to_json(anchor).alias("response_json")))
