"""A catalog over the benchmark's relational tables, for queries that need one.

The tables are stated once as SQL that both engines read; ``tables`` gives them
as DataFrames and ``with_tables`` as the WITH clause of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "pages", "conversations")

_SRC = "CASE p_partkey % 4 WHEN 0 THEN 'rawg' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'steam' ELSE 'igdb' END"
_ID = "CASE WHEN p_partkey % 4 = 1 THEN concat('Q', CAST(p_partkey AS STRING)) ELSE CAST(p_partkey AS STRING) END"
_KEY = f"{_SRC} AS source, {_ID} AS source_id"
_GROUP = "CAST(floor(p_partkey / 4) AS BIGINT)"

SQL: dict[str, str] = {
    "entities": f"""SELECT {_KEY}, name, CASE WHEN p_partkey % 173 = 0 THEN NULL ELSE lower(name) END AS name_normalized,
      CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1960 + (p_partkey * 7) % 75 AS INT) END AS release_year,
      CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(CAST(1960 + (p_partkey * 7) % 75 AS STRING), '-05-01') END AS release_date,
      CASE WHEN p_partkey % 4 = 0 THEN concat(replace(lower(name), ' ', '-'), '-', CAST(p_partkey AS STRING)) END AS slug,
      CAST(60 + p_partkey % 5 AS INT) AS source_priority
    FROM (SELECT *, CASE WHEN p_partkey % 101 = 0 THEN concat(p_name, ' DLC Edition') WHEN p_partkey % 89 = 1 THEN concat('Q', CAST(p_partkey AS STRING))
      ELSE concat(p_name, ' ', CAST({_GROUP} % 20 AS STRING)) END AS name FROM {{part}})""",
    "aliases": f"""SELECT {_KEY}, concat(upper(p_name), ' ', CAST(p_size AS STRING)) AS alias, CASE WHEN p_partkey % 3 = 0 THEN 'ru' WHEN p_partkey % 3 = 1 THEN 'en' END AS language,
      CASE WHEN p_partkey % 4 = 3 THEN 'igdb_localization' ELSE 'alt' END AS alias_type
    FROM {{part}} WHERE p_partkey % 5 <> 0""",
    "external_ids": f"""SELECT {_KEY}, 'rawg' AS external_source, CASE WHEN p_partkey % 8 = 1 THEN concat(replace(lower(leader), ' ', '-'), '-', CAST(p_partkey - 1 AS STRING)) ELSE CAST(p_partkey - 1 AS STRING) END AS external_id
      FROM (SELECT a.p_partkey, concat(b.p_name, ' ', CAST(CAST(floor(b.p_partkey / 4) AS BIGINT) % 20 AS STRING)) AS leader FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey - 1) WHERE p_partkey % 4 = 1 AND p_partkey % 3 <> 0
    UNION ALL SELECT {_KEY}, 'steam', CAST(p_partkey + 1 AS STRING) FROM {{part}} WHERE p_partkey % 4 = 1 AND p_partkey % 5 <> 0
    UNION ALL SELECT {_KEY}, 'igdb', CAST(p_partkey + 2 AS STRING) FROM {{part}} WHERE p_partkey % 4 = 1 AND p_partkey % 7 = 0""",
    "genres": f"SELECT {_KEY}, p_type AS value FROM {{part}} WHERE p_partkey % 6 <> 0",
    "themes": f"SELECT {_KEY}, p_type AS value FROM {{part}} WHERE p_partkey % 4 = 3 AND p_partkey % 3 = 0",
    "tags": f"SELECT {_KEY}, p_brand AS value FROM {{part}} UNION ALL SELECT {_KEY}, concat('Tag ', CAST({_GROUP} % 9 AS STRING)) FROM {{part}}",
    "platforms": f"SELECT {_KEY}, concat('Size ', CAST(p_size % 5 AS STRING)) AS value FROM {{part}} UNION ALL SELECT {_KEY}, 'PC' FROM {{part}} WHERE p_partkey % 2 = 0",
    "companies": f"""SELECT {_KEY}, concat('Maker ', CAST({_GROUP} % 13 AS STRING)) AS company_name, 'developer' AS company_role FROM {{part}} WHERE p_partkey % 7 <> 0
    UNION ALL SELECT {_KEY}, concat('House ', CAST(p_partkey % 7 AS STRING)), 'publisher' FROM {{part}} WHERE p_partkey % 9 <> 0""",
    "descriptions": f"""SELECT {_KEY}, CASE WHEN p_partkey % 4 = 2 THEN 'short_description' ELSE 'summary' END AS description_type, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ru' END AS language,
      CASE WHEN p_partkey % 30 = 0 THEN '' ELSE concat(p_name, ' made by ', p_brand, ' as ', p_type, ' of size ', CAST(p_size AS STRING)) END AS description_text
    FROM {{part}} WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'wikipedia', concat('Q', CAST(p_partkey AS STRING)), 'summary', 'en', concat(p_name, ' is a thing. ', p_name, ' is a thing of note and of some size, known to many people.')
    FROM {{part}} WHERE p_partkey % 4 = 1 AND p_partkey % 2 = 1 AND p_partkey % 5 = 0""",
    "ratings": f"""SELECT {_KEY}, CASE WHEN p_partkey % 2 = 0 THEN 'rawg_rating' ELSE 'igdb_rating' END AS rating_type, CAST(p_size % 6 AS DOUBLE) AS rating_value,
      CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 2 = 0 THEN '5' ELSE '10' END AS rating_scale, CAST(p_partkey * 13 % 120 AS INT) AS rating_count
    FROM {{part}}
    UNION ALL SELECT {_KEY}, 'igdb_total_rating', CAST(p_retailprice % 110 AS DOUBLE), '100', CAST(p_size AS INT) FROM {{part}} WHERE p_partkey % 3 = 0""",
    "popularity": f"SELECT {_KEY}, 'recommendations_total' AS metric_name, CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) END AS metric_value FROM {{part}} WHERE p_partkey % 4 = 2",
    "urls": f"""SELECT {_KEY}, 'ruwiki' AS url_type, concat('https://ru.wikipedia.org/wiki/', replace(p_name, ' ', '_'), '_%28', CAST(p_partkey AS STRING), '%29') AS url, 'ru' AS language FROM {{part}} WHERE p_partkey % 4 = 1 AND p_partkey % 3 = 0
    UNION ALL SELECT {_KEY}, 'enwiki', concat('https://en.wikipedia.org/wiki/', replace(p_name, ' ', '_')), 'en' FROM {{part}} WHERE p_partkey % 4 = 1 AND p_partkey % 2 = 1
    UNION ALL SELECT {_KEY}, CASE WHEN p_partkey % 3 = 0 THEN 'rawg' ELSE 'website' END, concat('https://example.com/', CAST(p_partkey AS STRING)), NULL FROM {{part}} WHERE p_partkey % 4 = 0
    UNION ALL SELECT 'wikipedia', concat('Q', CAST(p_partkey AS STRING)), 'page', concat('https://en.wikipedia.org/wiki/P', CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 8 = 1 THEN 'ru' ELSE 'en' END FROM {{part}} WHERE p_partkey % 4 = 1 AND p_partkey % 5 = 0""",
    "canonical": f"""SELECT concat('c', CAST(p_partkey AS STRING)) AS canonical_id, name AS canonical_name, release_year
    FROM (SELECT p_partkey, concat(p_name, ' ', CAST({_GROUP} % 20 AS STRING)) AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1960 + (p_partkey * 7) % 75 AS INT) END AS release_year FROM {{part}}) WHERE p_partkey % 4 = 0""",
    "links": f"""SELECT concat('c', CAST({_GROUP} * 4 AS STRING)) AS canonical_id, {_KEY}, CASE WHEN p_partkey % 4 = 3 THEN 0.5 ELSE 1.0 END AS linkage_confidence FROM {{part}}""",
    # Pairs as a reviewer sees them, one for each line item.
    "view": """SELECT concat('p', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS pair_id, 'rawg' AS source_a, CAST(l_partkey AS STRING) AS source_id_a,
      concat('Name ', CAST(l_partkey % 50 AS STRING)) AS name_a, CAST(1980 + l_partkey % 40 AS INT) AS release_year_a,
      CASE WHEN l_linenumber % 2 = 0 THEN 'igdb' ELSE 'wikidata' END AS source_b, CAST(l_suppkey AS STRING) AS source_id_b,
      CASE WHEN l_suppkey % 31 = 0 THEN concat('Q', CAST(l_suppkey AS STRING)) ELSE concat('Name ', CAST(l_suppkey % 50 AS STRING)) END AS name_b, CAST(1980 + l_suppkey % 40 AS INT) AS release_year_b,
      CASE l_linenumber % 4 WHEN 0 THEN 'igdb_search' WHEN 1 THEN 'external_id' WHEN 2 THEN 'same_normalized_name' ELSE 'shared_alias' END AS candidate_source,
      CASE WHEN l_linenumber % 4 = 1 THEN 'wikidata_rawg_external_id' END AS label_source, CASE WHEN l_linenumber % 4 = 1 THEN '1' END AS label_value,
      CASE WHEN l_linenumber % 4 = 0 THEN CAST(1 + l_orderkey % 6 AS INT) END AS igdb_search_rank, CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'wikidata_alias' ELSE 'source_name' END END AS igdb_query_strategy,
      CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_orderkey % 100 AS DOUBLE) / 100 END AS igdb_search_confidence,
      CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(l_partkey * 37 % 101 AS DOUBLE) / 100 END AS name_similarity, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_suppkey * 53 % 101 AS DOUBLE) / 100 END AS alias_similarity,
      CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 13 END AS release_year_diff, l_linenumber % 4 = 1 AND l_orderkey % 5 = 0 AS external_id_exact_match,
      CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey % 5 AS DOUBLE) / 4 END AS developer_overlap, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_orderkey % 6 AS DOUBLE) / 5 END AS publisher_overlap,
      CAST(l_orderkey % 11 AS DOUBLE) / 10 AS platform_jaccard, CAST(l_partkey % 11 AS DOUBLE) / 10 AS genre_jaccard, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE CAST(l_suppkey % 11 AS DOUBLE) / 10 END AS tag_jaccard,
      l_tax > 0.04 AS description_available_flag, CASE WHEN l_tax > 0.06 THEN l_orderkey % 2 = 0 END AS description_language_match, CAST(1 + l_orderkey % 4 AS BIGINT) AS source_count_signal,
      CAST((l_orderkey * 7919 + l_linenumber * 104729) % 10007 AS DOUBLE) / 10007 AS same_game_probability,
      CASE WHEN l_linestatus = 'O' THEN CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'pending' WHEN 2 THEN 'unsure' ELSE 'skipped' END ELSE 'reviewed' END AS review_status,
      CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag = 'A' OR (l_orderkey * 31 + l_linenumber) % 3 = 0 END AS review_label,
      CASE WHEN l_linestatus = 'F' THEN 'igdb_borderline' END AS selection_strategy, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_orderkey % 97 AS DOUBLE) / 97 END AS priority_score,
      CASE WHEN l_orderkey % 2 = 0 THEN 'seen' END AS review_notes
    FROM {lineitem} WHERE l_linenumber <= 7""",
}
_DECISION = "CASE WHEN same_game_probability >= 0.95 THEN 'auto_merge' WHEN same_game_probability >= 0.70 THEN 'manual_review' ELSE 'no_merge' END"
# Line items repeat (order, line) keys in the generated data: the least row of each stands for the pair.
SQL["view"] = f"SELECT *, {_DECISION} AS model_decision FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY source_id_a, source_id_b, name_similarity, priority_score, alias_similarity, tag_jaccard, release_year_diff, review_status) AS nth FROM ({SQL['view']})) WHERE nth = 1"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A demo table; the session's columns are those of ``SQL[name]``."""
    used = {b: base(spark, sf_dir, b) for b in BASE if "{" + b + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


STAGING_NAMES = ("entities", "aliases", "external_ids", "genres", "themes", "tags", "platforms", "companies", "descriptions", "ratings", "popularity", "urls")


def staging(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return tables(spark, sf_dir, *STAGING_NAMES)


def oracle_table(name: str) -> str:
    return SQL[name].format(**{b: b for b in BASE})


def with_tables(*names: str, recursive: bool = False) -> str:
    """WITH clause of demo tables for an oracle query, to be followed by a comma or SELECT."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({oracle_table(n)})" for n in names)
