"""Recommendations over parts, ratings over line items and the demo catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.functions.text import decade_key, feature_key
from marlstone.operators import ratings, recommend
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


PART_WEIGHTS = {"brand": 3.0, "type": 2.0, "size": 1.0}
#: The operator's own limits, for the SQL.
LIMITS = {"max_block": recommend.MAX_BLOCK, "max_candidates": recommend.MAX_CANDIDATES, "top_k": recommend.TOP_K, "min_score": recommend.MIN_SCORE}


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: brand, type, size and price decade."""
    p = base(spark, sf_dir, "part")
    kinds = {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("string")}
    rows = [
        p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), feature_key(F.lit(k), v).alias("feature"), F.lit(PART_WEIGHTS[k]).alias("weight"))
        for k, v in kinds.items()
    ]
    rows.append(p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), decade_key(F.floor("p_retailprice").cast("int")).alias("feature"), F.lit(0.25).alias("weight")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_PARTS = """WITH f AS (
  SELECT p_partkey::VARCHAR AS id, p_name AS name, 'brand:' || lower(trim(p_brand)) AS feature, 3.0::DOUBLE AS weight FROM part
  UNION ALL SELECT p_partkey::VARCHAR, p_name, 'type:' || lower(trim(p_type)), 2.0 FROM part
  UNION ALL SELECT p_partkey::VARCHAR, p_name, 'size:' || p_size::VARCHAR, 1.0 FROM part
  UNION ALL SELECT p_partkey::VARCHAR, p_name, 'decade:' || ((floor(floor(p_retailprice) / 10) * 10)::INT)::VARCHAR || 's', 0.25 FROM part)"""


def _candidates_sql(max_block: int, max_candidates: int) -> str:
    return f"""{_PARTS},
usable AS (SELECT feature FROM f GROUP BY feature HAVING count(*) BETWEEN 2 AND {max_block}),
cand AS (
  SELECT id, other, overlap FROM (
    SELECT a.id, b.id AS other, sum(a.weight) AS overlap FROM f a JOIN usable u ON u.feature = a.feature JOIN f b ON b.feature = a.feature AND b.id <> a.id GROUP BY a.id, b.id)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) <= {max_candidates})"""


def _recs_sql(max_block: int, max_candidates: int, top_k: int, min_score: float) -> str:
    return f"""{_candidates_sql(max_block, max_candidates)},
total AS (SELECT id, any_value(name) AS name, sum(weight) AS t, count(*) AS n FROM f GROUP BY id),
shared AS (SELECT c.id, c.other, sum(a.weight) AS s, string_agg(a.feature, ',' ORDER BY a.weight DESC, a.feature) AS feats
  FROM cand c JOIN f a ON a.id = c.id JOIN f b ON b.id = c.other AND b.feature = a.feature GROUP BY c.id, c.other),
scored AS (SELECT s.id, s.other, s.s / (x.t + y.t - s.s) AS raw, y.name AS other_name, feats, x.n AS n1, y.n AS n2 FROM shared s JOIN total x ON x.id = s.id JOIN total y ON y.id = s.other),
recs AS (SELECT id AS canonical_id, other AS recommended_id, row_number() OVER (PARTITION BY id ORDER BY raw DESC, lower(other_name), other)::INT AS rank,
  round(raw, 6) AS score, feats AS shared_features, n1::INT AS source_feature_count, n2::INT AS candidate_feature_count
  FROM scored WHERE raw >= {min_score} QUALIFY row_number() OVER (PARTITION BY id ORDER BY raw DESC, lower(other_name), other) <= {top_k})"""


_CANDIDATES = _candidates_sql(LIMITS["max_block"], LIMITS["max_candidates"])
_RECS = _recs_sql(**LIMITS)


def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommendations(part_features(spark, sf_dir))


@_query(f"{_RECS} SELECT * FROM recs")
def f04_recommendations(spark, sf_dir):
    out = _recs(spark, sf_dir)
    return out.select("canonical_id", "recommended_id", "rank", "score", F.array_join("shared_features", ",").alias("shared_features"), "source_feature_count", "candidate_feature_count")


@_query(f"{_CANDIDATES} SELECT id, other, overlap FROM cand")
def d08_blocked_candidates(spark, sf_dir):
    return recommend.candidates(part_features(spark, sf_dir))


@_query(f"{_PARTS} SELECT feature, count(*) AS block_size FROM f GROUP BY feature")
def d08_block_sizes(spark, sf_dir):
    return recommend.block_sizes(part_features(spark, sf_dir))


@_query(f"{_RECS} SELECT count(*) AS recommendation_count, count(DISTINCT canonical_id) AS seed_count, min(score) AS min_score, round(avg(score), 6) AS avg_score, max(score) AS max_score FROM recs")
def e17_recommendation_stats(spark, sf_dir):
    return recommend.recommendation_stats(_recs(spark, sf_dir))


@_query(f"""{_RECS} SELECT printf('%.1f-%.1f', least(floor(score * 10 + 1e-9), 9) / 10, (least(floor(score * 10 + 1e-9), 9) + 1) / 10) AS score_bucket, count(*) AS row_count FROM recs GROUP BY 1""")
def e17_score_histogram(spark, sf_dir):
    return recommend.score_histogram(_recs(spark, sf_dir))


@_query(f"""{_RECS}, seeds AS (SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 50 = 0)
SELECT recommended_id, max(score) AS score, string_agg(DISTINCT canonical_id, ',' ORDER BY canonical_id) AS seeds, count(DISTINCT canonical_id) AS seed_count
FROM recs WHERE canonical_id IN (SELECT id FROM seeds) AND recommended_id NOT IN (SELECT id FROM seeds) GROUP BY recommended_id ORDER BY score DESC, recommended_id LIMIT 20""")
def e24_multi_seed(spark, sf_dir):
    seeds = base(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("canonical_id"))
    return recommend.merge_seeds(_recs(spark, sf_dir), seeds, limit=20).withColumn("seeds", F.array_join("seeds", ","))


def _part_entities(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("canonical_id"), F.col("p_name").alias("canonical_name"), F.col("p_size").alias("release_year"))


@_query(f"""{_RECS} SELECT canonical_id, recommended_id, s.p_name AS seed_game, r.p_name AS recommended_game, rank, score
FROM recs JOIN part s ON s.p_partkey::VARCHAR = canonical_id JOIN part r ON r.p_partkey::VARCHAR = recommended_id
WHERE len(string_split(shared_features, ',')) >= 3 ORDER BY score DESC, seed_game, recommended_game, recommended_id, canonical_id LIMIT 40""")
def d12_strong_examples(spark, sf_dir):
    recs = _recs(spark, sf_dir)
    rows = recommend.named_recommendations(recs.where(F.size("shared_features") >= 3), _part_entities(spark, sf_dir))
    rows = rows.orderBy(F.desc("score"), "seed_game", "recommended_game", "recommended_id", "canonical_id").limit(40)
    return rows.select("canonical_id", "recommended_id", "seed_game", "recommended_game", "rank", "score")


@_query(f"""{_RECS} SELECT recommended_id, r.p_name AS recommended_game, rank, score FROM recs JOIN part r ON r.p_partkey::VARCHAR = recommended_id WHERE canonical_id = '8' ORDER BY rank LIMIT 10""")
def d11_similar(spark, sf_dir):
    return recommend.similar(_recs(spark, sf_dir), _part_entities(spark, sf_dir), "8").select("recommended_id", "recommended_game", "rank", "score")


_FEATURES = with_tables("canonical", "links", "genres", "tags", "platforms", "companies") + """,
attrs AS (
  SELECT source, source_id, 'genre' AS kind, value FROM genres UNION ALL SELECT source, source_id, 'tag', value FROM tags
  UNION ALL SELECT source, source_id, 'platform', value FROM platforms UNION ALL SELECT source, source_id, company_role, company_name FROM companies),
feats AS (
  SELECT DISTINCT l.canonical_id AS id, kind, kind || ':' || lower(trim(value)) AS feature FROM links l JOIN attrs a ON a.source = l.source AND a.source_id = l.source_id WHERE trim(value) <> ''
  UNION SELECT canonical_id, 'decade', 'decade:' || ((floor(release_year / 10) * 10)::INT)::VARCHAR || 's' FROM canonical WHERE release_year IS NOT NULL)"""


@_query(f"""{_FEATURES} SELECT id, canonical_name AS name, feature, max(CASE kind WHEN 'genre' THEN 3.0 WHEN 'developer' THEN 2.0 WHEN 'publisher' THEN 1.5 WHEN 'tag' THEN 1.0 WHEN 'platform' THEN 0.5 ELSE 0.25 END)::DOUBLE AS weight
FROM feats JOIN canonical ON canonical_id = id GROUP BY ALL""")
def d07_entity_features(spark, sf_dir):
    t = tables(spark, sf_dir, "canonical", "links", "genres", "tags", "platforms", "companies")
    return recommend.entity_features(t["canonical"], t["links"], genres=t["genres"], tags=t["tags"], platforms=t["platforms"], companies=t["companies"])


# --- ratings ---------------------------------------------------------------------------------------

_LINE_RATINGS = """WITH r AS (
  SELECT p_partkey::VARCHAR AS id, p_name AS name, l_returnflag AS kind, greatest(0.0::DOUBLE, least(100.0::DOUBLE, l_discount::DOUBLE / 0.1::DOUBLE * 100)) AS x, l_quantity::INT AS v
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity::INT > 0),
per AS (SELECT id, min(name) AS name, sum(x::DECIMAL(18,10) * v)::DOUBLE AS pts, sum(v)::DOUBLE AS votes, count(*) AS n, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM r GROUP BY id),
g AS (SELECT sum(x::DECIMAL(18,10) * v)::DOUBLE / sum(v)::DOUBLE AS m FROM r),
b AS (SELECT id AS canonical_id, name AS canonical_name, round(pts / votes, 6) AS naive_weighted_rating,
  round(((pts / votes) * votes + m * 50.0::DOUBLE) / (votes + 50.0::DOUBLE), 6) AS bayesian_rating, votes::BIGINT AS vote_count, n AS rating_source_count, kinds AS rating_types,
  round(((pts / votes) * votes + m * 50.0::DOUBLE) / (votes + 50.0::DOUBLE) - pts / votes, 6) AS shrinkage_delta FROM per, g)"""


def line_ratings(spark, sf_dir):
    rows = base(spark, sf_dir, "lineitem").join(base(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(
        F.col("p_partkey").cast("string").alias("canonical_id"), F.col("p_name").alias("canonical_name"), F.lit(None).cast("int").alias("release_year"),
        F.col("l_returnflag").alias("rating_type"), F.col("l_discount").alias("rating_value"), F.lit("0.1").alias("rating_scale"), F.col("l_quantity").cast("int").alias("rating_count"),
    )


@_query(f"{_LINE_RATINGS} SELECT * FROM b")
def e05_bayesian_ratings(spark, sf_dir):
    return ratings.bayesian_ratings(line_ratings(spark, sf_dir)).drop("release_year")


@_query(f"""{_LINE_RATINGS} SELECT (SELECT count(*) FROM r) AS rating_input_count, count(DISTINCT canonical_id) AS canonical_game_count, (SELECT round(m, 6) FROM g) AS global_weighted_mean,
50.0::DOUBLE AS prior_votes, sum(vote_count)::BIGINT AS total_vote_count FROM b""")
def e05_rating_summary(spark, sf_dir):
    return ratings.rating_summary(line_ratings(spark, sf_dir))


_DEMO_RATINGS = with_tables("canonical", "links", "ratings") + """,
u AS (SELECT c.canonical_id, canonical_name, release_year, rating_type, rating_value, rating_scale, rating_count
  FROM ratings r JOIN links l ON l.source = r.source AND l.source_id = r.source_id JOIN canonical c ON c.canonical_id = l.canonical_id
  WHERE regexp_full_match(rating_scale, '[0-9]+(\\.[0-9]+)?') AND rating_value > 0 AND rating_count > 0)"""


@_query(f"{_DEMO_RATINGS} SELECT * FROM u")
def d09_rating_inputs(spark, sf_dir):
    t = tables(spark, sf_dir, "canonical", "links", "ratings")
    out = ratings.rating_inputs(t["ratings"], t["links"], t["canonical"])
    return out.select("canonical_id", "canonical_name", "release_year", "rating_type", "rating_value", "rating_scale", "rating_count")


@_query(f"""{_DEMO_RATINGS}, x AS (SELECT canonical_id, canonical_name, greatest(0.0::DOUBLE, least(100.0::DOUBLE, rating_value / rating_scale::DOUBLE * 100)) AS x, rating_count AS v FROM u),
g AS (SELECT sum(x::DECIMAL(18,10) * v)::DOUBLE / sum(v)::DOUBLE AS m FROM x),
p AS (SELECT canonical_id, min(canonical_name) AS canonical_name, sum(x::DECIMAL(18,10) * v)::DOUBLE / sum(v)::DOUBLE AS n, sum(v)::DOUBLE AS votes FROM x GROUP BY 1),
b AS (SELECT canonical_id, canonical_name, votes::BIGINT AS vote_count, round((n * votes + m * 50.0::DOUBLE) / (votes + 50.0::DOUBLE) - n, 6) AS shrinkage_delta FROM p, g)
SELECT * FROM b WHERE vote_count < 50 AND abs(shrinkage_delta) > 1.0 ORDER BY abs(shrinkage_delta) DESC, vote_count, lower(canonical_name), canonical_id LIMIT 25""")
def c14_low_vote_shifts(spark, sf_dir):
    t = tables(spark, sf_dir, "canonical", "links", "ratings")
    rated = ratings.bayesian_ratings(ratings.rating_inputs(t["ratings"], t["links"], t["canonical"]))
    return ratings.low_vote_shifts(rated).select("canonical_id", "canonical_name", "vote_count", "shrinkage_delta")


@_query(f"{_LINE_RATINGS} SELECT canonical_name, bayesian_rating, vote_count FROM b ORDER BY bayesian_rating DESC, vote_count DESC, lower(canonical_name), canonical_id LIMIT 20")
def c14_chart_rows(spark, sf_dir):
    return ratings.chart_rows(ratings.bayesian_ratings(line_ratings(spark, sf_dir)))


@_query(with_tables("ratings") + """ SELECT source, rating_type, rating_scale, count(*) AS row_count, count(*) FILTER (WHERE rating_count > 0) AS with_vote_count,
min(rating_value) AS min_rating, max(rating_value) AS max_rating, max(rating_count) AS max_vote_count FROM ratings GROUP BY ALL""")
def e04_rating_sources(spark, sf_dir):
    return ratings.source_summary(table(spark, sf_dir, "ratings"))
