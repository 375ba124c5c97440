"""Staging transforms over payloads built from parts, and sinks and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlstone.operators import rank
from marlstone.plans.demo import base, table, with_tables
from marlstone.plans.scratch import Scratch
from marlstone.sources import landing, sinks, staging
from marlstone.sources.schemas import schema

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _named(*names) -> F.Column:
    return F.array(*[F.struct(n.alias("name")) for n in names])


def _at(p: DataFrame) -> F.Column:
    return F.timestamp_seconds(F.col("p_partkey"))


def rawg_payloads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Index pages of ten parts, and details of every third part."""
    p = base(spark, sf_dir, "part")
    item = F.struct(
        F.col("p_partkey").alias("id"), F.concat_ws("-", F.lit("part"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"),
        F.concat((F.col("p_size") + 1960).cast("string"), F.lit("-01-02")).alias("released"), (F.col("p_size") / 10).alias("rating"), F.lit(5).alias("rating_top"),
        F.col("p_size").alias("ratings_count"), _named(F.col("p_type"), F.col("p_type")).alias("genres"), _named(F.col("p_brand"), F.col("p_type")).alias("tags"),
        F.array(F.struct(F.struct(F.lit("PC").alias("name")).alias("platform")), F.struct(F.struct(F.lit("PC").alias("name")).alias("platform"))).alias("platforms"),
    )
    pages = p.withColumn("i", F.to_json(item)).groupBy(F.floor(F.col("p_partkey") / 10).alias("k")).agg(F.array_join(F.sort_array(F.collect_list("i")), ",").alias("j"))
    index = pages.select(F.concat(F.lit('{"results":['), "j", F.lit("]}")).alias("response_json"), F.timestamp_seconds("k").alias("loaded_at"))
    detail = F.concat(
        F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"name":"'), "p_name", F.lit(' detailed","released":null,"description_raw":"'), "p_brand",
        F.lit('","metacritic":'), F.col("p_size").cast("string"), F.lit(',"playtime":3,"developers":[{"name":"D'), F.col("p_size").cast("string"), F.lit('"}]}'),
    )
    details = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("source_record_id"), detail.alias("response_json"), _at(p).alias("loaded_at"))
    return index, details


@_query("""SELECT p_partkey::VARCHAR AS source_id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' detailed' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) || ' detailed' ELSE lower(p_name) END AS name_normalized,
CASE WHEN p_partkey % 3 <> 0 THEN (p_size + 1960)::VARCHAR || '-01-02' END AS release_date, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 1960 END AS release_year, 'part-' || p_partkey::VARCHAR AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END AS has_details FROM part""")
def j01_rawg_entities(spark, sf_dir):
    e = staging.stage_rawg(*rawg_payloads(spark, sf_dir))["entities"]
    return e.select("source_id", "name", "name_normalized", "release_date", "release_year", "slug", F.col("quality_flags")["has_details"].alias("has_details"))


@_query("""SELECT 'genres' AS kind, p_partkey::VARCHAR AS source_id, p_type AS value FROM part UNION ALL SELECT 'tags', p_partkey::VARCHAR, p_brand FROM part UNION ALL SELECT 'tags', p_partkey::VARCHAR, p_type FROM part
UNION ALL SELECT 'platforms', p_partkey::VARCHAR, 'PC' FROM part UNION ALL SELECT 'platforms', p_partkey::VARCHAR, 'PC' FROM part
UNION ALL SELECT 'companies', p_partkey::VARCHAR, 'developer:D' || p_size::VARCHAR FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'descriptions', p_partkey::VARCHAR, 'en:' || p_brand FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'ratings', p_partkey::VARCHAR, 'rawg_rating/5' FROM part UNION ALL SELECT 'ratings', p_partkey::VARCHAR, 'rawg_rating_top/5' FROM part UNION ALL SELECT 'ratings', p_partkey::VARCHAR, 'rawg_metacritic/100' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'popularity', p_partkey::VARCHAR, 'playtime_hours' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'urls', p_partkey::VARCHAR, 'https://www.metacritic.com/game/part-' || p_partkey::VARCHAR FROM part WHERE p_partkey % 3 = 0""")
def j01_rawg_attributes(spark, sf_dir):
    b = staging.stage_rawg(*rawg_payloads(spark, sf_dir))
    cols = {
        "genres": F.col("value"), "tags": F.col("value"), "platforms": F.col("value"), "companies": F.concat_ws(":", "company_role", "company_name"), "descriptions": F.concat_ws(":", "language", "description_text"),
        "ratings": F.concat_ws("/", "rating_type", "rating_scale"), "popularity": F.col("metric_name"), "urls": F.col("url"),
    }
    out = None
    for name, c in cols.items():
        part = b[name].select(F.lit(name).alias("kind"), "source_id", c.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def wikidata_payloads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = base(spark, sf_dir, "part")
    v = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    binding = F.struct(
        v(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.floor(F.col("p_partkey") / 2).cast("string"))).alias("game"), v(F.col("p_name")).alias("labelEn"), v(F.upper("p_name")).alias("aliasEn"),
        v(F.col("p_partkey").cast("string")).alias("steam"), v(F.concat((F.col("p_size") + 1960).cast("string"), F.lit("-03-04T00:00:00Z"))).alias("releaseDate"),
    )
    sparql = p.select(F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results"))).alias("response_json"), _at(p).alias("loaded_at"), F.col("p_partkey").alias("seq"))
    qid = F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))
    doc = F.concat(F.lit('{"entities":{"'), qid, F.lit('":{"labels":{"ru":{"value":"ru '), "p_name", F.lit('"}},"sitelinks":{"enwiki":{"title":"'), "p_name", F.lit('"}},"claims":{"P1733":[{"mainsnak":{"datavalue":{"value":"s1"}}}]}}}}'))
    documents = p.select(qid.alias("source_record_id"), doc.alias("response_json"), _at(p).alias("loaded_at"))
    return sparql, documents


def _wikidata_entities(sparql: DataFrame, documents: DataFrame) -> DataFrame:
    b = staging.stage_wikidata(sparql, documents)
    steam = b["external_ids"].where("external_source = 'steam'").select("source_id", F.col("external_id").alias("steam"))
    return b["entities"].join(steam, "source_id", "left").select("source_id", "name", "release_date", "steam")


@_query("""WITH b AS (SELECT 'Q' || (p_partkey // 2)::VARCHAR AS q, arg_min(p_name, p_partkey) AS en, arg_max(p_size, p_partkey) AS sz, max(p_partkey) AS st FROM part GROUP BY 1),
d AS (SELECT 'Q' || p_partkey::VARCHAR AS q, 'ru ' || p_name AS ru FROM part)
SELECT coalesce(b.q, d.q) AS source_id, coalesce(ru, en) AS name, (sz + 1960)::VARCHAR || '-03-04' AS release_date, CASE WHEN d.q IS NOT NULL THEN 's1' ELSE st::VARCHAR END AS steam FROM b FULL JOIN d ON b.q = d.q""")
def j02_wikidata_entities(spark, sf_dir):
    """With an entity document for every part."""
    return _wikidata_entities(*wikidata_payloads(spark, sf_dir))


@_query("""SELECT p_partkey::VARCHAR AS source_id, p_name || ' demo x' AS name, CASE WHEN p_size <= 31 AND p_size > 0 THEN '2001-09-' || lpad(p_size::VARCHAR, 2, '0') ELSE '2001-09-' || lpad(p_size::VARCHAR, 2, '0') END AS release_date, p_partkey % 2 = 1 AS is_dlc, true AS is_demo, 'true' AS has_supported_languages FROM part WHERE p_partkey % 5 <> 0""")
def j03_steam_entities(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    data = F.struct(
        F.concat("p_name", F.lit(" demo x")).alias("name"), F.when(F.col("p_partkey") % 2 == 1, "DLC").otherwise("game").alias("type"), F.lit("English").alias("supported_languages"),
        F.struct(F.concat(F.col("p_size").cast("string"), F.lit(" Sep, 2001")).alias("date")).alias("release_date"),
    )
    app = F.create_map(F.col("p_partkey").cast("string"), F.struct((F.col("p_partkey") % 5 != 0).alias("success"), data.alias("data")))
    raw = p.select(F.col("p_partkey").cast("string").alias("source_record_id"), F.to_json(app).alias("response_json"), _at(p).alias("loaded_at"))
    e = staging.stage_steam(raw)["entities"]
    return e.select("source_id", "name", "release_date", "is_dlc", "is_demo", F.col("quality_flags")["has_supported_languages"].alias("has_supported_languages"))


@_query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'Q' || p_partkey::VARCHAR WHEN 1 THEN p_partkey::VARCHAR ELSE 'en:' || replace(p_name, ' ', '_') END AS source_id, 'en' AS language, p_brand AS description_text FROM part""")
def j04_wikipedia_descriptions(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    page = F.struct(
        F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 < 2, F.col("p_partkey")).alias("pageid"), F.concat(F.lit(" "), "p_brand", F.lit("\n ")).alias("extract"),
        F.struct(F.struct(F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("p_partkey").cast("string")).alias("page")).alias("desktop")).alias("content_urls"),
    )
    wrapped = F.struct(page.alias("response"), F.struct(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid")).alias("selection"))
    raw = p.select(F.when(F.col("p_partkey") % 3 == 0, F.to_json(wrapped)).otherwise(F.to_json(page)).alias("response_json"), _at(p).alias("loaded_at"))
    return staging.stage_wikipedia(raw)["descriptions"].select("source_id", "language", "description_text")


@_query("""SELECT p_partkey::VARCHAR AS source_id, p_name AS name, (1960 + p_size)::INT AS release_year, 'igdb' AS external_source, p_partkey::VARCHAR AS external_id, 1.0::DOUBLE AS confidence FROM part
UNION ALL SELECT p_partkey::VARCHAR, p_name, 1960 + p_size, 'steam', 'x' || p_size::VARCHAR, 0.9 FROM part""")
def j05_igdb_entities(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    days = F.datediff(F.make_date(F.col("p_size") + 1960, F.lit(6), F.lit(1)), F.lit("1970-01-01").cast("date"))
    game = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (days.cast("long") * 86400).alias("first_release_date"),
        F.array(F.struct(F.concat(F.lit("x"), F.col("p_size").cast("string")).alias("uid"), F.struct(F.lit(" Steam ").alias("name")).alias("external_game_source"))).alias("external_games"),
    )
    b = staging.stage_igdb(p.select(F.to_json(game).alias("response_json"), _at(p).alias("loaded_at")))
    return b["entities"].select("source_id", "name", "release_year").join(b["external_ids"].select("source_id", "external_source", "external_id", "confidence"), "source_id")


@_query(with_tables("entities") + """ SELECT source, source_id, CASE WHEN source IN ('rawg', 'wikidata') THEN CASE WHEN name_normalized IS NULL OR name_normalized <> lower(name) THEN 'true' END END AS refreshed,
CASE WHEN source = 'rawg' THEN 100 WHEN source = 'wikidata' THEN 80 ELSE source_priority END::INT AS source_priority, CASE WHEN source IN ('rawg', 'wikidata') AND release_date IS NULL THEN 'true' END AS missing FROM entities""")
def j06_refreshed_entities(spark, sf_dir):
    e = staging.conform(table(spark, sf_dir, "entities"), "entities")
    out = staging.refresh_entities(e)
    flag = lambda k: F.try_element_at("quality_flags", F.lit(k))
    return out.select("source", "source_id", flag("normalized_name_refreshed").alias("refreshed"), "source_priority", flag("missing_release_date").alias("missing"))


@_query("""SELECT source_record_id, response_json FROM (SELECT (o_custkey % 200)::VARCHAR AS source_record_id, '{"k":' || o_orderkey::VARCHAR || '}' AS response_json, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def a01_latest_payloads(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderkey") % 11 == 0, F.lit("[]")).otherwise(F.concat(F.lit('{"k":'), F.col("o_orderkey").cast("string"), F.lit("}")))
    raw = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).cast("string").alias("source_record_id"), body.alias("response_json"), F.col("o_orderdate").alias("loaded_at"), F.when(F.col("o_orderkey") % 7 == 0, 500).alias("http_status"))
    return landing.latest_raw(raw, "source_record_id").select("source_record_id", "response_json")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def a08_typed_scan(spark, sf_dir):
    return landing.scan(base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), where=F.col("o_orderstatus") == "F", order=["o_orderkey"], limit=100).select("o_orderkey", "o_custkey")


@_query(with_tables("view") + " SELECT pair_id, review_label::INT AS manual_label FROM view WHERE review_status = 'reviewed' AND review_label IS NOT NULL")
def a10_reviewed_labels(spark, sf_dir):
    return landing.reviewed_labels(table(spark, sf_dir, "view"))


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def a11_jsonl_round_trip(spark, sf_dir):
    """Rows written as gzipped JSON lines and read back with a declared schema."""
    s = Scratch(spark, "jsonl")
    sinks.write_jsonl(base(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), s.path("customers"))
    return landing.read_jsonl(spark, s.path("customers"), schema("c_custkey bigint, c_name string, c_acctbal double"), partitions=8)


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def a12_csv_round_trip(spark, sf_dir):
    s = Scratch(spark, "csv")
    sinks.write_csv_report(base(spark, sf_dir, "nation").select("n_nationkey", "n_name"), s.path("nations"))
    return landing.read_csv(spark, s.path("nations"))


@_query("SELECT 'b' AS algorithm, c_custkey AS k FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'a', c_custkey FROM customer WHERE c_custkey % 3 = 2")
def b09_partition_replacement(spark, sf_dir):
    """Two slices written, one of them written again: only that one changes."""
    s = Scratch(spark, "slices")
    c = base(spark, sf_dir, "customer")
    slice_of = lambda name, rest: c.where(F.col("c_custkey") % 3 == rest).select(F.lit(name).alias("algorithm"), F.col("c_custkey").alias("k"))
    sinks.replace_partition(slice_of("a", 0).unionByName(slice_of("b", 1)), s.path("t"), "algorithm", ["algorithm", "k"])
    sinks.replace_partition(slice_of("a", 2), s.path("t"), "algorithm", ["algorithm", "k"])
    return spark.read.schema("k bigint, algorithm string").parquet(s.path("t")).select("algorithm", "k")


@_query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS tags, o_totalprice AS price FROM orders""")
def b12_export_values(spark, sf_dir):
    o = base(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return sinks.conformed(o, schema("o_orderkey bigint, day string, tags string, price double"))


_OLD = "SELECT 'rawg' AS source_a, o_orderkey::VARCHAR AS source_id_a, 'wikidata' AS source_b, o_custkey::VARCHAR AS source_id_b, 'p' || o_orderkey::VARCHAR AS pair_id, 'external_id' AS candidate_source, '1' AS label_value, 0.5::DOUBLE AS confidence FROM orders WHERE o_orderkey % 2 = 0"
_NEW = "SELECT 'rawg' AS source_a, o_orderkey::VARCHAR AS source_id_a, 'wikidata' AS source_b, o_custkey::VARCHAR AS source_id_b, 'n' || o_orderkey::VARCHAR AS pair_id, 'shared_alias' AS candidate_source, CAST(NULL AS VARCHAR) AS label_value, (o_orderkey % 10)::DOUBLE / 10 AS confidence FROM orders WHERE o_orderkey % 3 = 0"


@_query(f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.source_id_a, n.source_id_a) AS source_id_a, coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.candidate_source, n.candidate_source) AS candidate_source, coalesce(o.label_value, n.label_value) AS label_value,
greatest(coalesce(o.confidence, 0), coalesce(n.confidence, 0)) AS confidence FROM o FULL JOIN n ON o.source_id_a = n.source_id_a AND o.source_id_b = n.source_id_b""")
def b03_merge_pairs(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    keys = [F.lit("rawg").alias("source_a"), F.col("o_orderkey").cast("string").alias("source_id_a"), F.lit("wikidata").alias("source_b"), F.col("o_custkey").cast("string").alias("source_id_b")]
    row = lambda mark, rule, label, conf: [F.concat(F.lit(mark), F.col("o_orderkey").cast("string")).alias("pair_id"), *keys, F.lit(rule).alias("candidate_source"), F.lit(None).cast("string").alias("label_source"), F.lit(label).cast("string").alias("label_value"), conf.alias("confidence")]
    old = o.where("o_orderkey % 2 = 0").select(*row("p", "external_id", "1", F.lit(0.5)))
    new = o.where("o_orderkey % 3 = 0").select(*row("n", "shared_alias", None, (F.col("o_orderkey") % 10) / F.lit(10.0)))
    return rank.merge_candidate_pairs(old, new).select("source_id_a", "pair_id", "candidate_source", "label_value", "confidence")


@_query("""WITH o AS (SELECT o_orderkey::VARCHAR AS k, (1 + o_orderkey % 5)::INT AS r, 'old' AS t, 0.5::DOUBLE AS c FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey::VARCHAR AS k, (1 + o_orderkey % 4)::INT AS r, 'new' AS t, (o_orderkey % 10)::DOUBLE / 10 AS c FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.k, n.k) AS igdb_id, CASE WHEN o.k IS NULL THEN n.r WHEN n.k IS NULL THEN o.r ELSE least(o.r, n.r) END AS search_rank, CASE WHEN o.k IS NULL THEN n.t WHEN n.k IS NULL THEN o.t WHEN n.r <= o.r THEN n.t ELSE o.t END AS query_text,
CASE WHEN o.k IS NULL THEN n.c WHEN n.k IS NULL THEN o.c ELSE greatest(o.c, n.c) END AS confidence FROM o FULL JOIN n ON o.k = n.k""")
def b05_merge_searches(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    row = lambda m, word, conf: [F.lit("rawg").alias("source_name"), F.lit("1").alias("source_game_id"), F.col("o_orderkey").cast("string").alias("igdb_id"), (F.col("o_orderkey") % m + 1).cast("int").alias("search_rank"), F.lit(word).alias("query_text"), F.lit(word).alias("query_strategy"), conf.alias("confidence"), F.lit(word).alias("metadata")]
    old = o.where("o_orderkey % 2 = 0").select(*row(5, "old", F.lit(0.5)))
    new = o.where("o_orderkey % 3 = 0").select(*row(4, "new", (F.col("o_orderkey") % 10) / F.lit(10.0)))
    return rank.merge_search_candidates(old, new).select("igdb_id", "search_rank", "query_text", "confidence")


@_query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def b04_replace_rows(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return rank.replace_on_keys(old, new, ["k"])


@_query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def b07_cascading_delete(spark, sf_dir):
    parents = rank.delete_rows(base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), F.col("o_orderstatus") == "F")
    return rank.cascade(base(spark, sf_dir, "lineitem"), parents, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@_query("""SELECT o_custkey::VARCHAR AS source_record_id, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS id FROM orders GROUP BY 1""")
def b02_merge_raw(spark, sf_dir):
    o = base(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source_record_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("loaded_at"))
    return sinks.merge_raw(o.where("id % 2 = 0"), o, ["source_record_id"]).select("source_record_id", "id")


@_query(with_tables("entities", "genres") + " SELECT 'entities' AS table_name, source, count(*) AS row_count FROM entities GROUP BY source UNION ALL SELECT 'genres', source, count(*) FROM genres GROUP BY source")
def b16_table_counts(spark, sf_dir):
    return sinks.table_counts({n: table(spark, sf_dir, n) for n in ("entities", "genres")})


@_query("SELECT 'customers' AS dataset, count(*) AS row_count FROM customer UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'absent', 0")
def b17_dataset_manifest(spark, sf_dir):
    s = Scratch(spark, "datasets")
    sets = [sinks.Dataset("customers", base(spark, sf_dir, "customer"), required=True), sinks.Dataset("nations", base(spark, sf_dir, "nation"))]
    sinks.export_datasets(sets, s.root)
    return sinks.dataset_manifest(spark, s.root, ["customers", "nations", "absent"]).drop("path")


@_query("SELECT 1::BIGINT AS n_files, 0::BIGINT AS n_problems")
def b15_checksum_check(spark, sf_dir):
    """Files of a pack, and those whose checksum differs from the pack's manifest."""
    s = Scratch(spark, "pack")
    sinks.write_jsonl(base(spark, sf_dir, "nation").coalesce(1), s.path("raw"))
    manifest = sinks.file_checksums(spark, s.root, "*.json.gz")
    problems = sinks.verify_checksums(spark, s.root, manifest).agg(F.count("*").alias("n_problems"))
    return manifest.agg(F.count("*").alias("n_files")).crossJoin(F.broadcast(problems))  # one row each
