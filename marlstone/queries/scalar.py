"""Scalar functions over columns of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, ids, similarity, text
from marlstone.functions.scoring import number, whole_number
from marlstone.operators.search import title_url, url_title
from marlstone.operators.training import usable_name
from marlstone.plans.demo import base, table, with_tables
from marlstone.sources.requests import in_year_window, year_bounds
from marlstone.sources.staging import hub_id

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TEXT = "replace(text, chr(10), ' ')"
_TITLE = r"""nullif(trim(regexp_replace(regexp_replace(lower({0}), '[®™©]', '', 'g'), '[\s:;,_./\\|()\[\]{{}}!?+''"-]+', ' ', 'g')), '')"""


def whole_text():
    """A document's text on one line."""
    return F.replace(F.col("text"), F.lit("\n"), F.lit(" "))


@_query(f"""SELECT doc_id, {_TITLE.format(_TEXT)} AS unicode_name, nullif(trim(regexp_replace(lower({_TEXT}), '[^a-z0-9]+', ' ', 'g')), '') AS ascii_name, nullif(trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')), '') AS collapsed FROM documents""")
def i01_normal_forms(spark, sf_dir):
    d = base(spark, sf_dir, "documents")
    return d.select("doc_id", text.unicode_title(whole_text()).alias("unicode_name"), text.ascii_title(whole_text()).alias("ascii_name"), text.collapsed_text(whole_text()).alias("collapsed"))


@_query()
def i04_distinct_titles(spark, sf_dir):
    """Rows only: SQL compares every word with all before it; tests hold it to plain Python."""
    joined = F.array_join(text.distinct_titles(F.split(whole_text(), " ")), "|")
    return base(spark, sf_dir, "documents").select("doc_id", F.nullif(joined, F.lit("")).alias("titles"))


_FLAG = """SELECT p_partkey, n, contains(n, ' dlc ') OR contains(n, ' expansion ') OR contains(n, ' add on ') OR contains(n, ' addon ') AS is_dlc, contains(n, ' demo ') OR contains(n, ' trial ') AS is_demo, contains(n, ' remake ') AS is_remake,
contains(n, ' remaster ') OR contains(n, ' remastered ') AS is_remaster, contains(n, ' bundle ') OR contains(n, ' collection ') OR contains(n, ' anthology ') AS is_bundle FROM (SELECT p_partkey, lower(w) AS n FROM (SELECT p_partkey,
p_name || CASE p_partkey % 6 WHEN 0 THEN ' DLC pack' WHEN 1 THEN ' demo' WHEN 2 THEN ' remake one' WHEN 3 THEN ' remastered now' WHEN 4 THEN ' add on x' ELSE ' bundle' END AS w FROM part))"""


@_query(f"""SELECT p_partkey, is_dlc, is_demo, is_remake, is_remaster, is_bundle, concat_ws(',', CASE WHEN NOT is_dlc THEN 'is_dlc_not_inferred' END, CASE WHEN NOT is_demo THEN 'is_demo_not_inferred' END, CASE WHEN NOT is_remake THEN 'is_remake_not_inferred' END,
CASE WHEN NOT is_remaster THEN 'is_remaster_not_inferred' END, CASE WHEN NOT is_bundle THEN 'is_bundle_not_inferred' END) AS reasons FROM ({_FLAG})""")
def i05_title_flags(spark, sf_dir):
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, " DLC pack").when(k == 1, " demo").when(k == 2, " remake one").when(k == 3, " remastered now").when(k == 4, " add on x").otherwise(" bundle")
    p = base(spark, sf_dir, "part").withColumn("n", F.concat("p_name", tail))
    return p.select("p_partkey", *[c.alias(f) for f, c in text.title_flags("n").items()], F.array_join(text.title_flag_reasons("n"), ",").alias("reasons"))


_D = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN NULL WHEN 3 THEN 'soon' ELSE '2015-02-31' END"


@_query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN d END AS date, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN substr(d, 1, 4)::INT END AS year, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'partial_release_date' WHEN 2 THEN 'missing_release_date' WHEN 3 THEN 'invalid_release_date' ELSE 'partial_release_date' END AS reason
FROM (SELECT o_orderkey, {_D} AS d FROM orders)""")
def i06_iso_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    d = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy")).when(k == 2, F.lit(None).cast("string")).when(k == 3, "soon").otherwise("2015-02-31")
    return base(spark, sf_dir, "orders").select("o_orderkey", dates.iso_release_date(d).alias("x")).select("o_orderkey", "x.*")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate)::INT END AS year FROM orders""")
def i07_store_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    d = F.when(k == 0, F.date_format("o_orderdate", "d MMM, yyyy")).when(k == 1, F.date_format("o_orderdate", "dd MMMM yyyy")).when(k == 2, F.concat(F.lit("Q3 "), F.date_format("o_orderdate", "yyyy"))).otherwise("soon")
    return base(spark, sf_dir, "orders").select("o_orderkey", dates.store_release_date(d).alias("x")).select("o_orderkey", "x.*")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS prefix_date, strftime(o_orderdate, '%Y-%m-%d') AS epoch_date, year(o_orderdate)::INT AS epoch_year FROM orders""")
def i08_prefix_and_epoch_dates(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    iso = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")).otherwise("http://example.org/x")
    days = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    epoch = dates.epoch_release_date(days.cast("long") * 86400)
    return o.select("o_orderkey", dates.prefix_release_date(iso)["date"].alias("prefix_date"), epoch["date"].alias("epoch_date"), epoch["year"].alias("epoch_year"))


@_query("""SELECT p_partkey, 'Q' || p_partkey::VARCHAR AS hub, p_name AS title, 'https://ru.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS url FROM part""")
def i10_ids_and_urls(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    uri = F.concat(F.when(F.col("p_partkey") % 2 == 0, "http://www.wikidata.org/entity/Q").otherwise("Q"), F.col("p_partkey").cast("string"))
    url = title_url(F.lit("ru"), "p_name")
    return p.select("p_partkey", hub_id(uri).alias("hub"), url_title(url).alias("title"), url.alias("url"))


@_query(r"""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', ''), '') AS path FROM pages""")
def i11_page_paths(spark, sf_dir):
    """Last path segments of page URLs, joined back to paths."""
    p = base(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    head = F.regexp_replace(path, "[^/]*$", "")
    return p.select("page_id", F.nullif(F.concat(head, F.replace(url_title("url"), F.lit(" "), F.lit("_"))), F.lit("")).alias("path"))


@_query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def i29_vector_similarity(spark, sf_dir):
    e = base(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(similarity.dot("x", "y"), 6).alias("dot"), F.round(similarity.cosine("x", "y"), 6).alias("cosine"))


@_query("""WITH w AS (SELECT doc_id, list_distinct(string_split(lower(replace(text, chr(10), ' ')), ' ')) AS s FROM documents) SELECT a.doc_id, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def i22_set_jaccard(spark, sf_dir):
    w = base(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower(whole_text()), " ")).alias("s"))
    pairs = w.withColumnRenamed("s", "a").join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b")), "doc_id")
    return pairs.select("doc_id", similarity.set_jaccard("a", "b").alias("jaccard"))


@_query("""WITH f AS (SELECT p_partkey AS k, unnest([{'f': p_brand, 'w': 3.0}, {'f': p_type, 'w': 2.0}, {'f': 's' || p_size::VARCHAR, 'w': 1.0}], recursive := true) FROM part),
t AS (SELECT k, sum(w) AS t FROM f GROUP BY k), s AS (SELECT a.k, sum(least(a.w, b.w)) AS s FROM f a JOIN f b ON b.k = a.k + 1 AND a.f = b.f GROUP BY a.k)
SELECT x.k AS p_partkey, round(coalesce(s.s, 0) / (x.t + y.t - coalesce(s.s, 0)), 6)::DOUBLE AS score FROM t x JOIN t y ON y.k = x.k + 1 LEFT JOIN s ON s.k = x.k""")
def i23_weighted_jaccard(spark, sf_dir):
    p = base(spark, sf_dir, "part").select("p_partkey", F.create_map("p_brand", F.lit(3.0), "p_type", F.lit(2.0), F.concat(F.lit("s"), F.col("p_size").cast("string")), F.lit(1.0)).alias("m"))
    pairs = p.withColumnRenamed("m", "a").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("m").alias("b")), "p_partkey")
    return pairs.select("p_partkey", F.round(similarity.weighted_jaccard("a", "b"), 6).alias("score"))


@_query("""SELECT p_partkey, CASE WHEN trim(p_name) <> '' THEN 'tag:' || lower(trim(p_name)) END AS feature, 'decade:' || ((floor((1900 + p_size) / 10) * 10)::INT)::VARCHAR || 's' AS decade FROM part""")
def i24_feature_keys(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    return p.select("p_partkey", text.feature_key(F.lit("tag"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("feature"), text.decade_key(F.col("p_size") + 1900).alias("decade"))


@_query("""SELECT p_partkey, printf('%.1f%%', p_size / 50.0 * 100) AS pct FROM part""")
def i31_percent(spark, sf_dir):
    return base(spark, sf_dir, "part").select("p_partkey", text.percent_text(F.col("p_size") / 50.0).alias("pct"))


@_query("""SELECT c_custkey, sha256('{"city":"x","name":"' || c_name || '"}') AS hash FROM customer""")
def i35_payload_hash(spark, sf_dir):
    return base(spark, sf_dir, "customer").select("c_custkey", text.payload_hash(F.create_map(F.lit("name"), "c_name", F.lit("city"), F.lit("x"))).alias("hash"))


@_query("""SELECT c_custkey, 'name=' || c_name || ';Api-Key=***REDACTED***;my_token=***REDACTED***' AS redacted FROM customer""")
def i36_redaction(spark, sf_dir):
    c = base(spark, sf_dir, "customer").withColumn("m", F.create_map(F.lit("name"), "c_name", F.lit("Api-Key"), F.lit("s1"), F.lit("my_token"), F.lit("s2")))
    return c.select("c_custkey", F.array_join(F.transform(F.map_entries(text.redact_map_column("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("redacted"))


@_query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value, 2) END AS n, CASE WHEN event_id % 2 = 0 THEN event_id END AS k FROM events""")
def i39_safe_numbers(spark, sf_dir):
    e = base(spark, sf_dir, "events")
    return e.select("event_id", number(F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise("n/a"), 2).alias("n"), whole_number(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x")).alias("k"))


@_query(with_tables("entities") + """ SELECT source, source_id, length(trim(name)) > 2 AND NOT regexp_full_match(trim(name), 'Q?[0-9]+') AS usable FROM entities""")
def c01_usable_names(spark, sf_dir):
    return table(spark, sf_dir, "entities").select("source", "source_id", usable_name("name").alias("usable"))


@_query("""SELECT o_orderkey, year(o_orderdate) BETWEEN 1995 - 1 AND 1995 + 1 AS inside FROM orders""")
def a19_year_window(spark, sf_dir):
    """The remote search window as a local predicate on epoch seconds."""
    low, high = year_bounds(1995, 1)
    epoch = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long") * 86400
    o = base(spark, sf_dir, "orders").withColumns({"e": epoch, "y": F.lit(1995)})
    return o.select("o_orderkey", (in_year_window("e", "y", 1) & F.col("e").between(low, high - 1)).alias("inside"))


def canonical_id_sql(keys: str) -> str:
    """SQL of the name-based UUID (version 5) of keys joined by bars."""
    h = f"sha1(unhex('{ids.CANONICAL_NAMESPACE.hex}') || encode('{ids.CANONICAL_PREFIX}' || {keys}))"
    variant = f"substr('89ab', (('0x' || substr({h}, 17, 1))::INT & 3) + 1, 1)"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), {variant} || substr({h}, 18, 3), substr({h}, 21, 12))"


_RAWG_KEY = "'rawg:' || p_partkey::VARCHAR"


@_query(f"SELECT p_partkey, {canonical_id_sql(_RAWG_KEY)} AS id FROM part")
def i25_canonical_ids(spark, sf_dir):
    """Name-based UUIDs of single keys."""
    p = base(spark, sf_dir, "part")
    return p.select("p_partkey", ids.canonical_id(F.array(F.concat(F.lit("rawg:"), F.col("p_partkey").cast("string")))).alias("id"))
