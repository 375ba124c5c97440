"""Merges, sinks, requests, control, service, streaming."""

import hashlib
import json
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__
from marlstone.operators import canonical, rank
from marlstone.plans import control
from marlstone.plans.catalog import build_catalog
from marlstone.plans.demo import staging
from marlstone.plans.scratch import Scratch, shared_folder
from marlstone.plans.service import CatalogService, review_label
from marlstone.sources import requests, schemas, sinks
from marlstone.sources.landing import empty, read_jsonl, read_table
from marlstone.streaming import ingest


def test_first_and_top_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), ("a", 2, "w"), (None, 1, "n")], "k string, v int, t string")
    assert rows(rank.first_per_key(df, ["k"], [F.desc("v"), "t"]), "k", "t") == [("a", "w"), ("b", "z"), (None, "n")]
    assert rows(rank.top_per_key(df, ["k"], [F.desc("v"), "t"], 2).where("k = 'a'"), "t", "rank") == [("w", 1), ("y", 2)]
    assert rank.cap_rows(df, ["v", "t"], 2).count() == 2 and rank.cap_rows(df, ["v"], None).count() == 5


def test_numbering_is_a_total_order(spark, monkeypatch):
    df = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("v"), F.lit("t").alias("t"))
    assert rows(rank.numbered(df, [F.desc("v")]), "v", "n") == rows(df.select("v", (500 - F.col("v")).alias("n")))
    monkeypatch.setattr(rank, "TOP_ROWS", 10)
    assert rows(rank.cap_rows(df, ["v"], 123), "v") == rows(spark.range(123)) and rank.cap_rows(df.limit(0), ["v"], 50).count() == 0


def test_merges(spark):
    schema = "source_a string, source_id_a string, source_b string, source_id_b string, pair_id string, candidate_source string, label_source string, label_value string, confidence double"
    old = spark.createDataFrame([("r", "1", "w", "2", "old", "external_id", "s", "1", 0.9), ("r", "9", "w", "2", "kept", "x", None, None, None)], schema)
    new = spark.createDataFrame([("r", "1", "w", "2", "new", "shared_alias", None, None, 0.95), ("r", "3", "w", "2", "added", "shared_alias", None, None, 0.7)], schema)
    got = rows(rank.merge_candidate_pairs(old, new), "pair_id", "candidate_source", "label_value", "confidence")
    assert got == [("added", "shared_alias", None, 0.7), ("kept", "x", None, None), ("old", "external_id", "1", 0.95)]
    once = rank.merge_candidate_pairs(rank.merge_candidate_pairs(old, new), new)
    assert rows(once) == rows(rank.merge_candidate_pairs(old, new))  # redelivery changes nothing
    assert rows(rank.replace_on_keys(old, new.where("source_id_a = '1'"), ["source_id_a"]), "pair_id") == [("kept",), ("new",)]
    assert rows(rank.delete_rows(old, F.col("label_value") == "1"), "pair_id") == [("kept",)] and rank.delete_rows(old).count() == 0


def test_partition_replacement(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_partition(spark.createDataFrame([("a", 1), ("b", 2)], "source string, k int"), path, "source", ["source", "k"])
    sinks.replace_partition(spark.createDataFrame([("a", 7)], "source string, k int"), path, "source")
    assert rows(spark.read.parquet(path), "source", "k") == [("a", 7), ("b", 2)]
    with pytest.raises(ValueError):
        sinks.replace_partition(spark.createDataFrame([("a", 1), ("a", 1)], "source string, k int"), path, "source", ["source", "k"])


def test_export_and_packs(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("x", {"b": "2", "a": "1"}, [1, 2], "5"), (None, None, None, "bad")], "s string, m map<string,string>, l array<int>, n string")
    out = sinks.conformed(df, schemas.schema("s string, m string, l string, n int, absent double"))
    assert rows(out) == sorted([("x", '{"a":"1","b":"2"}', "[1,2]", 5, None), (None, None, None, None, None)], key=repr)
    sinks.write_dataset(df, f"{root}/free.parquet")
    assert dict(spark.read.parquet(f"{root}/free.parquet").dtypes)["m"] == "string"
    with pytest.raises(ValueError):
        sinks.export_datasets([sinks.Dataset("none", df.limit(0), required=True)], root)
    assert sinks.export_datasets([sinks.Dataset("some", df.select("s"))], root) == {"some": 2}
    sinks.write_jsonl(df.select("s", "n"), f"{root}/pack/rows")
    manifest = sinks.file_checksums(spark, f"{root}/pack", "*.json.gz")
    assert sinks.verify_checksums(spark, f"{root}/pack", manifest).count() == 0
    broken = manifest.select("path", F.lit("0").alias("sha256")).unionByName(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert sorted(r.problem for r in sinks.verify_checksums(spark, f"{root}/pack", broken).collect())[-1] == "missing"
    back = read_jsonl(spark, f"{root}/pack/rows", schemas.schema("s string, n string"), partitions=2)
    assert rows(back) == sorted([("x", "5"), (None, "bad")], key=repr)
    sinks.write_quality_csv(df.limit(0).select("s"), f"{root}/empty")
    assert spark.read.option("header", True).csv(f"{root}/empty").first().status == "empty"
    svg = sinks.bar_chart_svg(spark.createDataFrame([("a<", 2.0), ("b", 4.0)], "n string, v double"), "n", ["v"], title="T")
    assert svg.count("<rect") == 2 and "a&lt;" in svg


def test_manifest(spark):
    counts = sinks.table_counts({"t": spark.createDataFrame([("rawg",), ("wikidata",)], "source string")})
    assert sinks.pack_manifest(counts)["run_status"] == "completed" and sinks.pack_manifest(counts)["missing_optional_sources"] == ["igdb", "steam", "wikipedia"]
    assert sinks.pack_manifest(counts, warnings=["w"])["run_status"] == "partial"
    assert sinks.pack_manifest(counts.limit(0))["run_status"] == "failed"


def test_request_texts():
    assert requests.games_by_ids([1, 2], ["id"]) == "fields id; where id = (1, 2); limit 2;"
    assert requests.search_games('say "x"', fields=["id"], release_year=2000, year_window=1) == (
        'fields id; search "say \\"x\\""; where first_release_date != null & first_release_date >= 915148800 & first_release_date < 1009843200; limit 5;'
    )
    for wrong in (lambda: requests.games_by_ids([]), lambda: requests.search_games(" "), lambda: requests.by_rawg_ids([" "]), lambda: requests.sparql_query("x", limit=1)):
        with pytest.raises(ValueError):
            wrong()
    assert 'VALUES ?rawg { "a" "b\\"c" }' in requests.by_rawg_ids(["a", 'b"c'])
    assert requests.sparql_query("labels_aliases", limit=0).endswith("LIMIT 1") and len(requests.reference_queries()) == 10
    assert requests.encode_title("A b/ц") == "A_b%2F%D1%86"
    with pytest.raises(PermissionError):
        requests.steam_app_list()


def test_pacing_and_retry():
    slept, clock = [], iter([0.0, 0.1, 5.0])
    pacer = requests.paced(requests.RateLimit(2, 1.0), clock=lambda: next(clock), sleep=slept.append)
    assert [round(next(pacer), 2) for _ in range(3)] == [0.0, 0.4, 0.0]
    answers, waits = iter([requests.Answer(503, ""), requests.Answer(429, ""), requests.Answer(200, "{}")]), []
    assert requests.call_with_retry(lambda: next(answers), sleep=waits.append).status == 200 and waits == [0.5, 1.0]
    assert requests.call_with_retry(lambda: requests.Answer(403, ""), sleep=waits.append).status == 403
    with pytest.raises(TimeoutError):
        requests.call_with_retry(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)
    assert requests.Retry().wait(9) == 4.0
    assert requests.configured_limit("rawg", {}, {"RAWG_REQUESTS_PER_SECOND": "3"}) == requests.RateLimit(3, 1.0)
    assert requests.configured_limit("wikidata", {"requests_per_minute": 7}, {}) == requests.RateLimit(7, 60.0) and requests.configured_limit("x", {}, {}) is None


def test_tokens_are_renewed_before_they_end():
    asked, now = [], [0.0]

    def transport(request):
        asked.append(request)
        return requests.Answer(200, json.dumps({"access_token": f"t{len(asked)}", "expires_in": 100}))

    headers = requests.igdb_headers(transport, {"IGDB_CLIENT_ID": "half", "TWITCH_CLIENT_ID": "id", "TWITCH_CLIENT_SECRET": "s"}, clock=lambda: now[0])
    taken = []
    for now[0] in (0.0, 39.0, 40.0):
        taken.append(next(headers)["Authorization"])
    assert taken == ["Bearer t1", "Bearer t1", "Bearer t2"] and asked[0].params["client_id"] == "id" and "'s'" not in str(asked[0].log_row())
    for environment, answer in (({}, requests.Answer(200, "{}")), ({"IGDB_CLIENT_ID": "a", "IGDB_CLIENT_SECRET": "b"}, requests.Answer(403, "no"))):
        with pytest.raises(PermissionError):
            next(requests.igdb_headers(lambda r: answer, environment))  # noqa: B023


def test_landing_pull(spark, tmp_path):
    (tmp_path / "rawg").mkdir()
    (tmp_path / "rawg" / "5.json").write_text(json.dumps({"id": 5}))
    pull = requests.Landing(requests.file_transport(str(tmp_path)), quota={"rawg": 2}, sleep=lambda s: None)
    assert pull.fetch(requests.rawg_details(5))["http_status"] == 200
    assert pull.fetch(requests.rawg_details(5))["from_cache"] is True and pull.quota["rawg"] == 1
    assert pull.fetch(requests.rawg_details(6))["error_message"] == "HTTP 404"
    with pytest.raises(requests.QuotaExceeded):
        pull.fetch(requests.rawg_details(7))
    with pytest.raises(LookupError):
        pull.fetch(requests.rawg_details(8), cache_only=True)
    assert rows(pull.table(spark), "source_record_id", "http_status") == [("5", 200), ("6", 404)]


def test_quota_logs_and_states(spark):
    log = spark.createDataFrame([("a", "2026-01-05 00:00:00"), ("a", "2026-01-06 00:00:00"), ("a", "2026-02-01 00:00:00"), ("b", None)], "source string, t string").withColumn("requested_at", F.col("t").cast("timestamp"))
    usage = control.quota_usage(log)
    assert rows(usage) == [("a", "2026-01", 2), ("a", "2026-02", 1)]
    limits = spark.createDataFrame([("a", 2)], "source string, quota_limit long")
    assert rows(control.quota_status(usage, limits), "quota_period", "remaining", "exceeded") == [("2026-01", 0, True), ("2026-02", 1, False)]
    events = spark.createDataFrame([("r", "p", "s", "running", 0), ("r", "p", "s", "completed", 5)], "run_id string, pipeline_name string, stage_name string, status string, t long").withColumn("logged_at", F.timestamp_seconds("t"))
    assert rows(control.run_states(events), "status", "duration_ms") == [("completed", 5000)]


def test_store_checks(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert len(control.schema_problems(spark, root)) == control.expected_table_count()
    empty(spark, schemas.STAGING["genres"]).write.parquet(f"{root}/stg/genres")
    assert control.existing_tables(spark, root) == ["stg.genres"] and read_table(spark, root, "stg", "genres").count() == 0
    assert rows(control.readiness(spark, root, ["stg/genres", "x"], ["y"])) == [("stg/genres", "ok"), ("x", "error"), ("y", "warning")]


def test_catalog_build_and_service(spark):
    def t(name, *data):
        fields = schemas.STAGING[name].fieldNames()
        return spark.createDataFrame([tuple(d.get(f) for f in fields) for d in data], schemas.STAGING[name])

    e = lambda s, i, n, y: {"source": s, "source_id": i, "name": n, "name_normalized": n.lower(), "release_year": y}
    stg = {
        "entities": t("entities", e("rawg", "1", "Halo", 2001), e("wikidata", "Q1", "Halo", 2001), e("rawg", "2", "Halo Two", 2004), e("steam", "9", "Other", 2004)),
        "external_ids": t("external_ids", {"source": "wikidata", "source_id": "Q1", "external_source": "rawg", "external_id": "1"}),
        "genres": t("genres", *[{"source": s, "source_id": i, "value": "Shooter"} for s, i in (("rawg", "1"), ("rawg", "2"), ("steam", "9"))]),
    }
    reviews = spark.createDataFrame([], schemas.MATCHING["reviews"])
    built = build_catalog(spark, stg)
    assert built.canonical["entities"].count() == 3 and built.canonical["sources"].count() == 4
    pair = built.pairs.first().pair_id
    reviews = spark.createDataFrame([(pair, None, "pending", None, None, None, None, None)], schemas.MATCHING["reviews"])
    service = CatalogService(spark, built.staging, built.canonical, built.pairs, built.view, reviews, built.predictions, built.recommendations, write_key="k")
    assert service.health() == {"status": "ok"} == service.health_store() and service.version()["version"]
    halo = service.games(search="halo").collect()
    assert [r.canonical_name for r in halo] == ["Halo", "Halo Two"] and halo[0].source_count == 2
    detail = service.game(halo[0].canonical_id).first()
    assert detail.genres == ["Shooter"] and len(detail.sources) == 2
    assert service.similar(halo[0].canonical_id).count() == 2 and service.recommend(["halo two"]).count() == 2
    with pytest.raises(PermissionError):
        service.update_review(pair, label="positive")
    with pytest.raises(LookupError):
        service.update_review("none", key="k", label="positive")
    assert service.update_review(pair, key="k", label="positive").first().review_label is True
    assert {r.metric: r.value for r in service.stats_ml().collect()}["manual_positive_labels"] == 1
    assert service.stats_catalog().count() > 0 and service.stats_graph().count() == 2 and service.health_sources().count() == 3
    assert service.explain_recommendation(entity=halo[0].canonical_id).first().explanation_ru.startswith("Для игры `Halo`")
    assert service.explain_match(mode="llm", provider="mock").first().provider == "mock" and service.review_matches().count() == 1
    assert (review_label("positive"), review_label("0"), review_label(None)) == (True, False, None)
    with pytest.raises(ValueError):
        review_label("maybe")


def _written(monkeypatch):
    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (names.append(name), table(self, df, name))[1])
    return names


def test_canonical_entities_are_built_without_other_pairs(spark, monkeypatch):
    """Pairs, features and predictions are not made for entities merged by identifiers, which are those that all pairs give."""
    root, written = "/root/testdata/sf0.001", _written(monkeypatch)
    got = __spark_entry__.queries()["k09_catalog_build"](spark, root)
    assert "records" in written and not {"pairs", "features", "rows", "predictions", "recommendations"} & set(written)
    built = build_catalog(spark, staging(spark, root))
    members = canonical.components(built.records, canonical.v0_edges(built.pairs))
    wiki = built.staging["descriptions"].where("source = 'wikipedia'").select("source_id")
    every = canonical.canonical_tables(built.records, members, built.staging["aliases"], wiki)
    counts = every["sources"].groupBy("canonical_id").agg(F.count("*").alias("sources"))
    assert rows(got) == rows(every["entities"].join(counts, "canonical_id")) and built.pairs.groupBy("candidate_source").count().count() > 1
    assert all(rows(built.canonical[name]) == rows(df) for name, df in every.items()) and set(built.canonical) == set(every)
    pairs = rows(built.pairs, "pair_id")
    assert rows(built.features, "pair_id") == rows(built.predictions, "pair_id") == rows(built.view, "pair_id") == pairs
    assert built.recommendations.count() and built.ratings.count() and rows(built.extra["members"]) == rows(members)
    again = len(written)
    assert built.view.count() == len(pairs) and built.canonical["aliases"].count() and len(written) == again


def test_reviewed_pairs_are_merged_by_a_build(spark):
    e = lambda s, i, n: (s, i, n, n.lower())
    entities = spark.createDataFrame([e("rawg", "1", "Halo"), e("wikidata", "Q1", "Halo"), e("rawg", "2", "Myst"), e("wikidata", "Q2", "Myst")], "source string, source_id string, name string, name_normalized string")
    entities = empty(spark, schemas.STAGING["entities"]).unionByName(entities, allowMissingColumns=True)
    pairs = {(r.source_id_a, r.source_id_b): r.pair_id for r in build_catalog(spark, {"entities": entities}).pairs.collect()}
    assert set(pairs) == {("1", "Q1"), ("2", "Q2")} and build_catalog(spark, {"entities": entities}).canonical["entities"].count() == 4
    reviews = spark.createDataFrame([(pairs["1", "Q1"], "reviewed", True), (pairs["2", "Q2"], "pending", None)], "pair_id string, review_status string, review_label boolean")
    reviews = empty(spark, schemas.MATCHING["reviews"]).unionByName(reviews, allowMissingColumns=True)
    sources = build_catalog(spark, {"entities": entities}, reviews=reviews).canonical["sources"]
    assert sorted(r.ids for r in sources.groupBy("canonical_id").agg(F.array_sort(F.collect_list("source_id")).alias("ids")).collect()) == [["1", "Q1"], ["2"], ["Q2"]]


def test_stream_keeps_the_last_delivery(spark, tmp_path):
    landing, table = tmp_path / "landing", f"file://{tmp_path}/table"
    landing.mkdir()
    row = lambda i, h, at, status=None: json.dumps({"id": i, "source": "rawg", "request_hash": h, "source_record_id": h, "response_json": "{}", "loaded_at": at, "http_status": status})
    (landing / "1.json").write_text("\n".join([row(1, "a", "2026-01-01T00:00:00"), row(1, "a", "2026-01-01T00:00:00"), row(2, "b", "2026-01-01T00:00:00", 500)]))
    stream = ingest.landing_stream(spark, f"file://{landing}")
    query = ingest.start_latest(stream, table, f"file://{tmp_path}/checkpoint", ["source", "request_hash"])
    query.awaitTermination(60)
    (landing / "2.json").write_text(row(3, "c", "2026-01-02T00:00:00"))
    query = ingest.start_latest(ingest.landing_stream(spark, f"file://{landing}"), table, f"file://{tmp_path}/checkpoint", ["source", "request_hash"])
    query.awaitTermination(60)
    last = max(int(p.name.removeprefix("v=")) for p in (tmp_path / "table").iterdir() if p.name.startswith("v="))
    assert rows(ingest.read_latest(spark, table, last), "request_hash") == [("a",), ("c",)]


def test_reports_are_bounded_and_checksums_are_streamed(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "a b").mkdir(parents=True)
    (tmp_path / "in" / "a b" / "x%20.bin").write_bytes(bytes(3_000_000))
    (tmp_path / "in" / "short").write_bytes(b"x")
    expected = [("a b/x%20.bin", hashlib.sha256(bytes(3_000_000)).hexdigest(), 3_000_000), ("short", hashlib.sha256(b"x").hexdigest(), 1)]
    assert rows(sinks.file_checksums(spark, f"file://{tmp_path}/in")) == expected
    monkeypatch.setattr(sinks, "arrow_store", lambda uri: (_ for _ in ()).throw(OSError(uri)))
    assert rows(sinks.file_checksums(spark, f"file://{tmp_path}/in")) == expected
    monkeypatch.setattr(sinks, "REPORT_ROWS", 3)
    sinks.write_json_report(spark.range(3), f"file://{tmp_path}/r")
    with pytest.raises(ValueError):
        sinks.write_csv_report(spark.range(4), f"file://{tmp_path}/r")


def test_scratch_wants_a_shared_folder_on_a_cluster():
    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder or d), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://h:7077", "hdfs://h/x/")) == "hdfs://h/x" and shared_folder(session("local[4]")).startswith("file://")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
