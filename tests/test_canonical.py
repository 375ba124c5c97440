"""Components, survivorship, strategies and risk."""

import random

from conftest import rows
from pyspark.sql import functions as F

from marlstone.functions.ids import CANONICAL_NAMESPACE
from marlstone.functions.scoring import STRATEGIES, Strategy
from marlstone.operators import canonical, strategies
from marlstone.operators.graph import connected_components
from marlstone.plans.scratch import Scratch

RECORD = "source string, source_id string, name string, release_year int, external_ids map<string,string>"
VIEW = (
    "pair_id string, source_a string, source_id_a string, source_b string, source_id_b string, name_a string, name_b string, candidate_source string, label_value string, "
    "name_similarity double, release_year_diff bigint, same_game_probability double, review_status string, review_label boolean"
)


def records(spark, *data):
    return spark.createDataFrame([(*d, None, {})[: max(5, len(d))] if len(d) < 5 else d for d in data], RECORD)


def test_components_match_brute_force(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(40)] + [(7, 7), (None, 3)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a int, b int"), Scratch(spark, "t"))))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert found == {x: root(x) for x in up}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "t")).count() == 0


def pair(pid, a, b, **more):
    row = {"pair_id": pid, "source_a": a[0], "source_id_a": a[1], "source_b": b[0], "source_id_b": b[1], "name_a": "A", "name_b": "B", "candidate_source": "external_id", "label_value": "1",
           "name_similarity": 0.95, "release_year_diff": 0, "same_game_probability": 0.5, "review_status": None, "review_label": None}
    return tuple({**row, **more}.values())


def test_canonical_v0(spark):
    recs = records(
        spark, ("rawg", "1", "Game", 2013, {"rawg": "g"}), ("wikidata", "Q1", "Игра", 2014, {"rawg": "g", "steam": "10"}), ("steam", "10", "Game (Steam)", 2012, {"steam": "10"}),
        ("igdb", "5", "Game", 2013, {"igdb": "5"}), ("wikidata", "Q9", "Q9", None, {}),
    )
    pairs = spark.createDataFrame([pair("a", ("rawg", "1"), ("wikidata", "Q1")), pair("b", ("rawg", "1"), ("igdb", "5"), candidate_source="igdb_search", label_value=None)], VIEW)
    members = canonical.components(recs, canonical.v0_edges(pairs))
    entities = {tuple(e["keys"]): e for e in canonical.canonical_entities(recs, members).collect()}
    merged = entities[("rawg:1", "steam:10", "wikidata:Q1")]
    assert (merged.canonical_name, merged.release_year, merged["size"]) == ("Game", 2013, 3)
    assert entities[("igdb:5",)]["size"] == 1 and entities[("wikidata:Q9",)].canonical_name == "Q9"
    summary = {(r.metric, r.key): r.value for r in canonical.component_summary(members).collect()}
    assert summary[("canonical_game_count", "")] == 3 and summary[("merged_component_count", "")] == 1 and summary[("max_component_size", "")] == 3
    aliases = spark.createDataFrame([("wikidata", "Q1", " Alias ", "ru"), ("wikidata", "Q1", "", "en")], "source string, source_id string, alias string, language string")
    wiki = spark.createDataFrame([("Q1",), ("Q77",)], "source_id string")
    tables = canonical.canonical_tables(recs, members, aliases, wiki)
    assert tables["sources"].where("source = 'wikipedia'").count() == 1
    assert rows(tables["sources"].where("linkage_confidence = 0.5"), "source_id") == [("5",), ("Q9",)]
    named = rows(tables["aliases"].where(F.col("canonical_id") == merged.canonical_id), "alias", "language")
    assert ("Alias", "ru") in named and ("Game", None) in named and ("Игра", None) not in named
    external = rows(tables["external_ids"].where(F.col("canonical_id") == merged.canonical_id), "external_source", "external_id")
    assert ("rawg", "g") in external and ("wikidata", "Q1") in external


def test_v1_edges(spark):
    a, b = ("rawg", "1"), ("wikidata", "Q1")
    view = spark.createDataFrame(
        [
            pair("ok", a, b), pair("far", ("rawg", "2"), b, release_year_diff=3), pair("low", ("rawg", "3"), b, name_similarity=0.5),
            pair("denied", ("rawg", "4"), b, review_status="reviewed", review_label=False),
            pair("saved", ("rawg", "5"), b, candidate_source="shared_alias", label_value=None, review_status="reviewed", review_label=True), pair("null", ("rawg", "6"), b, release_year_diff=None),
        ],
        VIEW,
    )
    got = rows(canonical.v1_edges(view).select("u.id", "edge_source"))
    assert got == [("1", "deterministic_external_id"), ("5", "manual_positive"), ("6", "deterministic_external_id")]


def test_namespace_is_fixed():
    assert CANONICAL_NAMESPACE.version == 5


def test_strategy_evaluation(spark):
    recs = records(spark, ("rawg", "1", "A", None, {}), ("igdb", "2", "B", None, {}))
    view = spark.createDataFrame([pair("p", ("rawg", "1"), ("igdb", "2"), candidate_source="igdb_search", label_value=None, same_game_probability=0.96, review_status="reviewed", review_label=False)], VIEW)
    plain = strategies.evaluate_strategy(recs, view, Strategy("m", "model_only", 0.95)).first()
    assert (plain.false_positive, plain.precision, plain.f1) == (1, 0.0, None)
    hybrid = strategies.evaluate_strategy(recs, view, Strategy("h", "hybrid", 0.95, block_negatives=True)).first()
    assert (hybrid.true_negative, hybrid.false_positive, hybrid.edge_count, hybrid.precision) == (1, 0, 0, None)


def test_bridges_sizes_and_risk(spark):
    recs = records(spark, ("rawg", "1", "A", None, {}), ("rawg", "2", "A2", None, {}), ("igdb", "3", "B", None, {}), ("steam", "9", "Z", None, {}))
    view = spark.createDataFrame(
        [
            pair("p", ("rawg", "1"), ("igdb", "3"), review_status="reviewed", review_label=True, same_game_probability=0.99),
            pair("q", ("rawg", "2"), ("igdb", "3"), candidate_source="igdb_search", label_value=None, same_game_probability=0.99, review_status="reviewed", review_label=False),
        ],
        VIEW,
    )
    strategy = Strategy("t", "hybrid", 0.9)
    edges, members = strategies.strategy_members(recs, view, strategy)
    assert rows(strategies.bridge_counts(edges, "t"), "source_pair", "edge_origin", "edge_count") == [("igdb <-> rawg", "model", 1), ("igdb <-> rawg", "trusted_and_model", 1)]
    assert rows(strategies.size_distribution(members, "t"), "component_size_bucket", "component_count") == [("1", 1), ("3-5", 1)]
    risk = strategies.risky_components(recs, view, edges, members, "t").collect()
    assert len(risk) == 1 and risk[0].risk_score == 110 and risk[0].same_source_duplicate_sources == "rawg:2" and risk[0].component_label == "B | A | A2"
    assert [strategies.size_bucket(F.lit(n)) is not None for n in (1, 2, 4)]
    assert strategies.merge_risks(view, members, "t").count() == 1
    assert strategies.likely_wrong_negatives(view).first().pair_id == "q"


def test_every_strategy_runs(spark):
    recs = records(spark, ("rawg", "1", "A", None, {}), ("igdb", "2", "B", None, {}))
    view = spark.createDataFrame([pair("p", ("rawg", "1"), ("igdb", "2"), same_game_probability=0.91)], VIEW)
    got = dict(rows(strategies.compare_strategies(recs, view, STRATEGIES[:2]), "strategy", "edge_count"))
    assert got == {"canonical_v1_trusted": 1, "model_auto_095": 0}


def test_all_strategies_at_once_give_what_each_gives_alone(spark):
    draw = random.Random(3)
    recs = records(spark, *((s, str(i), f"{s}{i}", None, {}) for s in ("rawg", "igdb", "wikidata") for i in range(12)))
    view = spark.createDataFrame(
        [
            pair(
                f"p{k}", ("rawg", str(draw.randrange(12))), (draw.choice(["igdb", "wikidata"]), str(draw.randrange(12))), candidate_source=draw.choice(["external_id", "igdb_search"]),
                label_value=draw.choice(["1", None]), same_game_probability=draw.choice([0.5, 0.75, 0.92, 0.97]), review_status=draw.choice(["reviewed", None]), review_label=draw.choice([True, False, None]),
            )
            for k in range(30)
        ],
        VIEW,
    )
    together = {r.strategy: r for r in strategies.compare_strategies(recs, view).collect()}
    assert set(together) == {s.name for s in STRATEGIES}
    for strategy in STRATEGIES:
        assert strategies.evaluate_strategy(recs, view, strategy).collect() == [together[strategy.name]]
    assert len({r.component_count for r in together.values()}) > 1


def test_components_in_one_task_and_in_rounds(spark):
    draw = random.Random(1)
    links = [(("s", str(draw.randrange(60))), ("t", str(draw.randrange(60)))) for _ in range(45)] + [(("s", "1"), ("s", "1")), (("s", None), None)]
    kind = "struct<source:string,id:string>"
    edges = spark.createDataFrame(links, f"u {kind}, v {kind}")
    found = [sorted(map(str, connected_components(edges, Scratch(spark, "few"), few=few).collect())) for few in (0, 10, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 40
    assert connected_components(edges.limit(0), Scratch(spark, "few"), few=9).count() == 0
