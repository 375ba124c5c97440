"""Payloads of each source to staging tables."""

import json

from conftest import rows
from pyspark.sql import functions as F

from marlstone.sources import landing, staging


def raw(spark, *payloads):
    """(record id, payload, seconds) as landing rows."""
    data = [(i, r, p if isinstance(p, str) or p is None else json.dumps(p, ensure_ascii=False), t) for i, (r, p, t) in enumerate(payloads)]
    df = spark.createDataFrame(data, "seq long, source_record_id string, response_json string, t long")
    return df.withColumn("loaded_at", F.timestamp_seconds("t")).drop("t")


ITEM = {
    "id": 1, "slug": "game", "name": "Game!", "released": "2013-09-17", "rating": 4.5, "rating_top": 5, "ratings_count": 10, "metacritic": 92, "playtime": 70,
    "genres": [{"name": "Action"}, {"name": "RPG"}, {"name": "Action"}], "tags": [{"name": "Co-op"}, {"name": "Open"}],
    "platforms": [{"platform": {"name": "PC"}}, {"platform": {"name": "PC"}}], "esrb_rating": {"id": 4, "name": "M"},
}


def test_rawg(spark):
    index = raw(spark, (None, {"results": [ITEM, {"id": 2, "name": "", "released": "broken"}, {"name": "no id"}]}, 1), (None, {"results": []}, 2))
    details = raw(spark, ("1", {"id": 1, "name": "Game detailed", "released": None, "description_raw": "Text", "website": "http://w", "developers": [{"name": "Dev"}], "publishers": [{"name": "Pub"}]}, 3))
    b = staging.stage_rawg(index, details)
    one = {r.source_id: r for r in b["entities"].collect()}
    assert set(one) == {"1", "2"} and one["1"].name == "Game detailed" and one["1"].name_normalized == "game detailed"
    assert one["1"].release_date is None and one["1"].quality_flags["has_details"] == "true" and one["1"].game_type == "game"  # a null detail overrides
    assert one["2"].release_year is None and one["2"].name_normalized is None
    assert [b[t].count() for t in ("genres", "platforms", "tags", "companies", "descriptions", "ratings", "popularity")] == [2, 2, 2, 2, 1, 3, 1]
    assert rows(b["urls"], "url_type", "url") == [("metacritic_url", "https://www.metacritic.com/game/game"), ("website", "http://w")]
    assert rows(b["ratings"].where("rating_type = 'rawg_metacritic'"), "rating_value", "rating_scale", "rating_count") == [(92.0, "100", None)]


def value(x):
    return {"type": "literal", "value": x}


def test_wikidata(spark):
    bindings = [
        {"game": value("http://www.wikidata.org/entity/Q1"), "labelEn": value("Game"), "rawg": value("game"), "aliasEn": value("G"), "releaseDate": value("2013-01-01T00:00:00Z")},
        {"game": value("http://www.wikidata.org/entity/Q1"), "labelEn": value("Later"), "rawg": value("game-2"), "aliasEn": value("G2"), "aliasRu": value("И"), "articleEn": value("https://en.wikipedia.org/wiki/G")},
        {"labelEn": value("no id")},
    ]
    docs = raw(spark, ("Q1", {"entities": {"Q1": {"labels": {"ru": {"value": "Игра"}}, "aliases": {"ru": [{"value": "Игрушка"}]}, "sitelinks": {"ruwiki": {"title": "Игра один"}}, "claims": {"P1733": [{"mainsnak": {"datavalue": {"value": "271590"}}}]}}}}, 5), ("Q2", {"entities": {}}, 5))
    b = staging.stage_wikidata(raw(spark, (None, {"results": {"bindings": bindings}}, 1)), docs)
    e = {r.source_id: r for r in b["entities"].collect()}
    assert e["Q1"].name == "Игра" and e["Q1"].name_normalized == "" and e["Q1"].release_year == 2013  # ASCII normal form of a staging pass
    assert e["Q2"].name == "Q2" and e["Q1"].quality_flags["has_ru_label"] == "true"
    assert rows(b["aliases"], "alias", "language") == [("G", "en"), ("G2", "en"), ("И", "ru"), ("Игрушка", "ru")]
    assert rows(b["external_ids"], "external_source", "external_id") == [("rawg", "game-2"), ("steam", "271590")]  # the last binding wins
    assert rows(b["urls"], "url_type", "url") == [("enwiki", "https://en.wikipedia.org/wiki/G"), ("ruwiki", "https://ru.wikipedia.org/wiki/Игра_один")]
    uri = spark.createDataFrame([("http://x/genid/1/",), ("Q7",), ("",), (None,)], "v string")
    assert [r[0] for r in uri.select(staging.hub_id(F.col("v"))).collect()] == ["1", "Q7", None, None]


def test_steam(spark):
    data = {
        "steam_appid": 10, "name": "X remaster now", "type": "DLC", "is_free": False, "supported_languages": "English", "platforms": {"windows": True, "mac": False, "linux": True},
        "categories": [{"description": "Solo"}, {"description": "Solo"}], "genres": [{"description": "Action"}], "release_date": {"coming_soon": False, "date": "14 апр. 2015"},
        "developers": ["D", " D ", ""], "publishers": ["P"], "metacritic": {"score": 96}, "recommendations": {"total": 5}, "short_description": " a  b ", "detailed_description": "", "header_image": "h",
    }
    b = staging.stage_steam(raw(spark, ("10", {"10": {"success": True, "data": data}}, 1), ("11", {"11": {"success": False}}, 1), ("12", "[]", 1), (None, "{}", 1)))
    e = b["entities"].collect()
    assert [(r.source_id, r.release_date, r.is_dlc, r.is_remaster, r.is_demo) for r in e] == [("10", "2015-04-14", True, True, False)]
    assert e[0].quality_flags["category_count"] == "1" and e[0].quality_flags["is_demo_not_inferred"] == "true" and "is_remaster_not_inferred" not in e[0].quality_flags
    assert rows(b["platforms"], "value") == [("linux",), ("windows",)] and b["companies"].count() == 2
    assert rows(b["descriptions"], "description_type", "language", "description_text", "source_url") == [("short_description", "ru", "a b", "https://store.steampowered.com/app/10/")]
    assert rows(b["urls"], "url_type") == [("header_image",), ("store_url",)] and rows(b["external_ids"], "external_id") == [("10",)]


def test_wikipedia(spark):
    page = {"title": "A b", "lang": "en", "pageid": 5, "extract": " x  y ", "content_urls": {"desktop": {"page": "https://en.wikipedia.org/wiki/A_b"}}}
    wrapped = {"response": {**page, "lang": None}, "selection": {"qid": "Q9", "language": "ru"}}
    bare = {k: page[k] for k in ("title", "content_urls")}
    b = staging.stage_wikipedia(raw(spark, (None, page, 1), (None, wrapped, 1), (None, wrapped, 2), (None, bare, 1), (None, {"extract": "no title"}, 1)))
    assert rows(b["descriptions"], "source_id", "language", "description_text") == [("5", "en", "x y"), ("Q9", "ru", "x y"), ("Q9", "ru", "x y")]
    assert rows(b["urls"], "source_id") == [("5",), ("Q9",), ("en:A_b",)] and rows(b["external_ids"], "external_id") == [("Q9",)]


def test_igdb(spark):
    game = {
        "id": 7, "name": "G demo x remake y", "slug": "g", "first_release_date": 1379376000, "alternative_names": [{"name": "Alt"}, {"name": "Alt"}], "game_localizations": [{"name": "Loc"}],
        "genres": [{"name": "RPG"}], "keywords": [{"name": "k"}], "themes": [{"name": "t"}], "platforms": [{"name": "PC"}], "summary": "s", "storyline": " ", "rating": 80.5, "rating_count": 3,
        "involved_companies": [{"company": {"name": "C"}, "developer": True, "publisher": True}, {"company": {"name": "C"}, "developer": True}], "updated_at": 9,
        "external_games": [{"uid": "10", "external_game_source": {"name": "Steam"}}, {"uid": "", "external_game_source": {"name": "x"}}],
        "websites": [{"category": 1, "url": "u"}, {"category": 1, "url": "u"}, {"url": "v"}],
    }
    b = staging.stage_igdb(raw(spark, ("7", {"id": 7, "name": "old"}, 1), ("7", game, 2), (None, {"name": "no id"}, 3)))
    e = b["entities"].first()
    assert (e.name, e.release_date, e.is_demo, e.is_remake, b["entities"].count()) == ("G demo x remake y", "2013-09-17", True, False, 1)
    assert rows(b["aliases"], "alias", "alias_type") == [("Alt", "igdb_alternative_name"), ("Loc", "igdb_localization")]
    assert rows(b["external_ids"], "external_source", "external_id", "confidence") == [("igdb", "7", 1.0), ("steam", "10", 0.9)]
    assert rows(b["companies"], "company_role") == [("developer",), ("publisher",)] and rows(b["urls"], "url_type", "url") == [("1", "u"), ("website", "v")]
    assert [b[t].count() for t in ("genres", "tags", "themes", "platforms", "descriptions", "ratings", "popularity")] == [1] * 7


def test_refresh_only_touches_its_sources(spark):
    index = raw(spark, (None, {"results": [{"id": 1, "name": "Ведьмак demo 3", "released": "2015"}]}, 1))
    store = raw(spark, ("10", {"10": {"success": True, "data": {"name": "Ведьмак"}}}, 1))
    both = staging.union_bundles(staging.stage_rawg(index, raw(spark, ("9", None, 1)).limit(0)), staging.stage_steam(store))
    got = {r.source: r for r in staging.refresh_entities(both["entities"]).collect()}
    assert got["rawg"].name_normalized == "ведьмак demo 3" and got["rawg"].is_demo and got["rawg"].release_year == 2015 and got["rawg"].release_date is None
    assert got["rawg"].quality_flags["partial_release_date"] == "true" and got["rawg"].quality_flags["normalized_name_refreshed"] == "true"
    assert got["steam"].source_priority == 60 and "normalized_name_refreshed" not in got["steam"].quality_flags


def test_latest_raw_and_missing_tables(spark, tmp_path):
    df = raw(spark, ("a", {"v": 1}, 1), ("a", {"v": 2}, 2), ("a", "[]", 3), ("b", {"v": 3}, 1)).withColumns({"id": F.col("seq"), "http_status": F.when(F.col("seq") == 3, 500)})
    assert rows(landing.latest_raw(df, "source_record_id"), "response_json") == [('{"v": 2}',)]
    assert landing.read_table(spark, f"file://{tmp_path}", "stg", "entities", source="rawg", limit=5).count() == 0
    assert landing.read_csv(spark, f"file://{tmp_path}/none.csv").count() == 0 and landing.read_json(spark, f"file://{tmp_path}/none.json") is None
