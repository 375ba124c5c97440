"""Raw payloads to long staging tables, one function a source.

Payload columns are JSON text with a record id where the source has one; every
function returns a dict of lazy tables in the staging schemas.  Lists become
rows by explode; "first seen" orders are the orders inside the payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from marlstone.functions.dates import epoch_release_date, iso_release_date, prefix_release_date, store_release_date
from marlstone.functions.text import FLAG_TOKENS, ascii_title, collapsed_text, title_flag_reasons, title_flags, unicode_title
from marlstone.operators.rank import first_per_key
from marlstone.operators.search import title_url
from marlstone.sources.schemas import STAGING

Bundle = dict[str, DataFrame]
_NAMED = "array<struct<id:string,name:string>>"


def conform(df: DataFrame, table: str) -> DataFrame:
    """The staging columns of a table in their types; absent ones are null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in STAGING[table]])


def _clean(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def names(items: Column, field: str = "name", *, distinct: bool = True) -> Column:
    """Non-blank names of an array of structs, each once in order (or as they come)."""
    found = F.filter(F.transform(items, lambda x: _clean(x[field])), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(found) if distinct else found, F.array().cast("array<string>"))


def values(df: DataFrame, items: Column, table: str) -> DataFrame:
    return conform(df.select("source", "source_id", F.explode(items).alias("value")), table)


def _long(df: DataFrame, table: str, *rows: Column) -> DataFrame:
    """Rows of an array of structs whose null entries are left out."""
    each = df.select("source", "source_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x"))
    return conform(each.select("source", "source_id", "x.*"), table)


def _companies(df: DataFrame, **roles: Column) -> DataFrame:
    parts = [df.select("source", "source_id", F.explode(items).alias("company_name"), F.lit(role).alias("company_role")) for role, items in roles.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return conform(out, "companies")


def _flags(*, dlc: Column | None = None, demo: Column | None = None, only: tuple[str, ...] = tuple(FLAG_TOKENS)) -> dict[str, Column]:
    inferred = title_flags("name")
    out = {f: inferred[f] if f in only else F.lit(False) for f in FLAG_TOKENS}
    if dlc is not None:
        out["is_dlc"] = dlc | out["is_dlc"]
    if demo is not None:
        out["is_demo"] = demo | out["is_demo"]
    return out


def _quality(reasons: bool = False, **flags: Column) -> Column:
    """Quality map of text values; null values stay as null entries."""
    base = F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), v.cast("string"))])
    if not reasons:
        return base
    return F.map_concat(base, F.map_from_entries(F.transform(title_flag_reasons("name"), lambda r: F.struct(r, F.lit("true")))))


# --- RAWG ------------------------------------------------------------------------------------------

_RAWG_FIELDS = {
    "id": "string", "slug": "string", "name": "string", "released": "string", "tba": "boolean", "type": "string", "rating": "double",
    "rating_top": "double", "ratings_count": "int", "metacritic": "double", "playtime": "double", "website": "string", "background_image": "string",
    "reddit_url": "string", "metacritic_url": "string", "description": "string", "description_raw": "string", "genres": _NAMED, "tags": _NAMED,
    "developers": _NAMED, "publishers": _NAMED, "esrb_rating": "struct<id:string,name:string>",
    "platforms": "array<struct<name:string,platform:struct<id:string,name:string>>>",
}
_RAWG = ", ".join(f"{k} {v}" for k, v in _RAWG_FIELDS.items())


def stage_rawg(index: DataFrame, details: DataFrame) -> Bundle:
    """Index pages (response_json, loaded_at) overlaid with details (source_record_id, response_json, loaded_at).

    A key that is present in the details wins, null included; the last loaded
    index row and detail of an id count.
    """
    pages = index.select("loaded_at", F.explode(F.from_json("response_json", "results array<string>")["results"]).alias("j"))
    listed = pages.select("loaded_at", "j", F.get_json_object("j", "$.id").alias("source_id")).where("source_id is not null")
    listed = first_per_key(listed, ["source_id"], [F.desc_nulls_last("loaded_at"), "j"])
    detailed = details.select(F.col("source_record_id").cast("string").alias("source_id"), F.col("response_json").alias("d"), F.col("loaded_at").alias("d_at"))
    detailed = first_per_key(detailed.where("source_id is not null"), ["source_id"], [F.desc_nulls_last("d_at"), "d"])
    both = listed.join(detailed, "source_id", "full_outer")
    both = both.withColumns({"i": F.from_json("j", _RAWG), "x": F.from_json("d", _RAWG), "keys": F.coalesce(F.json_object_keys("d"), F.array().cast("array<string>"))})
    pick = lambda k: F.when(F.array_contains("keys", k), F.col(f"x.{k}")).otherwise(F.col(f"i.{k}")).alias(k)
    p = both.select(F.lit("rawg").alias("source"), "source_id", F.col("d").isNotNull().alias("has_details"), F.coalesce("d_at", "loaded_at").alias("raw_loaded_at"), *[pick(k) for k in _RAWG_FIELDS if k != "id"])
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    kind = F.when(F.col("tba"), F.lit("tba")).when(given("type").isNotNull(), F.col("type")).when(F.col("esrb_rating").isNotNull(), F.lit("game"))
    entities = p.select(
        "source", "source_id", F.coalesce("name", F.lit("")).alias("name"), ascii_title("name", empty_as_null=False).alias("name_normalized"),
        given("released").alias("release_date"), F.substring(given("released"), 1, 4).try_cast("int").alias("release_year"), "slug", kind.alias("game_type"),
        *[F.lit(False).alias(f) for f in FLAG_TOKENS], "raw_loaded_at", F.lit(100).alias("source_priority"),
        _quality(has_details=F.col("has_details")).alias("quality_flags"),
    )
    rating = lambda kind, c, scale, votes: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("rating_type"), F.col(c).alias("rating_value"), F.lit(scale).alias("rating_scale"), votes.alias("rating_count")))
    none = F.lit(None).cast("int")
    url = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("url_type"), c.alias("url")))
    page = F.coalesce(given("metacritic_url"), F.when((F.col("metacritic") != 0) & given("slug").isNotNull(), F.concat(F.lit("https://www.metacritic.com/game/"), "slug")))
    text = F.coalesce(given("description_raw"), given("description"))
    told = F.when(text.isNotNull(), F.struct(F.lit("summary").alias("description_type"), F.lit("en").alias("language"), text.alias("description_text"), F.col("website").alias("source_url")))
    platform = F.transform("platforms", lambda x: F.struct(F.coalesce(x["platform"]["name"], F.when(x["platform"].isNull(), x["name"])).alias("name")))
    return {
        "entities": conform(entities, "entities"),
        "genres": values(p, names(F.col("genres")), "genres"),
        "platforms": values(p, names(platform, distinct=False), "platforms"),
        "tags": values(p, names(F.col("tags")), "tags"),
        "companies": _companies(p, developer=names(F.col("developers"), distinct=False), publisher=names(F.col("publishers"), distinct=False)),
        "descriptions": _long(p, "descriptions", told),
        "ratings": _long(p, "ratings", rating("rawg_rating", "rating", "5", F.col("ratings_count")), rating("rawg_rating_top", "rating_top", "5", F.col("ratings_count")), rating("rawg_metacritic", "metacritic", "100", none)),
        "popularity": _long(p, "popularity", F.when(F.col("playtime").isNotNull(), F.struct(F.lit("playtime_hours").alias("metric_name"), F.col("playtime").alias("metric_value"), F.lit("hours").alias("metric_unit")))),
        "urls": _long(p, "urls", url("website", given("website")), url("background_image", given("background_image")), url("reddit_url", given("reddit_url")), url("metacritic_url", page)),
    }


# --- Wikidata --------------------------------------------------------------------------------------

_BINDING = ("game", "qid", "label", "labelRu", "labelEn", "releaseDate", "rawg", "steam", "igdb", "aliasRu", "aliasEn", "articleRu", "articleEn")
_SPARQL = "results struct<bindings:array<struct<" + ",".join(f"{k}:struct<type:string,value:string>" for k in _BINDING) + ">>>"
_ENTITY = (
    "entities map<string,struct<labels:map<string,struct<value:string>>,aliases:map<string,array<struct<value:string>>>,"
    "sitelinks:map<string,struct<title:string>>,claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>>>"
)
# Properties that hold ids of the other sources.
CLAIMS = {"rawg": "P9968", "steam": "P1733", "igdb": "P9043"}


def hub_id(value: Column) -> Column:
    """Last segment of an entity URI; other text stays, blank is null."""
    v = F.nullif(value, F.lit(""))
    return F.when(v.rlike("^https?://"), F.element_at(F.split(F.regexp_replace(v, "/+$", ""), "/"), -1)).otherwise(v)


def sparql_bindings(sparql: DataFrame) -> DataFrame:
    """One row a binding with its values as text (blank is null), in the order of payload and place."""
    rows = sparql.select("seq", "loaded_at", F.posexplode(F.from_json("response_json", _SPARQL)["results"]["bindings"]).alias("place", "b"))
    out = rows.select("seq", "place", "loaded_at", *[F.nullif(F.col(f"b.{k}.value"), F.lit("")).alias(k) for k in _BINDING])
    return out.withColumn("hub", hub_id(F.coalesce("qid", "game"))).where("hub is not null and hub <> ''")


def entity_claims(entity: Column, prop: str) -> Column:
    """Values of a property as text, in order."""
    claims = F.try_element_at(entity["claims"], F.lit(prop))
    return F.filter(F.transform(claims, lambda c: c["mainsnak"]["datavalue"]["value"]), lambda v: v.isNotNull())


def stage_wikidata(sparql: DataFrame, documents: DataFrame) -> Bundle:
    """Query results (response_json, loaded_at, seq) and entity documents (source_record_id, response_json, loaded_at).

    Over the bindings of a hub id in order: first non-null labels; last date,
    external ids and sitelinks; alias sets.  Documents fill missing labels and
    override ids and sitelinks.
    """
    b = sparql_bindings(sparql)
    order = F.struct("seq", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    folded = b.groupBy("hub").agg(
        *[first(c) for c in ("label", "labelRu", "labelEn")], *[last(c) for c in ("releaseDate", "rawg", "steam", "igdb", "articleRu", "articleEn")],
        F.max_by("loaded_at", order).alias("b_at"), F.collect_set("aliasRu").alias("ru"), F.collect_set("aliasEn").alias("en"),
    )
    e = documents.select(F.col("source_record_id").alias("hub"), F.col("loaded_at").alias("e_at"), F.try_element_at(F.from_json("response_json", _ENTITY)["entities"], F.col("source_record_id")).alias("e"))
    e = first_per_key(e.where("hub is not null"), ["hub"], [F.desc_nulls_last("e_at")])
    label = lambda lang: F.nullif(F.try_element_at("e.labels", F.lit(lang))["value"], F.lit(""))
    alias = lambda lang: F.coalesce(names(F.try_element_at("e.aliases", F.lit(lang)), "value"), F.array().cast("array<string>"))
    link = lambda site, lang: title_url(F.lit(lang), F.try_element_at("e.sitelinks", F.lit(site))["title"])
    e = e.select(
        "hub", "e_at", label("ru").alias("e_ru"), label("en").alias("e_en"), alias("ru").alias("a_ru"), alias("en").alias("a_en"),
        link("ruwiki", "ru").alias("l_ru"), link("enwiki", "en").alias("l_en"),
        *[F.try_element_at(entity_claims(F.col("e"), p), F.lit(1)).alias(f"e_{s}") for s, p in CLAIMS.items()],
    )
    none = F.array().cast("array<string>")
    r = folded.join(e, "hub", "full_outer").select(
        F.lit("wikidata").alias("source"), F.col("hub").alias("source_id"), F.coalesce("e_at", "b_at").alias("raw_loaded_at"),
        F.coalesce("labelRu", "e_ru").alias("ru_label"), F.coalesce("labelEn", "e_en").alias("en_label"), "label", prefix_release_date("releaseDate").alias("day"),
        *[F.coalesce(f"e_{s}", s).alias(s) for s in CLAIMS], F.coalesce("l_ru", "articleRu").alias("ruwiki"), F.coalesce("l_en", "articleEn").alias("enwiki"),
        F.array_sort(F.array_union(F.coalesce("ru", none), F.coalesce("a_ru", none))).alias("ru"),
        F.array_sort(F.array_union(F.coalesce("en", none), F.coalesce("a_en", none))).alias("en"),
    )
    r = r.withColumn("name", F.coalesce("ru_label", "en_label", "label", "source_id"))
    any_of = lambda *cs: F.coalesce(*cs).isNotNull()
    entities = r.select(
        "source", "source_id", "name", ascii_title("name", empty_as_null=False).alias("name_normalized"), F.col("day.date").alias("release_date"),
        F.col("day.year").alias("release_year"), F.col("source_id").alias("slug"), F.lit("video_game").alias("game_type"), *[F.lit(False).alias(f) for f in FLAG_TOKENS],
        "raw_loaded_at", F.lit(80).alias("source_priority"),
        _quality(has_external_ids=any_of(*CLAIMS), has_sitelinks=any_of("ruwiki", "enwiki"), has_ru_label=any_of("ru_label"), has_en_label=any_of("en_label")).alias("quality_flags"),
    )
    alt = lambda lang: r.select("source", "source_id", F.explode(lang).alias("alias"), F.lit(lang).alias("language"), F.lit("wikidata_alt_label").alias("alias_type"))
    ids = [F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("external_source"), F.col(s).alias("external_id"), F.lit(1.0).alias("confidence"))) for s in CLAIMS]
    sites = [F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("url_type"), F.col(s).alias("url"), F.lit(s[:2]).alias("language"))) for s in ("ruwiki", "enwiki")]
    return {
        "entities": conform(entities, "entities"),
        "aliases": conform(alt("ru").unionByName(alt("en")), "aliases"),
        "external_ids": _long(r, "external_ids", *ids),
        "urls": _long(r, "urls", *sites),
    }


# --- Steam -----------------------------------------------------------------------------------------

_STORE = (
    "steam_appid string, name string, type string, is_free boolean, required_age string, supported_languages string, controller_support string, "
    "platforms struct<windows:boolean,mac:boolean,linux:boolean>, categories array<struct<id:string,description:string>>, "
    "genres array<struct<id:string,description:string>>, release_date string, developers array<string>, publishers array<string>, "
    "metacritic struct<score:double>, recommendations struct<total:double>, short_description string, detailed_description string, "
    "about_the_game string, header_image string, website string"
)


def store_url(app: Column) -> Column:
    return F.concat(F.lit("https://store.steampowered.com/app/"), app, F.lit("/"))


def stage_steam(raw: DataFrame) -> Bundle:
    """App details (source_record_id, response_json, loaded_at); only successful ones count."""
    app = F.try_element_at(F.from_json("response_json", T.MapType(T.StringType(), T.StringType())), F.col("source_record_id"))
    rows = raw.where("source_record_id is not null").withColumn("app", F.from_json(app, "success boolean, data string"))
    rows = first_per_key(rows.where("app.success and app.data is not null"), ["source_record_id"], [F.desc_nulls_last("loaded_at")])
    d = rows.select(F.lit("steam").alias("source"), F.col("source_record_id").alias("source_id"), F.col("loaded_at").alias("raw_loaded_at"), F.from_json("app.data", _STORE).alias("d"))
    d = d.select("source", "source_id", "raw_loaded_at", "d.*").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "source_id"))
    # The date is an object with a text, or the text itself.
    day = store_release_date(F.coalesce(F.get_json_object("release_date", "$.date"), F.when(~F.startswith("release_date", F.lit("{")), F.col("release_date"))))
    kind = F.lower(F.coalesce("type", F.lit("")))
    categories = names(F.col("categories"), "description")
    entities = d.select(
        "source", "source_id", "name", unicode_title("name").alias("name_normalized"), day["date"].alias("release_date"), day["year"].alias("release_year"),
        F.col("source_id").alias("slug"), F.nullif("type", F.lit("")).alias("game_type"), *[c.alias(f) for f, c in _flags(dlc=kind == "dlc", demo=kind == "demo").items()],
        "raw_loaded_at", F.lit(60).alias("source_priority"),
        _quality(
            True, has_supported_languages=F.coalesce(F.col("supported_languages") != "", F.lit(False)), has_recommendations=F.col("recommendations.total").isNotNull(),
            has_metacritic=F.col("metacritic.score").isNotNull(), is_free=F.coalesce("is_free", F.lit(False)), required_age=F.col("required_age"),
            controller_support=F.col("controller_support"), category_count=F.size(categories),
        ).alias("quality_flags"),
    )
    text = lambda c: F.when(collapsed_text(c).isNotNull(), F.struct(F.lit(c).alias("description_type"), F.lit("ru").alias("language"), collapsed_text(c).alias("description_text"), F.coalesce(F.nullif("website", F.lit("")), store_url(F.col("source_id"))).alias("source_url")))
    url = lambda c: F.when(_clean(F.col(c)).isNotNull(), F.struct(F.lit(c).alias("url_type"), _clean(F.col(c)).alias("url")))
    platforms = F.filter(F.array(*[F.when(F.col(f"platforms.{p}"), F.lit(p)) for p in ("windows", "mac", "linux")]), lambda x: x.isNotNull())
    plain = lambda c: F.coalesce(F.array_distinct(F.filter(F.transform(c, lambda x: _clean(x)), lambda x: x.isNotNull())), F.array().cast("array<string>"))
    return {
        "entities": conform(entities, "entities"),
        "genres": values(d, names(F.col("genres"), "description"), "genres"),
        "tags": values(d, categories, "tags"),
        "platforms": values(d, platforms, "platforms"),
        "companies": _companies(d, developer=plain("developers"), publisher=plain("publishers")),
        "descriptions": _long(d, "descriptions", *map(text, ("short_description", "detailed_description", "about_the_game"))),
        "ratings": _long(d, "ratings", F.when(F.col("metacritic.score").isNotNull(), F.struct(F.lit("steam_metacritic").alias("rating_type"), F.col("metacritic.score").alias("rating_value"), F.lit("100").alias("rating_scale")))),
        "popularity": _long(d, "popularity", F.when(F.col("recommendations.total").isNotNull(), F.struct(F.lit("recommendations_total").alias("metric_name"), F.col("recommendations.total").alias("metric_value"), F.lit("count").alias("metric_unit")))),
        "urls": _long(d, "urls", F.struct(F.lit("store_url").alias("url_type"), store_url(F.col("source_id")).alias("url")), url("website"), url("header_image")),
        "external_ids": _long(d, "external_ids", F.struct(F.lit("steam").alias("external_source"), F.col("source_id").alias("external_id"), F.lit(1.0).alias("confidence"))),
    }


# --- Wikipedia -------------------------------------------------------------------------------------

_SUMMARY = "title string, pageid bigint, lang string, extract string, content_urls struct<desktop:struct<page:string>>"


def stage_wikipedia(raw: DataFrame) -> Bundle:
    """Page summaries, bare or wrapped as {selection, response}; the id falls back from hub id to page id to title."""
    wrapped = F.get_json_object("response_json", "$.response")
    inner = F.when(F.startswith(wrapped, F.lit("{")), wrapped).otherwise(F.col("response_json"))
    selection = F.when(F.startswith(wrapped, F.lit("{")), F.from_json(F.get_json_object("response_json", "$.selection"), "qid string, title string, language string"))
    r = raw.select("loaded_at", F.from_json(inner, _SUMMARY).alias("r"), selection.alias("s"))
    page = F.col("r.content_urls.desktop.page")
    title = _clean(F.coalesce(F.nullif("r.title", F.lit("")), "s.title"))
    language = F.trim(F.coalesce(F.nullif("s.language", F.lit("")), F.nullif("r.lang", F.lit("")), F.nullif(F.substring(F.regexp_replace(page, "^[^/]*//", ""), 1, 2), F.lit("")), F.lit("en")))
    rows = r.select(F.lit("wikipedia").alias("source"), title.alias("title"), language.alias("language"), _clean(F.col("s.qid")).alias("qid"), F.col("r.pageid").alias("page_id"), collapsed_text("r.extract").alias("text"), page.alias("page"))
    rows = rows.where("title is not null").withColumn("source_id", F.coalesce("qid", F.col("page_id").cast("string"), F.concat("language", F.lit(":"), F.replace("title", F.lit(" "), F.lit("_")))))
    told = F.when(F.col("text").isNotNull(), F.struct(F.lit("summary").alias("description_type"), F.col("language"), F.col("text").alias("description_text"), F.col("page").alias("source_url")))
    urls = rows.where("page is not null").select("source", "source_id", F.lit("page").alias("url_type"), F.col("page").alias("url"), "language")
    ids = rows.where("qid is not null").select("source", "source_id", F.lit("wikidata").alias("external_source"), F.col("qid").alias("external_id"), F.lit(1.0).alias("confidence"))
    return {
        "descriptions": _long(rows, "descriptions", told),
        "urls": conform(first_per_key(urls, ["source_id", "url_type", "url"], ["language"]), "urls"),
        "external_ids": conform(ids.distinct(), "external_ids"),
    }


# --- IGDB ------------------------------------------------------------------------------------------

_IGDB = (
    "id string, name string, slug string, version_title string, version_parent string, game_type string, first_release_date string, updated_at double, "
    f"alternative_names {_NAMED}, game_localizations {_NAMED}, genres {_NAMED}, themes {_NAMED}, keywords {_NAMED}, platforms {_NAMED}, "
    "involved_companies array<struct<company:struct<name:string>,developer:boolean,publisher:boolean,porting:boolean,supporting:boolean>>, "
    "summary string, storyline string, rating double, rating_count int, aggregated_rating double, aggregated_rating_count int, total_rating double, "
    "total_rating_count int, external_games array<struct<uid:string,external_game_source:struct<name:string>>>, websites array<struct<category:string,url:string>>"
)


def stage_igdb(raw: DataFrame) -> Bundle:
    """Game payloads (response_json, loaded_at); the last loaded one of an id counts."""
    rows = raw.select("loaded_at", F.from_json("response_json", _IGDB).alias("p")).withColumn("source_id", _clean(F.col("p.id"))).where("source_id is not null")
    p = first_per_key(rows, ["source_id"], [F.desc_nulls_last("loaded_at")]).select(F.lit("igdb").alias("source"), "source_id", F.col("loaded_at").alias("raw_loaded_at"), "p.*")
    p = p.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "source_id"))
    day = epoch_release_date("first_release_date")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    entities = p.select(
        "source", "source_id", "name", unicode_title("name").alias("name_normalized"), day["date"].alias("release_date"), day["year"].alias("release_year"),
        F.nullif("slug", F.lit("")).alias("slug"), F.nullif("game_type", F.lit("")).alias("game_type"), *[c.alias(f) for f, c in _flags(only=("is_dlc", "is_demo")).items()],
        "raw_loaded_at", F.lit(55).alias("source_priority"),
        _quality(True, has_themes=some("themes"), has_keywords=some("keywords"), has_localizations=some("game_localizations"), has_version_parent=F.col("version_parent").isNotNull()).alias("quality_flags"),
    )
    alt = lambda c, kind: p.select("source", "source_id", F.explode(names(F.col(c))).alias("alias"), F.lit(kind).alias("alias_type"))
    roles = ("developer", "publisher", "porting", "supporting")
    company = F.flatten(F.transform("involved_companies", lambda c: F.filter(F.array(*[F.when(c[r], F.struct(_clean(c["company"]["name"]).alias("company_name"), F.lit(r).alias("company_role"))) for r in roles]), lambda x: x.isNotNull())))
    companies = p.select("source", "source_id", F.explode(company).alias("c")).select("source", "source_id", "c.*").where("company_name is not null").distinct()
    other = F.transform("external_games", lambda g: F.struct(F.lower(_clean(g["external_game_source"]["name"])).alias("external_source"), _clean(g["uid"]).alias("external_id"), F.lit(0.9).alias("confidence")))
    own = F.array(F.struct(F.lit("igdb").alias("external_source"), F.col("source_id").alias("external_id"), F.lit(1.0).alias("confidence")))
    ids = p.select("source", "source_id", F.explode(F.concat(own, F.coalesce(other, F.array().cast("array<struct<external_source:string,external_id:string,confidence:double>>")))).alias("x"))
    ids = ids.select("source", "source_id", "x.*").where("external_source is not null and external_id is not null")
    site = F.transform("websites", lambda w: F.struct(F.lower(F.coalesce(F.nullif(w["category"], F.lit("")), F.lit("website"))).alias("url_type"), _clean(w["url"]).alias("url")))
    urls = p.select("source", "source_id", F.explode(site).alias("x")).select("source", "source_id", "x.*").where("url is not null").distinct()
    rating = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(f"igdb_{c}").alias("rating_type"), F.col(c).alias("rating_value"), F.lit("100").alias("rating_scale"), F.col(f"{c}_count").alias("rating_count")))
    text = lambda c: F.when(_clean(F.col(c)).isNotNull(), F.struct(F.lit(c).alias("description_type"), _clean(F.col(c)).alias("description_text")))
    return {
        "entities": conform(entities, "entities"),
        "aliases": conform(alt("alternative_names", "igdb_alternative_name").unionByName(alt("game_localizations", "igdb_localization")), "aliases"),
        "external_ids": conform(ids, "external_ids"),
        "genres": values(p, names(F.col("genres")), "genres"),
        "tags": values(p, names(F.col("keywords")), "tags"),
        "themes": values(p, names(F.col("themes")), "themes"),
        "platforms": values(p, names(F.col("platforms")), "platforms"),
        "companies": conform(companies, "companies"),
        "descriptions": _long(p, "descriptions", text("summary"), text("storyline")),
        "ratings": _long(p, "ratings", rating("rating"), rating("aggregated_rating"), rating("total_rating")),
        "popularity": _long(p, "popularity", F.when(F.col("updated_at").isNotNull(), F.struct(F.lit("updated_at_epoch").alias("metric_name"), F.col("updated_at").alias("metric_value"), F.lit("epoch_seconds").alias("metric_unit")))),
        "urls": conform(urls, "urls"),
    }


# --- second pass -----------------------------------------------------------------------------------

REFRESHED = {"rawg": 100, "wikidata": 80}


def refresh_entities(entities: DataFrame, priorities: dict[str, int] = REFRESHED) -> DataFrame:
    """Second pass over some sources: Unicode names, checked dates, flags; reasons join the quality map."""
    mine = F.col("source").isin(*priorities)
    day = iso_release_date("release_date")
    title = unicode_title("name")
    said = F.filter(
        F.concat(
            F.array(F.when(title.isNotNull() & ~title.eqNullSafe(F.col("name_normalized")), F.lit("normalized_name_refreshed")), day["reason"]), title_flag_reasons("name")
        ),
        lambda x: x.isNotNull(),
    )
    old = F.coalesce("quality_flags", F.create_map().cast("map<string,string>"))
    added = F.map_from_entries(F.transform(said, lambda r: F.struct(r, F.lit("true"))))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(added, k))
    priority = F.col("source_priority")
    for s, n in priorities.items():
        priority = F.when(F.col("source") == s, n).otherwise(priority)
    new = {
        "name_normalized": title, "release_date": day["date"], "release_year": day["year"], "source_priority": priority,
        "quality_flags": F.map_concat(kept, added), **title_flags("name"),
    }
    return entities.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})


def union_bundles(*bundles: Bundle) -> Bundle:
    """All sources' tables by name."""
    out: Bundle = {}
    for bundle in bundles:
        for name, df in bundle.items():
            out[name] = out[name].unionByName(df) if name in out else df
    return out
