"""Table schemas by layer: raw envelopes, staging, pairs and reviews, canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def schema(fields: str) -> T.StructType:
    """Schema of ``name type, ...`` (Spark's own parser needs a session)."""
    pairs = (f.split() for f in fields.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW = schema(
    "id bigint, request_id string, source string, endpoint string, request_hash string, source_record_id string, response_json string, "
    "response_hash string, response_storage_path string, loaded_at timestamp, from_cache boolean, http_status int, error_message string"
)
_KEY = "source string, source_id string"
STAGING: dict[str, T.StructType] = {
    "entities": schema(
        f"{_KEY}, name string, name_normalized string, release_date string, release_year int, slug string, game_type string, is_dlc boolean, "
        "is_demo boolean, is_remake boolean, is_remaster boolean, is_bundle boolean, raw_loaded_at timestamp, source_priority int, "
        "quality_flags map<string,string>"
    ),
    "aliases": schema(f"{_KEY}, alias string, language string, alias_type string"),
    "external_ids": schema(f"{_KEY}, external_source string, external_id string, confidence double"),
    "genres": schema(f"{_KEY}, value string"),
    "themes": schema(f"{_KEY}, value string"),
    "tags": schema(f"{_KEY}, value string"),
    "platforms": schema(f"{_KEY}, value string"),
    "companies": schema(f"{_KEY}, company_name string, company_role string"),
    "descriptions": schema(f"{_KEY}, description_type string, language string, description_text string, source_url string"),
    "ratings": schema(f"{_KEY}, rating_type string, rating_value double, rating_scale string, rating_count int"),
    "popularity": schema(f"{_KEY}, metric_name string, metric_value double, metric_unit string"),
    "urls": schema(f"{_KEY}, url_type string, url string, language string"),
}
_PAIR = "pair_id string, source_a string, source_id_a string, source_b string, source_id_b string"
MATCHING: dict[str, T.StructType] = {
    "pairs": schema(f"{_PAIR}, candidate_source string, label_source string, label_value string, confidence double"),
    "features": schema(
        "pair_id string, name_similarity double, alias_similarity double, release_year_diff bigint, external_id_exact_match boolean, "
        "developer_overlap double, publisher_overlap double, platform_jaccard double, genre_jaccard double, tag_jaccard double, "
        "description_available_flag boolean, description_language_match boolean, source_count_signal bigint, reasons map<string,string>, features_json string"
    ),
    "predictions": schema("pair_id string, model_name string, model_version string, same_game_probability double, decision string, predicted_at timestamp"),
    "searches": schema(
        "source_name string, source_game_id string, candidate_source string, igdb_id string, search_rank int, query_text string, query_strategy string, confidence double"
    ),
    "reviews": schema(
        "pair_id string, review_label boolean, review_status string, selection_strategy string, priority_score double, reviewer string, review_notes string, reviewed_at timestamp"
    ),
}
CANONICAL: dict[str, T.StructType] = {
    "entities": schema("canonical_id string, canonical_name string, release_year int"),
    "sources": schema(f"canonical_id string, {_KEY}, linkage_confidence double"),
    "aliases": schema("canonical_id string, alias string, language string"),
    "external_ids": schema("canonical_id string, external_source string, external_id string"),
    "recommendations": schema("canonical_id string, recommended_id string, rank int, score double, algorithm string, shared_features array<string>"),
}
# Keys of the raw tables' upserts.
_REQUEST = ("source", "endpoint", "request_hash")
_RECORD = (*_REQUEST, "source_record_id")
RAW_KEYS = {
    "rawg_game_index": _RECORD,
    "rawg_game_details": _REQUEST,
    "rawg_reference_data": _REQUEST,
    "wikidata_sparql_results": _REQUEST,
    "wikidata_entities": _RECORD,
    "steam_app_details": _RECORD,
    "wikipedia_pages": _RECORD,
    "igdb_games": _RECORD,
    "igdb_reference_data": _REQUEST,
    "igdb_search_results": _RECORD,
}
LAYERS = {"raw": {k: RAW for k in RAW_KEYS}, "stg": STAGING, "ml": MATCHING, "dm": CANONICAL}
