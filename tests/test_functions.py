"""Golden values and edge cases of the scalar functions."""

import difflib
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marlstone.functions import dates, ids, scoring, similarity, text
from marlstone.operators.search import title_url, url_title


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")


def test_title_normal_forms(spark):
    df = texts(spark, ["The Witcher® 3: Wild Hunt", "  DOOM  ", "Ведьмак 3", "a b", "", "   ", None, "™", "(x) [y]-z"])
    got = dict(rows(df.select("k", text.unicode_title("v").alias("t"))))
    assert got == {0: "the witcher 3 wild hunt", 1: "doom", 2: "ведьмак 3", 3: "a b", 4: None, 5: None, 6: None, 7: None, 8: "x y z"}
    ascii_only = dict(rows(df.select("k", text.ascii_title("v").alias("t"))))
    assert ascii_only[2] == "3" and ascii_only[4] is None and ascii_only[7] is None
    staged = dict(rows(df.select("k", text.ascii_title("v", empty_as_null=False).alias("t"))))
    assert staged[7] == "" and staged[4] is None and staged[6] is None


def test_lists_and_flags(spark):
    values = F.array(*map(F.lit, ("A b", "a  B", "", "c")))
    assert one(spark, text.distinct_titles(values))[0] == ["a b", "c"]
    df = spark.createDataFrame([("Game DLC pack",), ("x remastered",), (None,)], "name string")
    flags = text.title_flags("name")
    assert [tuple(r) for r in df.select(flags["is_dlc"], flags["is_remaster"]).collect()] == [(True, False), (False, False), (False, False)]
    padded = text.title_flags("name", pad=True)
    assert [r[0] for r in df.select(padded["is_remaster"]).collect()] == [False, True, False]
    assert df.select(text.title_flag_reasons("name").alias("r")).first().r == ["is_demo_not_inferred", "is_remake_not_inferred", "is_remaster_not_inferred", "is_bundle_not_inferred"]


def test_iso_dates(spark):
    df = texts(spark, ["2013-09-17", "2013", None, " ", "soon", "2015-02-31", "2013-09-17T10:00"])
    got = {r.k: tuple(r.x) for r in df.select("k", dates.iso_release_date("v").alias("x")).collect()}
    assert got == {
        0: ("2013-09-17", 2013, None), 1: (None, 2013, "partial_release_date"), 2: (None, None, "missing_release_date"), 3: (None, None, "missing_release_date"),
        4: (None, None, "invalid_release_date"), 5: (None, 2015, "partial_release_date"), 6: ("2013-09-17", 2013, None),
    }


def test_store_prefix_and_epoch_dates(spark):
    df = texts(spark, ["17 Sep, 2013", "14 апр. 2015", "Q3 2019", "x", None, "99 Foo 2001"])
    got = [tuple(r.x) for r in df.orderBy("k").select(dates.store_release_date("v").alias("x")).collect()]
    assert got == [("2013-09-17", 2013), ("2015-04-14", 2015), (None, 2019), (None, None), (None, None), (None, 2001)]
    df = texts(spark, ["2013-09-17T00:00:00Z", "http://www.wikidata.org/.well-known/genid/x", None])
    assert [tuple(r.x) for r in df.orderBy("k").select(dates.prefix_release_date("v").alias("x")).collect()] == [("2013-09-17", 2013), (None, None), (None, None)]
    df = texts(spark, ["0", "1379376000", "-86400", "x", None, "99999999999999"])
    assert [tuple(r.x) for r in df.orderBy("k").select(dates.epoch_release_date("v").alias("x")).collect()] == [("1970-01-01", 1970), ("2013-09-17", 2013), ("1969-12-31", 1969), (None, None), (None, None), (None, None)]


def test_gestalt_ratio_is_the_standard_one(spark):
    pairs = [("game one", "game one deluxe"), ("abc", "xyz"), ("a" * 300, "ab" * 150), (None, "x"), ("", "x"), ("game one", "game one deluxe")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    expected = {i: round(difflib.SequenceMatcher(None, a, b).ratio(), 6) if a and b else None for i, (a, b) in enumerate(pairs)}
    assert dict(rows(df.select("k", similarity.gestalt_ratio("a", "b")))) == expected
    assert dict(rows(similarity.with_gestalt_ratio(df, "a", "b", "r"), "k", "r")) == expected


def test_set_similarities(spark):
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    assert one(spark, similarity.set_jaccard(strings("a", "b"), strings("b", "c", "d"))) == (0.25,)
    assert one(spark, similarity.set_jaccard(strings(), strings("b"))) == (None,)
    weights = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.lit(v))])
    left, right = weights(**{"genre:action": 3.0, "platform:pc": 0.5}), weights(**{"genre:action": 3.0, "tag:indie": 1.0})
    assert one(spark, F.round(similarity.weighted_jaccard(left, right), 6)) == (0.666667,)
    assert one(spark, similarity.weighted_jaccard(weights(a=1.0), weights(b=1.0))) == (0.0,)


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, similarity.dot(v(0.5, 1), v(1, 0)), similarity.cosine(v(1, 0), v(2, 0)), similarity.cosine(v(0, 0), v(1, 1))) == (0.5, 1.0, 0.0)
    assert (similarity.component_count(5, 9, 64), similarity.component_count(1, 9, 64)) == (4, 0)


def test_tfidf_ngrams(spark):
    assert one(spark, similarity.padded_char_ngrams(F.lit("ab c")))[0] == [" ab", "ab ", " ab ", " c "]
    assert one(spark, similarity.word_ngrams(F.lit("A b c")))[0] == ["a", "b", "c", "a b", "b c"]
    df = spark.createDataFrame([("1", "same name", "same name"), ("2", "abc", "xyz"), ("3", None, "x")], "pair_id string, a string, b string")
    got = dict(rows(similarity.tfidf_pair_cosine(df, "a", "b", similarity.word_ngrams).select("pair_id", F.round("cosine", 6))))
    assert got == {"1": 1.0, "2": 0.0, "3": 0.0}
    provider, scores, warning = similarity.text_similarity(df, "a", "b")
    assert provider == "tfidf_fallback" and warning and scores.count() == 3


def test_canonical_ids_are_uuid5(spark):
    keys = ["rawg:1", "wikidata:Q1ж"]
    expected = str(uuid.uuid5(ids.CANONICAL_NAMESPACE, "canonical_v0:" + "|".join(keys)))
    assert one(spark, ids.canonical_id(F.array(*map(F.lit, keys)))) == (expected,)
    for name in map(str, range(40)):
        assert one(spark, ids.uuid5(uuid.NAMESPACE_URL, F.lit(name))) == (str(uuid.uuid5(uuid.NAMESPACE_URL, name)),)


def test_decisions_and_buckets(spark):
    p = lambda x: one(spark, scoring.decision(F.lit(x)))[0]
    assert (p(0.97), p(0.72), p(0.20)) == ("auto_merge", "manual_review", "no_merge")
    gap = scoring.Policy(auto_merge=0.95, review_min=0.7, review_max=0.9)
    assert one(spark, scoring.decision(F.lit(0.92), gap)) == ("no_merge",)
    ranks = [one(spark, scoring.rank_bucket(F.lit(r).cast("int")))[0] for r in (None, 1, 3, 5, 6)]
    assert ranks == ["unknown", "1", "2-3", "4-5", "6+"]
    conf = [one(spark, scoring.confidence_bucket(F.lit(c).cast("double")))[0] for c in (None, 0.95, 0.85, 0.7, 0.69)]
    assert conf == ["unknown", "0.95-1.00", "0.85-0.95", "0.70-0.85", "<0.70"]
    assert one(spark, scoring.safe_ratio(F.lit(1), F.lit(2)), scoring.safe_ratio(F.lit(1), F.lit(0))) == (0.5, None)
    assert [scoring.clamp_limit(x, default=20, maximum=100) for x in (0, -1, 5, 500)] == [20, 20, 5, 100]


def test_search_confidence(spark):
    c = lambda r, s, a, b: one(spark, scoring.search_confidence(F.lit(r), F.lit(s), F.lit(a).cast("int"), F.lit(b).cast("int")))[0]
    assert c(1, "source_name", 2000, 2000) == 0.95
    assert c(1, "wikidata_alias", 2000, 2000) == 0.99
    assert c(9, "source_name", None, 2000) == 0.45


@pytest.mark.parametrize(
    ("url", "title"),
    [("https://ru.wikipedia.org/wiki/A_%28b%29?x=1", "A (b)"), ("https://x.org/a/b_c/", "b c"), ("https://en.wikipedia.org/wiki/C+1", "C+1"), ("https://e.org/wiki/100%", "100%")],
)
def test_url_titles(spark, url, title):
    assert one(spark, url_title(F.lit(url))) == (title,)


def test_title_url(spark):
    assert one(spark, title_url(F.lit("en"), F.lit("A b")), title_url(F.lit("en"), F.lit(""))) == ("https://en.wikipedia.org/wiki/A_b", None)


def test_requests_and_redaction():
    a = text.request_digest("RAWG", "https://h/x?b=1&key=s", "get", {"token": "1", "z": [1, {"k": 2}]})
    b = text.request_digest("rawg", "https://h/x?key=other&b=1", "GET", {"z": [1, {"k": 2}], "token": "2"})
    assert a == b and len(a) == 64
    assert text.masked({"Api-Key": "x", "a": {"password": "p", "b": 1}}) == {"Api-Key": text.REDACTED, "a": {"password": text.REDACTED, "b": 1}}
    assert text.masked_url("postgresql://u:p@h:5/db?token=t&a=1") == "postgresql://u:%s@h:5/db?a=1&token=%s" % (text.REDACTED, text.REDACTED.replace("*", "%2A"))
    assert text.masked(None) is None and text.masked({"list": [{"my-token": 1}, 2]}) == {"list": [{"my-token": text.REDACTED}, 2]}
    assert text.masked_url("https://u@h/x") == "https://u:@h/x" and text.masked_url("https://h:8/x?key=") == "https://h:8/x?key=%2A%2A%2AREDACTED%2A%2A%2A"
