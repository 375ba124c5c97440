"""Similarities: set and weighted Jaccard, cosine, gestalt ratio, TF-IDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import Text, as_column


def _ratios(least: float = 0.0):
    """Gestalt ratios as a pandas function; pairs that cannot reach ``least`` give null without being aligned."""

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float | None] = {}
        out: list[float | None] = []
        for a, b in zip(left, right):
            key = (a, b)
            if key not in seen:
                seen[key] = None
                if a and b:
                    matcher = SequenceMatcher(None, a, b)
                    # Shared characters in any order bound the ratio from above.
                    if not least or matcher.quick_ratio() >= least - 1e-6:
                        seen[key] = round(matcher.ratio(), 6)
            out.append(seen[key])
        return pd.Series(out, dtype="float64").astype(object).where(lambda s: s.notna(), None)

    return ratio


@pandas_udf(T.DoubleType())
def gestalt_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio to six digits, null if a side is null or empty.

    No Catalyst expression computes it; use it after blocking, on distinct pairs
    (``with_gestalt_ratio``).  The ratio depends on the order of its arguments.
    """
    return _ratios()(left, right)


#: Lengths of two texts of a ratio of at least 0.75 differ by a factor of 5 / 3 at most: they lie in equal or neighbouring bands.
BAND_BASE = 1.667


def length_band(text: Text) -> Column:
    """Number of the band of a text's length; null for null and empty texts."""
    n = F.length(as_column(text))
    return F.when(n > 0, F.floor(F.log(BAND_BASE, n.cast("double"))).cast("int"))


def with_gestalt_ratio(df: DataFrame, left: str, right: str, name: str, *, least: float = 0.0) -> DataFrame:
    """``df`` with the gestalt ratio of two columns, computed once for each distinct pair.

    Ratios below ``least`` may be null: twice the shorter length over the sum of
    the lengths bounds the ratio, which is looked at before Python.
    """
    pairs = df.select(F.col(left).alias("__l"), F.col(right).alias("__r")).where("__l is not null and __r is not null")
    if least:
        a, b = F.length("__l"), F.length("__r")
        pairs = pairs.where(2 * F.least(a, b) >= (a + b) * (least - 1e-6))
    udf = pandas_udf(_ratios(least), T.DoubleType()) if least else gestalt_ratio
    scored = pairs.distinct().select("__l", "__r", udf("__l", "__r").alias(name))
    return df.join(scored, (F.col(left) == F.col("__l")) & (F.col(right) == F.col("__r")), "left").drop("__l", "__r")


def set_jaccard(left: Text, right: Text) -> Column:
    """|a & b| / |a | b| to six digits; null when a side is null or empty."""
    a, b = as_column(left), as_column(right)
    usable = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(usable, F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6))


def weighted_jaccard(left: Text, right: Text) -> Column:
    """Sum of minima over sum of maxima of two map<string,double>; 0 without shared keys."""
    both = F.map_zip_with(as_column(left), as_column(right), lambda k, a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).otherwise(F.lit(0.0)))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    shared = total(both)
    union = total(as_column(left)) + total(as_column(right)) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def dot(left: Text, right: Text) -> Column:
    """Dot product of two arrays of equal length."""
    products = F.zip_with(as_column(left), as_column(right), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(left: Text, right: Text) -> Column:
    """Cosine of two vectors, 0 when one of them has no length."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm > 0, dot(left, right) / norm).otherwise(F.lit(0.0))


def component_count(documents: int, features: int, wanted: int) -> int:
    """Rank of a truncated decomposition: at most one below the smaller side, at least 0."""
    return max(0, min(wanted, min(documents, features) - 1))


def _cut(text: Column, size: int):
    return lambda i: F.substring(text, i, F.lit(size))


def _run(words: Column, size: int, glue: str):
    return lambda i: F.array_join(F.slice(words, i, size), glue)


def word_ngrams(text: Text, low: int = 1, high: int = 2) -> Column:
    """Lower-cased words (runs of word characters) as n-grams of words."""
    words = F.regexp_extract_all(F.lower(as_column(text)), F.lit(r"(?U)\w+"), F.lit(0))
    return _grams(words, low, high, " ")


def padded_char_ngrams(text: Text, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with one space on each side.

    A padded word shorter than n counts once as a whole, for the first such n only.
    """
    words = F.filter(F.split(F.lower(as_column(text)), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_word(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            longer = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), _cut(w, n))
            short = F.array(w) if n == low else F.when(F.length(w) == n, F.array(w)).otherwise(F.array().cast("array<string>"))
            parts.append(F.when(F.length(w) > n, longer).otherwise(short))
        return F.concat(*parts)

    return F.flatten(F.transform(padded, of_word))


def _grams(words: Column, low: int, high: int, glue: str) -> Column:
    parts = []
    for n in range(low, high + 1):
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), _run(words, n, glue))
        parts.append(F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def tfidf_weights(pairs: DataFrame, left: str, right: str, grams, *, key: str = "pair_id") -> DataFrame:
    """(key, side, term, w) TF-IDF weights, not normalised, of two text columns.

    The corpus is all left and right texts together; idf is
    ``ln((1 + n) / (1 + df)) + 1``.  Null texts are empty.
    """
    sides = pairs.select(key, F.lit("l").alias("side"), F.coalesce(left, F.lit("")).alias("t")).unionByName(
        pairs.select(key, F.lit("r").alias("side"), F.coalesce(right, F.lit("")).alias("t"))
    )
    terms = sides.select(key, "side", F.explode(grams(F.col("t"))).alias("term")).groupBy(key, "side", "term").agg(F.count("*").alias("tf"))
    n = sides.agg(F.count("*").alias("n"))
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n is one row
    idf = idf.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return terms.join(idf, "term").select(key, "side", "term", (F.col("tf") * F.col("idf")).alias("w"))


def distinct_texts(pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, Column]:
    """Distinct pairs of texts as (__l, __r, __times), and the condition that joins them back."""
    texts = pairs.select(F.coalesce(left, F.lit("")).alias("__l"), F.coalesce(right, F.lit("")).alias("__r"))
    same = (F.coalesce(F.col(left), F.lit("")) == F.col("__l")) & (F.coalesce(F.col(right), F.lit("")) == F.col("__r"))
    return texts.groupBy("__l", "__r").agg(F.count("*").alias("__times")), same


def text_weights(both: DataFrame, grams) -> DataFrame:
    """(t, times, term, w) of distinct texts: the weights of ``tfidf_weights``, in which a text counts as often as it occurs."""
    sides = both.select(F.col("__l").alias("t"), "__times").unionByName(both.select(F.col("__r").alias("t"), "__times"))
    texts = sides.groupBy("t").agg(F.sum("__times").alias("times"))
    terms = texts.select("t", "times", F.explode(grams(F.col("t"))).alias("term")).groupBy("t", "times", "term").agg(F.count("*").alias("tf"))
    n = texts.agg(F.sum("times").alias("n"))
    idf = terms.groupBy("term").agg(F.sum("times").alias("df")).crossJoin(F.broadcast(n))  # n is one row
    idf = idf.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return terms.join(idf, "term").select("t", "times", "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf_pair_cosine(pairs: DataFrame, left: str, right: str, grams, *, key: str = "pair_id") -> DataFrame:
    """(key, cosine) of L2-normalised TF-IDF vectors of two text columns; a side without terms gives 0.

    Terms are made once for each distinct text, cosines once for each distinct pair.
    """
    both, same = distinct_texts(pairs, left, right)
    weights = text_weights(both, grams)
    vectors = weights.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"), F.sum(F.col("w") * F.col("w")).alias("n"))
    side = lambda s: vectors.select(F.col("t").alias(f"__{s}"), F.col("v").alias(f"v{s}"), F.col("n").alias(f"n{s}"))
    met = both.join(side("l"), "__l").join(side("r"), "__r")
    shared = F.aggregate(F.map_entries("vl"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vr", e["key"]), F.lit(0.0)))
    scored = met.select("__l", "__r", (shared / F.sqrt(F.col("nl") * F.col("nr"))).alias("cosine"))
    return pairs.select(key, left, right).join(scored, same, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def text_similarity(pairs: DataFrame, left: str, right: str, *, model=None, key: str = "pair_id") -> tuple[str, DataFrame, str | None]:
    """(provider, (key, score), warning).

    ``model`` may score pandas batches (``mapInPandas`` from (key, left, right)
    to (key, cosine)); without one the TF-IDF score is used and said so.
    """
    if model is not None:
        kind = dict(pairs.dtypes)[key]
        return "embedding_model", pairs.select(key, left, right).mapInPandas(model, f"{key} {kind}, cosine double"), None
    scores = tfidf_pair_cosine(pairs, left, right, padded_char_ngrams, key=key)
    return "tfidf_fallback", scores, "no embedding model is available; TF-IDF scores are returned"


