"""The corpus pipeline's stages on a small corpus, each against its own input."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from marlstone.llm import queries as llm_queries
from marlstone.llm.mixing import mix
from marlstone.llm.quality import score_quality


def prose(draw, n):
    return " ".join(draw.choice(["river", "stone", "under", "light", "carries", "green", "of", "and", "morning", "window", "seven"]) + draw.choice(["", "", "a", "e", "o"]) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    draw = random.Random(9)
    item = prose(draw, 30)
    shared = prose(draw, 60)
    texts = {i: prose(draw, draw.randrange(40, 90)) for i in range(120)}
    for i in range(0, 120, 6):
        texts[i] = " ".join(w.upper() + "!!" for w in texts[i].split())  # junk
    texts |= {200 + i: texts[2 * i + 1] for i in range(10)}  # copies
    texts |= {300 + i: f"{prose(draw, 40)} {shared} {prose(draw, 40)}" for i in range(4)}
    texts |= {400: f"{prose(draw, 50)} {item} {prose(draw, 20)}", 401: None, 402: ""}
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not (i < 120 and i % 6 == 0)), 0) for i in texts if i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", texts, shared, item


def test_stages(spark, folder, tmp_path):
    root, texts, shared, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = [set(texts)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        assert out.columns[:5] == docs.columns[:5] and (k == 4 or out.columns == docs.columns)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        rows = docs.collect()
        seen.append({r.doc_id for r in rows})
        now = {r.doc_id: r.text for r in rows}
        if name == "quality_classifier":
            assert not {i for i in seen[-1] if i < 120 and i % 6 == 0} and len(seen[-1] & set(range(120))) == 100
        if name == "minhash_neardup":
            gone = seen[-2] - seen[-1]
            assert gone == {200 + i for i in range(10) if (2 * i + 1) in seen[-2]}
        if name == "substring_dedup":
            assert seen[-1] == seen[-2] and shared in now[300] and all(shared not in now[300 + i] and len(now[300 + i].split()) < 100 for i in (1, 2, 3))
            assert all(now[i] == texts[i] for i in (1, 3, 5, 400))
            assert all(r.n_chars == len(r.text or "") for r in rows)
        if name == "benchmark_decontamination":
            assert seen[-2] - seen[-1] == {400}
    assert {r.doc_id for r in rows} <= seen[-2] and max(r.copy for r in rows) == 2


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_dropped(texts, percent):
    """Ids that are not the smallest of their group of near copies."""
    sets = {}
    for i, t in texts.items():
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in texts if root(i) != i}


def without_repeats(texts, window=20):
    """Texts whose words in later occurrences of a window are gone; unchanged texts as they are."""
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = words_of(texts[i]), set()
        for s in range(len(w) - window + 1):
            if tuple(w[s : s + window]) in seen:
                gone |= set(range(s, s + window))
            seen.add(tuple(w[s : s + window]))
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    return out


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    """Every stage on what the one before kept; the first, a fitted model, against scores of the operator."""
    root, _, _, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in score_quality(docs, spark.read.parquet(f"{root}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = {i: t for i, t in texts.items() if scores[i] == 1}
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name == "minhash_neardup":
            expected = {i: t for i, t in expected.items() if i not in near_dropped(expected, 80)}
        if name == "substring_dedup":
            expected = without_repeats(expected)
        if name == "benchmark_decontamination":
            windows = {tuple(terms_of(item)[s : s + 10]) for s in range(len(terms_of(item)) - 9)}
            expected = {i: t for i, t in expected.items() if not any(tuple(terms_of(t)[s : s + 10]) in windows for s in range(len(terms_of(t)) - 9))}
        stage(spark, docs, root).write.parquet(f"file://{tmp_path}/brute-{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/brute-{name}")
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    mixed = corpus_pipeline.mixing(spark, docs, root).collect()
    copies = Counter(r.doc_id for r in mixed)
    taken = {r.doc_id: r.copies for r in mix(docs).collect()}
    assert copies == Counter({i: n for i, n in taken.items() if n}) and {(r.doc_id, r.text) for r in mixed} <= set(expected.items())
    assert sorted((r.doc_id, r["copy"]) for r in mixed) == sorted((i, k + 1) for i, n in taken.items() for k in range(n))


def test_stages_on_empty_tables(spark, folder, tmp_path):
    root = folder[0]
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        assert out.count() == 0 and out.columns[:5] == docs.columns[:5], name


def test_run_gives_the_stages_result(spark, folder):
    root = folder[0]
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() > 100


def test_registration():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_neardup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(llm_queries.oracle_sql()) <= set(llm_queries.queries())
