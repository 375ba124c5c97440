"""Registered queries do the whole job: no guard, prefix, filter or folding below the operator's own."""

from conftest import rows

import __spark_entry__
from marlstone.operators import training
from marlstone.queries import matching


def saved(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def test_recommender_runs_under_the_operators_own_limits(spark, tmp_path):
    """Blocks of 61 to 500 parts make candidates, held against brute force."""
    parts = [(i, f"part {i:03d}", f"Brand#{i % 2}", f"TYPE {i % 7}", i % 5, 900.0 + i % 40) for i in range(150)]
    root = saved(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    found = __spark_entry__.queries()
    weights = lambda p: {("b", p[2]): 3.0, ("t", p[3]): 2.0, ("s", p[4]): 1.0, ("d", int(p[5]) // 10): 0.25}
    candidates, expected = set(), set()
    for a in parts:
        near, scored = [], []
        for b in parts:
            wa, wb = weights(a), weights(b)
            shared = sum(w for k, w in wa.items() if k in wb)
            if a is not b and shared:
                near.append((-shared, str(b[0]), shared / (12.5 - shared), b[1]))
        candidates |= {(str(a[0]), other, -less) for less, other, _, _ in sorted(near)[:250]}
        scored = sorted((-raw, name, other) for _, other, raw, name in sorted(near)[:250] if raw >= 0.12)[:10]
        expected |= {(str(a[0]), other, k, round(-less, 6)) for k, (less, _, other) in enumerate(scored, 1)}
    assert set(rows(found["d08_blocked_candidates"](spark, root))) == candidates
    got = found["f04_recommendations"](spark, root)
    assert set(rows(got, "canonical_id", "recommended_id", "rank", "score")) == expected
    assert len(expected) == 1500


def test_whole_texts_of_all_documents_are_read(spark, tmp_path):
    texts = {1: "One two\nThree one", 2: " ".join(f"w{i}" for i in range(300)) + "\none\n" + "Three", 3: None, 4: ""}
    root = saved(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    found = __spark_entry__.queries()
    long = texts[2].lower().split()
    assert rows(found["i04_distinct_titles"](spark, root)) == sorted([(1, "one|two|three"), (2, "|".join(long)), (3, None), (4, None)], key=repr)
    assert {r.doc_id: (r.unicode_name, r.ascii_name, r.collapsed) for r in found["i01_normal_forms"](spark, root).collect()} == {
        1: ("one two three one", "one two three one", "One two Three one"), 2: (" ".join(long), " ".join(long), " ".join(texts[2].split())), 3: (None,) * 3, 4: (None,) * 3,
    }
    assert {r.doc_id: r.jaccard for r in found["i22_set_jaccard"](spark, root).collect()}[1] == round(2 / 303, 6)


def test_components_and_documents_of_whole_tables(spark, tmp_path):
    orders = [(k, k % 700) for k in range(1500)]
    root = saved(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long")
    low = {}
    for k, c in orders:
        low[c] = min(low.get(c, 0), -1 - k)
    found = __spark_entry__.queries()
    assert dict(rows(found["k01_components"](spark, root), "node", "component")) == low | {-1 - k: low[c] for k, c in orders}
    parts = [(i, f"part {i}", 5) for i in range(390, 450)]
    saved(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_size int")
    got = {r.source_id: r.name for r in found["j02_wikidata_entities"](spark, root).collect()}
    assert all(got[f"Q{i}"] == f"ru part {i}" for i, _, _ in parts)


def test_training_takes_all_reviews_and_the_operators_ratio(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(training, "training_frame", lambda p, f, e, reviews, *, ratio=training.MAX_NEGATIVE_RATIO: taken.update(n=reviews.count(), ratio=ratio))
    root = "/root/testdata/sf0.001"
    matching.training_rows(spark, root)
    reviewed = matching.table(spark, root, "view").where("review_status = 'reviewed' and review_label is not null").count()
    assert taken == {"n": reviewed, "ratio": training.MAX_NEGATIVE_RATIO} and reviewed


def test_risky_components_are_not_limited(spark):
    plan = __spark_entry__.queries()["e13_risky_components"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().logical().toString()
    assert "Limit" not in plan


def test_strategies_take_all_pairs_of_the_view(spark):
    from marlstone.queries import graph

    rows_, records = graph.review_records(spark, "/root/testdata/sf0.001")
    view = matching.table(spark, "/root/testdata/sf0.001", "view")
    assert rows_.count() == view.count() and records.count() == view.select("source_a", "source_id_a").union(view.select("source_b", "source_id_b")).distinct().count()


def _without_pairs(spark, monkeypatch, query):
    """The query's plan; the tables that it writes are records alone, and nothing of a pair's is dealt out before its features are known."""
    written, table = [], matching.Scratch.table
    monkeypatch.setattr(matching.Scratch, "table", lambda self, df, name: (written.append(name), table(self, df, name))[1])
    plan = __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert written == ["records"] and "Python" not in plan and "Pandas" not in plan
    return plan


def test_pair_features_do_not_write_or_move_pairs(spark, monkeypatch):
    plan = _without_pairs(spark, monkeypatch, "i27_pair_features")
    assert "Exchange" not in plan[: plan.index("Join")]


def test_feature_summary_makes_pairs_once(spark, monkeypatch):
    plan = _without_pairs(spark, monkeypatch, "e02_feature_summary")
    pairs = __spark_entry__.queries()["i27_pair_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == pairs.count("Scan parquet")
