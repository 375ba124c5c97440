"""Decontamination, near-duplicates, substrings and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import decontaminate, mixing, neardup, substring
from marlstone.llm.words import spaced

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, component string, h string, size string"


def documents(spark, texts, sources=None, start=0):
    """Documents with extra columns whose names clash with those that operators use."""
    data = [(start + i, t, "en", (sources[i] if sources else "s"), len(t or ""), "d", "c", "h", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def vocabulary(draw, n):
    return ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 6))) for _ in range(n)]


def corpus(seed=5, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empty and long texts."""
    draw = random.Random(seed)
    words = vocabulary(draw, 400)
    passage = [draw.choice(words) for _ in range(70)]
    texts = []
    for i in range(n):
        own = [draw.choice(words) for _ in range(draw.choice([1, 3, 9, 25, 80, 200]))]
        if i % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = passage[draw.randrange(20) : draw.randrange(45, 70)]
        texts.append(draw.choice([" ", "\n", "\t  "]).join(own))
        if i % 7 == 0:
            texts.append(texts[-1])
        if i % 5 == 0:
            changed = texts[-1].split()
            changed[draw.randrange(len(changed))] = "CHANGED"
            texts.append(" ".join(changed))
    return [*texts, None, "", " \n ", "x", "X x", " ".join(draw.choice(words) for _ in range(6000)), " ".join(["same"] * 90), " nbsp  \x0b vt"]


def test_word_rules():
    text = "A b\x0bC\x1cd 　e"
    assert [w.decode() for w in spaced(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", text)
    mixed = "Ab-1é_Z\x00q r"
    low = re.sub("[A-Z]", lambda m: m[0].lower(), mixed)
    assert [w.decode() for w in decontaminate.terms(mixed.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# --- decontamination -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(texts, items):
    wanted = {}
    for item, text in items:
        w = terms(text)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wanted.setdefault(tuple(w[s : s + k]), set()).add(str(item))
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = terms(text), set(), set()
        for k in {len(x) for x in wanted}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in wanted:
                    hit |= set(range(s, s + k))
                    found |= wanted[tuple(w[s : s + k])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0], ids=["broadcast", "joined"])
def test_decontamination_matches_brute_force(spark, limit):
    texts = [t and t.replace(" ", "-", 3) for t in corpus(8)]
    items = [(1, " ".join((texts[8] or "").split()[3:18])), (10, texts[4]), (2, "x"), (3, None), (4, "..."), (5, texts[4]), (6, "CHANGED"), (7, "one two three four five six seven eight nine ten eleven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, texts), bench, broadcast_bytes=limit).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == contaminated(texts, items)
    assert any(r.n_hit for r in got) and any(not r.n_hit and r.n_words for r in got)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0], ids=["broadcast", "joined"])
def test_rows_with_repeated_and_null_ids(spark, limit):
    text, other = "a b c d e f g h i j k", "one two"
    data = [(1, text), (1, text), (1, other), (None, text), (None, "x"), (2, None), (3, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "b c d e f g h i j k"), (8, "two"), (8, "two"), (None, "x")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in decontaminate.contamination(docs, bench, broadcast_bytes=limit).collect()), key=str)
    assert got == sorted([(1, 11, 10, ["7"])] * 2 + [(1, 2, 1, ["8"]), (None, 11, 10, ["7"]), (None, 1, 1, ["None"]), (2, 0, 0, []), (3, 0, 0, [])], key=str)
    clean = decontaminate.clean_documents(docs, bench, broadcast_bytes=limit)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == [(2, None), (3, "")]
    cut = sorted((str(r.doc_id), r.text) for r in decontaminate.cut_hits(docs, bench, broadcast_bytes=limit).where("text is not null").collect())
    assert cut == [("1", "a" + " " * 10)] * 2 + [("1", "one "), ("3", ""), ("None", ""), ("None", "a" + " " * 10)]


def test_index_fits_its_stated_size():
    draw = random.Random(1)
    words = vocabulary(draw, 30_000)
    items = [(i, " ".join(draw.choice(words) for _ in range(60)).encode()) for i in range(3000)]
    index = decontaminate.BenchmarkIndex(items)
    assert index.size_in_bytes() <= 6.5 * sum(len(t) for _, t in items)


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "window_hashes", lambda codes, size: np.zeros(max(0, len(codes) - size + 1), np.uint64))
    index = decontaminate.BenchmarkIndex([(1, b"a b"), (2, b"c d"), (3, b"a b"), (4, b"e f")], 2)
    hit, items = index.scan([b"x", b"a", b"b", b"c"])
    assert hit.tolist() == [False, True, True, False] and items == {"1", "3"}


def test_decontamination_of_empty_tables(spark):
    docs, bench = documents(spark, ["a b", None]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect()] == [False, False]


def test_clean_documents_and_cuts(spark):
    docs = documents(spark, ["keep THE, hit words here", "nothing", None])
    bench = spark.createDataFrame([(1, "the hit")], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench, broadcast_bytes=0).collect()) == [1, 2]
    assert {r.doc_id: r.text for r in decontaminate.cut_hits(docs, bench).collect()} == {0: "keep ,  words here", 1: "nothing", 2: None}


# --- near-duplicates -------------------------------------------------------------------------------


def groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("unit_rows", "unit_shingles"), [(1024, 10**6), (3, 10**6), (1024, 500)], ids=["by cluster", "by bucket and block", "by shingles"])
def test_near_duplicates_match_brute_force(spark, unit_rows, unit_shingles):
    texts = corpus(11)
    base = texts[-3].split()[:300]
    texts += [" ".join(w if (k * 7 + i) % 150 else f"e{i}" for i, w in enumerate(base)) for k in range(12)]  # a chain-like group
    got = neardup.near_duplicates(documents(spark, texts), unit_rows=unit_rows, unit_shingles=unit_shingles).collect()
    expected = groups(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected
    assert sum(not k for _, _, k in expected.values()) > 20


def test_near_duplicates_edge_cases(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "z"])
    doubled = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1, None, None, None, None)], SCHEMA))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(doubled).where("doc_id is not null").collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 0, False), (2, 2, True)]
    lost = neardup.near_duplicates(doubled).where("doc_id is null").first()
    assert lost.component_id is None and lost.kept
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    texts = {(5, "a b c d e f"), (5, "q r s t u v"), (2, "q r s t u v"), (9, "a b c d e f"), (1, "short"), (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z")}
    docs = spark.createDataFrame(sorted(texts), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 22, 1, True), (2, 2, 2, True), (5, 2, 2, False), (5, 2, 5, True), (9, 2, 5, False)]


@pytest.mark.parametrize("banded", [True, False])
def test_unit_links_match_all_pairs(banded):
    draw = np.random.default_rng(5)
    base = [np.unique(draw.integers(0, 10**6, n).astype(np.uint64)) for n in (5, 40, 40, 300, 2000)]
    sets = [np.unique(np.concatenate([b[draw.random(len(b)) > 0.06], draw.integers(0, 10**6, 1).astype(np.uint64)])) for b in base for _ in range(130)]
    ids = draw.permutation(len(sets))
    bands = np.repeat(np.arange(len(sets))[:, None] // 65, 3, axis=1) if banded else None
    forest = neardup._Forest(len(sets))
    place = {int(i): k for k, i in enumerate(ids)}
    for a, b in neardup.unit_links(ids, bands, sets, 80):
        assert forest.join(place[a], place[b])  # a forest: no link twice
    whole = neardup._Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if (bands is None or bands[i, 0] == bands[j, 0]) and neardup._linked(sets[i], sets[j], 80):
                whole.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [whole.root(i) for i in range(len(sets))]
    assert 10 < len({whole.root(i) for i in range(len(sets))}) < len(sets) - 100


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 2**63, 600).astype(np.uint64))
    b = np.concatenate([a[:500], np.unique(draw.integers(0, 2**63, 100).astype(np.uint64))])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.sketch(a, 1024) == neardup.sketch(np.sort(b), 1024)).mean() - true) < 0.06
    tiny = neardup.sketch(a[:1], 240)
    assert len(np.unique(tiny)) > 200 and (neardup.sketch(a[:1], 240) == tiny).all()


# --- substrings ------------------------------------------------------------------------------------


def removed(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[d] |= set(range(s, s + window))
            seen.add(key)
    return {d: (len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for d, (w, g) in enumerate(zip(words, gone))}


@pytest.mark.parametrize(("window", "base"), [(20, 5), (20, 10), (8, 2), (6, 3)])
def test_substrings_match_brute_force(spark, window, base):
    texts = corpus(window)
    got = substring.repeated_substrings(documents(spark, texts), window=window, base=base, with_text=True).collect()
    expected = removed(texts, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected
    assert sum(1 for n, g, _ in expected.values() if 0 < g < n) > 5
    for r in got:
        assert (r.kept_text is None) == (r.n_removed == 0)


def test_substring_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = documents(spark, [text, None])
    doubled = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, text, "en", "s", 1, None, None, None, None)], SCHEMA))
    assert sorted((r.doc_id is None, r.n_removed) for r in substring.repeated_substrings(doubled).collect()) == [(False, 0), (False, 0), (False, 0), (True, 0)]
    assert substring.repeated_substrings(docs.limit(0)).count() == 0
    for base in (6, 20):
        with pytest.raises(ValueError):
            substring.repeated_substrings(docs, window=20, base=base)


def test_window_hashes_are_of_the_words_alone():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 2**63, 60).astype(np.uint64)
    again = np.concatenate([codes[30:35], codes[7:27], codes[2:5]])
    for window in (20, 12, 7):
        a, b = substring._doubled(codes, window, substring.FIRST), substring._doubled(again, window, substring.FIRST)
        assert len(a) == 60 - window + 1 and a[7] == b[5] and len(np.intersect1d(a, b)) == 20 - window + 1
        assert not np.intersect1d(a, substring._doubled(codes, window, substring.SECOND)).size


def test_candidates_never_lose_a_repeat():
    draw = np.random.default_rng(8)
    passage = draw.integers(0, 50, 40).astype(np.uint64) + np.uint64(1000)
    texts = [np.concatenate([draw.integers(0, 40, 50).astype(np.uint64), passage[k : k + 30], draw.integers(0, 40, 50).astype(np.uint64)]) for k in range(0, 10, 3)]
    count = Counter(tuple(t[s : s + 20]) for t in texts for s in range(len(t) - 19))
    runs = [substring.window_hashes(t, 5) for t in texts]
    chosen = [np.unique(substring.chosen_runs(r, 16)) for r in runs]
    seen = Counter(int(r[p]) for r, c in zip(runs, chosen) for p in c)
    first = [substring._candidates(t, np.array([k for k, p in enumerate(c) if seen[int(r[p])] > 1]), 5, 5, 20) for t, r, c in zip(texts, runs, chosen)]
    ten = [substring.window_hashes(t, 10) for t in texts]
    at = [substring.chosen_runs(r, 6) for r in ten]
    parts = [np.unique(np.concatenate([a[np.flatnonzero(m)], a[np.flatnonzero(m) + 5]])) for a, m in zip(at, first)]
    seen = Counter(int(r[p]) for r, c in zip(ten, parts) for p in c)
    second = [substring._candidates(t, np.array([p for p in c if seen[int(r[p])] > 1]), 10, 5, 20) for t, r, c in zip(texts, ten, parts)]
    for t, one, two in zip(texts, first, second):
        again = np.array([count[tuple(t[s : s + 20])] > 1 for s in range(len(t) - 19)])
        assert again.any() and not (again & ~one).any() and not (again & ~two).any() and max(one.sum(), two.sum()) < len(one) / 2


def test_repeat_levels_match_brute_force(spark):
    texts = corpus(3)
    words, expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts], {}
    length = 5
    while True:
        count = Counter(tuple(w[s : s + length]) for w in words for s in range(len(w) - length + 1))
        level = {(d, length): n for d, w in enumerate(words) if (n := sum(count[tuple(w[s : s + length])] > 1 for s in range(len(w) - length + 1)))}
        if not level:
            break
        expected |= level
        length *= 2
    got = substring.repeat_levels(documents(spark, texts), base=5).collect()
    assert {(r.doc_id, r.length): r.n_windows for r in got} == expected and length >= 80
    assert substring.repeat_levels(documents(spark, texts).limit(0)).count() == 0


def test_chosen_runs_are_window_minima():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 50, 200).astype(np.uint64)  # many ties
    for span in (1, 2, 5, 11):
        assert substring.chosen_runs(values, span).tolist() == [i + int(np.argmin(values[i : i + span])) for i in range(len(values) - span + 1)]


# --- mixing ----------------------------------------------------------------------------------------


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_targets(spark, seed):
    draw = random.Random(seed)
    sources = [draw.choice(["a", "B", "é", "z", None, "\U0001f600", "empty"]) for _ in range(400)]
    texts = [None if s == "empty" or draw.random() < 0.05 else " ".join("w" * draw.randrange(1, 3) for _ in range(draw.choice([1, 5, 50]))) for s in sources]
    got = mixing.mix(documents(spark, texts, sources)).collect()
    sizes = Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len((t or "").split())
    expected, taken = targets(sizes), Counter()
    for r in got:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (len((texts[r.doc_id] or "").split()), sizes[s])
        assert r.target == pytest.approx(expected[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s, want in expected.items():
        assert abs(taken[s] - want) <= max(60, 0.02 * want)
    again = mixing.mix(documents(spark, texts, sources).repartition(9)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)
    rows = mixing.mixed_documents(documents(spark, texts, sources))
    assert rows.count() == sum(r.copies for r in got) and rows.columns == [*documents(spark, ["x"]).columns, "copy"]


def test_mixing_of_nothing(spark):
    assert mixing.mix(documents(spark, ["a"]).limit(0)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(documents(spark, [None, ""])).collect()] == [(0.0, 0), (0.0, 0)]
