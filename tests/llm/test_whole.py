"""The text stages do the whole job: near copies between 0.80 and 0.85 go, and every notice of a list is found."""

import random

import corpus_pipeline
from marlstone.llm import licenses


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_between_80_and_85_go(spark):
    draw, texts, gone = random.Random(4), {}, set()
    for k in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        copy = list(words)
        for at in range(10, 170 if k % 2 else 210, 40):
            copy[at] = f"x{draw.randrange(10**6)}"
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        similarity = len(a & b) / len(a | b)
        assert 0.80 <= similarity < 0.85 if k % 2 else similarity < 0.80
        texts |= {k: " ".join(words), 100 + k: " ".join(copy)}
        gone |= {100 + k} if k % 2 else set()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert set(texts) - kept == gone


def notices(text):
    return [(k, place, d) for k, place, d, _ in licenses.scan(text.encode())]


def test_every_notice_of_a_list_is_found():
    long = [(k, t) for k, texts in licenses.TEMPLATES.items() for t in texts if len(licenses.wording(t.encode())) >= licenses.LONG]
    text, expected, at = "", [], 0
    for licence, t in [*long, *long[::-1]]:
        words = t.split()
        words[len(words) // 2] = "otherwise"
        text += " ".join(words) + " end of this entry. "
        expected.append((licence, at))
        at += len(licenses.wording(" ".join(words).encode())) + 4
    assert [(k, place) for k, place, _ in notices(text)] == expected
    bsd3, bsd2 = licenses.TEMPLATES["BSD-3-Clause"][0], licenses.TEMPLATES["BSD-2-Clause"][0]
    assert [k for k, _, _ in notices(f"{bsd3} one more entry {bsd2}")] == ["BSD-3-Clause", "BSD-2-Clause"]
    assert [k for k, _, _ in notices(bsd3)] == ["BSD-3-Clause"]
    mit = "Licensed under the MIT License"
    assert notices(f"{mit} . {mit}") == [("MIT", 0, 0), ("MIT", 5, 0)]
    for licence in ("GPL-3.0", "GPL-2.0"):
        assert [k for k, _, _ in notices(licenses.TEMPLATES[licence][1])] == [licence]
