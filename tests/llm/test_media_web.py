"""GIF, WARC, HTML and licence operators."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import extract, gif, htmltree, licenses, media, warc, wrapper
from marlstone.plans.scratch import Scratch


# --- GIF -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trips(bits):
    draw = random.Random(bits)
    for n in (0, 1, 2, 3, 253, 254, 255, 256, 257, 4000, 30_000):
        for data in (bytes(draw.randrange(1 << bits) for _ in range(n)), bytes(n), bytes(i % 3 for i in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_lzw_reads_known_streams():
    # A 10 x 10 sample image of four colours, as published in GIF tutorials.
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    image = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert gif.lzw_decode(stream, 2, 100) == bytes(int(x) for x in "".join(image))
    with pytest.raises(ValueError):
        gif.lzw_decode(gif._pack(np.array([256, 300], np.uint32), np.array([9, 9], np.uint8)), 8, 10)
    assert gif.lzw_decode(gif.lzw_encode(b"abcabc")[:4], 8, 6) == b"ab"  # cut short


def build(frames, screen=(2, 2), palette=bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])):
    """GIF of (left, top, w, h, indices, disposal, transparent, delay, interlaced) frames with four colours."""
    out = [b"GIF89a", bytes([screen[0], 0, screen[1], 0, 0x81, 0, 0]), palette, b"\x21\xfe\x03hey\x00"]
    for left, top, w, h, data, disposal, clear, delay, lace in frames:
        out.append(bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, 0, clear or 0, 0]))
        out.append(bytes([0x2C, left, 0, top, 0, w, 0, h, 0, 0x40 if lace else 0, 2]) + gif._sub_blocks(gif.lzw_encode(bytes(data), 2)))
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_timing():
    full = (0, 0, 2, 2, [0, 0, 0, 0], 1, None, 5, False)
    for disposal, expected in ((1, [1, 0, 0, 2]), (2, [None, 0, 0, 2]), (3, [0, 0, 0, 2])):
        frames = gif.decode(build([full, (0, 0, 1, 1, [1], disposal, None, 7, False), (1, 1, 1, 1, [2], 0, None, 0, False)]), canvas=True)
        colours = {(255, 0, 0): 0, (0, 255, 0): 1, (0, 0, 255): 2}
        last = frames[-1].canvas.reshape(4, 4)
        assert [colours[tuple(p[:3])] if p[3] else None for p in last.tolist()] == expected
        assert [f.delay_ms for f in frames] == [50, 70, 0]
    seen = gif.decode(build([full, (0, 0, 2, 2, [3, 1, 3, 1], 1, 3, 1, False)]), canvas=True)[-1].canvas
    assert seen[:, 0, 0].tolist() == [255, 255] and seen[:, 1, 1].tolist() == [255, 255]


def test_interlaced_rows():
    data = [y % 4 for y in gif._row_order(10).tolist()]
    assert gif.decode(build([(0, 0, 1, 10, data, 0, None, 0, True)], screen=(1, 10)))[0].indices[:, 0].tolist() == [y % 4 for y in range(10)]


def test_media_table(spark):
    texts = ["", None, "a", "é" * 96, "x" * 192, "y" * 193, "z é " * 30_000, "a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.store_media(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert b"".join(f.indices.tobytes() for f in gif.decode(bytes(r.media))) == payload
    assert got[2][2:] == got[7][2:] and got[0][2:8] == got[1][2:8] and media.store_media(docs.limit(0)).count() == 0
    frames = media.gif_frames(media.store_media(docs.where("doc_id = 6")), id_col="doc_id").orderBy("frame").collect()
    assert len(frames) > 1 and frames[1].start_ms == 100 and sum(frames[0].red) == 192 * 256
    assert [(f.start_ms, f.red, f.disposal) for f in got[6].frames] == [(f.start_ms, f.red, 2) for f in frames]
    assert sum(frames[-1].red) == got[6].payload_bytes - 192 * 256 * (len(frames) - 1)  # earlier frames are cleared


def test_broken_and_oversize_gifs_give_no_row(spark):
    whole = build([(0, 0, 2, 2, [0, 1, 2, 3], 1, None, 5, False)])
    giant = lambda w, h: b"GIF89a" + bytes([w % 256, w // 256, h % 256, h // 256, 0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes(4) + bytes([w % 256, w // 256, h % 256, h // 256, 0, 2, 1, 0, 0, 0x3B])
    rows = [(i, bytearray(whole[:i])) for i in range(len(whole))] + [(1000, bytearray(giant(65535, 65535))), (1001, bytearray(giant(4000, 4000))), (1002, bytearray(b"no gif")), (1003, None), (1004, bytearray(whole))]
    got = media.gif_frames(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert [(r.media_id, r.width, r.red) for r in got] == [(1004, 2, [3, 0, 0, 0, 0, 0, 0, 1])]


def test_transparency_and_disposal_reach_the_frame_rows(spark):
    data = build([(0, 0, 2, 2, [0, 0, 0, 0], 1, None, 5, False), (0, 0, 2, 1, [3, 1], 3, 3, 6, False), (1, 1, 1, 1, [2], 2, None, 7, False)])
    got = media.gif_frames(spark.createDataFrame([(1, bytearray(data))], "media_id long, media binary")).orderBy("frame").collect()
    shown = [(r.start_ms, r.red[7], r.green[7], r.blue[7]) for r in got]
    assert shown == [(0, 4, 0, 0), (50, 3, 1, 0), (110, 3, 0, 1)]  # the second frame is taken back before the third


# --- WARC ------------------------------------------------------------------------------------------


def pages(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 120
    data = [(1, "http://www.Example.com/a?b=1#top", big), (2, "https://u@m.example.com:80/", big), (3, None, None), (4, "http://a.b/ x", "short"), (5, "http://a.b/", "short"), (6, "http://x.y", big + "!"), (7, "http://www.example.com/a?b=1", ""), (9, "notaurl", big)]
    return spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string"), data


def test_archive_round_trip(spark):
    table, data = pages(spark)
    got = {r.page_id: r for r in warc.archive_roundtrip(table).collect()}
    assert set(got) == {r[0] for r in data}
    for page, _, html in data:
        raw = (html or "").encode()
        again = page in (1, 2)
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 9) if again else ("response", None))
    doubled = warc.archive_roundtrip(table.where("page_id = 9").unionByName(table.where("page_id = 9")))
    assert [r.record_type for r in doubled.collect()] == ["response", "response"]
    assert warc.archive_roundtrip(table.limit(0)).count() == 0


def test_index_lookup_and_range_reads(spark, monkeypatch):
    table, _ = pages(spark)
    many = spark.range(100, 160).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example.com/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"), F.lit("x").alias("digest"))
    same = spark.range(-30, 0).select(F.col("id").alias("page_id"), F.lit("http://hot.example.com/").alias("url"), F.lit("hot").alias("html"), F.lit("x").alias("digest"))
    s = Scratch(spark, "test-warc")
    folder = warc.write_archives(table.unionByName(many).unionByName(same), s.path("a"), file_bytes=2000)
    captures = s.table(warc.read_archives(spark, folder), "captures")
    files = captures.groupBy("file").agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).collect()
    assert len(files) > 10 and all(r.bytes <= 2004 or r.n == 1 for r in files)
    blocks = warc.build_index(captures, s.path("i"), lines=7, shards=3)
    directory = warc.write_directory(blocks, s.path("d"), group=2)
    assert blocks.count() >= 14 and directory.count() >= 7 and warc.index_entries(blocks).count() == captures.count() == 98
    key = lambda url, page: warc.line_key(warc.url_key(F.lit(url)), F.lit(page).cast("long"))
    wanted = [("http://h.example.com/123", 123), ("http://www.Example.com/a?b=1#x", 1), ("http://hot.example.com/", -7), ("http://h.example.com/123", 124), ("http://zz.example.com/", 1)]
    asked = spark.range(1).select(F.explode(F.array(*[key(*w) for w in wanted])).alias("w"))
    found = s.table(warc.lookup(blocks, directory, asked), "found")
    assert sorted(r.page_id for r in found.collect()) == [-7, 1, 123]
    expected = sorted(tuple(r) for r in captures.where("page_id in (-7, 1, 123)").collect())
    for store in ("ranges", "whole files"):
        if store == "whole files":
            monkeypatch.setattr(warc, "arrow_store", lambda uri: (_ for _ in ()).throw(OSError(uri)))
        read = warc.read_ranges(found, folder)
        assert sorted(tuple(r) for r in read.mapInArrow(warc._parsed, warc.CAPTURES).collect()) == expected
        assert all(len(r.record) == r.length and r.record.startswith(b"WARC/1.1\r\n") for r in read.collect())
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_lookups_give_the_same_rows_as_the_index(spark):
    table, _ = pages(spark)
    rows = table.unionByName(table.where("page_id in (2, 4)")).unionByName(spark.createDataFrame([(None, None, "nobody", "c"), (-40, "http://a.b/", "x" * 5000, "c")], table.schema))
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    sorted_rows = lambda step: sorted((tuple(r) for r in warc.archive_roundtrip(rows, step=step, lines=2, file_bytes=3000).select(*columns, "looked_up").collect()), key=str)
    every, some = sorted_rows(1), sorted_rows(20)
    assert [r[:-1] for r in every] == [r[:-1] for r in some] and len(every) == 12
    assert sum(r[-1] for r in every) == 11 and [r[0] for r in some if r[-1]] == [-40]


def test_url_keys(spark):
    urls = ["http://www.Example.com/a?b=1#top", "https://u@m.example.com:80/", "http://a.b", None, "x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example,www)/a?b=1", "com,example,m)/", "b,a)/", ")/", ")x"]


# --- HTML ------------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav>"
    "<!-- <p>no</p> --><div class='cookie-notice'>Cookies</div><div class=\"ad\">Buy</div>{0}<aside>Side</aside><footer>&copy; 2020</footer></body></html>"
)


def text_of(source, plan=None):
    return extract.main_text(source, plan or {})


def test_article_without_furniture():
    body = (
        "<article><h1>A &amp; B</h1><p><b>bold <i>in</i>side\n\n text<br><p>two&nbsp;x&#33;<p>&lt;tag&gt; <div class='share-buttons'>Share</div><div class='promo'>P</div>"
        "<form>F<input></form><ul><li>one<li>two</ul><section id=\"comments\"><p>Troll</p></section><p hidden>h</p><p>last &notanentity; <script>x</script>end"
    )
    # "&not" is a reference that needs no semicolon.
    assert text_of(PAGE.format(body)) == "A & B bold inside text two x! <tag> one two last ¬anentity; end"


def test_words_of_names_that_only_look_like_furniture_stay():
    body = "<article class='heading main-content'><div class='additional shader'>Kept</div><p class=leading>too</p></article>"
    assert text_of(PAGE.format(body)) == "Kept too"
    assert text_of("<div class='layout has-sidebar'><article>Kept</article><div class='sidebar2'>No</div></div>") == "Kept"
    assert text_of("<div class='page header-area'><article>Kept</article></div>") == "Kept"
    assert text_of("<article>A<div class='comment12'>No</div></article>") == "A"
    kept = "overflow-hidden share-price search-engine side-effects discussion news-alerts related-work nav-tabs-content menuetto has-comments".split()
    for word in kept:
        assert text_of(PAGE.format(f"<article><p>One</p><div class='lead {word}'>two</div><p id={word}>three</p></article>")) == "One two three", word
    for word in "ad cookie-notice comment-list share-buttons related-posts sidebar_widget newsletter-signup menu promo-box-2".split():
        assert text_of(PAGE.format(f"<article><p>One</p><div class='x {word}'>two</div><section id={word}>three</section></article>")) == "One", word
    assert text_of("<article>A<p style='display : none'>No</p><p style='color:red' data-hidden=1>B</p><p hidden=false>C</p><p aria-hidden=true>No</p></article>") == "A B C"


@pytest.mark.parametrize("source", ["", "<", "<p", "</p></div>", "<p a='x>y", "text only", "<article>" * 300 + "deep", "<script>never ends", "<!-- open", "&#99999999;", "<p>" * 2000, "<div>" * 20_000 + "deep", "<b><i>" * 5000, "<p>x<b>y</b>" * 3000])
def test_broken_pages_do_not_crash(source):
    folded = wrapper.of_page(htmltree.parse(source))
    assert isinstance(text_of(source), str) and json.loads(json.dumps(wrapper.align(folded, folded))) is not None
    assert text_of(source).endswith("deep") == source.endswith("deep")


def test_alignment_generalises():
    page = lambda s: wrapper.of_page(htmltree.parse(s))
    a, b = page("<h1>x</h1><p>1</p><p>2</p><footer>f</footer>"), page("<h1>y</h1><p>1</p><table></table><footer>f</footer>")
    w = wrapper.align(a, b)
    assert [(n[1], n[2], n[3]) for n in w] == [("h1", 2, False), ("p", 2, True), ("table", 1, False), ("footer", 2, False)]
    constants = lambda n: n[4][0][1]
    assert constants(w[0]) == [] and constants(w[1]) == [wrapper.text_hash("1")] and constants(w[3]) == [wrapper.text_hash("f")]  # a slot, and what both have
    groups = page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert groups[0][4][0][0] == "g" and len(groups[0][4]) == 1
    long = page("".join(f"<{t}>{k}</{t}>" for k in range(4) for t in ("h2", "p", "ul", "table", "pre")))
    assert [len(n[2]) for n in long] == [5]
    assert wrapper.align(w, w) == [["e", n[1], 2 * n[2], n[3], [["t", x[1], 2 * x[2], 2 * x[3]] for x in n[4]]] for n in w]


def test_matches_are_a_longest_common_subsequence():
    draw = random.Random(3)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = wrapper._matches(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(p < q and r < t for (p, r), (q, t) in zip(found, found[1:]))


def test_wrappers_stay_bounded():
    rare = [["e", f"x{k}", 1, False, [["t", [], 1, 1]]] for k in range(500)]
    common = [["e", "p", 50, True, [["t", [], 9, 50], *rare]], ["e", "div", 2, False, []]]
    assert wrapper.bounded(common, 100) == [["e", "p", 50, True, [["t", [], 9, 50]]], ["e", "div", 2, False, []]]
    assert len(wrapper.bounded([["e", f"a{k}", 1, False, [["t", [], 1, 1]]] for k in range(3)], 4)) == 2


def test_pages_of_hosts_without_article(spark):
    make = lambda i: f"<html><body><div class=top>Same words</div><div class=story><h2>Title {i}</h2><p>Body of page {i} with its own text, long enough to matter {i * 7}.</p></div><div class=bottom>Same end</div></body></html>"
    data = [(i, f"http://h{i % 2}.example.org/{i}", make(i), "clash") for i in range(12)] + [(50, None, None, "c"), (51, "http://h0.example.org/x", "", "c")]
    table = spark.createDataFrame(data, "page_id long, url string, html string, plan string")
    got = {r.page_id: r for r in extract.extract_main_text(table.repartition(5)).collect()}
    for i in range(12):
        assert got[i].text == f"Title {i} Body of page {i} with its own text, long enough to matter {i * 7}." and got[i].n_chars == len(got[i].text)
    assert (got[50].text, got[51].text, len(got)) == ("", "", 14)
    assert extract.extract_main_text(table.limit(0)).count() == 0
    wrappers = extract.infer_wrappers(table).where("host = 'h0.example.org'").first()
    assert wrappers.pages == 6 and sorted(len(x) for x in json.loads(wrappers.plan)["shared"].values()) == [1, 1]


def generated_host(draw, host, n):
    """(url, html, main text) of pages under two templates without article tags, with plain furniture of every kind."""
    word = lambda: "".join(draw.choice("abdegilmnoprstuv") for _ in range(draw.randrange(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(draw.randrange(a, b)))
    links = lambda k: "<ul>" + "".join(f"<li><a href='/{word()}'>{line(1, 3)}</a></li>" for _ in range(k)) + "</ul>"
    menu, consent, end = links(6), line(8, 14), line(5, 9)
    note = f"<p>{line(6, 9)}</p>"  # stands in the middle of every text
    for k in range(n):
        title, paragraphs = line(3, 8), [line(15, 60) for _ in range(draw.randrange(2, 7))]
        inner = [f"<p>{x}</p>" for x in paragraphs]
        inner.insert(1, note)
        story = f"<div class={draw.choice(['story', 'post wide'])}><h2>{title}</h2>{''.join(inner)}<div class=ad>{line(2, 5)}</div><div class='comment-list'><p>{line(9, 20)}</p></div></div>"
        aside = f"<div class=col>{links(draw.randrange(3, 7))}</div>"
        html = f"<html><body><div class=a>{menu}</div><div class=b>{consent}</div><div class=c>{story}{aside}</div><div class=d>{end}</div></body></html>"
        yield f"http://{host}/{k}", html, " ".join([title, *paragraphs])


def test_generated_hosts_against_their_texts(spark):
    draw = random.Random(12)
    made = [x for h, n in (("big.example.org", 400), ("small.example.org", 9), ("www.example.org", 40)) for x in generated_host(draw, h, n)]
    table = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract_main_text(table.repartition(7)).collect()}
    assert [got[i] for i in range(len(made))] == [t for *_, t in made]


def test_wrappers_do_not_depend_on_partitions(spark):
    draw = random.Random(13)
    made = list(generated_host(draw, "h.example.org", 90)) + list(generated_host(draw, "k.example.org", 5))
    table = spark.createDataFrame([(u, h) for u, h, _ in made], "url string, html string")
    rows = [sorted(tuple(r) for r in extract.infer_wrappers(t, group=4).collect()) for t in (table.coalesce(1), table.repartition(11), table.orderBy(F.desc("html")).unionByName(table.limit(9)))]
    assert rows[0] == rows[1] == rows[2] and [r[1] for r in rows[0]] == [90, 5]


def test_copies_on_a_host_keep_their_text():
    page = "<body><div class=top>Menu words</div><div class=x><p>Same text on every page of this host, and a good deal of it.</p><p>{0}</p></div></body>"
    nodes = None
    for k in range(8):
        one = wrapper.of_page(htmltree.parse(page.format("end" * (k + 1))))
        nodes = wrapper.align(nodes, one) if nodes else one
    plan = extract.plan_of(nodes, 8)
    assert text_of(page.format("end"), plan).endswith("Same text on every page of this host, and a good deal of it. end")
    assert text_of("<article><p>Only <b>bold</b></p></article>", {"shared": {wrapper.step(wrapper.step(wrapper.step("", "article"), "p"), "b"): [wrapper.text_hash("bold")]}}) == "Only bold"


# --- licences --------------------------------------------------------------------------------------


def found(text):
    return [(k, d) for k, _, d, _ in licenses.scan(text.encode() if text is not None else None)]


def test_every_template_is_found_by_its_words():
    filler = "plain words of a text that goes on "
    for licence, texts in licenses.TEMPLATES.items():
        for text in texts:
            got = found(filler * 30 + text.upper() + ". " + filler * 30)
            assert (licence, 0) in got, (licence, got)


def test_what_stands_beside_a_notice():
    assert found("This is not licensed under the MIT License") == [] and found("it has not been released under the MIT License") == []
    assert found("Why not? Licensed under the MIT License") == [] and found("not a toy. Licensed under the MIT License") == [("MIT", 0)]
    assert found("SPDX-License-Identifier: BSD-3-Clause") == [("BSD-3-Clause", 0)] and found("SPDX-License-Identifier: None") == []
    for licence, texts in licenses.TEMPLATES.items():  # the templates of other licences that share words do not claim them
        for text in texts:
            assert found(text) == [(licence, 0)]
            words = text.split()
            if len(licenses.wording(text.encode())) >= 40:
                words[len(words) // 3] = "elsewhere"
                assert [k for k, _ in found(" ".join(words))] == [licence]


def test_scan_finds_what_a_search_for_every_wording_finds():
    draw = random.Random(6)
    known, _ = licenses.templates()
    noise = ["copyright", "notice", "license", "terms", "software", "river", "stone", "the", "of", "under", "permission", "above"]
    for _ in range(150):
        words = []
        for t in [draw.choice(known) for _ in range(draw.choice([1, 2, 5, 12]))]:
            words += [draw.choice(noise).encode() for _ in range(draw.randrange(1, draw.choice([4, 90, 700])))] + t.words
        line = b" " + b" ".join(words) + b" "
        places = {(t.licence, s, e) for t in known for s, e, _ in t.exact(line)}
        outer = {(k, s, 0) for k, s, e in places if not any((s2 <= s and e <= e2) and e2 - s2 > e - s for _, s2, e2 in places)}
        assert {(k, s, d) for k, s, d, _ in licenses.scan(line)} == outer


def test_wording_decides():
    assert found("Licensed under CC BY 4.0") == [("CC-BY-4.0", 0)] and found("Licensed under CC BY-NC 4.0") == [("CC-BY-NC-4.0", 0)]
    assert found("He is a licensed driver of the MIT campus") == [] and found(None) == [] and found("") == []
    isc = licenses.TEMPLATES["ISC"][0]
    assert found(isc.replace("any purpose", "some purpose")) == [("ISC", 2)]
    assert found(isc[: len(isc) // 2]) == []


def test_licence_table(spark):
    two = "Released under the MIT License.\ntext\nLicensed under CC BY-NC 4.0."
    docs = spark.createDataFrame([(1, two, "c"), (2, None, "c"), (3, "x" * 100_000, "c"), (1, two, "c")], "doc_id long, text string, licenses string")
    got = sorted((r.doc_id, r.n_notices, r.licenses, r.exact) for r in licenses.license_notices(docs).collect())
    assert got == [(1, 2, "CC-BY-NC-4.0,MIT", True), (1, 2, "CC-BY-NC-4.0,MIT", True), (2, 0, "", True), (3, 0, "", True)]
    assert licenses.license_notices(docs.limit(0)).count() == 0
