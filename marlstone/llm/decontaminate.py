"""Benchmark decontamination: documents scanned for windows of benchmark words.

The benchmark's windows (``window`` consecutive normalised words, or the whole
item when it is shorter) form a hash set.  Documents are scanned for runs of
benchmark words; every window of such a run is looked up by hash and a hit is
verified word by word.

Two ways to bring set and documents together, picked by the benchmark's size:
up to ``broadcast_bytes`` of text the set is broadcast and documents never
move.  Beyond it a bit map of fixed size tells which windows of documents may be
benchmark windows, and those are joined with the benchmark's on their words;
what is found goes back to the documents by their texts' digests, so that both
ways treat repeated and null ids alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm.carry import packed, unpacked
from marlstone.llm.words import utf8_rows, window_hashes, word_hashes
from marlstone.plans.scratch import Scratch

WINDOW = 10
#: Most text of a benchmark whose windows are broadcast (about six times this in memory; a test measures it).
BROADCAST_BYTES = 8_000_000
#: Bits of the map of possible windows on the other way: 8 MB, whatever the benchmark's size.
MAP_BITS = 26

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and blanks every byte that no word holds.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    return text.translate(_NORMAL).split() if text else []


class BenchmarkIndex:
    """Windows of a benchmark as flat arrays.

    ``line`` holds the items' words joined by spaces, ``begin`` where each word
    starts in it.  For each window length there are the sorted window hashes, the
    first word of one occurrence of each window, and the items that hold it.
    """

    def __init__(self, items: Iterable[tuple[int, bytes | None]], window: int = WINDOW):
        lines, starts, hashes, ends, self.names = [], [], [], [0], []
        at = 0
        for item, text in items:
            words = terms(text)
            if words:
                line = b" ".join(words) + b" "
                starts.append(at + np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]]).astype(np.uint32))
                hashes.append(word_hashes(words))
                ends.append(ends[-1] + len(words))
                lines.append(line)
                self.names.append(str(item))
                at += len(line)
        self.line = b"".join(lines)
        self.begin = np.concatenate([*starts, [at]]).astype(np.uint32)
        codes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.words = np.unique(codes)
        ends = np.array(ends)
        sizes = np.minimum(np.diff(ends), window)
        self.sizes = sorted(set(sizes.tolist()))
        self.tables = {size: self._table(size, codes, ends, np.flatnonzero(sizes == size)) for size in self.sizes}

    def _words(self, first: int, size: int) -> bytes:
        return self.line[self.begin[first] : self.begin[first + size] - 1]

    def _table(self, size: int, codes: np.ndarray, ends: np.ndarray, items: np.ndarray) -> tuple:
        """(hashes, first words, where each window's items start, items), sorted by hash."""
        first = np.concatenate([np.arange(ends[i], ends[i + 1] - size + 1, dtype=np.int32) for i in items])
        owner = np.repeat(items.astype(np.int32), [ends[i + 1] - ends[i] - size + 1 for i in items])
        hashes = np.concatenate([window_hashes(codes[ends[i] : ends[i + 1]], size) for i in items])
        order = np.argsort(hashes, kind="stable")
        hashes, first, owner = hashes[order], first[order], owner[order]
        head = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        # Windows of one hash are one window unless their words differ (another row of that hash then).
        for run in np.split(np.flatnonzero(~head), np.flatnonzero(np.diff(np.flatnonzero(~head)) > 1) + 1) if not head.all() else ():
            span = np.arange(run[0] - 1, run[-1] + 1)
            texts = [self._words(int(f), size) for f in first[span]]
            if len(set(texts)) > 1:
                by = span[np.argsort(np.array(texts, object), kind="stable")]
                first[span], owner[span] = first[by], owner[by]
                head[span[1:]] = [a != b for a, b in zip(sorted(texts)[1:], sorted(texts))]
        starts = np.flatnonzero(head)
        return hashes[starts], first[starts], np.append(starts, len(hashes)).astype(np.int32), owner

    def size_in_bytes(self) -> int:
        return len(self.line) + self.begin.nbytes + self.words.nbytes + sum(x.nbytes for t in self.tables.values() for x in t)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(mask of hit words, items with occurring windows) of one document."""
        hit = np.zeros(len(words), bool)
        items: set[int] = set()
        if not words or not self.sizes:
            return hit, set()
        codes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        count = np.concatenate([[0], np.cumsum(self.words[at] == codes)])
        for size in self.sizes:
            if size > len(words):
                break
            whole = np.flatnonzero(count[size:] - count[:-size] == size)
            if not len(whole):
                continue
            hashes, first, starts, owner = self.tables[size]
            wanted = window_hashes(codes, size)[whole]
            low = np.searchsorted(hashes, wanted)
            high = np.searchsorted(hashes, wanted, side="right")
            for k in np.flatnonzero(high > low).tolist():
                s = int(whole[k])
                text = b" ".join(words[s : s + size])
                for j in range(int(low[k]), int(high[k])):
                    if text == self._words(int(first[j]), size):
                        hit[s : s + size] = True
                        items.update(owner[starts[j] : starts[j + 1]].tolist())
        return hit, {self.names[i] for i in items}


def _row(words: list[bytes], hit: np.ndarray, items: set[str]) -> tuple:
    return len(words), int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sorted(items)


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            rows = []
            for text in utf8_rows(batch.column(1)):
                words = terms(text)
                rows.append(_row(words, *table.scan(words)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items"],
            )

    return run


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            keep = [not table.scan(terms(text))[0].any() for text in utf8_rows(batch.column(1))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _windows_of(window: int):
    """Benchmark rows -> (words, size, item, slot): the windows and their places in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                words = terms(text)
                size = min(window, len(words))
                slots = _slots(words, size) if words else ()
                rows += [(b" ".join(words[s : s + size]), size, str(item), slot) for s, slot in enumerate(slots)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.binary(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["words", "size", "item", "slot"])

    return run


def _slots(words: list[bytes], size: int) -> list[int]:
    return (window_hashes(word_hashes(words), size) >> np.uint64(64 - MAP_BITS)).astype(np.int64).tolist()


def _bit_map(windows: DataFrame) -> np.ndarray:
    """Bits of the slots in use, as one row for 64 bits at most: ``2 ** MAP_BITS / 8`` bytes on the driver."""
    bits = windows.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(2**MAP_BITS // 64, np.int64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint64)


def _document_windows(sizes: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                words = terms(text)
                codes = word_hashes(words)
                for size in sizes:
                    if size > len(words):
                        break
                    slots = window_hashes(codes, size) >> np.uint64(64 - MAP_BITS)
                    there = known[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)
                    rows += [(key, b" ".join(words[s : s + size]), s, size) for s in np.flatnonzero(there).tolist()]
                if len(rows) > 50_000:
                    yield _window_batch(rows)
                    rows = []
            if rows:
                yield _window_batch(rows)

    return run


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "words", "start", "size"])


def _text_key(text: str | Column) -> Column:
    """What stands for a text in joins: equal texts are found alike, so neither ids nor row numbers are needed."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def _benchmark(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text) of the items that have a text, and the bytes of all texts."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _broadcast_index(items: DataFrame, window: int):
    """The index of a benchmark whose size was checked."""
    rows = [(r.item_id, r.text.encode()) for r in items.collect()]
    return items.sparkSession.sparkContext.broadcast(BenchmarkIndex(rows, window))


def _found(texts: DataFrame, items: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((key, start, size, words) of hits in ``texts``, (words, size, item) of the benchmark) by a join on the words."""
    windows = scratch.table(items.mapInArrow(_windows_of(window), "words binary, size int, item string, slot long").distinct(), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` rows
    bits = items.sparkSession.sparkContext.broadcast(_bit_map(windows))
    spots = texts.mapInArrow(_document_windows(sizes, bits), "key string, words binary, start int, size int")
    spots = spots.join(windows.select("words", "size").distinct(), ["words", "size"], "left_semi").distinct()
    return scratch.table(spots.select("key", "start", "size", "words"), "spots"), windows.select("words", "size", "item")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(_text_key("text").alias("key"), "text").where("key is not null")


def _spans(spots: DataFrame) -> DataFrame:
    return spots.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("found"))


def _mask(n_words: int, found: list[dict] | None) -> np.ndarray:
    hit = np.zeros(n_words, bool)
    for x in found or ():
        hit[x["start"] : x["start"] + x["size"]] = True
    return hit


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found, items in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = terms(text)
            rows.append(_row(words, _mask(len(words), found), set(items or ())))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items"],
        )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) per row.

    A document word inside any occurrence of a benchmark window is hit; items
    are those with an occurring window, sorted as strings.  Null, empty or
    wordless texts have no words and no hits; null or wordless items have no
    window; an item of fewer than ``window`` words is one window.  Equal items
    under several ids all count.  Rows keep their multiplicity, with repeated
    and null ids.  Other columns are ignored; an empty benchmark hits nothing.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items, size = _benchmark(benchmark)
    if size <= broadcast_bytes:
        out = docs.mapInArrow(_scan(_broadcast_index(items, window)), f"doc_id long, {COLUMNS}")
    else:
        spots, windows = _found(_keyed(docs), items, window, Scratch(docs.sparkSession, "windows"))
        named = spots.select("key", "words", "size").distinct().join(windows, ["words", "size"])
        named = named.groupBy("key").agg(F.collect_set("item").alias("items"))
        joined = docs.withColumn("key", _text_key("text")).join(_spans(spots), "key", "left").join(named, "key", "left")
        out = joined.select("doc_id", "text", "found", "items").mapInArrow(_finish, f"doc_id long, {COLUMNS}")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark, with all their columns; null texts stay."""
    items, size = _benchmark(benchmark)
    pack = packed(documents)
    if size <= broadcast_bytes:
        return unpacked(pack.mapInArrow(_clean(_broadcast_index(items, window)), pack.schema), documents)
    spots, _ = _found(_keyed(documents), items, window, Scratch(documents.sparkSession, "windows"))
    return unpacked(pack.withColumn("key", _text_key("text")).join(spots.select("key").distinct(), "key", "left_anti"), documents)


_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without(text: bytes | None, hit: np.ndarray) -> str | None:
    """A text without its hit words; everything between words stays."""
    if text is None:
        return None
    string, out, last = text.decode(), [], 0
    for m, gone in zip(_TERM.finditer(string), hit.tolist()):
        if gone:
            out.append(string[last : m.start()])
            last = m.end()
    return "".join([*out, string[last:]])


def _cut(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            kept = [_without(text, table.scan(terms(text))[0]) for text in utf8_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])

    return run


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, found in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
            kept.append(_without(text, _mask(len(terms(text)), found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])


def cut_hits(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text) with hit words cut out and everything between them kept; null texts stay null."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, size = _benchmark(benchmark)
    if size <= broadcast_bytes:
        return docs.mapInArrow(_cut(_broadcast_index(items, window)), "doc_id long, text string")
    spots, _ = _found(_keyed(docs), items, window, Scratch(docs.sparkSession, "windows"))
    joined = docs.withColumn("key", _text_key("text")).join(_spans(spots), "key", "left")
    return joined.select("doc_id", "text", "found").mapInArrow(_cut_spans, "doc_id long, text string")
