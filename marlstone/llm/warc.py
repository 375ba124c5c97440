"""WARC archives with a two-level capture index.

Writing: records are assembled as text columns (HTTP response blocks; revisit
records for repeated payloads), packed into archives of about ``FILE_BYTES`` and
saved by Spark's text writer, one archive a file, so that commits, retries and
any Hadoop file system work as for other tables.  Reading: files come back as
bytes and are cut by Content-Length, never by separator.

Index: one line a capture, ``<reversed host>)<path> <page> {json}``, sorted by
key and page over range partitions and packed into compressed blocks of
``BLOCK_LINES``.  The directory holds the first and last line keys of each block
in groups of ``GROUP_BLOCKS``; the sparse directory holds those of each group.  A
lookup bisects the sparse directory, joins the groups found for their blocks,
bisects the lines of each block, and reads the records' byte ranges.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.llm.words import utf8_rows
from marlstone.plans.scratch import Scratch
from marlstone.sources.landing import arrow_store

MIN_REVISIT_BYTES = 1000
#: Bytes of records to an archive file; a larger record is an archive of its own.
FILE_BYTES = 32_000_000
BLOCK_LINES = 3000
#: Blocks to a group of the directory, lines to a shard of the index, and most shards (beyond it shards grow).
GROUP_BLOCKS, SHARD_LINES, MAX_SHARDS = 64, 300_000, 100_000
#: Winners of payload groups (under 100 bytes each) are broadcast up to so many.
BROADCAST_ROWS = 200_000
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def target_uri(url: Column, page: Column) -> Column:
    """A URL without blanks and control characters; a null one is a name made of the page id."""
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:x-page:"), F.coalesce(page.cast("string"), F.lit(""))))


def capture_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, record): the WARC record of each page, without the closing separator."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    groups = (
        page.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    groups = Scratch(pages.sparkSession, "warc-groups").table(groups, "groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    page = page.join(groups, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("winner") != F.col("page_id"), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "html"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        target_uri(F.col("url"), F.col("page_id")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("size").cast("string"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _id(F.col("winner")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(SEPARATOR),
    )
    return page.withColumn("revisit", revisit).withColumn("http", http).select("page_id", F.concat(head, block).alias("record"))


def _archives(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, end = [], 0, SEPARATOR.encode()
        for batch in batches:
            for record in utf8_rows(batch.column(0)):
                if held and size + len(record) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary()).cast(pa.string())], ["archive"])
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(end)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary()).cast(pa.string())], ["archive"])

    return run


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write a folder of WARC files of about ``file_bytes``, one record per row of ``pages``; returns its path."""
    archives = capture_records(pages, min_bytes).select("record").mapInArrow(_archives(file_bytes), "archive string")
    archives.write.mode("overwrite").option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)
    return path


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse_records(data: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, bytes], bytes]]:
    """(offset, length, fields, block) of each record of an archive; ValueError if it is broken."""
    data = bytes(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {m[1].decode().lower(): m[2] for m in _FIELD.finditer(data, data.index(b"\r\n", at) + 2, end)}
        start = end + 4
        size = int(fields["content-length"])
        stop = start + size
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} ends early")
        yield at, stop + 4 - at, fields, data[start:stop]
        at = stop + 4


CAPTURES = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "file string, offset long, length long"
)


def _page(value: bytes | None) -> int | None:
    digits = value[len(b"<urn:x-page:") : -1] if value else b""
    return int(digits) if digits else None


def _capture(fields: dict[str, bytes], block: bytes, file: str, offset: int, length: int) -> tuple:
    kind = fields["warc-type"].decode()
    digest, size = fields["warc-payload-digest"].decode().removeprefix("sha1:"), int(fields["x-payload-length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{file}: the payload at byte {offset} does not match its digest")
    uri = fields["warc-target-uri"].decode()
    return _page(fields["warc-record-id"]), uri, kind, size, digest, _page(fields.get("warc-refers-to")), file, offset, length


def _capture_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [x.split() for x in CAPTURES.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, columns)], [name for name, _ in columns])


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
            yield _capture_batch([_capture(fields, block, file, offset, length) for offset, length, fields, block in parse_records(data or b"")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_captures, CAPTURES)


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed host, then the rest, e.g. ``com,example,m)/en/25?x=1``."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


BLOCKS = "shard int, block int, first_key string, last_key string, n_lines int, data binary"


def line_key(key: Column, page: Column) -> Column:
    """Key of an index line: a URL key and the page id as 20 digits in id order (none for a null id)."""
    digits = F.lpad((page.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(digits, F.lit("")))


def _pack_blocks(lines_per_block: int):
    def flush(shard: int, block: int, keys: list[str], lines: list[bytes]) -> tuple:
        return shard, block, keys[0], keys[-1], len(lines), zlib.compress(b"\n".join(lines), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        lines: list[bytes] = []
        shard = block = 0
        for batch in batches:
            out = []
            for number, key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2))):
                shard = number
                keys.append(key)
                lines.append(line)
                if len(lines) >= lines_per_block:
                    out.append(flush(shard, block, keys, lines))
                    keys, lines, block = [], [], block + 1
            if out:
                yield _block_batch(out)
        if lines:
            yield _block_batch([flush(shard, block, keys, lines)])

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in BLOCKS.split(", ")])


def build_index(captures: DataFrame, path: str, *, lines: int = BLOCK_LINES, shards: int | None = None) -> DataFrame:
    """Sort captures by URL key and page and write compressed index blocks; returns the blocks.

    The page id is part of the range key, so one URL captured many times is
    spread over shards; blocks of equal keys follow each other.
    """
    spark = captures.sparkSession
    if shards is None:
        shards = min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), captures.count() // SHARD_LINES + 1))
    entry = F.to_json(
        F.struct("url", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "length")
    )
    key = line_key(url_key(F.col("url")), F.col("page_id"))
    keyed = captures.select(key.alias("key"), "file", "offset", F.concat_ws(" ", key, entry).alias("line"))
    order = ["key", "file", "offset"]
    ranged = keyed.repartitionByRange(shards, *order)
    blocks = ranged.sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "key", "line").mapInArrow(_pack_blocks(lines), BLOCKS)
    blocks.write.mode("overwrite").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


ENTRY = "url string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def _split(line: str) -> list[str]:
    """URL key, page digits and entry of an index line."""
    return line.split(" ", 2)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in utf8_rows(batch.column(0)):
            parts = [_split(line) for line in zlib.decompress(data).decode().split("\n")]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts]), pa.array([p[2] for p in parts])], ["key", "entry"])


def index_entries(blocks: DataFrame) -> DataFrame:
    """All captures of an index, from its decompressed blocks."""
    lines = blocks.select("data").mapInArrow(_lines, "key string, entry string")
    return lines.select("key", F.from_json("entry", ENTRY).alias("e")).select("key", "e.*")


def write_directory(blocks: DataFrame, path: str, group: int = GROUP_BLOCKS) -> DataFrame:
    """(shard, part, first_key, last_key, blocks): the first and last keys of every ``group`` neighbouring blocks."""
    rows = blocks.select("shard", F.floor(F.col("block") / group).cast("int").alias("part"), "block", "first_key", "last_key")
    held = F.array_sort(F.collect_list(F.struct("block", "first_key", "last_key")))
    groups = rows.groupBy("shard", "part").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), held.alias("blocks"))
    groups.write.mode("overwrite").parquet(path)
    return blocks.sparkSession.read.schema(groups.schema).parquet(path)


def _placed(sparse):
    """Wanted line keys -> the groups of blocks that may hold them, by bisection of the sparse directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, place = sparse.value
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                out += [(key, *place[i]) for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()))], ["wanted", "shard", "part"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wanted keys, block) -> the entries of those lines, by bisection of the block's lines."""
    for batch in batches:
        out = []
        for keys, data in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
            lines = zlib.decompress(data).decode().split("\n")
            for key in keys:
                at = bisect.bisect_left(lines, key + " ")
                while at < len(lines) and lines[at].startswith(key + " "):
                    out.append((key, _split(lines[at])[2]))
                    at += 1
        cols = list(zip(*out)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["wanted", "entry"])


def lookup(blocks: DataFrame, directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index entries of ``wanted`` (a column of line keys), one row for each capture found.

    The sparse directory is one row for ``GROUP_BLOCKS`` blocks of lines; what
    it points at is joined by shard and group, then by shard and block.  Keys
    wanted of one block are lines of it (others find no block, or nothing in
    it), so a block meets a bounded list.
    """
    spark = blocks.sparkSession
    rows = sorted((r.first_key, r.last_key, r.shard, r.part) for r in directory.select("first_key", "last_key", "shard", "part").collect())  # the sparse level
    sparse = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], [(r[2], r[3]) for r in rows]))
    placed = wanted.select(F.col(wanted.columns[0]).alias("wanted")).distinct().mapInArrow(_placed(sparse), "wanted string, shard int, part int")
    inside = F.filter("blocks", lambda b: (b["first_key"] <= F.col("wanted")) & (b["last_key"] >= F.col("wanted")))
    spots = placed.join(directory.select("shard", "part", "blocks"), ["shard", "part"]).select("wanted", "shard", F.explode(inside).alias("b"))
    spots = spots.select("wanted", "shard", "b.block")
    lists = spots.groupBy("shard", "block").agg(F.sort_array(F.collect_set("wanted")).alias("wanted"))
    lines = lists.join(blocks.select("shard", "block", "data"), ["shard", "block"]).select("wanted", "data").mapInArrow(_opened, "wanted string, entry string")
    return lines.select("wanted", F.from_json("entry", ENTRY).alias("e")).select("wanted", "e.*")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, offset, length) -> with the record's bytes; neighbouring rows of one file share a handle."""
    name, handle = None, None
    for batch in batches:
        found = []
        for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if file != name:
                if handle is not None:
                    handle.close()
                store, path = arrow_store(file)
                name, handle = file, store.open_input_file(path)
            found.append(handle.read_at(length, offset))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["file", "offset", "length", "record"])
    if handle is not None:
        handle.close()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ranges, content) -> the records, for stores that only Spark's readers open."""
    for batch in batches:
        for file, ranges, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2))):
            cols = [[file] * len(ranges), [r["offset"] for r in ranges], [r["length"] for r in ranges], [content[r["offset"] : r["offset"] + r["length"]] for r in ranges]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "offset", "length", "record"])


def read_ranges(entries: DataFrame, path: str) -> DataFrame:
    """(file, offset, length, record): the byte ranges that ``entries`` name, read on executors from archives under ``path``.

    Stores that Arrow opens are read by range; of others the archives named
    come as whole files and are cut there.
    """
    ranges = entries.select("file", "offset", "length").distinct()
    kind = "file string, offset long, length long, record binary"
    try:
        arrow_store(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        lists = ranges.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # records of one archive
        files = entries.sparkSession.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
        return lists.join(files, "file").select("file", "ranges", "content").mapInArrow(_cut, kind)
    return ranges.sortWithinPartitions("file", "offset").mapInArrow(_records, kind)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records read by range -> captures; each range has to be one whole record."""
    for batch in batches:
        rows = []
        for file, offset, length, record in zip(*(batch.column(k).to_pylist() for k in range(4))):
            (_, size, fields, block), *more = parse_records(record)
            if more or size != length:
                raise ValueError(f"{file}: no single record at byte {offset}")
            rows.append(_capture(fields, block, file, offset, length))
        yield _capture_batch(rows)


#: Captures whose page id is divisible by this are answered by lookups and range reads.
LOOKUP_STEP = 20


def archive_roundtrip(
    pages: DataFrame, *, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES, lines: int = BLOCK_LINES, shards: int | None = None, step: int = LOOKUP_STEP
) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, file, offset, length, looked_up) per page.

    Writes the archives, reads them back and builds the index of all captures.
    Page ids divisible by ``step`` are then looked up by their URLs: directory,
    block, line and byte range; the others' rows are the index's entries.
    ``url`` is the record's target URI.  Null html is an empty payload; a null
    url gets a placeholder URI; repeated rows are repeated records (the largest
    page_id of a payload is a response in each of its rows); rows with a null
    page_id are responses.  Payloads under ``min_bytes`` are never revisits.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = write_archives(pages, scratch.path("archives"), min_bytes=min_bytes, file_bytes=file_bytes)
    captures = scratch.table(read_archives(spark, folder), "captures")
    blocks = build_index(captures, scratch.path("index"), lines=lines, shards=shards)
    directory = write_directory(blocks, scratch.path("directory"))
    scratch.drop("captures")
    page = F.col("page_id").cast("long")
    asked = F.coalesce(page % step == 0, F.lit(False))
    wanted = pages.where(asked).select(line_key(url_key(target_uri(F.col("url").cast("string"), page)), page).alias("wanted"))
    found = scratch.table(lookup(blocks, directory, wanted), "found")
    read = read_ranges(found, folder).mapInArrow(_parsed, CAPTURES).withColumn("looked_up", F.lit(True))
    rest = index_entries(blocks).drop("key").where(~asked).withColumn("looked_up", F.lit(False))
    return read.unionByName(rest)
