"""WARC archives of pages: written with repeated payloads as revisits, read back in byte ranges.

**Writing.** Every record is a gzip member of its own. Of rows with equal payloads of at least ``least`` bytes,
the one with the largest page_id becomes a ``response`` record; the others become ``revisit`` records that carry no
payload and name the response. Shorter payloads are all responses. Spark's text writer puts the members into files, so
that its commit protocol and any of its stores serve: members are its lines, and the zero byte in which a member's length
field ends stands for the end of a line.

**Reading.** A file is cut into byte ranges. A task looks for the gzip magic in its range and decodes each candidate: it
counts as a record if it starts with a WARC header, is as long as the header says and has the right check sum. A task owns
the records that start inside its range, and reads beyond its end to finish the last one. From a record's end on it goes
straight to the next. A payload may hold a whole archive, whose members a task sees if its range starts amid them; they are
told by starting before the end of a record that an earlier range owns, and left out.

Equal payloads are equal in SHA-1, XXH64 and length. A payload with very many copies is not brought together: winners are
aggregated from partial sums, those with more than ``HOT_ROWS`` copies (by their number, at most a ``HOT_ROWS``-th of the
rows) are broadcast, and rows meet the others by shuffle where these are many.

Defined results: a null html is an empty payload. A null page_id is smaller than any other and read back as null; a null url
is left out and read back as null; blanks and control characters of a url are percent-encoded. Of equal rows one is the response and the others revisit it. An empty table
gives no record. Columns other than page_id, url and html are left out, whatever their names. Text of any length up to
Spark's 2 GB stays whole. Members that are cut off, damaged or no WARC records are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradebook.llm.columns import bounded, text_of, written

#: Payloads from this size on are kept once.
LEAST = 1000
#: A payload with more copies than this is broadcast to its rows.
HOT_ROWS = 100_000
#: Bytes of an archive that one task looks through.
RANGE_BYTES = 32 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
_BATCH_BYTES = 8 << 20
#: A WARC header longer than this is none.
_HEADER_BYTES = 1 << 20
#: Fixed values of the format.
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http;msgtype=response"

#: What ``read`` gives for each record, besides ``payload``.
FIELDS = (
    "path string, range_start long, offset long, end long, record_type string, record_id string, target_uri string, "
    "record_date string, refers_to string, payload_bytes long, payload_digest string"
)

# --- writing


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """A row per record: record_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to (a record_id)."""
    same = ["payload_digest", "payload_hash", "payload_bytes"]
    payload = text_of("html")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"),
        F.xxhash64(payload).alias("payload_hash"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written, so that a row keeps its number whatever is lost.
    rows = written(rows, "pages")
    name = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.sha1(F.concat_ws(" ", "payload_digest", "row", "url")))
    best = F.max(F.struct("page_id", "url", "row", name.alias("record_id")))
    kept = rows.filter(F.col("payload_bytes") >= least).groupBy(*same).agg(best.alias("best"), F.count("*").alias("copies"))
    kept = written(kept.filter("copies > 1"), "kept").select(*same, F.col("best.row").alias("kept_row"), F.col("best.record_id").alias("kept_id"), "copies")
    hot = F.broadcast(kept.filter(F.col("copies") > HOT_ROWS).drop("copies").withColumnsRenamed({"kept_row": "hot_row", "kept_id": "hot_id"}))
    cold = kept.filter(F.col("copies") <= HOT_ROWS).drop("copies")
    rows = rows.join(hot, same, "left")
    key = F.when(F.col("hot_id").isNotNull(), F.concat_ws(":", "payload_digest", "row")).otherwise(F.col("payload_digest"))
    cold = bounded(written(cold.withColumnsRenamed({c: f"cold_{c}" for c in same}), "cold"))
    met = (key == F.col("cold_payload_digest")) & (F.col("payload_hash") == F.col("cold_payload_hash")) & (F.col("payload_bytes") == F.col("cold_payload_bytes"))
    rows = rows.join(cold, met, "left").withColumn("response", F.coalesce("hot_row", "kept_row", "row") == F.col("row"))
    return rows.select(
        name.alias("record_id"),
        "url",
        F.when(F.col("response"), F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(~F.col("response"), F.coalesce("hot_id", "kept_id")).alias("refers_to"),
    )


def _member(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    record = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    member = zlib.compress(record, 6, wbits=31)
    # The last byte of the length field, zero up to 16 MB, is written by Spark as the end of a line.
    return member[:-1] if member[-1] == 0 else member + zlib.compress(b"", 6, wbits=31)[:-1]


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _members(date: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
        begun = False
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if not begun:
                    begun = True
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{row['record_id']}:info>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    yield _member(info, b"format: WARC File Format 1.1\r\n")
                sha1 = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
                fields = {
                    "WARC-Type": "response" if row["refers_to"] is None else "revisit",
                    "WARC-Record-ID": f"<{row['record_id']}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": None if row["url"] is None else re.sub(r"[\x00-\x20\x7f]", lambda c: quote(c.group()), row["url"]),
                    "WARC-Payload-Digest": f"sha1:{sha1}",
                    "WARC-Refers-To": None if row["refers_to"] is None else f"<{row['refers_to']}>",
                    "WARC-Profile": None if row["refers_to"] is None else _REVISIT_PROFILE,
                    "Content-Type": _HTTP,
                }
                yield _member(fields, _http(row["payload_bytes"]) + (row["payload"] or "").encode())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for member in of_rows(batches):
            waiting.append(member)
            held += len(member)
            if held >= _BATCH_BYTES:
                yield pa.record_batch([pa.array(waiting, pa.binary())], ["member"])
                waiting, held = [], 0
        if waiting:
            yield pa.record_batch([pa.array(waiting, pa.binary())], ["member"])

    return run


def write(pages: DataFrame, path: str, date: str = "2024-06-01T00:00:00Z", least: int = LEAST) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to new archives below ``path``, one for each task."""
    members = planned(pages, least).mapInArrow(_members(date), "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


# --- reading


def _opened(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """How to read (offset, size) of a file in a mounted folder or in a store that Arrow knows, and how to close it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        file = open(unquote(parts.path) if parts.scheme else path, "rb")
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        file = store.open_input_file(name)

    def read_at(offset: int, size: int) -> bytes:
        file.seek(offset)
        return file.read(size)

    return read_at, file.close


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _digest(named: str | None) -> str | None:
    """Bare hex of a labelled SHA-1, in base 32 or 16; None for any other."""
    label, _, value = (named or "").partition(":")
    if label.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _record(read_at: Callable[[int, int], bytes], offset: int, with_payload: bool) -> dict | None:
    """The record whose member starts at ``offset``; None if there is none."""
    inflate, at, text, fields, body = zlib.decompressobj(31), offset, bytearray(), None, 0
    while not inflate.eof:
        data = read_at(at, _READ)
        if not data:
            return None
        at += len(data)
        try:
            text += inflate.decompress(data)
        except zlib.error:
            return None
        if fields is None:
            if not text.startswith(b"WARC/"[: len(text)]):
                return None
            body = text.find(b"\r\n\r\n") + 4
            if body < 4:
                if len(text) > _HEADER_BYTES:
                    return None
                continue
            fields = _fields(bytes(text[: body - 4]))
            if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
                return None
    if fields is None or len(text) != body + int(fields["content-length"]) + 4:
        return None
    block = memoryview(text)[body : len(text) - 4]
    kind, payload, size = fields["warc-type"].lower(), block, None
    if fields.get("content-type", "").startswith("application/http"):
        gap = text.find(b"\r\n\r\n", body)
        http = _fields(bytes(text[body : gap if gap >= 0 else len(text) - 4]))
        payload = block[gap + 4 - body :] if 0 <= gap <= len(text) - 8 else block[len(block) :]
        size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
    revisit = kind == "revisit"
    return {
        "offset": offset,
        "end": at - len(inflate.unused_data),
        "record_type": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "target_uri": fields.get("warc-target-uri"),
        "record_date": fields.get("warc-date"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": size if revisit else len(payload),
        "payload_digest": _digest(fields.get("warc-payload-digest")) if revisit else hashlib.sha1(payload).hexdigest(),
        "payload": bytes(payload) if with_payload and not revisit else None,
    }


def records_from(read_at: Callable[[int, int], bytes], start: int, end: int, with_payload: bool = True) -> Iterator[dict]:
    """The records of a file that start at ``start`` or later, and before ``end``."""
    at = start
    while at < end:
        data = read_at(at, min(_READ, end + len(_MAGIC) - 1 - at))
        found = data.find(_MAGIC)
        if found < 0:
            if len(data) < len(_MAGIC):
                return
            at += len(data) - len(_MAGIC) + 1
            continue
        record = _record(read_at, at + found, with_payload)
        if record is None:
            at += found + 1
        else:
            yield record
            at = record["end"]


def _reader(with_payload: bool, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                read_at, close = _opened(span["path"])
                waiting, held = [], 0
                for record in records_from(read_at, span["range_start"], span["range_end"], with_payload):
                    waiting.append(record | {"path": span["path"], "range_start": span["range_start"]})
                    held += 500 + len(record["payload"] or b"")
                    if held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(waiting, schema)
                        waiting, held = [], 0
                close()
                if waiting:
                    yield pa.RecordBatch.from_pylist(waiting, schema)

    return run


def read(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the gzipped archives below ``path``: ``FIELDS`` and ``payload`` (null for revisits).

    Files are listed by Spark and read in tasks, from mounted folders or a store that Arrow knows. Digests are
    worked out from the payloads, those of revisits taken from their headers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.filter("length > 0").select("path", F.explode(starts).alias("range_start"))
    ranges = ranges.withColumn("range_end", F.col("range_start") + range_bytes)
    ranges = ranges.repartition(max(1, ranges.count()))
    schema = FIELDS + ", payload binary"
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (column.split() for column in schema.split(", "))])
    found = written(ranges.mapInArrow(_reader(payload, arrow), schema), "records")
    return _not_embedded(found)


def _not_embedded(found: DataFrame) -> DataFrame:
    """Without records that start before the end of one that an earlier range of their file owns."""
    spans = found.groupBy("path", "range_start").agg(F.max("end").alias("last"), F.min("offset").alias("first"))
    earlier = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("taken", F.max("last").over(earlier)).filter("first < taken").select("path", "range_start", "taken")
    cut = written(cut, "cut")
    if cut.isEmpty():
        return found
    return found.join(bounded(cut), ["path", "range_start"], "left").filter("taken is null or offset >= taken").drop("taken")


def page_of(record_id: str | Column) -> Column:
    """The page_id that ``write`` put into a record's id."""
    return F.regexp_extract(record_id, "^urn:page:(-?[0-9]+):", 1).try_cast("long")


def archived(pages: DataFrame, path: str, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``pages`` written to ``path`` and read back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id)."""
    write(pages, path, least=least)
    records = read(pages.sparkSession, path, payload=False, range_bytes=range_bytes).filter("record_type in ('response', 'revisit')")
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )


def oracle_sql() -> str:
    """The rows of ``archived`` in SQL."""
    return f"""with p as (select page_id, ifnull(html, '') as payload from pages),
        s as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha1(payload) as payload_digest,
            max(page_id) over (partition by payload) as kept from p)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= {LEAST} and page_id <> kept then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= {LEAST} and page_id <> kept then kept end as refers_to from s"""
