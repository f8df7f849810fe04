r"""WARC archives: written by Spark's text writer, read back by a salvaging parser.

Records are gathered into archives of ARCHIVE bytes, each one row of the text writer and so one file: Spark's own commit
protocol covers lost executors and any Hadoop file system will do. With gzip every record is a member of its own, so
a broken member costs only itself. Every record is checked: version line, headers, length, end mark, block and payload digests. After
a failed check the reader searches for the next version line or gzip member that itself passes,
goes on from there, and reports the bytes between as a quarantined gap. (A whole valid record quoted inside
the payload of a broken one can't be told from a record of the archive.)
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import cut, delete_folder, shared_dir, table

END = "\r\n\r\n"
#: Smaller payloads are always written whole.
LEAST_REVISIT = 100
#: Bytes after which an archive is full. The reader holds one archive in memory; one of a longer record is that record.
ARCHIVE = 32 << 20
#: A gzip member without content: what the text writer sets behind the members of a file.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Winners of repeated payloads that are broadcast (about 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: Bytes within which the headers of a record end, and the name and comment of a gzip member; a member is inflated by as many.
HEAD, NAMES, CHUNK = 1 << 16, 1 << 10, 1 << 16
START = re.compile(rb"WARC/1\.[0-9]\r\n|\x1f\x8b\x08")
FIELDS = "kind string, path string, start bigint, end bigint, page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary, reason string"


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, n (bytes), digest, refers_to (null: response) of each page.

    Of pages with equal payloads of at least LEAST_REVISIT bytes, all rows with the smallest page_id are responses, so
    a repeated row is no revisit of itself. Null html is empty. A null page_id is larger than any other.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("n", F.octet_length("html").cast("long"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
    first = cut(first.where("k > 1 and first is not null").select("digest", "first"))
    if first.count() <= MAX_BROADCAST:
        first = F.broadcast(first)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").withColumn("refers_to", refers).drop("first")


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record for each page, as a string column named record."""
    typed = with_types(pages)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    typed = typed.withColumn("block", block)
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.concat(F.lit("\r\nWARC-Refers-To: "), ident("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))
    uri = F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x1f]", ""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "),
        ident("page_id"),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit("\r\nWARC-Block-Digest: sha256:"),
        F.sha2(F.col("block").cast("binary"), 256),
        F.when(F.col("refers_to").isNull(), "").otherwise(revisit),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
    )
    return typed.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, compression: str = "none", archive: int = ARCHIVE) -> None:
    """Archives of all pages under ``path``, of about ``archive`` bytes each; with compression "gzip" a member for each record."""
    members = compression == "gzip"
    if compression not in ("none", "gzip"):
        raise ValueError(f"unknown compression {compression}")
    end = END.encode()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                one = record.as_py() + end
                held.append(gzip.compress(one, 6, mtime=0) if members else one)
                size += len(held[-1])
                if size >= archive:
                    yield full(held)
                    held, size = [], 0
        if held:
            yield full(held)

    def full(held: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([whole if members else whole[: -len(end)]], pa.binary())], ["value"])

    rows = records(pages).select(F.col("record").cast("binary").alias("record")).mapInArrow(gathered, "value binary")
    writer = rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    if members:
        writer = writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    else:
        writer = writer.option("lineSep", END)
    writer.text(path)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def _ident(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return (found[1] or None) if found else None


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at`` and its end, or None and what is wrong with it."""
    # another version line ends the search, so many in a row are each looked at once
    other = data.find(b"\r\nWARC/1.", at, at + HEAD)
    head_end = data.find(b"\r\n\r\n", at, at + HEAD if other < 0 else other + 4)
    if head_end < 0:
        return None, at, "headers without end"
    head = _headers(data[at:head_end])
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length) or "warc-type" not in head or "warc-record-id" not in head:
        return None, at, "headers"
    begin = head_end + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "length"
    block = data[begin:end]
    told = head.get("warc-block-digest", "")
    if told.startswith("sha256:") and hashlib.sha256(block).hexdigest() != told[7:]:
        return None, at, "block digest"
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, size = head["warc-type"], _headers(http).get("content-length", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        actual = hashlib.sha256(payload).hexdigest()
        if digest not in ("", actual):
            return None, at, "payload digest"
        digest, size = actual, str(len(payload))
    made = {
        "kind": "record", "start": at, "end": end + 4, "page_id": _ident(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": int(size) if size.isdigit() else None, "payload_digest": digest, "refers_to": _ident(head.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }
    return made, end + 4, ""


def _member_head(data: bytes, at: int) -> bool:
    """Whether the header of a gzip member may stand at ``at``: no reserved flags, and its name and comment end within NAMES bytes."""
    flags, here = data[at + 3 : at + 4], at + 10
    if not flags or flags[0] & 0xE0:
        return False
    if flags[0] & 4:
        here += 2 + int.from_bytes(data[here : here + 2], "little")
    for bit in (8, 16):
        if flags[0] & bit:
            here = data.find(b"\0", here, here + NAMES) + 1
            if not here:
                return False
    return here < len(data)


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """Content and end of the gzip member at ``at``; None if it is broken or cut off. Of what follows at most CHUNK bytes are read."""
    if not _member_head(data, at):
        return None, at
    inflate, whole, parts, here, size = zlib.decompressobj(31), memoryview(data), [], at, 1 << 9
    try:
        while not inflate.eof and here < len(data):
            parts.append(inflate.decompress(whole[here : here + size]))
            here, size = here + size, min(2 * size, CHUNK)
    except zlib.error:
        return None, at
    return (b"".join(parts), min(here, len(data)) - len(inflate.unused_data)) if inflate.eof else (None, at)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order. Offsets of records in a gzip member are those of the member."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found: list[dict] = []
        end, why = at, "no version line"
        if data.startswith(b"WARC/1.", at):
            record, end, why = parse_record(data, at)
            found = [record] if record else []
        elif data.startswith(MAGIC, at):
            content, end = _member(data, at)
            why = "gzip member"
            if content == b"":  # nothing in it, nothing lost
                if gap is not None:
                    yield {"kind": "gap", "start": gap, "end": at, "reason": reason}
                gap, at = None, end
                continue
            if content is not None:
                found = [x | {"start": at, "end": end} for x in salvage(content)]
        if found:
            if gap is not None:
                yield {"kind": "gap", "start": gap, "end": at, "reason": reason}
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, reason = at, why
        following = START.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield {"kind": "gap", "start": gap, "end": len(data), "reason": reason}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (kind "record") and quarantined gaps (kind "gap": path, start, end, reason) of all archives under ``path``.

    An archive is read as a whole, so its size bounds a task's memory; those of write_archives are of ARCHIVE bytes or one record. The payload of
    a record may be of any length up to the 2 GB of a value. Empty archives have no rows.
    """
    schema = spark.createDataFrame([], FIELDS).schema
    kinds = pa.schema([(f.name, {"bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in schema])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    rows.append(x | {"path": name.as_py()} | ({} if payloads else {"payload": None}))
                    size += x["end"] - x["start"]
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, read back into the shared checkpoint folder, drop the archives. A gap in an archive is an error, since it would be a lost page."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    ident = lambda c: F.col(c).cast("long").alias(c)
    found = read_archives(spark, path, payloads=False)
    found = cut(found.select("kind", ident("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to")))
    lost = found.where("kind = 'gap'").count()
    if lost:
        raise ValueError(f"{lost} gaps in the archives under {path}")
    delete_folder(spark, path)
    return found.drop("kind")


OP6_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
