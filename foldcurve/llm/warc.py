"""WARC archives: records written in segments, read back and put together again.

Writing. A page becomes one record; a payload longer than `segment_bytes` of framed
content becomes a first record and `continuation` records that name its id as their
origin and carry segment numbers, the last of them the total length. Payloads go in
chunked transfer framing. Records leave Spark's text writer as archive files: its line
end is the blank lines that end a record. No stored byte run equals the version line
that starts a record, since a chunk is ended inside such a run; so a file can be read
in splits.

Reading. Spark's text reader cuts archives at the version line; each piece is parsed,
and its length checked against its Content-Length: a damaged archive raises an error.
Records without segments are decoded where they are read. Segments are grouped by
origin, ordered by number, checked for gaps and against the total length, and joined;
only they are shuffled. Chunked framing is decoded last.

Payloads stay in the task that reads or writes their page, apart from one join by page
id that brings each page its record type. Digests are grouped with partial sums, and
the join from rows to digest groups is one that Spark can split where a digest is hot.

Null html is the empty payload. A null page_id is written, read back and never referred
to or a revisit. Rows alike in page_id and payload count as one for the choice of the
response and come back each. Extra columns are not read. Empty tables give no archives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.llm.common import shared_folder, shuffles_dropped, written

VERSION = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
#: Framed bytes in one record, and bytes in one chunk.
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 16
RECORD = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, origin string, segment int, total long, content binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked framing; a chunk ends inside every run that equals the version line."""
    cuts = set(range(0, len(payload), size))
    at = payload.find(VERSION)
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(VERSION, at + 1)
    marks = [*sorted(cuts), len(payload)]
    out = bytearray()
    for a, b in zip(marks, marks[1:]):
        if b > a:
            out += b"%x\r\n" % (b - a)
            out += payload[a:b]
            out += b"\r\n"
    return bytes(out + b"0\r\n\r\n")


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked framing, chunk extensions and trailers allowed; ValueError where it is damaged."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def header(**fields) -> bytes:
    return VERSION + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def records(page_id, url: str, payload: bytes, own_digest: str, refers_to, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the blank lines at their ends."""
    common = {"X_Page_ID": page_id, "WARC_Target_URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC_Payload_Digest": f"sha1:{own_digest}"}
    if refers_to is not None:
        yield header(WARC_Type="revisit", WARC_Record_ID=f"<{name}>", **common, WARC_Refers_To=f"<page:{refers_to}>", Content_Length=0)
        return
    framed = chunked(payload)
    cuts = list(range(0, len(framed), segment_bytes))
    # A segment, too, must not begin or end inside a version line: framing has broken all of them.
    for i, at in enumerate(cuts):
        part = framed[at : at + segment_bytes]
        fields = {"WARC_Type": "response" if i == 0 else "continuation", "WARC_Record_ID": f"<{name}>" if i == 0 else f"<{name}/{i + 1}>", **common}
        if len(cuts) > 1:
            fields |= {"WARC_Segment_Number": i + 1}
            if i:
                fields |= {"WARC_Segment_Origin_ID": f"<{name}>"}
            if i == len(cuts) - 1:
                fields |= {"WARC_Segment_Total_Length": len(framed)}
        yield header(**fields, Transfer_Encoding="chunked", Content_Length=len(part)) + part


def parsed(piece: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and content of a record without its version line."""
    head, gap, rest = piece.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if not gap or rest[length:] not in (b"\r\n\r\n", b"") or len(rest) < length:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} does not hold its {length} bytes")
    return fields, rest[:length]


def digests(pages: DataFrame) -> DataFrame:
    """page_id and the digest of its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [digest((x.as_py() or "").encode()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page_id", "digest"])

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(html as string) as html").mapInArrow(run, "page_id long, digest string")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to: the pages whose payload a page with a larger id has, too."""
    big = pages if least_bytes <= 0 else pages.where(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least_bytes)
    rows = written(digests(big.where("page_id is not null")))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("refers_to > _least").drop("_least")
    # Written, so that the join shuffles both sides itself and may split a hot digest.
    return rows.join(written(groups), "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of `pages` (page_id, url, html) under `path`; equal payloads of `least_bytes` or more are stored once."""
    chosen = revisits(pages, least_bytes).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    own = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    joined = own.join(chosen, F.col("page_id") == F.col("_page"), "left").select("page_id", "url", "html", "_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, of, refers_to in zip(*(c for c in batch.columns)):
                payload = (html.as_py() or "").encode()
                own_digest = digest(payload)
                # Rows that share an id but not the payload are no revisits.
                target = refers_to.as_py() if of.as_py() == own_digest else None
                n += 1
                for record in records(page_id.as_py(), url.as_py() or "", payload, own_digest, target, f"urn:page:{page_id.as_py()}:{task}:{n}", segment_bytes):
                    out.append(record)
                    size += len(record)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    stored = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    with shuffles_dropped(pages.sparkSession):
        stored.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`, segments apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in RECORD.split(", ")]
        for batch in batches:
            rows = []
            for piece in batch.column(0):
                piece = piece.as_py()
                if not piece:  # what stands before the first version line of a file
                    continue
                f, content = parsed(piece)
                page, to, origin = f["X-Page-ID"] if "X-Page-ID" in f else None, f.get("WARC-Refers-To"), f.get("WARC-Segment-Origin-ID")
                number, total = f.get("WARC-Segment-Number"), f.get("WARC-Segment-Total-Length")
                rows.append(
                    (
                        f["WARC-Record-ID"],
                        int(page) if page is not None else None,
                        f["WARC-Type"],
                        int(to.strip("<>").split(":")[1]) if to else None,
                        f["WARC-Payload-Digest"].split(":", 1)[1],
                        origin or f["WARC-Record-ID"],
                        int(number) if number else None,
                        int(total) if total else None,
                        content,
                    )
                )
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    pieces = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(run, RECORD)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload: one row per page record; null payload for revisits."""
    found = read_records(spark, path)
    whole = found.where("segment is null").select("page_id", "record_type", "refers_to", "payload_digest", "content")
    parts = found.where("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "record_type", "total", "content"))).alias("parts"),
        F.first("page_id").alias("page_id"),
        F.first("payload_digest").alias("payload_digest"),
    )
    ok = (
        (F.col("parts")[0]["record_type"] == "response")
        & (F.element_at("parts", -1)["segment"] == F.size("parts"))
        & (F.col("parts")[0]["segment"] == 1)
        & (F.element_at("parts", -1)["total"] == F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["content"])))
        & (F.size(F.array_distinct(F.transform("parts", lambda x: x["segment"]))) == F.size("parts"))
    )
    content = F.when(ok, F.concat_ws("", F.transform("parts", lambda x: x["content"].cast("string"))).cast("binary")).otherwise(
        F.raise_error(F.concat(F.lit("segments of record "), "origin", F.lit(" are missing or do not add up to their total length"))).cast("binary")
    )
    joined = parts.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_digest", content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            out = []
            for kind, content, want in zip(kinds, batch.column(4), batch.column(3)):
                payload = None if kind == "revisit" else dechunked(content.as_py())
                if payload is not None and digest(payload) != want.as_py():
                    raise ValueError("a payload does not have its record's digest")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["page_id", "record_type", "refers_to", "payload_digest", "payload"])

    return whole.unionByName(joined).mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes archives to the shared folder and lists what they hold, a row per page.

    The length of a revisit is that of the response it refers to: equal digests, equal payloads.
    """
    spark = pages.sparkSession
    path = shared_folder(spark)
    write_archives(pages, path, least_bytes, segment_bytes)
    held = read_pages(spark, path).select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("_bytes"))
    held = written(held)
    lengths = held.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("_bytes").alias("_length"))
    lengths = written(lengths.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_of"), "_length"))
    revisit = held.where("record_type = 'revisit'").join(lengths, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_of")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    response = held.where("record_type = 'response'").withColumn("payload_bytes", F.col("_bytes"))
    return response.select(columns).unionByName(revisit.withColumn("payload_bytes", F.col("_length")).select(columns))
