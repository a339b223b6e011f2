"""WARC archives of pages, written and read back, with segmented records and chunked payloads.

A page whose payload is the first of its equals is a response record, the rest revisit it. A block longer than
SEGMENT characters is cut into segments: the first is the response record itself, the others are continuation
records that name it as their origin. Payloads are framed in HTTP chunks. Reading groups continuation records by
origin, orders them by segment number, verifies the total length, strips the HTTP header and decodes the chunks.

Archives are gzip files that Spark's text writer lays down, so they go to any store that Spark writes to. Page_id and
a row's number make the record id, so repeated rows stay apart.

Edge cases: null html is an empty payload; of equal payloads with equal page_id one row is the response; a null
page_id comes after every other and is written as an empty id; an empty table writes no record; html of any length
is cut by characters, so a record stays a valid text.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import shared_folder, steps, written

LEAST_REVISIT = 100
SEGMENT, CHUNK = 48_000, 8_000
#: Records a file: an archive is read as a whole, so it stays under this many records of at most 4 * SEGMENT bytes.
RECORDS = 400
#: Between records; Spark's text writer puts it after each.
END = "\r\n\r\n"
VERSION = "WARC/1.1"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(text: str) -> str:
    """HTTP chunk framing; sizes are in UTF-8 bytes."""
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: str, **fields) -> str:
    names = {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z", **names, "Content-Length": len(block.encode())}
    return f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block


def records_of(page_id, url, html: str, record_id: str, digest: str, refers: str | None) -> list[str]:
    """The records of one page."""
    same = {"WARC_Target_URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "X_Page_ID": "" if page_id is None else page_id, "WARC_Payload_Digest": f"sha256:{digest}"}
    if refers is not None:
        return [record("revisit", record_id, "", WARC_Refers_To=f"<{refers}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **same)]
    block = HTTP + chunked(html)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        return [record("response", record_id, block, **same)]
    out = [record("response", record_id, parts[0], WARC_Segment_Number=1, **same)]
    for k, part in enumerate(parts[1:], 2):
        total = len(block.encode()) if k == len(parts) else None
        out.append(record("continuation", f"{record_id}-{k}", part, WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
    return out


def parsed(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + len(END)
    return out


def write_archives(pages: DataFrame, path: str) -> None:
    """One response or revisit for each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2("html", 256))
    # The first of each payload: added up within each task first, so a payload of many pages is no hot group.
    long = F.octet_length("html") >= LEAST_REVISIT
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = rows.where(long).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    known = rows.join(first, "digest", "left").withColumn("refers_row", F.when(long & (F.col("row") != F.col("first_row")), F.col("first_row")))
    names = ["page_id", "url", "html", "row", "digest", "refers_row"]

    def run(batches):
        for batch in steps(batches, "html"):
            out = []
            for page_id, url, html, row, digest, refers in zip(*[batch.column(c).to_pylist() for c in names]):
                out += records_of(page_id, url, html, f"urn:page:{row}", digest, None if refers is None else f"urn:page:{refers}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    text = known.select(*names).mapInArrow(run, "value string")
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, record_type, record_id, refers_to_record, digest, payload) of each page record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    fields = "page_id long, record_type string, record_id string, refers string, digest string, origin string, number int, total long, block binary"

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = parsed(zlib.decompress(content.as_py(), 47))
                for i in range(0, len(found), 64):
                    rows = []
                    for head, block in found[i : i + 64]:
                        own = head["WARC-Record-ID"]
                        number = head.get("WARC-Segment-Number")
                        page = head.get("X-Page-ID", "")
                        total = head.get("WARC-Segment-Total-Length")
                        rows.append((int(page) if page else None, head["WARC-Type"], own, head.get("WARC-Refers-To"), head.get("WARC-Payload-Digest", "").removeprefix("sha256:"), head.get("WARC-Segment-Origin-ID", own) if number else None, int(number) if number else None, int(total) if total else None, block))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in fields.split(", ")])

    found = files.mapInArrow(run, fields)
    whole = found.where("origin is null").select("page_id", "record_type", "record_id", "refers", "digest", "block")
    # Only segmented records are shuffled; an origin has as many segments as its one page needs.
    part = F.struct("number", "total", "page_id", "record_type", "digest", "block")
    groups = found.where("origin is not null").groupBy("origin").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.block))")
    ordered = F.expr("forall(sequence(1, size(parts)), i -> parts[i - 1].number = i)")
    groups = groups.select(
        F.col("parts")[0]["page_id"].alias("page_id"),
        F.col("parts")[0]["record_type"].alias("record_type"),
        F.col("origin").alias("record_id"),
        F.lit(None).cast("string").alias("refers"),
        F.col("parts")[0]["digest"].alias("digest"),
        F.when(ordered & (F.element_at("parts", -1)["total"] == F.octet_length(joined)), joined).alias("block"),
    )

    def decode(batches):
        names = ["page_id", "record_type", "record_id", "refers", "digest", "payload"]
        for batch in batches:
            payload = []
            for kind, block in zip(batch.column("record_type").to_pylist(), batch.column("block").to_pylist()):
                if kind == "revisit":
                    payload.append(None)
                elif block is None:
                    raise ValueError("a segmented record is incomplete")
                else:
                    payload.append(unchunked(block[block.index(b"\r\n\r\n") + 4 :]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(payload, pa.binary())], names=names)

    return whole.union(groups).mapInArrow(decode, "page_id long, record_type string, record_id string, refers string, digest string, payload binary")


def archive_report(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, from the archives alone."""
    records = read_archives(spark, path)
    measured = records.select("page_id", "record_type", "record_id", "refers", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("own"), "digest")
    measured = measured.withColumn("own", F.when((F.col("record_type") == "revisit") | (F.col("own") == F.col("digest")), F.col("own")).otherwise(F.raise_error(F.lit("a payload does not match its digest"))))
    measured = written(measured, "warc-records")
    targets = measured.join(measured.where("refers is not null").select(F.col("refers").alias("record_id")).distinct(), "record_id", "left_semi")
    targets = targets.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full"), F.col("own").alias("full_digest"))
    out = measured.join(targets, "refers", "left")
    return out.select("page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.coalesce("own", "full_digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and report what reading them gives."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return archive_report(pages.sparkSession, path)
