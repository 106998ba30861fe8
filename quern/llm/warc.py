"""WARC archives: segmented, chunk-framed records written and read back by Spark.

Archives are text files whose lines end with the blank lines that end a WARC record, so Spark's own
writer (and its commit protocol) makes them, on any file system it knows. A payload longer than one
segment becomes a first record and continuation records, which carry the origin's identifier and
their number; the last has the total length. Bodies are framed by chunked transfer coding.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

END = b"\r\n"
_RECORD_SCHEMA = (
    "record_id string, record_type string, origin_id string, segment int, total_length long, refers_to string, "
    "target_uri string, payload_digest string, block binary"
)


def chunked(body: bytes, chunk: int) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    parts = [b"%x\r\n%s\r\n" % (len(body[k : k + chunk]), body[k : k + chunk]) for k in range(0, len(body), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """Body of a chunked message; chunk extensions and trailers are skipped. Raises ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = framed.find(END, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != END:
            raise ValueError("a chunk is shorter or longer than its size")
        out.append(framed[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Payload and headers (lower-case names) of an HTTP message; the transfer coding is undone."""
    head, parted, body = block.partition(END + END)
    headers = dict(_header_fields(head))
    if not parted:
        raise ValueError("an HTTP head does not end")
    return (unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body), headers


def _header_fields(head: bytes):
    for line in head.split(END)[1:]:
        name, _, value = line.partition(b":")
        yield name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _one_line(text: str | None) -> str | None:
    return None if text is None else re.sub(r"[\x00-\x20\x7f]+", " ", text).strip()


def write_archives(records: DataFrame, path: str, segment_bytes=8192, chunk_bytes=4096, date="1970-01-01T00:00:00Z", codec="gzip", records_per_file=8_000) -> None:
    """Write one logical record per row of (page_id, row, url, record_type, refers_to, refers_row, digest, payload).

    A record's identifier is made of page_id and row, a number that no other row has, so a revisit
    names the very record it revisits.

    A response's block is an HTTP message with chunked body, cut into segments of segment_bytes; a
    revisit's is the HTTP head alone, with the length of the payload it stands for. Files hold at
    most records_per_file physical records.
    """

    def made(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own, payload = _record_id(r["page_id"], r["row"]), r["payload"]
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                response = r["record_type"] == "response"
                if response:
                    block = (head + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload, chunk_bytes)
                else:
                    block = (head + f"Content-Length: {len(payload)}\r\n\r\n").encode()
                common = [("WARC-Date", date), ("WARC-Target-URI", _one_line(r["url"])), ("WARC-Payload-Digest", f"sha256:{r['digest']}")]
                if r["refers_to"] is not None:
                    common += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(r["refers_to"], r["refers_row"]))]
                segments = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                for k, some in enumerate(segments, 1):
                    fields = [("WARC-Type", r["record_type"] if k == 1 else "continuation"), ("WARC-Record-ID", own if k == 1 else f"{own[:-1]}:{k}>")]
                    fields += common + [("Content-Type", "application/http; msgtype=response")] if k == 1 else [("WARC-Date", date)]
                    if len(segments) > 1:
                        fields += [("WARC-Segment-Number", k)] + ([("WARC-Segment-Origin-ID", own)] if k > 1 else [])
                        fields += [("WARC-Segment-Total-Length", len(block))] if k == len(segments) else []
                    out.append(_record(fields, some))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = records.mapInArrow(made, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", codec).option("maxRecordsPerFile", records_per_file).text(path)


def read_records(data: bytes):
    """Physical records of a WARC file's bytes, as dicts; Content-Length alone says where each ends."""
    at = 0
    while at < len(data):
        end = data.find(END + END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(_header_fields(data[at:end]))
        low = end + 4
        at = low + int(fields["content-length"])
        if at > len(data):
            raise ValueError("a record is cut short")
        yield fields, data[low:at]
        while data.startswith(END, at):
            at += 2


def _unpacked(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    import gzip

    return gzip.decompress(content)  # one member or one a record


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Physical records of all WARC files (plain or gzip) under a path. A file must fit in a task's memory."""

    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for f, block in read_records(_unpacked(content.as_py())):
                    refers = f.get("warc-refers-to")
                    rows.append(
                        (
                            f["warc-record-id"], f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), int(f.get("warc-segment-number", 0)),
                            int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, refers, f.get("warc-target-uri"),
                            f.get("warc-payload-digest"), block,
                        )
                    )
                    size += len(block)
                    if size > 1 << 23:
                        yield _table(rows)
                        rows, size = [], 0
                if rows:
                    yield _table(rows)

    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _RECORD_SCHEMA.split(", ")]

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(parsed, _RECORD_SCHEMA)


def reassembled(physical: DataFrame) -> DataFrame:
    """Logical records: segments grouped by origin, ordered by number, and checked against the total length.

    Only segmented records are shuffled. ``problem`` says what is wrong with a record whose
    segments are missing, doubled or of another total length; its block is then null.
    """
    whole = physical.where("segment = 0").withColumn("problem", F.lit(None).cast("string"))
    part = F.struct("segment", "block")
    grouped = (
        physical.where("segment > 0")
        .groupBy("origin_id")
        .agg(
            F.array_sort(F.collect_list(part)).alias("parts"),
            F.max("total_length").alias("total_length"),
            *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_id", "record_type", "refers_to", "target_uri", "payload_digest")],
        )
        # joined as strings, whose bytes Spark leaves as they are: one copy, where concatenating one by one copies what is joined so far
        .withColumn("joined", F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary"))
        .withColumn(
            "problem",
            F.when(F.col("total_length").isNull(), "no last segment")
            .when(F.col("parts.segment") != F.sequence(F.lit(1), F.size("parts")), "segments missing or doubled")
            .when(F.octet_length("joined") != F.col("total_length"), "another total length"),
        )
        .withColumn("block", F.when(F.col("problem").isNull(), F.col("joined")))
        .withColumn("segment", F.lit(0))
        .select(*physical.columns, "problem")
    )
    return whole.unionByName(grouped)


def page_records(logical: DataFrame) -> DataFrame:
    """page_id, record_id, record_type, refers_to (a page), refers_id, payload_bytes, payload_digest, payload, problem of logical page records.

    A response's payload is decoded and its digest computed and compared with the header's. A
    revisit has the digest and length that its own headers state and no payload (see ``resolved``).
    """

    def decoded(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for kind, digest, block, problem in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                payload = length = None
                stated = (digest or "").removeprefix("sha256:") or None
                if problem is None:
                    try:
                        body, headers = http_payload(block)
                        if kind == "revisit":
                            length = int(headers["content-length"])
                        else:
                            payload, length = body, len(body)
                            found = hashlib.sha256(body).hexdigest()
                            problem = None if stated in (None, found) else "another payload digest"
                            stated = found
                    except (ValueError, KeyError) as e:
                        problem = f"unreadable: {e}"
                for column, value in zip(rows, (length, stated, payload, problem), strict=True):
                    column.append(value)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "record_id", "record_type", "refers_to", "refers_id")]
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=["page_id", "record_id", "record_type", "refers_to", "refers_id", "payload_bytes", "payload_digest", "payload", "problem"])

    page = lambda c: F.regexp_extract(F.col(c), "^<urn:page:(-?\\d+)", 1).try_cast("long")
    read = logical.select("record_type", "payload_digest", "block", "problem", page("record_id").alias("page_id"), "record_id", page("refers_to").alias("refers_to"), F.col("refers_to").alias("refers_id"))
    return read.mapInArrow(decoded, "page_id long, record_id string, record_type string, refers_to long, refers_id string, payload_bytes long, payload_digest string, payload binary, problem string")


def resolved(records: DataFrame) -> DataFrame:
    """Page records whose revisits are checked against the record they name; ``problem`` says where it is absent or differs.

    Only revisits are joined, with the digests of responses. records are evaluated twice: write them first.
    """
    revisits, others = records.where("record_type = 'revisit'"), records.where("coalesce(record_type <> 'revisit', true)")
    named = others.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("payload_digest").alias("told_digest"), F.col("payload_bytes").alias("told_bytes"))
    same = F.col("told_digest").eqNullSafe(F.col("payload_digest")) & F.col("told_bytes").eqNullSafe(F.col("payload_bytes"))
    problem = F.coalesce("problem", F.when(F.col("told_digest").isNull(), "revisits no record here").when(~same, "another payload than the record it revisits"))
    met = revisits.join(named, "refers_id", "left").withColumn("problem", problem)
    return others.unionByName(met.select(*records.columns))


def planned_records(pages: DataFrame, scratch: Scratch, id_col="page_id", url_col="url", html_col="html", least_bytes=100) -> DataFrame:
    """Which pages are responses and which revisit an equal payload of at least least_bytes.

    Of equal payloads, rows at the smallest page_id (repeated ids: all of them) are responses. Only
    digests that occur under several ids go back to the pages, so no page of a hot payload waits
    for another; the join's sides are written or scanned, and skewed parts are split. pages are read
    twice and must then have the same rows in the same partitions, as files do.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha2("payload", 256))
    many = base.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("first"), F.max("page_id").alias("last_id"))
    many = scratch.save(many.where("first.page_id < last_id").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")), "equal")
    refers = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    return (
        base.join(many, "digest", "left")
        .withColumn("refers_to", refers)
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .withColumn("refers_row", F.when(F.col("refers_to").isNotNull(), F.col("first_row")))
        .select("page_id", "row", "url", "record_type", "refers_to", "refers_row", "digest", "payload")
    )


def round_trip(pages: DataFrame, archive_path: str | None = None, id_col="page_id", url_col="url", html_col="html", keep_payload=True, **writing) -> DataFrame:
    """Write a WARC record per page, then read the archives back into page records, with their payloads or without.

    A null html is an empty payload; a null url is left out and a null page_id stays null (such a
    page is a response). Repeated rows are records of their own. Revisits are checked against what
    they name. Columns: see ``page_records``.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = archive_path or scratch.path("archives")
    write_archives(planned_records(pages, scratch, id_col, url_col, html_col), path, **writing)
    scratch.drop("equal")
    records = page_records(reassembled(read_archives(pages.sparkSession, path)))
    return resolved(scratch.save(records if keep_payload else records.drop("payload"), "records"))
