"""WARC archives written from and read into a table of record chunks.

A payload is cut into segments, rows of (record id, segment number, bytes), each a WARC record of its own as the
format's segmentation prescribes: the first is the response, the others continuations. No step holds more than a
segment of a record next to it, and the digest of a payload is carried along its segments.

Archives are written and read by Spark's text files with the record separator as line separator, so they may lie
in any store that Spark reads, and are compressed as a whole file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.shared import scratch, stored

#: Bytes of payload in one segment.
SEGMENT = 1 << 16
#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 100
# Records end with two line ends and begin with their version. Payloads are cut so that this stands between
# records only, and archives can be read with it as line separator.
_VERSION = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_SEPARATOR = _END + _VERSION
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Cut UTF-8 into pieces of at most ``size`` bytes, between characters and inside whatever could be a separator."""
    mark = _SEPARATOR.encode()
    at = 0
    while True:
        stop = min(len(data), at + size)
        # line ends of the header or of the record's end may complete a separator; cut it behind "WARC"
        found = (_END.encode() + data[at:stop] + _END.encode()).find(mark)
        if found >= 0:
            stop = at + found + 4
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[at:stop]
        at = stop
        if at >= len(data):
            return


def _header(fields: list[tuple[str, object]]) -> str:
    return "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)


def record_id(name: object, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name}/{segment}')}>"


def _one_line(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n") or "urn:none"


def _write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, html, digest, repeated, refers, certain) -> one WARC record per segment, without the line ends behind it.

    A record is named by its page and digest; rows without an id and repeated rows get a random name. A revisit of a
    repeated row says which page it refers to, not which record (``certain`` is false).
    """
    for batch in batches:
        out: list[str] = []
        size = 0
        for page, url, html, digest, repeated, refers, certain in zip(*batch.columns, strict=True):
            page, refers, digest = page.as_py(), refers.as_py(), digest.as_py()
            name = uuid.uuid4() if page is None or repeated.as_py() else f"{page}/{digest}"
            base = [("WARC-Target-URI", _one_line(url.as_py())), ("WARC-Date", "1970-01-01T00:00:00Z")]
            if refers is not None:
                head = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(name)), *base, ("Page-ID", page),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Payload-Digest", f"sha256:{digest}"),
                        ("WARC-Refers-To", record_id(f"{refers}/{digest}") if certain.as_py() else None), ("Refers-To-Page", refers)]
                out.append(_VERSION + _header([*head, ("Content-Length", 0)]) + "\r\n")
                continue
            data = (html.as_py() or "").encode("utf-8")
            parts = list(segments(data))
            carried = hashlib.sha256()
            for number, part in enumerate(parts, 1):
                carried.update(part)
                first, last = number == 1, number == len(parts)
                head = [("WARC-Type", "response" if first else "continuation"), ("WARC-Record-ID", record_id(name, number)), *base, ("Page-ID", page),
                        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(part).hexdigest()}")]
                if len(parts) > 1:
                    head += [("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", None if first else record_id(name)),
                             ("WARC-Segment-Total-Length", len(data) if last else None)]
                if last:
                    head.append(("WARC-Payload-Digest", f"sha256:{carried.hexdigest()}"))
                out.append(_VERSION + _header([*head, ("Content-Length", len(part))]) + "\r\n" + part.decode("utf-8"))
                size += len(part)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one WARC record per row (more for oversized payloads) to gzip-compressed archives in folder ``path``.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes those with the smallest id are responses and
    the others are revisits of it. A null payload is empty, a null url is ``urn:none``; ids are integers, repeated ids
    and repeated rows stay rows, a row with a null id is a response of its own and refers to nothing. Other columns
    are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = rows.filter(F.col("page").isNotNull()).select("page", "digest", F.octet_length("html").alias("size"))
    pairs = keys.groupBy("page", "digest").agg(F.max("size").alias("size"), (F.count(F.lit(1)) > 1).alias("repeated"))
    firsts = pairs.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min(F.struct("page", "repeated")).alias("first"), F.count(F.lit(1)).alias("held")
    ).filter(F.col("held") > 1)
    later = F.col("page") > F.col("first.page")
    marks = pairs.join(firsts, "digest", "left").filter(F.col("repeated") | later).select(
        "page", "digest", "repeated", F.when(later, F.col("first.page")).alias("refers"), (~F.col("first.repeated")).alias("certain")
    )
    full = rows.join(marks, ["page", "digest"], "left")
    # a revisit sends no payload
    html = F.when(F.col("refers").isNull(), F.col("html")).alias("html")
    records = full.select("page", "url", html, "digest", "repeated", "refers", "certain").mapInArrow(_write_records, "value string")
    records.write.option("lineSep", _END).option("compression", "gzip").text(path)


_CHUNK = (
    "page long, number int, segmented boolean, record_type string, url string, refers_to long, block_digest string, payload_digest string, "
    "total_length long, data binary, record string"
)
_FIELDS = {
    "Page-ID": int, "WARC-Segment-Number": int, "WARC-Type": str, "WARC-Target-URI": str, "Refers-To-Page": int, "WARC-Block-Digest": str,
    "WARC-Payload-Digest": str, "WARC-Segment-Total-Length": int, "Content-Length": int,
    "WARC-Record-ID": str, "WARC-Segment-Origin-ID": str,
}


def parse_record(text: str) -> tuple:
    """One row of the chunk table. The first record of a file still has its version, the last one its end."""
    head, _, body = text.removeprefix(_VERSION).partition(_END)
    lines = dict(line.split(": ", 1) for line in head.split("\r\n"))
    found = {name: kind(lines[name]) if name in lines else None for name, kind in _FIELDS.items()}
    data = body.encode("utf-8")
    if data[found["Content-Length"] :] == _END.encode():
        data = data[: found["Content-Length"]]
    if len(data) != found["Content-Length"]:
        raise ValueError(f"record of page {found['Page-ID']}: {len(data)} bytes, {found['Content-Length']} announced")
    block = found["WARC-Block-Digest"]
    if block is not None and block != f"sha256:{hashlib.sha256(data).hexdigest()}":
        raise ValueError(f"record of page {found['Page-ID']}: wrong block digest")
    number = found["WARC-Segment-Number"]
    return (
        found["Page-ID"], number or 1, number is not None, found["WARC-Type"], found["WARC-Target-URI"], found["Refers-To-Page"], block,
        found["WARC-Payload-Digest"], found["WARC-Segment-Total-Length"], data,
        found["WARC-Segment-Origin-ID"] or found["WARC-Record-ID"],
    )


_KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CHUNK.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = [parse_record(t.as_py()) for t in batch.column(0).slice(at, 500)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives in ``path``: one row per WARC record, block digests checked."""
    return spark.read.option("lineSep", _SEPARATOR).text(path).mapInArrow(_parse, _CHUNK)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by record and number -> one row per record; only a digest and a length are carried."""
    open_record = None

    def closed(state: list) -> tuple:
        _, page, carried, length, announced, total = state
        if announced != f"sha256:{carried.hexdigest()}" or total != length:
            raise ValueError(f"record of page {page}: its segments do not make up the payload")
        return page, length, carried.hexdigest()

    for batch in batches:
        rows = []
        for record, page, number, announced, total, data in zip(*batch.columns, strict=True):
            record, page, number = record.as_py(), page.as_py(), number.as_py()
            if number == 1:
                if open_record:
                    rows.append(closed(open_record))
                open_record = [record, page, hashlib.sha256(), 0, None, None]
            elif open_record is None or open_record[0] != record:
                raise ValueError(f"record of page {page}: its first segment is missing")
            part = data.as_py()
            open_record[2].update(part)
            open_record[3] += len(part)
            open_record[4], open_record[5] = announced.as_py(), total.as_py()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["page", "payload_bytes", "payload_digest"],
            )
    if open_record:
        page, length, digest = closed(open_record)
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([length], pa.int64()), pa.array([digest])], names=["page", "payload_bytes", "payload_digest"])


def payloads(chunks: DataFrame) -> DataFrame:
    """Per record: page, payload_bytes, payload_digest, record_type, refers_to.

    Records of one segment are done where they are read; only segments of oversized records are brought together.
    A revisit takes its length from the response it refers to.
    """
    kept = ("page", "payload_bytes", "payload_digest", "record_type", "refers_to")
    single = chunks.filter(~F.col("segmented") & (F.col("record_type") == "response")).select(
        "page", F.octet_length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_digest"),
        "record_type", "refers_to",
    )
    parts = chunks.filter("segmented").select("record", "page", "number", "payload_digest", "total_length", "data")
    joined = parts.repartition("record").sortWithinPartitions("record", "number").mapInArrow(_fold, "page long, payload_bytes long, payload_digest string")
    responses = single.unionByName(joined.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))
    revisits = chunks.filter(F.col("record_type") == "revisit").select("page", "payload_digest", "record_type", "refers_to")
    revisits = revisits.withColumn("payload_digest", F.substring_index("payload_digest", ":", -1))
    sizes = responses.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page").isNotNull())
    sizes = sizes.select(F.col("page").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    # written first: an aggregate directly below the join would tie all revisits of a response to one task
    revisits = revisits.join(stored(sizes, "sizes"), ["refers_to", "payload_digest"])
    return responses.unionByName(revisits.select(*kept))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the query: write archives to a shared folder, then read them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = payloads(read_archives(pages.sparkSession, path))
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest, in DuckDB's SQL.
SQL = f"""
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
    min(page_id) over (partition by coalesce(html, '')) as first
  from pages
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {LEAST_REVISIT} and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {LEAST_REVISIT} and page_id > first then first end as refers_to
from p
"""
