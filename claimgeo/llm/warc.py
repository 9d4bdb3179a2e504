"""WARC archives: writing pages as records, reading them back with segment
reassembly.

Writing runs on DataFrame functions: a page's payload becomes an HTTP response
in chunked transfer framing, split into a first record and continuation
records when it is long; pages with equal payloads become revisits. Spark's
text writer puts the records into gzip archives (records end in CRLF CRLF,
which is the line separator), through its usual committed output.

Reading parses each archive by the records' declared lengths, groups
continuations by origin, orders them by segment number, verifies the total
length and undoes the chunked framing. Only segmented payloads are shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut

# Fixed values of the formats.
CRLF = "\r\n"
HTTP_HEAD = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             "Transfer-Encoding: chunked\r\n\r\n")
REVISIT_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_BYTES = 4096
SEGMENT_BYTES = 16_384
RECORDS_PER_ARCHIVE = 4_000          # with the segment size this bounds an archive to about 66 MB
REVISIT_BYTES = 1_000


def _bytes(s: Column) -> Column:
    return s.cast("binary")


def _pieces(data: Column, size: int) -> Column:
    """A binary cut into consecutive pieces of ``size`` bytes, as strings that
    may hold parts of characters."""
    n = F.octet_length(data)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size), F.lit(0)).cast("int")),
                       lambda i: F.substring(data, i * size + 1, F.lit(size)).cast("string"))


def chunked(payload: Column, size: int = CHUNK_BYTES) -> Column:
    """A binary payload in chunked transfer framing, as a string."""
    chunks = F.transform(F.filter(_pieces(payload, size), lambda c: F.octet_length(c) > 0), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF)))
    return F.concat(F.array_join(chunks, ""), F.lit("0" + CRLF + CRLF))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES,
            chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One column ``value``: the WARC records of the pages, segments in rows
    of their own."""
    df = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                      _bytes(F.coalesce(F.col(payload_col).cast("string"), F.lit(""))).alias("payload"))
    df = df.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    shared = (df.filter(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes")
              .agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    df = df.join(shared, ["digest", "bytes"], "left")
    df = df.withColumn("revisit", F.col("original").isNotNull() & (F.coalesce("id", F.col("original") - 1) < F.col("original")))
    # The urn names the page; the rest keeps repeated rows of a page apart.
    df = df.withColumn("urn", F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"),
                                       F.expr("uuid()"), F.lit(">")))
    block = F.when(F.col("revisit"), F.lit(REVISIT_HEAD)).otherwise(
        F.concat(F.lit(HTTP_HEAD), chunked(F.col("payload"), chunk_bytes)))
    df = df.select("id", "url", "digest", "original", "revisit", "urn", _bytes(block).alias("block"))
    df = df.withColumn("total", F.octet_length("block")).withColumn("pieces", F.size(_pieces(F.col("block"), segment_bytes)))
    df = df.select("*", F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("k", "piece")).drop("block")

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        full = F.concat(F.lit(name + ": "), value, F.lit(CRLF))
        return full if when is None else F.when(when, full).otherwise(F.lit(""))

    cont, split = F.col("k") > 0, F.col("pieces") > 1
    kind = F.when(cont, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(cont, F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).otherwise(F.col("urn"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "),
             ~cont & (F.length(F.coalesce("url", F.lit(""))) > 0)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), ~cont),
        line("WARC-Profile", F.lit(PROFILE), F.col("revisit")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("original").cast("string"), F.lit("")),
                                        F.lit(">")), F.col("revisit")),
        line("WARC-Segment-Number", (F.col("k") + 1).cast("string"), split),
        line("WARC-Segment-Origin-ID", F.col("urn"), cont),
        line("WARC-Segment-Total-Length", F.col("total").cast("string"), cont & (F.col("k") == F.col("pieces") - 1)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("piece").cast("string")), F.lit(CRLF))
    return df.select(F.concat(head, "piece").alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE, **options) -> None:
    """Write the records of ``pages`` as gzip WARC archives under ``path``, a
    folder that all executors share."""
    (records(pages, **options).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_archive).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive, by the
    declared lengths; raises on damaged framing."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n") if end > 0 else [b""]
        if not lines[0].startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for raw in lines[1:]:
            name, _, value = raw.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        begin, length = end + 4, int(head["content-length"])
        at = begin + length + 4
        if data[begin + length:at] != b"\r\n\r\n":
            raise ValueError(f"record at byte {end} does not end where its length says")
        yield head, data[begin:begin + length]


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; raises if the
    framing is damaged or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends without its last chunk")
        size = int(body[at:end].split(b";")[0], 16)
        begin, at = end + 2, end + 2 + size + 2
        if not size:
            return b"".join(out)
        if body[at - 2:at] != b"\r\n" or len(body) < at:
            raise ValueError("chunk does not end where its size says")
        out.append(body[begin:at - 2])


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message, chunked framing undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", head) else body


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to,
    payload)`` of every response and revisit record under ``path``;
    ``payload`` is the decoded binary (null for revisits, left out without
    ``payloads``).

    Written from a table: a null page is an empty payload; among records with
    equal payloads of at least ``revisit_bytes`` bytes those with the largest
    id are responses (several, if rows with that id repeat), the others,
    also those with null ids, revisit it; without any id all are responses.
    Every row of the table comes back once. An empty table gives no records.

    Raises where an archive, a segment sequence, a total length or a digest
    does not hold together. An archive is a row while it is parsed: its size
    is bounded by the writer's records and segment size.
    """
    fields = [("page_id", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"),
              ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("payload", pa.binary(), "binary"),
              ("origin", pa.string(), "string"), ("segment", pa.int32(), "int"), ("total", pa.int64(), "long"),
              ("block", pa.binary(), "binary")]
    schema = pa.schema([(n, t) for n, t, _ in fields])
    ddl = ", ".join(f"{n} {t}" for n, _, t in fields)

    def page(urn: str | None) -> int | None:
        found = re.match(r"<urn:x-page:(-?[0-9]*)", urn or "")
        return int(found[1]) if found and found[1] else None

    def response(urn, digest, block):
        body = http_payload(block)
        own = hashlib.sha1(body).hexdigest()
        if digest != "sha1:" + own:
            raise ValueError(f"{urn}: payload has digest {own}, its record says {digest}")
        return page(urn), len(body), own, "response", None, body if payloads else None, None, None, None, None

    def as_batch(rows):
        return batch(dict(zip(schema.names, map(list, zip(*rows)))) if rows else dict.fromkeys(schema.names, []), schema)

    def archives(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in parse(zlib.decompress(content.as_py(), 31)):
                    urn, digest = head["warc-record-id"], head.get("warc-payload-digest")
                    number = int(head.get("warc-segment-number", 0))
                    if head["warc-type"] == "revisit":
                        rows.append((page(urn), None, digest.removeprefix("sha1:"), "revisit", page(head["warc-refers-to"]),
                                     None, None, None, None, None))
                    elif number:
                        total = head.get("warc-segment-total-length")
                        rows.append((None, None, digest, "segment", None, None, head.get("warc-segment-origin-id", urn),
                                     number, total and int(total), block))
                    elif head["warc-type"] == "response":
                        rows.append(response(urn, digest, block))
                yield as_batch(rows)

    def reassemble(batches):
        for b in batches:
            rows = []
            for urn, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"{urn}: segments {[p['segment'] for p in parts]} do not make up its total length")
                rows.append(response(urn, parts[0]["payload_digest"], block))
            yield as_batch(rows)

    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(archives, ddl)
    parsed = cut(parsed)
    segments = (parsed.filter("record_type = 'segment'").groupBy("origin")
                .agg(F.array_sort(F.collect_list(F.struct("segment", "block", "total", "payload_digest"))).alias("parts")))
    whole = parsed.filter("record_type = 'response'").unionByName(segments.mapInArrow(reassemble, ddl))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    sizes = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = parsed.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    checked = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.lit("a revisit refers to no response with its payload"))
                     .cast("long")).otherwise(F.col("payload_bytes"))
    revisits = revisits.withColumn("payload_bytes", checked)
    return whole.select(*out).unionByName(revisits.select(*out))
