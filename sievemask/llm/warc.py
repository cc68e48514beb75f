"""Archives of web pages: legacy ARC files are parsed by version, and converted to WARC records.

`write_arc` lays pages down as ARC archives, `read_arc` parses them: the first record of an archive is its version block,
which names the fields of all header lines that follow (five in version 1, ten in version 2); contents are cut by
declared length, never by searching. `to_warc` synthesises what ARC lacks: record identifiers (a name-based UUID of archive
and offset), ISO timestamps, record types and SHA-1 digests; of equal payloads one record is the response and the others
revisit it. `write_warc` and `read_warc` store and parse the records.

An archive is compressed and holds at most 1,024 records of up to 16 KiB or 16 longer ones, so one archive in memory is small. Spark's
own writers and readers do all file access, so archives live wherever tables can.

Defined cases: a null html is an empty payload; a null url becomes `urn:page:` and the id; white space in a url is
percent-encoded; a null page_id stays null and is never the largest; equal rows are records of their own, and all that carry the
largest page_id of a group are responses; an empty table gives no rows; further columns of `pages` are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import table, work_folder, written

SMALL, MANY, FEW = 16 * 1024, 1024, 16
# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_SCHEMA = (
    "archive string, offset long, arc_version int, url string, ip string, archive_date string, content_type string, http string, payload binary"
)
WARC_SCHEMA = (
    "record_type string, record_id string, refers_to_id string, target string, warc_date string, payload_digest string, page_id long, "
    "payload_bytes long, digest_ok boolean"
)


def _led(rows: DataFrame, most: int, leader: str) -> DataFrame:
    """`rows` (heads, body) as records, with a leading record before every `most` rows of a task. Archives take turns in `heads`."""
    lead = {"arc": _arc_leader, "warc": _warc_leader}[leader]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out = []
            for heads, body in zip(batch.column(0), batch.column(1), strict=True):
                if n % most == 0:
                    out.append(lead(n // most))
                turns = heads.as_py()
                out.append(turns[n // most % len(turns)] + body.as_py())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return rows.mapInArrow(add, "value string")


def _arc_leader(n: int) -> str:
    version = 1 + n % 2
    block = f"{version} 0 sievemask\n{ARC_FIELDS[version]}\n"
    tail = f"{len(block)}" if version == 1 else f"200 - - 0 part-{n}.arc {len(block)}"
    return f"filedesc://part-{n}.arc 0.0.0.0 20240101000000 text/plain {tail}\n{block}"


def _warc_leader(n: int) -> str:
    block = "format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    uid = hashlib.md5(f"warcinfo/{n}".encode()).hexdigest()
    uid = f"{uid[:8]}-{uid[8:12]}-3{uid[13:16]}-a{uid[17:20]}-{uid[20:]}"
    return (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
        f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n{block}"
    )


def _store(rows: DataFrame, size: Column, heads: Column, body: Column, path: str, leader: str, end: str) -> None:
    for kind, chosen, most in (("small", size < SMALL, MANY), ("large", size >= SMALL, FEW)):
        records = _led(rows.where(chosen).select(heads.alias("heads"), body.alias("body")), most, leader)
        records.write.option("lineSep", end).option("maxRecordsPerFile", most + 1).option("compression", "gzip").text(f"{path}/{kind}")


def write_arc(pages: DataFrame, path: str, captured: str = "20240101000000") -> None:
    """pages: page_id, url, html. Archives of a task alternate between versions 1 and 2."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page = F.col("page_id").cast("string")
    url = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(page, F.lit("none")))), r"[\s\p{Cntrl}]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), page), F.lit("")), F.lit("\r\n\r\n"),
    )
    content = F.concat(http, html)
    start = F.concat(F.when(url == "", F.lit("urn:page:none")).otherwise(url), F.lit(f" 0.0.0.0 {captured} text/html "))
    length = F.octet_length(content).cast("string")
    first = F.concat(start, length, F.lit("\n"))
    second = F.concat(start, F.lit("200 "), F.md5(content.cast("binary")), F.lit(" - 0 - "), length, F.lit("\n"))
    _store(pages, F.octet_length(html), F.array(first, second), content, path, "arc", "\n")


def _arc_records(content: bytes):
    """(offset, version, fields, body) of the records of one archive."""
    at, names, version = 0, None, 0
    while at < len(content):
        if content[at : at + 1] == b"\n":
            at += 1
            continue
        eol = content.index(b"\n", at)
        line = content[at:eol].decode()
        length = int(line.rsplit(" ", 1)[1])
        body = content[eol + 1 : eol + 1 + length]
        if len(body) != length:
            raise ValueError(f"the archive ends inside the record at byte {at}")
        if names is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an archive begins with its version block")
            first, fields = body.decode().split("\n")[:2]
            version, names = int(first.split(" ")[0]), fields.split(" ")
            if ARC_FIELDS.get(version) != fields:
                raise ValueError(f"header fields of version {version} are not known: {fields}")
        else:
            values = line.split(" ")
            if len(values) != len(names):
                raise ValueError(f"{len(values)} header fields at byte {at}, not {len(names)}")
            yield at, version, dict(zip(names, values, strict=True)), body
        at = eol + 1 + length


def _parsed(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [arrow[f.split()[1]] for f in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                held = []
                for row in rows_of(name.as_py(), gzip.decompress(content.as_py())):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(parse, schema)


def _arc_rows(name: str, content: bytes):
    for at, version, fields, body in _arc_records(content):
        head, _, payload = body.partition(b"\r\n\r\n")
        yield (
            "/".join(name.split("/")[-2:]), at, version, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"],
            head.decode(), payload,
        )


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: archive, offset, arc_version, url, ip, archive_date, content_type, http (its headers), payload."""
    return _parsed(spark, path, _arc_rows, ARC_SCHEMA)


def to_warc(arc: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """One row per ARC record: record_type, record_id, page_id, refers_to_id, target, warc_date, ip, http, payload, payload_digest.

    Of equal payloads of at least `least_bytes`, the record with the largest page_id is the response. Groups fold before they
    are shuffled; the join deals rows by payload hash, and a hot payload's rows are split by the adaptive plan."""
    uid = F.md5(F.concat_ws("/", "archive", F.col("offset").cast("string"), "url"))
    record_id = F.concat(
        F.lit("urn:uuid:"), F.substring(uid, 1, 8), F.lit("-"), F.substring(uid, 9, 4), F.lit("-3"), F.substring(uid, 14, 3), F.lit("-a"),
        F.substring(uid, 18, 3), F.lit("-"), F.substring(uid, 21, 12),
    )
    page = F.regexp_extract("http", r"(?i)(?:^|\r\n)X-Page-Id: (-?[0-9]+)", 1)
    rows = arc.select(
        record_id.alias("record_id"), F.when(page != "", page.cast("long")).alias("page_id"), F.col("url").alias("target"), "ip", "http",
        F.date_format(F.to_timestamp("archive_date", "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        "payload", F.sha1("payload").alias("payload_digest"),
        F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)).alias("same"),
    )
    grouped = rows.where("same is not null and page_id is not null").groupBy("same").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "record_id")).alias("_first")
    )
    several = written(grouped.where("_n > 1").select("same", "_first"), "payload-groups")
    # Small payloads have no hash; their own identifiers deal them out.
    joined = rows.withColumn("_met", F.coalesce("same", "record_id")).join(several.withColumnRenamed("same", "_met"), "_met", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "record_id",
        F.when(revisit, F.col("_first.record_id")).alias("refers_to_id"), "page_id", "target", "ip", "warc_date", "http", "payload", "payload_digest",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Revisit records keep the headers of their response, and no payload."""
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.col("http"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.format_string("<%s>", "record_id")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("target")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.format_string("<%s>", "refers_to_id")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    _store(records, F.octet_length(block), F.array(head), block, path, "warc", "\r\n\r\n")


def _warc_rows(name: str, content: bytes):
    at = 0
    while at < len(content):
        if content[at : at + 9] != b"WARC/1.1\r":
            raise ValueError(f"no record at byte {at} of {name}")
        stop = content.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in content[at:stop].decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        block = content[stop + 4 : stop + 4 + length]
        if len(block) != length or content[stop + 4 + length : stop + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} of {name} has another length than declared")
        at = stop + 8 + length
        if fields["WARC-Type"] == "warcinfo":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n"))}
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = fields["WARC-Type"] == "response"
        yield (
            fields["WARC-Type"], fields["WARC-Record-ID"][1:-1], fields["WARC-Refers-To"][1:-1] if not whole else None, fields["WARC-Target-URI"],
            fields["WARC-Date"], digest, int(http["x-page-id"]) if "x-page-id" in http else None, len(payload) if whole else None,
            hashlib.sha1(payload).hexdigest() == digest if whole else None,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record; a revisit's payload_bytes and digest_ok are null until `resolved`."""
    return _parsed(spark, path, _warc_rows, WARC_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Revisits meet their responses by record identifier. Adds refers_to, the response's page_id."""
    responses = records.where("record_type = 'response'")
    known = responses.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("digest_ok").alias("_ok")
    )
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "digest_ok").join(known, "refers_to_id", "left")
    revisits = revisits.withColumnsRenamed({"_bytes": "payload_bytes", "_ok": "digest_ok"})
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = work_folder(spark, "arc"), work_folder(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    # Each archive is parsed once: its rows are read several times below.
    write_warc(to_warc(written(read_arc(spark, arc), "arc-rows")), warc)
    found = resolved(written(read_warc(spark, warc), "warc-rows"))
    sound = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return found.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
     g AS (SELECT *, max(CASE WHEN n >= 1000 THEN page_id END) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

QUERIES = {"op9_warc": (op9_warc, OP9_SQL)}
