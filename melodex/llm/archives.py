"""Web archives: legacy ARC files are read by their declared lengths and converted to WARC files, which are read back.

An ARC file begins with a block that names its version, and so which fields its record lines have; every record line ends
with the length of what follows. Converting makes what WARC asks for and ARC lacks: record identifiers, ISO timestamps,
record types and SHA-256 digests. Of records with equal payloads one is a response, the others revisit it: first the
archives' index, without payloads, decides which; then records are read again, get their decisions by place, and are written.

Archives are written by Spark's text writer, whose line separators are just what the formats put after a record, so bytes
reach whatever store Spark writes to and are committed as any other table is; they are read as ``binaryFile`` rows. An
archive is one row and one task: keep archives to some hundred megabytes, as archives are.
"""

import gzip
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spread_join, written

#: Payloads of fewer bytes are never revisits; bytes of records handed on at a time.
LEAST_BYTES, BATCH_BYTES = 100, 8 << 20
#: How archives are packed: a little larger than usual, in half the time.
PACKED = {"compression": "gzip", "zlib.compress.level": "THREE"}

# The record lines of both versions of ARC, and what revisits are called.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_line = {
    1: re.compile(rb"(.*?) (\S+) (\d{4,17}|-) (.*) (\d+)"),
    2: re.compile(rb"(.*?) (\S+) (\d{4,17}|-) (.*) (\d+|-) \S+ (?:.*) (?:\d+|-) \S+ (\d+)"),
}
_blank = re.compile(rb"\r?\n\r?\n")

ARC_ROWS = "file string, archive string, archive_date string, offset long, version int, url string, ip string, date string, mime string, status int, head binary, payload binary, error string"
WARC_ROWS = "file string, offset long, fields map<string, string>, head binary, payload binary, error string"


def _opened(content: bytes) -> io.BufferedIOBase:
    """The archive's bytes as a stream, unpacked if they are packed, in one member or in many."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if content[:2] == b"\x1f\x8b" else raw


def split_http(block: bytes) -> tuple[bytes | None, bytes]:
    """Head (with the empty line that ends it) and payload of an HTTP message; no head where the block isn't one."""
    if not block.startswith(b"HTTP/"):
        return None, block
    end = _blank.search(block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def arc_records(stream) -> Iterator[tuple]:
    """Rows of ARC_ROWS of one archive, without their file, the block with its version among them (url ``filedesc:``).

    Lines that are no record line are skipped to the next that is, and reported as one row with an error; so is a record
    that ends early, with what is there of it.
    """
    version, name, date, offset, lost = 1, None, None, 0, None
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        told = line.rstrip(b"\r\n")
        if not told and lost is None:
            continue
        opening = told.startswith(b"filedesc:")
        found = (_line[1].fullmatch(told) or _line[2].fullmatch(told)) if opening else _line[version].fullmatch(told)
        if not found:
            lost = at if lost is None else lost
            continue
        if lost is not None:
            yield name, date, lost, version, None, None, None, None, None, None, None, f"{at - lost} bytes without a record line"
            lost = None
        url, ip, when, mime, *status, length = (x.decode("utf-8", "replace") for x in found.groups())
        block = stream.read(int(length))
        offset += len(block)
        error = None if len(block) == int(length) else f"{int(length) - len(block)} bytes are missing"
        if opening:
            first = block.split(b" ", 1)[0]
            version = int(first) if first in (b"1", b"2") else 1
            name, date = url.partition("://")[2].rpartition("/")[2] or None, when
            error = error or (None if first in (b"1", b"2") else "unknown version, read as 1")
        code = int(status[0]) if status and status[0] != "-" else None
        head, payload = split_http(block)
        yield name, date, at, version, None if url == "-" else url, None if ip == "-" else ip, None if when == "-" else when, None if mime == "-" else mime, code, head, payload, error
    if lost is not None:
        yield name, date, lost, version, None, None, None, None, None, None, None, f"{offset - lost} bytes without a record line"


def warc_records(stream) -> Iterator[tuple]:
    """Rows of WARC_ROWS of one archive, without their file. Names of fields are in lower case; of repeated ones the last
    counts. What isn't a record is skipped to the next ``WARC/`` line and reported as one row with an error."""
    offset, lost = 0, None
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.startswith(b"WARC/"):
            if line.strip() and lost is None:
                lost = at
            continue
        if lost is not None:
            yield lost, None, None, None, f"{at - lost} bytes without a record"
            lost = None
        fields = {"": line.strip().decode("latin-1")}
        while (line := stream.readline()).strip():
            offset += len(line)
            field, _, value = line.decode("utf-8", "replace").partition(":")
            fields[field.strip().lower()] = value.strip()
        offset += len(line)
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield at, fields, None, None, "no length"
            continue
        block = stream.read(int(length))
        offset += len(block)
        error = None if len(block) == int(length) else f"{int(length) - len(block)} bytes are missing"
        http = fields.get("content-type", "").startswith("application/http")
        head, payload = split_http(block) if http else (None, block)
        yield at, fields, head, payload, error
    if lost is not None:
        yield lost, None, None, None, f"{offset - lost} bytes without a record"


def _read(spark: SparkSession, path: str, records: Callable[[io.BufferedIOBase], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of all archives under a path, after each archive's own path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    types = pa.schema([(c.split()[0], _ARROW[c.split(None, 1)[1]]) for c in re.split(r", (?=\w+ \w)", schema)])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for r in records(_opened(content.as_py())):
                    rows.append((place, *r))
                    size += 200 + sum(len(x) for x in r if isinstance(x, bytes))
                    if size > BATCH_BYTES:
                        yield _batch(rows, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, types)

    return files.mapInArrow(parsed, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "map<string, string>": pa.map_(pa.string(), pa.string())}


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = []
    for values, field in zip(zip(*rows), types):
        values = [list(v.items()) if isinstance(v, dict) else v for v in values]
        columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=types)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC_ROWS of all archives under a path, packed or not: one row a record, version blocks and damaged parts included."""
    return _read(spark, path, arc_records, ARC_ROWS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_ROWS of all archives under a path, packed or not: one row a record, damaged parts included."""
    return _read(spark, path, warc_records, WARC_ROWS)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Pages (page_id, url, date of 14 digits, payload) as ARC archives, one a task, packed; versions take turns.

    The network documents are HTTP responses whose heads carry page_id. Spaces and controls in URLs are percent-encoded; a
    null URL or date is ``-``, a null page_id is left out, a null payload is empty. No pages: no records.
    """

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name, place = versions[part % len(versions)], f"pages-{part:05d}.arc", 0
        for batch in batches:
            out, size = [], 0
            for page, url, date, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if not place:
                    about = f"{version} 0 melodex\n{ARC_FIELDS[version]}\n".encode()
                    date0 = "20000101000000"
                    fields = f"text/plain {len(about)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(about)}"
                    out.append(f"filedesc://{name} 0.0.0.0 {date0} {fields}\n".encode() + about)
                    place += len(out[-1]) + 1
                payload = payload or b""
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head = (head + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n").encode()
                line = f"{url} 0.0.0.0 {date or '-'} text/html"
                n = len(head) + len(payload)
                line += f" {n}\n" if version == 1 else f" 200 {md5(payload).hexdigest()} - {place} {name} {n}\n"
                out.append(line.encode() + head + payload)
                place += len(out[-1]) + 1
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = pages.select("page_id", F.col("url").cast("string"), F.col("date").cast("string"), "payload").mapInArrow(archived, "value binary")
    records.select(F.col("value").cast("string")).write.options(lineSep="\n", **PACKED).text(path)


def _uuid(*parts: Column) -> Column:
    """A record's identifier: the same whenever the same record is converted."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _iso(date: Column) -> Column:
    """An ARC date of 4 to 17 digits as WARC writes it; null where it is no date."""
    whole = F.concat(F.substring(date, 1, 14), F.substring(F.lit("00000101000000"), F.length(F.substring(date, 1, 14)) + 1, 14))
    return F.date_format(F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def described(records: DataFrame) -> DataFrame:
    """Records of ``read_arc`` with what WARC asks for: kind (warcinfo, response or resource), iso, digest (of the payload,
    bare hex), bytes, record_id and warcinfo_id. Rows without a record (damaged parts) go.

    A record without a valid date takes its archive's, or else the epoch. What isn't HTTP is a resource.
    """
    whole = records.where("url is not null or payload is not null")
    opening = F.coalesce(F.col("url").startswith("filedesc:"), F.lit(False))
    info = _uuid(F.lit("warcinfo"), F.col("file"), F.col("archive"), F.col("archive_date"))
    told = whole.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    return told.select(
        "*",
        F.when(opening, "warcinfo").when(F.col("head").isNotNull(), "response").otherwise("resource").alias("kind"),
        F.coalesce(_iso(F.col("date")), _iso(F.col("archive_date")), F.lit("1970-01-01T00:00:00Z")).alias("iso"),
        F.when(opening, info).otherwise(_uuid(F.col("file"), F.col("offset"), F.col("url"), F.col("date"), F.col("digest"))).alias("record_id"),
        info.alias("warcinfo_id"),
    )


def revisits(index: DataFrame, *order: str, least: int = LEAST_BYTES) -> DataFrame:
    """file, offset, and the other_id, other_url and other_iso that a record revisits, for each that does.

    ``index`` is written and holds file, offset, kind, bytes, digest, record_id, url, iso and the columns ``order``. Of
    responses or resources with one digest and ``least`` bytes or more, the first by ``order`` (nulls last), then file
    and offset, is kept. Digests of many records are dealt over tasks.
    """
    kinds = index.where(F.col("kind").isin("response", "resource") & (F.col("bytes") >= least)).withColumn("key", F.concat("kind", F.lit(" "), "digest"))
    by = [x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = F.min(F.struct(*by, "file", "offset", "record_id", "url", "iso")).alias("first")
    groups = written(kinds.groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1"))
    found = spread_join(kinds.select("key", "file", "offset"), groups, "key", index.count(), "file", "offset")
    others = found.where((F.col("file") != F.col("first.file")) | (F.col("offset") != F.col("first.offset")))
    return others.select("file", "offset", F.col("first.record_id").alias("other_id"), F.col("first.url").alias("other_url"), F.col("first.iso").alias("other_iso"))


def write_warc(records: DataFrame, path: str) -> None:
    """Records of ``described``, with other_id, other_url and other_iso where they are revisits, as WARC archives, packed.

    A revisit keeps its HTTP head and leaves its payload out. Each record names the warcinfo record of its archive.
    """
    revisit = F.col("other_id").isNotNull()
    http = F.col("head").isNotNull()
    block = F.when(revisit, F.coalesce("head", F.lit(b""))).when(http, F.concat("head", "payload")).otherwise(F.col("payload"))
    # A field's value ends with its line.
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]", " "), F.lit("\r\n")), F.lit(""))
    info = F.col("kind") == "warcinfo"
    mime = F.when(info, "text/plain").when(http, "application/http; msgtype=response").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))
    told = records.withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("iso")),
        field("WARC-Target-URI", F.when(~info, F.col("url"))),
        field("WARC-IP-Address", F.when(~info, F.col("ip"))),
        field("WARC-Filename", F.when(info, F.col("archive"))),
        field("WARC-Warcinfo-ID", F.when(~info, F.col("warcinfo_id"))),
        field("WARC-Profile", F.when(revisit, REVISIT)),
        field("WARC-Refers-To", F.col("other_id")),
        field("WARC-Refers-To-Target-URI", F.col("other_url")),
        field("WARC-Refers-To-Date", F.col("other_iso")),
        field("WARC-Truncated", F.when(F.col("error").endswith("missing"), "unspecified")),
        field("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha256:"), "digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        field("Content-Type", mime),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    value = F.concat(head.cast("binary"), F.col("block")).cast("string")
    told.select(value.alias("value")).write.options(lineSep="\r\n\r\n", **PACKED).text(path)


def convert(spark: SparkSession, arc: str, warc: str, *order: str, found: Callable[[DataFrame], DataFrame] = lambda d: d, least: int = LEAST_BYTES) -> None:
    """Legacy archives under ``arc`` as WARC archives under ``warc``, equal payloads as revisits of one response.

    ``found`` may add columns, which ``order`` then names, to choose that one by; otherwise it is the first in its archive.
    """
    index = written(found(described(read_arc(spark, arc))).select("file", "offset", "kind", "bytes", "digest", "record_id", "url", "iso", *order))
    others = written(revisits(index, *order, least=least))
    # Only what the archives say is shuffled; what follows from it is made again.
    write_warc(described(read_arc(spark, arc).join(others.hint("merge"), ["file", "offset"], "left")), warc)


def resolved(records: DataFrame, *about: str) -> DataFrame:
    """Records of ``read_warc`` but for warcinfo and damaged parts: record_type, record_id, url, payload_bytes and
    payload_digest of the full payload, intact (does the payload have the digest that its record says?), the columns
    ``about``, and ``other_`` followed by their names: those of the response that a revisit refers to.

    Revisits take bytes and digest from that response, dealt over tasks where many refer to one; without it, nulls.
    """
    f = lambda name: F.col("fields")[name]
    digest = F.sha2("payload", 256)
    rows = records.where(F.col("fields").isNotNull() & (f("warc-type") != "warcinfo"))
    kind = f("warc-type")
    told = written(
        rows.select(
            kind.alias("record_type"), f("warc-record-id").alias("record_id"), f("warc-target-uri").alias("url"), f("warc-refers-to").alias("key"), *about,
            F.when(kind != "revisit", F.octet_length("payload").cast("long")).alias("payload_bytes"),
            F.when(kind != "revisit", digest).alias("payload_digest"),
            F.regexp_replace(f("warc-payload-digest"), "^sha256:", "").alias("said"),
        )
    )
    whole, others = told.where("record_type <> 'revisit'"), told.where("record_type = 'revisit'")
    wanted = others.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    cited = whole.select(F.col("record_id").alias("key"), "payload_bytes", "payload_digest", *[F.col(c).alias(f"other_{c}") for c in about])
    # An identifier that two records bear by mistake counts once.
    one = written(wanted.join(cited.hint("merge"), "key").groupBy("key", "n").agg(F.min(F.struct("payload_bytes", "payload_digest", *[f"other_{c}" for c in about])).alias("of")).select("key", "n", "of.*"))
    bare = others.drop("payload_bytes", "payload_digest")
    joined = spread_join(bare.where("key is not null"), one, "key", told.count(), "record_id")
    alone = bare.where("key is null").unionByName(bare.where("key is not null").join(one.hint("merge"), "key", "left_anti"))
    out = whole.unionByName(joined, allowMissingColumns=True).unionByName(alone, allowMissingColumns=True)
    return out.select("record_type", "record_id", "url", "payload_bytes", "payload_digest", (F.col("payload_digest") == F.col("said")).alias("intact"), *about, *[f"other_{c}" for c in about])


def page_id() -> Column:
    """The page's number that ``write_arc`` put into the HTTP head."""
    return F.regexp_extract(F.col("head").cast("string"), r"\nX-Page-Id: (-?\d+)\r\n", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id, for revisits) and intact of
    every page (page_id, url, html), out of WARC archives that were converted from ARC archives of the pages.

    Null htmls are empty payloads. Null page_ids rank last when a response is chosen, and rows that repeat a page_id are
    records of their own: one of them is the response. Null URLs: records without one. No rows: none. Pages have no
    date; records are dated by their number. Other columns are not read.
    """
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    date = F.date_format(F.timestamp_seconds(F.lit(10**9) + F.pmod(F.col("page_id"), F.lit(10**8))), "yyyyMMddHHmmss")
    write_arc(pages.select("page_id", "url", date.alias("date"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")), f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc", "page_id", found=lambda d: d.withColumn("page_id", page_id()))
    back = resolved(read_warc(spark, f"{base}/warc").withColumn("page_id", page_id()), "page_id")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("other_page_id").alias("refers_to"), "intact")
