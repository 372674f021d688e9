"""WARC archives: writing captures as transactions and assembling them again.

A capture is three records: the response (or a revisit of an earlier equal payload), the request and a metadata
record; the latter two name the first in WARC-Concurrent-To.  Archives are plain WARC/1.1 files, written by Spark's
own text sink and committer into a folder all machines share, so a lost executor leaves no half archive.

Reading parses records by Content-Length and joins the three kinds on the concurrent-to identifier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, guarded_broadcast, scratch_path

#: Payloads of at least so many bytes are stored once.
LEAST_BYTES = 0
#: Captures in one archive file at most, and bytes beyond which payloads go to files of their size.
PER_FILE, LARGE = 1000, 32 << 10
#: Fixed by the format: base32's alphabet, the record separator.
BASE32, BETWEEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "\r\n\r\n"
#: Sorts a null page_id first.
NO_PAGE = -(2**63)
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 of a payload's SHA-1."""
    digest = F.sha1(payload)
    out = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def _record_id(kind: str) -> Column:
    """A capture's record id: the same whenever the same capture is written."""
    none = F.lit("\x00")
    page = F.coalesce(F.col("page_id").cast("string"), none)
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), page, F.coalesce("url", none), "digest", F.col("nth").cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, size and, for revisits, refers_page and refers_id.

    Of equal payloads of at least least_bytes, the one with the largest page_id (then url) is the response.
    A null html is an empty payload.  Rows repeated in all three columns are captures of their own, told apart by nth.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    own = own.withColumn("nth", F.lit(1))
    own = own.withColumn("id", _record_id("response"))
    key = F.struct(F.coalesce("page_id", F.lit(NO_PAGE)).alias("p"), F.coalesce("url", F.lit("")).alias("u"), "id")
    groups = own.groupBy("digest").agg(F.max(key).alias("top"), F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    # Payloads of a single capture need no join.
    several = durable(
        groups.where("n > 1").select(
            "digest", "size", F.col("top.id").alias("refers_id"), F.nullif("top.p", F.lit(NO_PAGE)).alias("refers_page")
        ),
        "payloads",
    )
    alike = own.join(guarded_broadcast(several.select("digest")), "digest", "left_semi")
    repeated = durable(alike.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if not repeated.isEmpty():
        # One row of each stands for all and is copied; the first keeps its id.
        several_ids = guarded_broadcast(repeated.select("id"))
        rows = own.join(several_ids, "id", "left_semi").groupBy("page_id", "url", "payload", "digest").agg(F.count("*").alias("n"))
        rows = rows.select("page_id", "url", "payload", "digest", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
        rows = rows.repartition("digest", "nth").withColumn("id", _record_id("response"))
        own = own.join(several_ids, "id", "left_anti").unionByName(rows)
    several = several.where(F.col("size") >= least_bytes).drop("size")
    joined = own.join(several, "digest", "left")
    other = (F.col("refers_id") != F.col("id")) & (F.octet_length("payload") >= least_bytes)
    return joined.withColumns(
        {
            "refers_id": F.when(other, F.col("refers_id")),
            "refers_page": F.when(other, F.col("refers_page")),
            "size": F.octet_length("payload").cast("long"),
        }
    )


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as text, without what separates it from the next; a null field is left out."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """pages' captures as WARC files at path."""
    found = captures(pages, least_bytes)
    # Line breaks can't stand in a header line.
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    revisit = F.col("refers_id").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    main = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.col("id")),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.col("refers_id")),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", _record_id("request")),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", F.col("id")),
            ("Content-Type", "application/http; msgtype=request"),
        ],
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    note = F.concat_ws(
        "\r\n",
        F.concat(F.lit("pageId: "), F.col("page_id").cast("string")),
        F.concat(F.lit("refersToPageId: "), F.col("refers_page").cast("string")),
        F.lit(""),
    )
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", _record_id("metadata")),
            ("WARC-Date", DATE),
            ("WARC-Concurrent-To", F.col("id")),
            ("Content-Type", "application/warc-fields"),
        ],
        note,
    )
    # A file is read as a whole.  Payloads of up to 2^k times LARGE are dealt to 2^k files, so that these stay small.
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("size"), F.lit(1)) / LARGE))).cast("int")
    shelf = F.concat_ws("-", power, F.pmod(F.xxhash64("id"), F.pow(F.lit(2), power).cast("long")))
    whole = found.select(F.concat_ws(BETWEEN, request, main, metadata).alias("value"), shelf.alias("shelf"))
    large = pages.select(F.max(F.octet_length(F.col("html").cast("string"))).alias("n")).first()["n"] or 0
    out = whole.drop("shelf").write if large <= LARGE else whole.write.partitionBy("shelf")
    out.option("lineSep", BETWEEN).option("maxRecordsPerFile", PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive; names are lower-cased."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, data[start:stop]
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, size long"


def read_records(spark, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives at path: RECORD, fields (of a metadata record) and, if asked, the payload.

    digest and size are of the full payload: taken from the bytes of a response, which must agree with its header,
    and from the headers of a revisit.
    """
    schema = RECORD + ", fields map<string,string>" + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in RECORD.split(", ")] + ["fields"] + ["payload"] * payloads

    def rows(data: bytes) -> Iterator[tuple]:
        for head, block in parse(data):
            kind, digest, size, fields, payload = head["warc-type"], None, None, {}, None
            if kind in ("response", "revisit"):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "response":
                    size = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
                else:
                    size = next((int(x[15:]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")), None)
                    payload = None
            elif kind == "metadata":
                pairs = (x.partition(": ") for x in block.decode("utf-8", "replace").split("\r\n") if x)
                fields = {a: b for a, _, b in pairs}
            row = (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"))
            row += (head.get("warc-target-uri"), digest, size, list(fields.items()))
            yield row + (payload,) * payloads

    types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        for archives in batches:
            for data in archives.column(0):
                found = []
                for row in rows(data.as_py()):
                    found.append(row)
                    if len(found) == 1000:
                        yield batch(found)
                        found = []
                yield batch(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response, request and metadata, each a record, the latter two null if missing.

    A capture is a response or revisit.  A request or metadata record belongs to the capture it names in
    concurrent-to, or to the one that names it, or, for metadata, to the capture of the request it names; records
    that find none are left out.  A record repeated whole is one record; of several requests or metadata records
    of one capture the one with the smallest id counts.
    """
    heads = records.where(F.col("type").isin("response", "revisit"))
    named = heads.where("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("id"))
    named = named.agg(F.min("id").alias("named_by"))
    others = records.where(F.col("type").isin("request", "metadata")).join(named, "id", "left")
    direct = F.coalesce("named_by", "concurrent_to")
    requests = others.where("type = 'request'").groupBy(F.col("id").alias("concurrent_to")).agg(F.min(direct).alias("via"))
    others = others.join(requests, "concurrent_to", "left")
    body = F.struct(*records.columns).alias("r")
    members = others.select(F.coalesce("named_by", "via", "concurrent_to").alias("capture_id"), "type", body)
    members = members.union(heads.select(F.col("id").alias("capture_id"), "type", body))

    def of(*kinds: str) -> Column:
        return F.min_by("r", F.when(F.col("type").isin(*kinds), F.col("r.id")))

    grouped = members.groupBy("capture_id").agg(
        of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata")
    )
    return grouped.where("response IS NOT NULL")


def transactions(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages written as archives in the shared folder, read back and assembled.

    A null html is an empty payload, a null url an empty target, a null page_id leaves its field out.  Rows repeated
    in all three columns are captures of their own; other columns are not read; an empty table has none.  A payload is
    written and read whole, so one of 2 GB or more can't be.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return assemble(durable(read_records(pages.sparkSession, path), "records"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what the archives hold of every page."""
    found = transactions(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(
        F.col("metadata.fields")["pageId"].cast("long").alias("page_id"),
        F.col("response.size").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.fields")["refersToPageId"].cast("long").alias("refers_to"),
    )
