"""WARC archives written and read by Spark, and the assembly of capture transactions.

Each page gives three records: a request, a response (or a revisit, where an earlier record has the same
payload) and a metadata record. Request and metadata name the response's or revisit's record id in
WARC-Concurrent-To. A record is one value of Spark's text writer with the record end as line separator,
so the files are plain concatenated WARC records, written and committed like any other output. A file is read
back as one value, so its size is bounded: it holds at most RECORDS_A_FILE records with payloads of at most
LONG_PAYLOAD bytes, or the three records of one longer page.

Reading parses whole files by Content-Length. `assemble` joins request and metadata to the response
through Concurrent-To and gives one nested row for each capture; a revisit's payload is resolved by a join
through WARC-Refers-To.

Defined cases: null html is an empty payload; payloads under MIN_REVISIT bytes never become revisits; of
equal payloads all rows of the smallest page_id are responses, whatever their urls, and revisits refer to the first of them by
url; rows that repeat a page_id get a capture each; equal rows get a capture each too, told apart by an occurrence number;
a null page_id sorts first; an empty table gives no captures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm.common import join_small, keyed, scratch, unkeyed, written

MIN_REVISIT = 100
RECORDS_A_FILE, LONG_PAYLOAD = 600, 256 << 10
END = "\r\n\r\n"
#: The date of records whose page has none: the archives depend on nothing but the pages.
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(kind: str, *cols: Column) -> Column:
    """A record id that follows from the page, so a task that runs again writes the same bytes."""
    h = F.md5(F.concat_ws("\u0001", F.lit(kind), *[c.cast("string") for c in cols]))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(h, F.lit("")) for h in head], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def archive_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Payload facts and the revisit decision for each page row."""
    clean = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20]", "%20")
    p = pages.select(keyed(id_col).alias("_id"), clean.alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"))
    p = p.withColumn("_digest", F.sha2("_html", 256)).withColumn("_bytes", F.octet_length("_html").cast("long"))
    at, key = F.struct("_id", "_url"), ["_id", "_url", "_digest"]
    names = written(p.select(*key, "_bytes"), "warc-names")
    long = names.where(F.col("_bytes") >= MIN_REVISIT).drop("_bytes")
    first = long.groupBy("_digest").agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = long.join(first, "_digest").where(F.col("_id") != F.col("_first._id")).distinct()
    repeats = written(names.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), "warc-repeats")
    # payloads stay where they are read: only the names of copies and of equal rows travel, if they are few enough
    p = join_small(p, written(copies.join(repeats, key, "full"), "warc-copies"), key, "left")
    one = p.where("_n IS NULL").drop("_n").withColumn("_copy", F.lit(None).cast("long"))
    if not repeats.isEmpty():
        # equal rows are folded to one and unfolded again, a number each; the first has none
        fold = p.where("_n IS NOT NULL").groupBy(*key).agg(*[F.first(c).alias(c) for c in ("_html", "_bytes", "_first", "_n")])
        part = fold.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / RECORDS_A_FILE)))).repartition(*key, "_part")
        low = F.col("_part") * RECORDS_A_FILE
        many = part.withColumn("_copy", F.explode(F.sequence(low, F.least(low + RECORDS_A_FILE, F.col("_n")) - 1)))
        one = one.unionByName(many.drop("_part", "_n").withColumn("_copy", F.when(F.col("_copy") > 0, F.col("_copy"))))
    return one.withColumn("_revisit", F.col("_first").isNotNull())


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes the records of pages under path."""
    p = archive_plan(pages, id_col, url_col, html_col)
    p = p.withColumn("_rid", _uuid("response", F.col("_id"), F.col("_url"), F.col("_digest"), F.col("_copy")))
    first_rid = _uuid("response", F.col("_first._id"), F.col("_first._url"), F.col("_digest"))
    common = lambda kind: [("WARC-Type", kind), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.nullif(F.col("_url"), F.lit("")))]
    rid = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    response = _record([*common(F.when(F.col("_revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", rid(F.col("_rid"))), digest,
                        ("WARC-Profile", F.when(F.col("_revisit"), F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", F.when(F.col("_revisit"), rid(first_rid))),
                        ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(head, F.when(F.col("_revisit"), F.lit("")).otherwise(F.col("_html"))))
    request = _record([*common(F.lit("request")), ("WARC-Record-ID", rid(_uuid("request", F.col("_rid")))), ("WARC-Concurrent-To", rid(F.col("_rid"))),
                       ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce(F.nullif(F.col("_url"), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1" + END)))
    metadata = _record([*common(F.lit("metadata")), ("WARC-Record-ID", rid(_uuid("metadata", F.col("_rid")))), ("WARC-Concurrent-To", rid(F.col("_rid"))),
                        ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), F.coalesce(unkeyed("_id").cast("string"), F.lit("")), F.lit("\r\n")))
    long = F.col("_bytes") > LONG_PAYLOAD
    parts = [("pages", p.where(~long), RECORDS_A_FILE)]
    if not pages.where(F.octet_length(html_col) > LONG_PAYLOAD).isEmpty():
        parts.append(("long", p.where(long), 3))
    for name, part, most in parts:
        records = part.select(F.explode(F.array(response, request, metadata)).alias("value"))
        records.write.option("lineSep", END).option("maxRecordsPerFile", most).text(f"{path}/{name}")
    return path


RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, uri string, declared_digest string, page_id long, block_ok boolean, payload_bytes long, payload_digest string, payload binary"


def parse_file(data: bytes) -> Iterator[dict]:
    """The records of one uncompressed WARC file. Raises ValueError where a record is broken."""
    at, n = 0, len(data)
    while at < n:
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record header at byte {at}")
        fields = {}
        for line in data[at:cut].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        start = cut + 4
        end = start + int(fields[b"content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        block, kind = data[start:end], fields.get(b"warc-type")
        payload, page = None, None
        if kind == "response":
            payload = block[block.find(b"\r\n\r\n") + 4 :]
        elif kind == "metadata":
            said = dict(x.split(b": ", 1) for x in block.split(b"\r\n") if b": " in x)
            page = int(said[b"page-id"]) if said.get(b"page-id") else None
        digest = hashlib.sha256(payload).hexdigest() if payload is not None else None
        declared = fields.get(b"warc-payload-digest", "").removeprefix("sha256:") or None
        bare = lambda k: fields[k].strip("<>") if k in fields else None  # noqa: B023, E731
        yield {"record_id": bare(b"warc-record-id"), "type": kind, "concurrent_to": bare(b"warc-concurrent-to"), "refers_to": bare(b"warc-refers-to"), "uri": fields.get(b"warc-target-uri"), "declared_digest": declared,
               "page_id": page, "block_ok": digest is None or digest == declared, "payload_bytes": None if payload is None else len(payload), "payload_digest": digest, "payload": payload}
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path. Files are dealt out by Spark; a task parses one at a time."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("declared_digest", pa.string()),
                        ("page_id", pa.int64()), ("block_ok", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def parse(batches):
        for b in batches:
            for data in b.column(0):
                rows = list(parse_file(data.as_py()))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").options(pathGlobFilter="part-*", recursiveFileLookup=True).load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: record_id, page_id, structs request, response and metadata, whether it is a
    revisit, and the payload's facts, for revisits those of the record that it refers to."""
    main = records.where(F.col("type").isin("response", "revisit"))
    side = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "uri", "page_id").alias(kind))
    captures = main.select("record_id", F.struct("type", "uri", "refers_to", "declared_digest", "block_ok", "payload_bytes", "payload_digest", "payload").alias("response"))
    captures = captures.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    named = captures.select("record_id", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")
    of = named.where("response.type = 'response'").select(F.col("record_id").alias("_to"), F.struct(F.col("page_id"), F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("digest")).alias("original"))
    return named.join(of, F.col("response.refers_to") == F.col("_to"), "left").drop("_to")


def capture_facts(pages: DataFrame) -> DataFrame:
    """Writes the archives of pages, reads them back, assembles the captures, and gives the facts of each."""
    spark = pages.sparkSession
    path = write_archives(pages, scratch(spark, "warc"))
    c = assemble(written(read_archives(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "warc-records"))
    return c.select(
        "page_id",
        F.coalesce("response.payload_bytes", "original.bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", F.col("original.page_id")).alias("refers_to"),
        (F.col("response.block_ok") & (F.coalesce("response.payload_digest", "original.digest") == F.col("response.declared_digest"))).alias("verified"),
        F.col("request").isNotNull().alias("has_request"),
    )


__all__ = ["archive_plan", "assemble", "capture_facts", "parse_file", "read_archives", "write_archives"]
