"""WARC archives: written from pages, read back, and assembled into captures.

Writing makes three records for each page: the response (or a revisit of an
equal payload's response), its request and a metadata record, the last two with
the response's id in WARC-Concurrent-To. Spark's own writer stores them: a row
is the text of a capture's records, and the line separator is the two line ends
that close a WARC record. Files hold CAPTURES_PER_FILE pages of up to SMALL_PAGE
bytes; larger pages are written by classes of size with as many fewer to a file, so
that a reader's task holds about FILE_BYTES at a time. A file is one gzip member.

Reading goes by Content-Length through each file. Assembly joins records through
their concurrent-to identifiers: a group has the records of one capture, never
more, and gives one nested row. Of several requests (or metadata records) of a
capture the one with the least id stands in `request`, the rest in `others`; of
several WARC-Concurrent-To headers of a record the first counts.

Which payloads repeat is found on (page_id, digest, length) only; groups are
reduced to their largest page_id before anything is joined. The list of revisits
is checkpointed and counted: up to BROADCAST_BYTES it goes to every task and no
payload moves; beyond that pages meet it by page_id.

Defined cases: null html is an empty payload; payloads under MIN_REVISIT bytes
are all responses; a null page_id counts as smaller than any other and stays
null; rows equal in page_id and payload are captures of their own, all responses
if theirs is the largest page_id; null urls have no target header, and white
space and control characters in urls are percent-encoded; empty tables give
empty archives; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import cut, shared_path, ship

MIN_REVISIT, CAPTURES_PER_FILE, SMALL_PAGE = 1000, 2000, 1 << 17
FILE_BYTES = CAPTURES_PER_FILE * SMALL_PAGE
REVISIT_BYTES, BROADCAST_BYTES = 96, 16 << 20
LINE, END = "\r\n", "\r\n\r\n"
RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, page_id long, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat_ws(LINE, *(F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in pairs))


def _id(kind: str) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", F.col("row").cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, content_type: str, *more: tuple[str, Column]) -> Column:
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", record_id), *more, ("Content-Type", content_type), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1" + LINE), head, F.lit(END), block)


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest, refers_to, refers_url of the rows whose payload a row with a larger page_id has as well."""
    narrow = pages.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    largest = F.max(F.struct("page_id", "url")).alias("largest")
    groups = narrow.groupBy("digest", "n").agg(largest, F.count("*").alias("rows")).where("rows > 1 AND largest.page_id IS NOT NULL")
    found = narrow.drop("url").join(groups, ["digest", "n"]).where("page_id IS NULL OR page_id < largest.page_id")
    return found.select("page_id", "digest", F.col("largest.page_id").alias("refers_to"), F.col("largest.url").alias("refers_url")).distinct()


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = MIN_REVISIT, compression: str = "gzip") -> None:
    """Writes pages(page_id, url, html) as archives under path."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    classes = [r[0] for r in rows.select(_size_class(F.octet_length("payload"))).distinct().collect()]  # 8 at the most
    again = cut(revisits(rows, least).withColumnsRenamed({"page_id": "page_id_", "digest": "digest_"}))
    size = again.agg(F.sum(F.coalesce(F.octet_length("refers_url"), F.lit(0)) + REVISIT_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # then payloads stay where they are
        again = F.broadcast(again)
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(again, rows.page_id.eqNullSafe(again.page_id_) & (rows.digest == again.digest_), "left")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    uri, refers_uri = _uri("url"), _uri("refers_url")
    repeat = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    main, common = _id("main"), [("WARC-Date", date), ("WARC-Target-URI", uri)]
    response = _record(
        F.when(repeat, "revisit").otherwise("response"), main, F.concat(http, F.when(repeat, "").otherwise(F.col("payload"))), "application/http; msgtype=response", *common,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("X-Page-ID", F.col("page_id").cast("string")), ("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        ("WARC-Refers-To-Target-URI", F.when(repeat, refers_uri)), ("WARC-Refers-To-Date", F.when(repeat, date)),
        ("WARC-Profile", F.when(repeat, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(uri, r"^[^:/]*://[^/?#]*|#.*$", ""), F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{END}"))
    request = _record("request", _id("request"), ask, "application/http; msgtype=request", *common, ("WARC-Concurrent-To", main))
    meta = _record("metadata", _id("metadata"), F.concat(F.lit("payload-length: "), F.octet_length("payload").cast("string"), F.lit(LINE)), "application/warc-fields", *common, ("WARC-Concurrent-To", main))
    text = rows.select(F.concat_ws(END, response, request, meta).alias("value"), _size_class(F.octet_length("payload")).alias("class"))
    for n, k in enumerate(sorted(classes) or [0]):
        some = text.where(F.col("class") == k).select("value")
        some.write.mode("append" if n else "error").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", max(1, CAPTURES_PER_FILE >> 2 * k)).text(path)


def _size_class(size: Column) -> Column:
    """0 up to SMALL_PAGE bytes, 1 up to four times as many, and so on."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / F.lit(SMALL_PAGE)) / 2)).cast("int")


def _uri(name: str) -> Column:
    """White space and control characters percent-encoded."""
    uri = F.col(name)
    for c in [*range(1, 33), 127]:
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return uri


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an archive, plain or gzip; raises ValueError on anything else."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        head = data[at:stop].decode("utf-8").split(LINE) if stop >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict[str, str] = {}
        for k, _, v in (line.partition(":") for line in head[1:]):
            fields.setdefault(k.strip().lower(), v.strip())
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if len(block) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        at += 4
        yield fields, block


def _row(fields: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind, body, size, digest = fields["warc-type"], None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(body), hashlib.sha1(body).hexdigest()
            if (said := fields.get("warc-payload-digest")) and said != f"sha1:{digest}":
                raise ValueError(f"record {fields['warc-record-id']} has another payload than its digest says")
        else:
            size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
            digest, body = fields["warc-payload-digest"].partition(":")[2], None
    number = lambda name: int(fields[name]) if name in fields else None
    return (
        fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
        number("x-page-id"), number("x-refers-to-page-id"), digest, size, (block if body is None and kind not in ("response", "revisit") else body) if payload else None,
    )


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under path; a response's payload without its HTTP header, other records' whole block."""
    ship(spark)
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for fields, block in parse(batch.column(0)[k].as_py()):
                    rows.append(_row(fields, block, payload))
                    size += len(block) * payload
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One row for each capture: its id, the structs response (or revisit), request and metadata, null where there is none, and others, a list of further records by type and id."""
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    kept = records.where(main | F.col("type").isin("request", "metadata"))
    keyed = kept.select(key.alias("capture_id"), F.struct(F.when(main, F.lit("response")).otherwise(F.col("type")).alias("kind"), "record_id", F.struct(*records.columns).alias("record")).alias("r"))
    # the records of one capture; their order is told by kind and id alone, so records need not be comparable
    lists = keyed.groupBy("capture_id").agg(F.collect_list("r").alias("all"))
    rank = lambda r: F.struct(r["kind"], r["record_id"])
    less = lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)
    lists = lists.withColumn("all", F.array_sort("all", less))
    of = lambda k: F.get(F.filter("all", lambda r: r["kind"] == k), F.lit(0))["record"].alias(k)
    others = F.transform(F.filter("all", lambda r, i: (i > 0) & (F.get("all", i - 1)["kind"] == r["kind"])), lambda r: r["record"])
    return lists.select("capture_id", *map(of, ("response", "request", "metadata")), others.alias("others"))


def round_trip(pages: DataFrame, path: str | None = None, payload: bool = False) -> DataFrame:
    """Writes pages to archives (a fresh shared folder unless path is given), reads them back and assembles the captures."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path)
    return captures(read(spark, path, payload))
