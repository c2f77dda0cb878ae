"""WARC archives with revisit records for repeated payloads.

Headers (digest, size, page id) are shuffled by digest: the smallest page id of each digest is found by a pre-aggregated
minimum, so a digest that a third of all pages share costs one row per task. The list of revisits is broadcast to the
pages, which stay where they are, if its measured size allows (``BROADCAST_BYTES``); beyond that pages are shuffled once
with it, by page id. Archives are written and read
by Spark's text source with the record end as line separator; a reader puts records together by their Content-Length, so
payloads may hold anything, and only one record is in memory at a time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import BROADCAST_BYTES, scratch_path, table, written

#: Payloads below this many bytes are always stored.
LEAST_PAYLOAD = 100
#: Ends a record, and its header block.
RECORD_END = "\r\n\r\n"
#: Records in an archive file at most.
FILE_RECORDS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolve(pages: DataFrame, least_payload: int = LEAST_PAYLOAD, bound: int | None = None) -> DataFrame:
    """Headers of all pages: page_id, url, payload_bytes, payload_digest, record_type, refers_to, with the payload ``html``.

    Of equal payloads of at least ``least_payload`` bytes, the smallest non-null page_id is the response and rows with
    another id revisit it. Rows without a page_id are responses, since nothing can name them; repeated rows with the
    smallest id are all responses. Null html is the empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    heads = pages.select("page_id", "payload_bytes", "payload_digest").where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_payload))
    # Only digests of several pages need a join.
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("latest")).where("original < latest").drop("latest")
    first = written(first, "repeated-digests")  # so that adaptive execution can split a frequent digest in the join
    moved = heads.join(first, "payload_digest").where("page_id > original").groupBy("page_id", "payload_digest").agg(F.max("original").alias("original"))
    moved = written(moved.withColumnsRenamed({"page_id": "_id", "payload_digest": "_digest"}), "revisits")
    bound = BROADCAST_BYTES if bound is None else bound
    moved = F.broadcast(moved) if moved.count() * 160 <= bound else moved.hint("shuffle_hash")
    found = pages.join(moved, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    kind = F.when(F.col("original").isNull(), "response").otherwise("revisit")
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("original").alias("refers_to"))


def record_id(page_id: Column, digest: Column) -> Column:
    """A name-based UUID from the page id and the digest."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(resolved: DataFrame, date: str = "1970-01-01T00:00:00Z") -> Column:
    """The text of each record, without its end. Headers are fresh; a revisit has the HTTP head as its block only."""
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:page:unknown")), r"[\x00-\x20\x7f]", "%20")
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP_HEAD), F.col("html"))).otherwise(F.lit(HTTP_HEAD))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), block)


def write_archives(pages: DataFrame, path: str, least_payload: int = LEAST_PAYLOAD, bound: int | None = None) -> None:
    """Writes gzipped archives to the folder ``path``, one record for each page, repeated payloads as revisits."""
    found = resolve(pages, least_payload, bound)
    found.select(records(found).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def whole_files(spark: SparkSession) -> SparkSession:
    """A session that reads each file in one task, as a record can't be told from the middle of an archive. The text is still
    streamed, so a task holds a batch of lines and not the file."""
    session = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        session.conf.set(name, str(1 << 60))
    return session


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``, compressed or not: their headers (lower-case names) and block, from any writer
    that ends records as the standard says. A file is one task's work. Broken records end the file's reading with an error."""
    pieces = whole_files(spark).read.option("lineSep", RECORD_END).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def assemble(batches):
        end = RECORD_END.encode()
        file, head, block, left = None, None, [], 0
        for batch in batches:
            heads, blocks = [], []
            for piece, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                piece = piece.as_py()
                if name != file:
                    if head is not None:
                        raise ValueError(f"the last record of {file} is cut short")
                    file = name
                if head is not None and block and left < len(end):
                    # This separator straddles the block's end; what is left of it begins the record's end.
                    rest = end[left:] + piece
                    if not rest.startswith(end):
                        raise ValueError(f"a record of {file} is longer than its Content-Length")
                    heads.append(list(head.items()))
                    blocks.append(b"".join([*block, end[:left]]))
                    head, piece = None, rest[len(end) :]
                if head is None:
                    if not piece.strip():
                        continue
                    head = _headers(piece)
                    left, block = int(head["content-length"]), []
                    if left == 0:
                        # An empty block adds nothing between the header's end and the record's end.
                        heads.append(list(head.items()))
                        blocks.append(b"")
                        head = None
                    continue
                # A separator inside the block belongs to it.
                if block:
                    block.append(end)
                    left -= len(end)
                block.append(piece)
                left -= len(piece)
                if left == 0:
                    heads.append(list(head.items()))
                    blocks.append(b"".join(block))
                    head = None
                elif left < 0:
                    raise ValueError(f"a record of {file} is longer than its Content-Length")
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["headers", "block"])
        if head is not None:
            raise ValueError(f"the last record of {file} is cut short")

    return pieces.mapInArrow(assemble, "headers map<string,string>, block binary")


def _headers(piece: bytes) -> dict[str, str]:
    version, *lines = piece.decode().lstrip("\r\n").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", version):
        raise ValueError(f"no WARC record begins with {version[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of archives that ``write_archives`` made: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. Sizes and digests are taken from the stored payloads; a revisit gets those of the response
    that it names, found by a join on record ids."""
    found = read_archives(spark, path)

    def digest(batches):
        for batch in batches:
            bodies = [block.as_py().partition(b"\r\n\r\n")[2] for block in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies])], ["headers", "payload_bytes", "payload_digest"])

    rows = found.mapInArrow(digest, "headers map<string,string>, payload_bytes long, payload_digest string")
    head = lambda name: F.col("headers")[name]
    rows = rows.select(head("x-page-id").cast("long").alias("page_id"), head("warc-target-uri").alias("url"), head("warc-type").alias("record_type"), head("warc-record-id").alias("id"), head("warc-refers-to").alias("to"), "payload_bytes", "payload_digest")
    rows = written(rows, "warc-headers")
    named = rows.where("record_type = 'revisit'").select(F.col("to").alias("id")).distinct()
    originals = rows.where("record_type = 'response'").join(named, "id", "left_semi").groupBy(F.col("id").alias("to")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("digest"))
    originals = written(originals, "revisited")
    responses = rows.where("record_type = 'response'").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = rows.where("record_type = 'revisit'").join(originals, "to").select("page_id", "url", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 m AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS o FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND page_id > o THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND page_id > o THEN o END AS refers_to
FROM m
"""
