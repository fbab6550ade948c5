"""WARC archives with revisit records.

Pages are keyed by the SHA-1 of their payload.  Headers (page id, digest,
length) are shuffled by digest; of equal payloads the largest page id keeps
its payload as a ``response`` and the others become ``revisit`` records that
refer to it.  Records are written as WARC/1.1 through Spark's text writer,
whose line separator is the record separator, so that any store that Spark
writes to can hold the archives.  Reading streams the archives through Spark's
text reader, whatever their size, and joins revisits to the responses they
refer to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.llm.common import cut_lineage

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
FILE_BYTES = 64_000_000
DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32, without padding: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                for k in range(4)]
    return F.concat(*out)


def resolve_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html") -> DataFrame:
    """Pages with their digest and role: ``page_id url payload payload_bytes payload_digest record_type refers_to refers_url``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with
    the largest page id are responses and the others revisit it; smaller
    payloads are all responses.  A revisit's ``payload`` is null.

    Headers go through the shuffle by digest; of the payloads only one for
    each digest and task, kept by the partial aggregate, as that of the largest
    page id.  Pages without an id take their payload to the join: they are
    responses where no page with an id has the same one.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    table = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         payload.alias("payload"))
    table = (table.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
             .withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))))
    headers = cut_lineage(table.drop("payload"))
    large = F.col("payload_bytes") >= min_bytes
    same = ["payload_bytes", "payload_digest"]
    originals = cut_lineage(headers.where(large & F.col("page_id").isNotNull()).groupBy(*same)
                            .agg(F.max(F.struct("page_id", "url")).alias("original")))
    columns = ["page_id", "url", "payload", *same, "record_type", "refers_to", "refers_url"]

    def role(rows: DataFrame, revisit: bool) -> DataFrame:
        """The rows as responses, or as revisits of their ``original``."""
        added = {"record_type": F.lit("revisit" if revisit else "response"),
                 "refers_to": F.col("original.page_id") if revisit else F.lit(None).cast("long"),
                 "refers_url": F.col("original.url") if revisit else F.lit(None).cast("string")}
        if revisit:
            added["payload"] = F.lit(None).cast("string")
        return rows.withColumns(added).select(*columns)

    roles = headers.where(large).join(originals, same)
    revisits = role(roles.where(~F.col("page_id").eqNullSafe(F.col("original.page_id"))), True)
    # rows that repeat the id of an original are responses as well
    urls = (roles.where(F.col("page_id") == F.col("original.page_id")).groupBy(*same)
            .agg(F.collect_list("url").alias("urls"), F.count(F.lit(1)).alias("n")))
    kept = (table.where(large & F.col("page_id").isNotNull()).groupBy(*same)
            .agg(F.max("page_id").alias("page_id"), F.max_by("payload", "page_id").alias("payload"))
            .join(urls, same))
    nulls = F.array_repeat(F.lit(None).cast("string"), (F.col("n") - F.size("urls")).cast("int"))
    responses = role(kept.withColumn("url", F.explode(F.concat("urls", nulls))), False)
    small = role(table.where(~large), False)
    alone = role(table.where(large & F.col("page_id").isNull()).join(originals, same, "left_anti"), False)
    return responses.unionByName(revisits).unionByName(small).unionByName(alone)


def _uri(url: Column) -> Column:
    """A header value may not hold line ends."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def record_text(date: str = DATE) -> Column:
    """The WARC record of a row of :func:`resolve_roles`, without the line ends that close it."""
    def urn(page_id: Column) -> Column:
        return F.concat(F.lit(f"<{ID_PREFIX}"), page_id.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit(f"<{ID_PREFIX}>"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", urn(F.col("refers_to"))),
                                 _line("WARC-Refers-To-Target-URI", _uri(F.col("refers_url"))),
                                 _line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", size.cast("string")), F.lit(CRLF), http,
        F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row as gzipped WARC/1.1 files under ``path``.

    A file holds as many records as have ``file_bytes`` of payload on average
    at most.  A null payload is empty; a null url has no Target-URI; a null
    page id has an empty record id and is a revisit if a page with an id has
    the same payload, else a response.  Rows that repeat the id of a response,
    with the same payload, are responses too.  An empty table gives archives
    without a record.  Other columns of ``pages`` are not looked at.
    """
    row = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(payload_col).cast("string"))).alias("b")).first()
    per_file = max(1, int(file_bytes * row["n"] // max(row["b"] or 0, 1))) if row["n"] else 1
    (resolve_roles(pages, min_bytes, id_col, url_col, payload_col).select(record_text(date).alias("value"))
     .write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))


class RecordParser:
    """Cuts a stream of bytes into WARC records; holds one unfinished record at most."""

    def __init__(self):
        self.buffer = bytearray()
        self.headers: dict[str, str] = {}
        self.body = self.end = 0  # of the record in hand, once its headers are complete

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers by lower-case name, block) of each record that ``data`` completes."""
        self.buffer += data
        while True:
            if not self.end:
                while self.buffer[:2] == b"\r\n":  # empty lines between records, as at a file's end
                    del self.buffer[:2]
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0:
                    return
                first, *lines = bytes(self.buffer[:at]).split(b"\r\n")
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"not the start of a WARC record: {first[:80]!r}")
                parts = (x.partition(b":") for x in lines)
                self.headers = {n.strip().lower().decode(): v.strip().decode() for n, _, v in parts}
                self.body = at + 4
                self.end = self.body + int(self.headers["content-length"])
            if len(self.buffer) < self.end + 4:
                return
            if self.buffer[self.end:self.end + 4] != b"\r\n\r\n":
                raise ValueError(f"wrong length: record {self.headers.get('warc-record-id')}")
            yield self.headers, bytes(self.buffer[self.body:self.end])
            del self.buffer[:self.end + 4]
            self.end = 0

    def close(self) -> None:
        if self.end or self.buffer.strip(b"\r\n"):
            raise ValueError(f"cut off: record {self.headers.get('warc-record-id')}")


def _page_id(urn: str | None) -> int | None:
    digits = urn.strip("<>").removeprefix(ID_PREFIX) if urn else ""
    return int(digits) if digits else None


READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under ``path``: ``page_id url record_type refers_to payload_digest payload_bytes [payload]``.

    ``payload_digest`` and ``payload_bytes`` are those of the payload that was
    read, checked against the header; a revisit has its header's digest and no
    size (see :func:`resolve_revisits`).
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * with_payload

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        parser = RecordParser()
        for part in parts:
            for piece in part.column(0):
                for h, block in parser.feed(piece.as_py() + b"\r\n\r\n"):
                    payload, digest = None, h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2]
                        read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if read != digest:
                            raise ValueError(f"record {h['warc-record-id']}: digest {read}, header {digest}")
                    row = (_page_id(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"],
                           _page_id(h.get("warc-refers-to")), digest, None if payload is None else len(payload))
                    rows.append(row + ((payload,) if with_payload else ()))
                    held += len(payload or b"") * with_payload + 200
                    if held > 4_000_000:
                        yield batch()
                        held = 0
        parser.close()
        if rows:
            yield batch()

    # gzipped files are not split, so a task gets a file's pieces in order, and with the separators they are its bytes
    pieces = (spark.read.option("lineSep", RECORD_END).option("pathGlobFilter", "*.gz").text(path)
              .select(F.col("value").cast("binary")))
    return pieces.mapInArrow(run, READ + ", payload binary" * with_payload)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the size of the response that each revisit refers to (by record id and digest)."""
    responses = cut_lineage(records.where("record_type <> 'revisit'")
                            .groupBy(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"))
                            .agg(F.min("payload_bytes").alias("r_bytes")))
    return (records.join(responses, (F.col("refers_to") == F.col("r_id"))
                         & (F.col("payload_digest") == F.col("r_digest")), "left")
            .withColumn("payload_bytes", F.coalesce("payload_bytes", "r_bytes")).drop("r_id", "r_digest", "r_bytes"))
