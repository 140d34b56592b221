"""WARC archives: one gzip member for each record, written and read back record by record.

Writing: each task streams its rows into archives of bounded size in a folder that all executors share. A file gets
its final name only when it is complete, and the list of files that the job returns is the list of archives, so a task
that runs again leaves at most unlisted files. Reading: a sequential reader feeds fixed blocks to an incremental zlib
decompressor, frames each record by its Content-Length, and verifies the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import KeyFilter, scratch_path, texts_of, with_groups, written

VERSION, BLOCK = b"WARC/1.1", 1 << 16
ARCHIVE_BYTES = 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record: version line, headers, Content-Length, block, two line ends."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(payload)))])]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def header_text(value) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


class WarcError(ValueError):
    """A record that is cut off, badly framed or not what its digest says."""


def read_records(stream, block: int = BLOCK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file object. Reads ``block`` bytes at a time; holds one record."""
    raw, at_end = b"", False
    while True:
        inflate, record, need = zlib.decompressobj(31), bytearray(), None
        if not raw:
            raw = stream.read(block)
        if not raw:
            return
        headers: dict[str, str] = {}
        while not inflate.eof:
            if not raw:
                raw = stream.read(block)
                at_end = not raw
            if at_end:
                raise WarcError("the archive ends inside a gzip member")
            try:
                record += inflate.decompress(raw, block)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            raw = inflate.unconsumed_tail or inflate.unused_data
            if need is None and (end := record.find(b"\r\n\r\n")) >= 0:
                lines = bytes(record[:end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/"):
                    raise WarcError("no WARC version line")
                for line in lines[1:]:
                    key, _, value = line.decode("utf-8").partition(":")
                    headers[key.strip().lower()] = value.strip()
                need = end + 4 + int(headers["content-length"])
            if need is not None and len(record) > need + 4:
                raise WarcError("a record is longer than its Content-Length")
        if need is None or len(record) != need + 4 or record[need:] != b"\r\n\r\n":
            raise WarcError("a record's length differs from its Content-Length")
        start = need - int(headers["content-length"])
        yield headers, bytes(record[start:need])


def verified(headers: dict[str, str], payload: bytes) -> bytes:
    if headers["warc-type"] != "revisit" and headers["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
        raise WarcError(f"the payload of {headers['warc-record-id']} differs from its digest")
    return payload


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, warc_date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record for each row and returns (archive, records), one row for each archive.

    The payload is the html in UTF-8, empty for null. Of the rows with equal payloads (by SHA-256) of at least ``min_bytes``, that
    with the largest id is the response and the others are revisits that name it. Rows with a null id are responses.
    Rows repeated with one id: one record each, with that row's payload; all are responses where the id is the largest that
    has the payload, and a payload is looked at by itself whatever other payloads its ids have. Null urls are written as
    ``urn:none``. Very long pages are one record each, read back in blocks. An empty table gives no archive. Other columns
    are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = texts_of(pages).select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("at", F.struct("page_id", F.sha2("html", 256).alias("sum")))
    sums = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("at.*")
    best = sums.groupBy("sum").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last"), F.count("*").alias("n"))
    revisits = with_groups(sums, written(best.where("first <> last"), "payloads"), "sum").where("page_id <> first")
    revisits = written(revisits.select(F.struct("page_id", "sum").alias("at"), "first").distinct(), "revisits")
    # an id with a payload is what revisits; only rows that may do so meet them
    marked = KeyFilter(revisits, "at").mark(rows, "at", "hit")
    names = ["page_id", "url", "html", "first"]
    rows = marked.where(~F.col("hit")).withColumn("first", F.lit(None).cast(kind)).select(names)
    rows = rows.unionByName(marked.where("hit").join(revisits, "at", "left").select(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            fs.move(f"{top}/.{name}", f"{top}/{name}")
            done.append((f"{folder}/{name}", n))

        for pdf in batches:
            for page_id, url, html, first in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["first"], strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                again = not pd.isna(first)
                headers = [
                    ("WARC-Type", "revisit" if again else "response"),
                    ("WARC-Record-ID", f"<urn:page:{'' if pd.isna(page_id) else int(page_id)}>"),
                    ("WARC-Date", warc_date),
                    ("WARC-Target-URI", header_text("urn:none" if url is None else url)),
                    ("Content-Type", "text/html; charset=utf-8"),
                    ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
                    ("X-Payload-Length", str(len(payload))),
                ]
                if again:
                    headers += [("WARC-Refers-To", f"<urn:page:{int(first)}>"), ("WARC-Profile", REVISIT_PROFILE)]
                member = gzip_member(record_bytes(headers, b"" if again else payload))
                if out is not None and size + len(member) > archive_bytes:
                    close()
                    out = None
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{top}/.{name}", compression=None)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["archive", "records"])

    assert kind in ("bigint", "int"), "page ids are whole numbers"
    return written(rows.mapInPandas(run, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, path_col: str = "archive", with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, html]) of every record.

    One task reads an archive from its start to its end. A record that is cut off or fails its digest raises.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(value: str | None):
        digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in (schema + ", html string" * with_payload).split(", ")]
        kinds = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"}
        for pdf in batches:
            for uri in pdf[path_col]:
                fs, path = _open(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, payload in read_records(stream):
                        verified(h, payload)
                        row = (
                            number(h["warc-record-id"]), h["warc-target-uri"], int(h["x-payload-length"]),
                            h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")),
                        )
                        rows.append((*row, payload.decode("utf-8", "surrogatepass")) if with_payload else row)
                        held += len(payload) if with_payload else 1
                        if held > (1 << 24 if with_payload else 10_000):
                            yield pd.DataFrame(rows, columns=columns).astype(kinds)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(kinds)

    files = archives.select(path_col).repartition(archives.sparkSession.sparkContext.defaultParallelism)
    return files.mapInPandas(run, schema + ", html string" * with_payload)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, scratch_path(spark, "warc"), archive_bytes=8 << 20)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex),
b AS (
  SELECT hex, top, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN b ON p.hex = b.hex
"""
