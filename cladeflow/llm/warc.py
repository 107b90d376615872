"""WARC archives, index first: each record's file, offset, length, URL and digest are kept in an index,
and selected records are read by byte ranges of neighbours joined together.

Defined results: a null payload is an empty one, a null URL an empty header; of records with equal payloads
of at least `least` bytes the one with the smallest id is a response and the others revisit it; repeated rows
with one id: all copies of the first id are responses; rows with a null id revisit a payload that a row with an id has,
and are responses else; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import common
from cladeflow.runtime import materialize, scratch, ship

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, file string, at long, length long"
EMPTY_ID = "none"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = EMPTY_ID if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member for each record
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of one record and its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row to files of about file_bytes; return the index, itself written as parquet."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    # Only ids and digests meet; a payload that a third of the pages share is one row per task before the shuffle.
    keys = materialize(rows.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("sha"), F.octet_length("html").alias("size")), "digests")
    firsts = keys.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # The pages of a common payload are dealt by salt, and its one row to every salt. An id can come again with another
    # payload, so the pair of both decides.
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    firsts = firsts.where("first is not null").select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    pair = salted.join(firsts, ["sha", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    pair = pair.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct()
    joined = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    joined = joined.join(pair, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        size, out, file = 0, [], None

        def close() -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        names = ["page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "file", "at", "length"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for b in common.pieces_of(batch, "html"):
                for i, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = (html or "").encode()
                    digest = sha1_base32(payload)
                    raw = _record(i, url, payload, digest, refers_to)
                    if file is None:
                        file = common.WholeFile(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    out.append((i, url, digest, "response" if refers_to is None else "revisit", refers_to, len(payload), file.uri, size, len(raw)))
                    file.write(raw)
                    size += len(raw)
                    if size >= file_bytes:
                        yield close()
                        size, out, file = 0, [], None
        if out:
            yield close()

    # the index is written with the records: what reads it never writes records again, and names of lost tasks' files are in no index
    return materialize(joined.mapInArrow(run, INDEX), "warc-index")


def ranges(spots: list[tuple[int, int]], gap: int = 1 << 16, most: int = 8 << 20) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) joined to reads of at most about `most` bytes, over gaps of at most `gap`."""
    held: list[tuple[int, int]] = []
    for at, n in sorted(spots):
        if held and (at - sum(held[-1]) > gap or at + n - held[0][0] > most):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((at, n))
    if held:
        yield held[0][0], sum(held[-1]), held


def read_warc(index: DataFrame) -> DataFrame:
    """The records an index selects, read by joined byte ranges; payload digests are checked."""
    spark = index.sparkSession
    ship(spark)
    # records of a file are dealt by ranges of 8 MB, so that one large file isn't one task
    spots = index.select("file", "at", "length", F.floor(F.col("at") / (8 << 20)).alias("part"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spots = spots.repartition(n, "file", "part").sortWithinPartitions("file", "at")
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(x: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(m[1]) if m else None

    def read(path: str, held: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        store, inner = common.filesystem(path)
        with store.open_input_file(inner) as f:
            for start, stop, members in ranges(held):
                f.seek(start)
                raw, rows = f.read(stop - start), []
                for at, length in members:
                    head, payload = parse_record(raw[at - start : at - start + length])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"payload digest differs: {path} at {at}")
                    rows.append((number(head["warc-record-id"]), head["warc-target-uri"], payload, int(head["x-payload-length"]), digest, head["warc-type"], number(head.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, []
        for b in batches:
            for f, at, length in zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("length").to_pylist(), strict=True):
                if f != path:
                    if held:
                        yield from read(path, held)
                    path, held = f, []
                held.append((at, length))
        if held:
            yield from read(path, held)

    return spots.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir):
    from cladeflow.runtime import table

    index = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows: a payload's SHA-1 in base32, five bits of it a letter.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT t, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (t)"""
