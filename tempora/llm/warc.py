"""Operator 7: WARC archives, index first.

Writing: each task appends records, every one a gzip member, to an archive of its own and returns an index row
(offset, length, URL, digest) for each; the index is written before anything is read. Only archives of the
attempt whose rows are in the index count, so a task that is run again leaves a file that nobody refers to.
Of records with equal payloads of at least ``least`` bytes, that of the largest page_id is the response and
the others are revisits. Reading: the selected index rows are sorted by archive and offset, neighbours closer
than GAP are read as one range, and every record is parsed and its digest verified.

Null html is an empty payload. Rows that repeat the largest page_id with the same payload are all responses;
a null page_id ranks below every other. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize, new_folder

INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
GAP, RANGE, STRIPE = 1 << 16, 1 << 23, 1 << 26


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A gzip member holding one record, and the payload's digest."""
    sha, body = digest(payload), b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {_uri(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}", *([f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []), f"Content-Length: {len(body)}",
    ]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"), sha


def parse(data: bytes) -> tuple:
    """A READ row from a record's gzip member."""
    raw = zlib.decompress(data, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    if lines[0] != "WARC/1.1" or raw[cut + 4 + len(body) :] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    sha, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and sha != digest(body):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
    ident = lambda key: None if (x := head.get(key, _name(None))) == _name(None) else int(x[10:-1])
    url = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), head["WARC-Target-URI"])
    return ident("WARC-Record-ID"), url, int(head["X-Payload-Length"]), sha, kind, ident("WARC-Refers-To"), body.decode() if kind == "response" else None


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives and their index below the shared folder; the index as a DataFrame."""
    folder = new_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))
    first = materialize(rows.groupBy("sha").agg(F.max("page_id").alias("first")), "payloads")
    full = F.octet_length("html") < least
    rows = rows.join(first, "sha").select("page_id", "url", "html", "first", (full | F.col("page_id").eqNullSafe(F.col("first"))).alias("response"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        path, at = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        out = None
        try:
            for pdf in batches:
                index = []
                for page, url, text, to, response in zip(*(pdf[c].astype(object).tolist() for c in ("page_id", "url", "html", "first", "response")), strict=True):
                    page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                    data, sha = record(page, url, text.encode(), to, not response)
                    out = out or where.open_output_stream(path, compression=None)
                    out.write(data)
                    index.append((page, url, path, at, len(data), sha, "response" if response else "revisit"))
                    at += len(data)
                yield pd.DataFrame(index, columns=["page_id", "url", "archive", "offset", "length", "payload_digest", "record_type"]).astype({"page_id": "Int64"})
        finally:
            if out:
                out.close()

    return materialize(rows.mapInPandas(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, begin, end) of what is read at once, from (offset, length) in order."""
    i = 0
    while i < len(rows):
        begin, end, j = rows[i][0], sum(rows[i]), i + 1
        while j < len(rows) and rows[j][0] - end <= GAP and sum(rows[j]) - begin <= RANGE:
            end = max(end, sum(rows[j]))
            j += 1
        yield i, j, begin, end
        i = j


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the index rows given, by sorted and coalesced byte ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, opened, source = None, None, None
        for pdf in batches:
            for archive, part in pdf.groupby("archive", sort=True):
                if archive != opened:
                    where = where or fs.FileSystem.from_uri(part["folder"].iat[0])[0]
                    opened, source = archive, where.open_input_file(archive)
                at, rows = sorted(zip(part["offset"].tolist(), part["length"].tolist(), strict=True)), []
                for i, j, begin, end in ranges(at):
                    data = memoryview(source.read_at(end - begin, begin))
                    rows += [parse(data[o - begin : o - begin + n]) for o, n in at[i:j]]
                    if sum(r[2] for r in rows) > RANGE:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        return out if payload else out.assign(payload=None)

    stripe = (F.col("offset") / STRIPE).cast("long")
    chosen = index.select("archive", "offset", "length", "folder", stripe.alias("stripe"))
    # a number of partitions given: the rows are few, what they stand for isn't, so they must not be put together by their size
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chosen.repartition(n, "archive", "stripe").sortWithinPartitions("archive", "offset").mapInPandas(run, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    return read(write(pages, least), payload=False).drop("payload", "url")
