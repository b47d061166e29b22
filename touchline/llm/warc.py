"""WARC archives of web pages, and their capture histories merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_BYTES = 1000  # payloads below are never revisits
ARCHIVE_BYTES = 16 << 20  # compressed; a record is never split
LEVEL = 3
RANGE_ROWS = 100_000  # captures that one task merges
BROADCAST_DIGESTS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = ("url_key string, captured timestamp, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "archive string, offset long, length long")


def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``, ``captured``) with ``digest``, ``bytes`` and ``refers_to``.

    Of equal payloads of at least ``LEAST_BYTES`` bytes the largest page_id (and rows that repeat it, or have none) is
    the response; the others refer to it. Payloads are counted by digest first; the digests of several rows are
    broadcast up to :data:`BROADCAST_DIGESTS`, and joined by key beyond that.
    """
    read = pages.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    repeated = read.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = cut_lineage(repeated.select(F.col("digest").alias("_digest"), "first"))
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    joined = read.join(repeated, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= LEAST_BYTES), "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("first"), F.col("first"))).drop("_digest", "first")


def _name(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url: str, html: bytes, captured: datetime, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit has the headers of the response only; they give the length of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id, digest)),
        ("WARC-Target-URI", "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "urn:none"),
        ("WARC-Date", captured.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Page-ID", page_id),
        ("WARC-Profile", PROFILE if refers_to is not None else None), ("WARC-Refers-To", None if refers_to is None else _name(refers_to, digest)),
        ("WARC-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "captured", "digest", "refers_to"))
        for page_id, url, html, captured, digest, refers_to in zip(*columns, strict=True):
            kept.append(record(page_id, url, html.encode(), captured, digest, refers_to))
            size += len(kept[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(kept)], pa.binary())], names=["content"])
                kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(kept)], pa.binary())], names=["content"])


def derived_time(page_id: Column) -> Column:
    """The pages have no time of capture: one second of the year 2024 by page_id, its first where there is none."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod(page_id, F.lit(366 * 86_400)), F.lit(0)))


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> None:
    """WARC files of about ``ARCHIVE_BYTES`` under ``path``, one gzip member a record, and one zero byte at the end.

    Spark's text writer puts one archive (a row) into each file and a separator after it; zero bytes after the last
    member are padding to every reader of gzip. So the files come through the committer of the job like any output.
    """
    rows = record_types(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        (derived_time(F.col("page_id")) if captured is None else captured).cast("timestamp").alias("captured")))
    archives = rows.select("page_id", "url", "html", "captured", "digest", "refers_to").mapInArrow(_archives, "content binary")
    archives.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def url_key(url: str) -> str:
    """Host with its labels turned round, then path and query, in lower case; no scheme, port, user or fragment."""
    rest = url.split("#")[0].lower()
    scheme, mark, after = rest.partition("://")
    rest = after if mark else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0]
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (rest[cut:] or "/")


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of an archive."""
    at = 0
    while at < len(content) and content[at]:
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(memoryview(content)[at:])
        if not unpack.eof:
            raise ValueError(f"archive ends within the record at {at}")
        end = len(content) - len(unpack.unused_data)
        head, _, body = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        if body[size:] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not {size} bytes long")
        yield at, end - at, fields, body[:size]
        at = end


def _entry(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    url = fields["WARC-Target-URI"]
    ids = [None if x is None else int(x) for x in (fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID"))]
    captured = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    return "" if url == "urn:none" else url_key(url), captured, ids[0], kind, ids[1], size, digest


def order_of(entry: tuple) -> tuple:
    """Captures go by key, then time, then page_id (none first), then place."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ENTRY.split(", ")]
    types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            archive = path.as_py().rpartition("/")[2]
            run = sorted(((*_entry(f, b), archive, at, size) for at, size, f, b in records(content.as_py())), key=order_of)
            if run:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*run, strict=True), types, strict=True)] + [pa.array(range(len(run)), pa.int64())], names=[*names, "turn"])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: every archive gives a run in :func:`order_of`, numbered by ``turn``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_runs, f"{ENTRY}, turn long")


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """K-way merge of sorted runs by a tree of losers: an inner node keeps the loser of its match, the winner goes up,
    and only the matches on the winner's way are played again for its run's next entry."""
    k = len(runs)
    if not k:
        return
    heads, at, end = [order_of(r[0]) if r else None for r in runs], [0] * k, [len(r) for r in runs]
    wins = lambda a, b: heads[b] is None or (heads[a] is not None and heads[a] <= heads[b])
    tree = [0] * k
    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if wins(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while heads[top] is not None:
        yield runs[top][at[top]]
        at[top] += 1
        heads[top] = order_of(runs[top][at[top]]) if at[top] < end[top] else None
        node = (top + k) // 2
        while node:
            if wins(tree[node], top):
                tree[node], top = top, tree[node]
            node //= 2


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs: list[list[tuple]] = []
    last = None
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            entry = tuple(None if x is None or x is pd.NA or x != x else x for x in row[:10])
            if entry[7] != last:
                runs.append([])
                last = entry[7]
            runs[-1].append(entry)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    part, done, at = TaskContext.get().partitionId(), [], 0
    for entry in merge_runs(runs):
        done.append(entry)
        if len(done) == 10_000:
            yield _frame(done, names, part, at)
            at, done = at + len(done), []
    if done:
        yield _frame(done, names, part, at)


def _frame(rows: list[tuple], names: list[str], part: int, at: int) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[names.index(c)] for r in rows], dtype="Int64")
    out["history_range"], out["history_place"] = part, range(at, at + len(rows))
    return out


def histories(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in one global order: by ``history_range`` and ``history_place`` in it.

    Ranges are cut by key, time, page_id and place, so that a key with any share of the captures is cut like others.
    Every task merges the parts of the sorted runs that fall into its range.
    """
    count = runs.count()
    dealt = runs.repartitionByRange(-(-count // range_rows) or 1, "url_key", "captured", "page_id", "archive", "offset")
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    return dealt.sortWithinPartitions("archive", "turn").select(*columns).mapInPandas(_merged, f"{ENTRY}, history_range int, history_place long")


def archive_pages(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back, and return their capture history: one row per page.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, then ``url_key``, ``captured`` and the
    place in the history. A NULL html is an empty payload, a NULL url has the empty key, a NULL page_id stays NULL and
    is always a response, rows that repeat are records of their own. Other columns are left aside; an empty table gives
    an empty result. The archives lie in the shared folder until they are read back.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    runs = cut_lineage(read_runs(spark, path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return histories(runs, range_rows).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_range", "history_place")
