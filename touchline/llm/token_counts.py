"""Token counts of documents in flat token files, which have separators but no index."""

from __future__ import annotations

import base64
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDTH = 2  # bytes of an id, high byte first
END = 0xC480  # id of the end of a document; its two bytes are one character in UTF-8, which the text writer takes as separator
KEY, KEY_IDS, KEY_BITS, NO_KEY = 51_200, 5, 13, 59_392  # ids that carry the key of a document before its tokens
BLOCK = 1 << 19  # ids that are searched at once
ROWS = 256  # documents that are encoded at once
_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file (lines of a base64 token and its id); special tokens are ordinary text."""
    key = hash(vocabulary)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def key_ids(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [NO_KEY] * KEY_IDS
    return [KEY + (doc_id >> KEY_BITS * i & (1 << KEY_BITS) - 1) for i in range(KEY_IDS)]


def key_of(ids: np.ndarray) -> int | None:
    if ids[0] == NO_KEY:
        return None
    value = sum((int(x) - KEY) << KEY_BITS * i for i, x in enumerate(ids)) & (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Flat files of 16-bit ids under ``path``: key, tokens and END of one document after the other."""
    with open(vocabulary, "rb") as f:  # on the driver; about a megabyte goes to the tasks
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shipped.value).encode_ordinary
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                out = [np.array(key_ids(i) + encode(t), ">u2").tobytes() for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    separator = END.to_bytes(WIDTH, "big").decode()
    rows.mapInArrow(run, "ids binary").select(F.col("ids").cast("string")).write.option("lineSep", separator).text(path)


def scan_block(ids: np.ndarray, before: bool, own: int) -> list[tuple[int, int, bool, bool, int | None]]:
    """Pieces of documents in one block: (separators before it, ids, begins here, ends here, key if it begins here).

    ``ids`` holds ``own`` ids of the block and some of the next, for a key that begins here; ``before`` says that a
    document begins with the block.
    """
    ends = np.flatnonzero(ids[:own] == END)
    start = np.r_[0, ends + 1]
    stop = np.r_[ends, own]
    begins = np.r_[before, np.ones(len(ends), bool)]
    finished = np.r_[np.ones(len(ends), bool), False]
    keep = (stop > start) | (begins & finished)
    return [(int(i), int(stop[i] - start[i]), bool(begins[i]), bool(finished[i]), key_of(ids[start[i] : start[i] + KEY_IDS]) if begins[i] else None)
            for i in np.flatnonzero(keep)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, block, data in zip(*(batch.column(c) for c in ("path", "block", "data")), strict=True):
            path, block, ids = path.as_py(), block.as_py(), np.frombuffer(data.as_buffer(), ">u2")
            before = block == 0 or ids[0] == END
            ids = ids[block > 0 :]
            own = min(BLOCK, len(ids))
            rows += [(path, block, *piece, 0) for piece in scan_block(ids, bool(before), own)]
            rows.append((path, block, 0, 0, False, False, None, int((ids[:own] == END).sum())))
        names = ["path", "block", "passed", "ids", "begins", "ends", "doc_id", "separators"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)


def count_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every document in the flat files under ``path``, by one search for separators.

    Files are cut into blocks that are searched on their own. Documents inside a block are done at once; what crosses
    blocks is numbered by a running sum of the separators in the blocks before (a prefix scan) and added up by number.
    A last document without separator counts as well.
    """
    sizes = F.ceil(F.length("content") / (BLOCK * WIDTH)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), sizes - 1), lambda i: F.substring(  # one id before a block, and a key after it
        F.col("content"), F.greatest(i * BLOCK * WIDTH - WIDTH, F.lit(0)) + 1, F.when(i > 0, WIDTH).otherwise(0) + (BLOCK + KEY_IDS) * WIDTH))
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    blocks = files.select("path", F.posexplode(cut).alias("block", "data"))
    pieces = cut_lineage(blocks.mapInArrow(_scan, "path string, block int, passed long, ids long, begins boolean, ends boolean, doc_id long, separators long"))
    whole = pieces.filter("begins AND ends").select("doc_id", "ids")
    crossing = pieces.filter("NOT (begins AND ends)")
    earlier = F.coalesce(F.sum("separators").over(W.partitionBy("path").orderBy("block").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = crossing.withColumn("number", earlier + F.col("passed")).filter("ids > 0 OR begins")
    stitched = numbered.groupBy("path", "number").agg(F.max("doc_id").alias("doc_id"), F.sum("ids").alias("ids")).select("doc_id", "ids")
    return whole.union(stitched).select("doc_id", (F.col("ids") - KEY_IDS).alias("n_tokens"))


def tokenize_and_count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` for every row of ``docs``: whole texts are written to flat token files, then counted there.

    NULL and empty texts have 0 tokens, a NULL doc_id stays NULL, repeated rows are counted one by one, other columns
    are left aside, an empty table gives an empty result. The files lie in the shared folder until they are counted.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary)
    counts = cut_lineage(count_tokens(spark, path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return counts
