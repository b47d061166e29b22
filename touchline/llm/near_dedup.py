"""Near-duplicates by bottom-k sketches of one hash function.

The sketch of a document is the ``K`` smallest hashes of its word shingles. The smallest ``K`` of two sketches together
are a random sample of the union of both sets, and what both hold of it estimates the Jaccard similarity. A linked pair
shares at least ``m`` of them but for one pair in a billion (:func:`least_shared`; for sets of up to ``K`` shingles
always). So, with values ordered rarest first, a linked pair meets in an inverted list of the first values of each, and
the values of passages that many documents have stand last and need no list. Estimates filter the pairs of a list, and
the full sets confirm every link.

Equal sets are one class from the start. Short lists are compared pair by pair. The members of a long list are first
compared with its smallest; only what then still lies in different components is compared, in blocks, by bitmaps of the
sketches and then by the full sets, and only links that join two components leave a block.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import cache
from math import exp, lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import BinaryType

from touchline.functions.lineage import cut_lineage
from touchline.llm.components import components
from touchline.llm.words import shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, K = 5, 192
LOST = 1e-9  # share of linked pairs that may share fewer values than assumed
SURE_UPTO = 4 * K  # set sizes whose bounds are listed; larger sets take that of an endless one
BITS = 1024
SHORT_LIST = 16
ROWS = 1024  # documents whose sets a task holds at once
BLOCK = 2048
BROADCAST_IDS = 1_000_000  # ids of 8 bytes, up to which they are broadcast


def _tail(union: int, draws: int) -> int:
    """Largest x such that of ``draws`` from a union three quarters of which are shared, fewer than x shared come with under LOST."""
    shared, draws = -(-3 * union // 4), min(draws, union)
    ways = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    x, total = max(0, draws - (union - shared)), 0.0
    while x < draws:
        total += exp(ways(shared, x) + ways(union - shared, draws - x) - ways(union, draws))
        if total > LOST:
            break
        x += 1
    return x


@cache
def least_shared(k: int = K) -> tuple[list[int], list[int]]:
    """For set sizes 1 .. SURE_UPTO, the least number of values that the sketches of a linked pair share within the
    sketch of their union: with a partner of any size, and with one at least as large. The last entry holds for all larger sets.
    """
    endless = _tail(1 << 40, k)

    def least(n: int, smallest: int) -> int:
        largest = max(n, 4 * n // 3)
        sizes = {smallest, largest, *np.linspace(smallest, largest, 6).astype(int).tolist(), *(u for u in (k, k + 1) if smallest <= u <= largest)}
        return min(_tail(u, k) for u in sizes)

    any_size = [least(n, n) for n in range(1, SURE_UPTO)] + [endless]
    larger = [least(n, 8 * n // 7) for n in range(1, SURE_UPTO)] + [endless]
    return any_size, larger


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[shingles[:K] % BITS] = 1
    return np.packbits(bits).tobytes()


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _hashed(texts: pa.Array) -> list[np.ndarray]:
    return [np.unique(s >> np.uint64(1)).astype(np.int64) for s in shingle_sets(texts, WORDS)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = _hashed(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _lists([s[:K] for s in sets])],
            names=["doc_id", "n", "same", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = _hashed(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([_bitmap(s) for s in sets], pa.binary()), _lists(sets)],
            names=["doc_id", "same", "bits", "full"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _keys(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Id and digest of each text as bytes in the order of (id, digest); NULL for a NULL id."""
    digests = [_digest(s) for at in range(0, len(texts), ROWS) for s in _hashed(texts.slice(at, ROWS))]
    return pa.array([None if i is None else (i + (1 << 63)).to_bytes(8, "big") + d for i, d in zip(ids.to_pylist(), digests, strict=True)], pa.binary())


def _key(doc_id: Column, text: Column) -> Column:
    return arrow_udf(_keys, BinaryType())(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def _keyed(texts: DataFrame) -> DataFrame:
    """The texts with such a key as their ``doc_id``."""
    return texts.select(_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")


def _id_of(key: Column) -> Column:
    return (F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _kind(table: DataFrame, column: str) -> str:
    return dict(table.dtypes)[column]


def _bound(which: int, n: Column) -> Column:
    return F.element_at(F.lit(least_shared()[which]), F.least(n, F.lit(SURE_UPTO)).cast("int"))


def inverted_lists(classes: DataFrame) -> DataFrame:
    """``value``, ``id``, ``n``, ``index`` (the value is among the first that a larger partner must share), ``length`` of the list.

    ``classes`` has ``id``, ``n``, ``sketch``. Only values of several classes are kept, and lists that hold an index row.
    """
    postings = classes.select("id", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    often = cut_lineage(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = postings.join(often, "value")
    mine = W.partitionBy("id")
    placed = shared.withColumn("place", F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "value")))
    first = lambda which: F.col("place") <= F.col("size") - _bound(which, F.col("n")) + 1
    kept = cut_lineage(placed.withColumn("index", first(1)).filter(first(0) | F.col("index")).select("value", "id", "n", "index"))
    lengths = kept.groupBy("value").agg(F.count("*").alias("length"), F.max("index").alias("any")).filter("length > 1 AND any").select("value", "length")
    return cut_lineage(kept.join(lengths, "value"))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose union sketch holds enough shared values."""
    pairs = cut_lineage(pairs)
    asked = cut_lineage(among(classes, "id", pairs.select("a").union(pairs.select("b"))).select("id", "n", "sketch"))
    side = lambda x: asked.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)  # then the sketches are the sets
    exact = F.size(F.array_intersect("s_a", "s_b"))
    return joined.filter(
        F.when(whole, 100 * exact >= 75 * (F.col("n_a") + F.col("n_b") - exact)).otherwise(shared >= least_shared()[0][-1])).select("a", "b")


def among(table: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``table`` whose ``key`` is in the one column of ``ids`` (or, ``left_anti``, is not).

    Up to :data:`BROADCAST_IDS` ids are broadcast, so that wide rows stay where they are; more are joined by key.
    """
    ids = cut_lineage(ids.toDF("_id").distinct())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return table.join(ids, F.col(key) == F.col("_id"), how)


def _one_text(texts: DataFrame) -> DataFrame:
    """``doc_id``, ``bits``, ``full``: bitmap and full set of each id. All rows of an id have equal sets."""
    sets = cut_lineage(texts.mapInArrow(_sets, f"doc_id {_kind(texts, 'doc_id')}, same binary, bits binary, full array<long>"))
    if sets.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return sets.select("doc_id", "bits", "full")
    return sets.groupBy("doc_id").agg(F.min(F.struct("same", "bits", "full")).alias("s")).select("doc_id", "s.bits", "s.full")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Sets are made again for the documents in question only."""
    pairs = cut_lineage(pairs)
    one = _one_text(among(texts, "doc_id", pairs.select("a").union(pairs.select("b"))))
    side = lambda x: one.select(F.col("doc_id").alias(x), F.col("full").alias(f"f_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("f_a", "f_b"))
    return joined.filter(100 * shared >= 75 * (F.size("f_a") + F.size("f_b") - shared)).select("a", "b").distinct()


def _fits(n_a: Column, n_b: Column) -> Column:
    return 3 * F.greatest(n_a, n_b) <= 4 * F.least(n_a, n_b)


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within a block of a group of long lists, or across two blocks: one for each pair of components that the block can join.

    Pairs that lie in one component already are passed over, bitmaps that cannot belong to a linked pair rule out most
    others, and what is left is settled on the full sets. So no pairs leave the block but links that are needed.
    """
    bounds = np.array(least_shared()[1])
    held: list[pd.DataFrame] = []

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
        left, right = rows[rows["own"] == one], rows[rows["own"] == two]
        a_bits, b_bits = (np.frombuffer(b"".join(x["bits"]), np.uint64).reshape(len(x), -1) for x in (left, right))
        a_n, b_n, a_id, b_id = (x[c].to_numpy() for c in ("n", "id") for x in (left, right))
        names, numbers = np.unique(rows["component"].to_numpy(), return_inverse=True)
        label = np.arange(len(names))  # of each component in this block, as links are found
        own = numbers.reshape(-1)
        a_c, b_c = own[(rows["own"] == one).to_numpy()], own[(rows["own"] == two).to_numpy()]
        a_set, b_set = left["full"].tolist(), right["full"].tolist()
        found = []
        for i in range(len(left)):
            ok = (label[b_c] != label[a_c[i]]) & (3 * np.maximum(a_n[i], b_n) <= 4 * np.minimum(a_n[i], b_n))
            if one == two:
                ok[: i + 1] = False
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            n = b_n[at]
            least = np.where((n <= K) & (a_n[i] <= K), -(-3 * (n + a_n[i]) // 7), bounds[np.minimum(np.minimum(n, a_n[i]), SURE_UPTO) - 1])
            differ = np.bitwise_count(b_bits[at] ^ a_bits[i]).sum(1, dtype=np.int64)
            for j in at[differ <= np.minimum(n, K) + min(a_n[i], K) - 2 * least].tolist():
                if label[b_c[j]] == label[a_c[i]]:
                    continue
                shared = len(np.intersect1d(a_set[i], b_set[j], assume_unique=True))
                if 100 * shared >= 75 * (a_n[i] + b_n[j] - shared):
                    found.append((min(a_id[i], b_id[j]), max(a_id[i], b_id[j])))
                    label[label == label[b_c[j]]] = label[a_c[i]]
        return pd.DataFrame({"a": np.array([x for x, _ in found], a_id.dtype), "b": np.array([x for _, x in found], a_id.dtype)})

    for frame in frames:
        for _, rows in frame.groupby(["group", "p", "q"], sort=False):
            if held and any(held[0][c].iloc[0] != rows[c].iloc[0] for c in ("group", "p", "q")):
                yield settle(pd.concat(held))
                held = []
            held.append(rows)
    if held:
        yield settle(pd.concat(held))


def links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``a``, ``b``: links that connect every component of classes. ``classes`` has ``id``, ``n``, ``sketch``; ``texts`` has ``doc_id``, ``text``."""
    lists = inverted_lists(classes)
    short, long_ = lists.filter(F.col("length") <= SHORT_LIST), lists.filter(F.col("length") > SHORT_LIST)
    x, y = short.filter("index").alias("x"), short.alias("y")
    pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & _fits(F.col("x.n"), F.col("y.n")))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    hubs = long_.groupBy("value").agg(F.min(F.struct("id", "n")).alias("hub"))
    stars = cut_lineage(long_.join(hubs, "value").filter(F.col("hub.id") != F.col("id")).select(
        F.col("hub.id").alias("a"), F.col("id").alias("b"), _fits(F.col("hub.n"), F.col("n")).alias("fits")).distinct())
    found = cut_lineage(_confirmed(_estimated(pairs.union(stars.filter("fits").select("a", "b")).distinct(), classes), texts))
    # documents that meet in long lists, directly or over others, are one group; where it is linked as a whole nothing is left to do
    groups = components(stars).select("id", F.col("component").alias("group"))
    labelled = cut_lineage(groups.join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id")))
    apart = labelled.groupBy("group").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    blocks = F.ceil(F.col("members") / BLOCK)
    rest = cut_lineage(labelled.join(apart.select("group", "members"), "group").select(
        "id", "group", "component", F.pmod(F.xxhash64("id"), blocks).alias("own"), F.sequence(F.lit(0).cast("long"), blocks - 1).alias("others")))
    sets = _one_text(among(texts, "doc_id", rest.select("id")))
    dealt = rest.join(sets.withColumnRenamed("doc_id", "id"), "id").withColumn("other", F.explode("others")).select(
        "group", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", F.size("full").alias("n"), "component", "bits", "full")
    ordered = dealt.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q")
    return found.union(ordered.mapInPandas(_compare, "a {0}, b {0}".format(_kind(classes, "id"))))


def _sketched(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and for each set ``same`` and id the ``n`` of the set and its ``copies``."""
    sketched = cut_lineage(texts.mapInArrow(_sketches, f"doc_id {_kind(texts, 'doc_id')}, n long, same binary, sketch array<long>"))
    rows = sketched.filter("doc_id IS NOT NULL").groupBy("same", "doc_id").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    return sketched, cut_lineage(rows)


def _judged(docs: DataFrame) -> tuple[DataFrame, bool]:
    """For every row ``id``, ``n``, ``component`` and ``kept``, and whether the ids are keys of (doc_id, digest): so where a doc_id has several sets."""
    texts = _texts(docs)
    sketched, rows = _sketched(texts)
    keyed = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if keyed:
        texts = _keyed(texts)
        sketched, rows = _sketched(texts)
    named, full = sketched.filter("n > 0 AND doc_id IS NOT NULL"), rows.filter("n > 0").drop("n")
    members = cut_lineage(full.join(full.groupBy("same").agg(F.min("doc_id").alias("id")), "same"))
    others = members.filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    classes = among(named, "doc_id", others.select("b"), "left_anti").select(F.col("doc_id").alias("id"), "n", "same", "sketch")
    if not members.filter("copies > 1").isEmpty():  # else every id has one row
        classes = cut_lineage(classes.groupBy("id").agg(F.min(F.struct("same", "n", "sketch")).alias("c")).select("id", "c.*"))
    labels = cut_lineage(components(links(texts, classes).union(others)))
    found = sketched.select(F.col("doc_id").alias("id"), "n").join(labels, "id", "left")
    found = found.select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"))
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True))), keyed


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if their sets of distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle)
    have a Jaccard similarity of 0.75 or more; ``component_id`` is the smallest doc_id reachable over links. Texts that
    are NULL or without words have no shingles and are linked with nothing. Rows of equal texts are one class. A row
    with a NULL doc_id cannot be named as a representative: it stays alone (``component_id`` NULL, ``kept`` true).
    Rows that repeat a doc_id are documents of their own where their sets differ, and the one of the smallest digest is
    kept where they are linked; rows of equal sets are reported alike. Other columns are left aside; an empty table gives an empty result.
    """
    found, keyed = _judged(docs)
    name = _id_of if keyed else lambda c: c
    return found.select(name(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), name(F.col("component")).alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, columns as they are: one document of each component."""
    found, keyed = _judged(docs)
    found = cut_lineage(found)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    whole = docs.select(row, (_key(F.col("doc_id"), F.col("text")) if keyed else F.col("doc_id").cast("long")).alias("_doc"))
    kept = among(whole, "_doc", found.filter("NOT kept").select("id"), "left_anti")
    if not found.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty():  # rows that repeat
        kept = kept.filter("_doc IS NULL").union(kept.filter("_doc IS NOT NULL").dropDuplicates(["_doc"]))
    return kept.select("_row.*")
