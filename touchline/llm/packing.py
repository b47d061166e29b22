"""Best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

import bisect
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.words import count_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = 4096  # documents that are packed together
BIN_BITS = 24  # a bin's number is that of its run of rows, shifted by so many bits, plus its number there
SCHEMA = "doc_id long, piece int, words long, source string, cluster long, bin long, place int"


def pack_group(sizes: list[int], sources: list, clusters: list[int], capacity: int, slots: int) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each piece; the pieces come longest first, none above ``capacity``.

    Open bins are kept in order of residual room. From the tightest bin that has room for the piece, the search goes
    on to the next larger residual until a bin is compatible: it holds no other piece of the piece's cluster, and
    less than ``slots`` pieces of its source. Both are bits of one number: a source has ``slots`` bits, a cluster
    of several pieces has one.
    """
    first_bit = {s: i * slots for i, s in enumerate(dict.fromkeys(sources))}
    often = Counter(clusters)
    base = len(first_bit) * slots
    cluster_bit = {c: 1 << base + i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    all_slots = (1 << slots) - 1
    order: list[tuple[int, int]] = []  # (residual, bin)
    bits: list[int] = []
    held: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        shift, own = first_bit[source], cluster_bit.get(cluster, 0)
        at = bisect.bisect_left(order, (size, -1))
        while at < len(order):
            have = bits[order[at][1]]
            if not have & own and (have >> shift & all_slots) != all_slots:
                break
            at += 1
        if at < len(order):
            room, bin_ = order.pop(at)
        else:
            room, bin_ = capacity, len(bits)
            bits.append(0)
            held.append(0)
        have = bits[bin_] >> shift & all_slots
        bits[bin_] |= own | ((have + 1) & ~have) << shift
        out.append((bin_, held[bin_]))
        held[bin_] += 1
        if room > size:
            bisect.insort(order, (room - size, bin_))
    return out


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one group, copies written out, at most GROUP at a time: more of them are packed as further runs."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        for _, rows in frame.groupby("pack", sort=False):
            rows = rows.loc[rows.index.repeat(rows["copies"])]
            while len(rows):
                if kept and kept[0]["pack"].iloc[0] != rows["pack"].iloc[0]:
                    yield pd.concat(kept)
                    kept = []
                take = GROUP - sum(map(len, kept))
                kept.append(rows.iloc[:take])
                rows = rows.iloc[take:]
                if sum(map(len, kept)) == GROUP:
                    yield pd.concat(kept)
                    kept = []
    if kept:
        yield pd.concat(kept)


def _pack(capacity: int, slots: int, groups: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, group = 0, None
        for rows in _runs(frames):
            part = part + 1 if group == rows["pack"].iloc[0] else 0
            group = rows["pack"].iloc[0]
            pieces = [
                (doc, i, min(capacity, words - i * capacity), None if pd.isna(source) else source, cluster)
                for doc, words, source, cluster in zip(rows["doc_id"], rows["words"], rows["source"], rows["cluster"], strict=True)
                for i in range(max(1, -(-words // capacity)))]
            pieces.sort(key=lambda p: -p[2])  # stable: the rows come in a settled order
            filled = [p for p in pieces if p[2]]
            bins = pack_group([p[2] for p in filled], [p[3] for p in filled], [p[4] for p in filled], capacity, slots)
            number = part * groups + int(group) << BIN_BITS
            frame = pd.DataFrame(pieces, columns=["doc_id", "piece", "words", "source", "cluster"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["bin"] = pd.array([number + b for b, _ in bins] + [None] * (len(pieces) - len(bins)), dtype="Int64")
            frame["place"] = pd.array([p for _, p in bins] + [None] * (len(pieces) - len(bins)), dtype="Int32")
            yield frame

    return run


def same_text(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space; NULL as empty."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.trim(words))


def pack(docs: DataFrame, capacity: int = 2048, slots: int = 4, cluster: Column | None = None) -> DataFrame:
    """Sequences of up to ``capacity`` words: one row per piece of a document, with its bin and place there.

    A document longer than ``capacity`` is cut into pieces. Documents are dealt by a hash (copies of one row by a hash
    for every few of them) into groups of about :data:`GROUP`, longest first within a group, and every group is packed by :func:`pack_group`; no bin spans two
    groups, so that the only loss is a few open bins for thousands of documents. Only numbers and names are shuffled.

    No bin holds two pieces of one cluster (by default documents of equal text, and so pieces of one document) or
    more than ``slots`` of one source. Texts without words, or NULL, have no bin (NULL). A NULL source is a source
    of its own, a NULL doc_id stays NULL, rows that repeat are packed one by one into different bins. Other columns
    are left aside; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), count_words(text).alias("words"), F.col("source").cast("string").alias("source"),
        (same_text(text) if cluster is None else cluster.cast("long")).alias("cluster"))
    groups = -(-docs.select(F.lit(1)).count() // GROUP) or 1
    share = max(1, GROUP // 16)  # copies of one row that are dealt together
    counted = rows.groupBy("doc_id", "words", "source", "cluster").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {share}"))))
    copies = F.least(F.col("n") - F.col("part") * share, F.lit(share)).alias("copies")
    dealt = parts.select("doc_id", "words", "source", "cluster", "part", copies, F.pmod(F.xxhash64("doc_id", "cluster", "source", "part"), F.lit(groups)).alias("pack"))
    ordered = dealt.repartition(min(groups, 100_000), "pack").sortWithinPartitions("pack", F.desc("words"), "doc_id", "cluster", "source", "part")
    return ordered.mapInPandas(_pack(capacity, slots, groups), SCHEMA)
