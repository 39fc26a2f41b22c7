"""Best-fit packing under conflicts: pieces of documents go to bins of CAPACITY tokens.

A document is cut into pieces of CAPACITY tokens and a rest; only a bin's own pieces count against it. Pieces are placed by
falling size. Open bins are ordered by what is left in them; the search starts at the first bin that has room (the tightest)
and goes on to its successors until one has neither the piece's source nor one of its duplicate clusters, which each bin holds as
bitmaps. Without one a new bin is opened. So no bin holds two documents of one source, two copies of one text or, mostly, two near
copies: a text's clusters are its words as a whole and BANDS bands of ROWS minima each over its 5-word shingles, so that two texts at
similarity 0.9 share a band with probability 0.99, at 0.75 with 0.78 and at 0.5 with 0.23.

Pieces are dealt by hash to shards of about SHARD_PIECES, as many as the table needs; a shard is packed by one task from rows of
some 40 bytes. No source or cluster is ever gathered in one place: a source on a third of all rows is a third of each shard.

Defined results: a null or empty text is one piece of the end token alone. A null source conflicts with none. Rows that repeat
are packed each; as copies of one text they never share a bin. Rows with a null doc_id are packed too. Very long texts are measured
whole and cut into as many pieces as they need. An empty table has no bins. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ODD, Workspace, map_batches, mix64, texts
from keyloom.llm.near_dup import MULTIPLIERS, shingles

BANDS, ROWS = 4, 4
CAPACITY, SHARD_PIECES = 2048, 8192
#: Bins of a shard have ids from shard << BIN_BITS on.
BIN_BITS = 32


def bands(text: str) -> list[int]:
    """The text's band clusters; none for a text without words."""
    s, low = shingles(text), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(s):
        return []
    for k in range(0, len(s), 4096):
        np.minimum(low, (s[k : k + 4096, None] * MULTIPLIERS[: BANDS * ROWS]).min(axis=0), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64((out ^ low[k::ROWS]) * ODD)
    return out.view(np.int64).tolist()


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n (words and an end token), cluster (hash of the words, A-Z lower-cased; 0 if there are none), bands."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, cluster, near = [], [], []
        for t in texts(batch):  # one text's words at a time
            words = t.encode("utf-8", "surrogatepass").lower().split()
            size.append(len(words) + 1)
            cluster.append(xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1 if words else 0)
            near.append(bands(t))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64()), pa.array(cluster, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "source", "n", "cluster", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, f, "doc_id bigint, source string, n bigint, cluster bigint, bands array<bigint>")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int | list[int]], capacity: int) -> list[int]:
    """Bin of each piece; pieces come in the order of placement. Sources and clusters are small numbers, -1 for none; a piece can have several clusters."""
    order: list[tuple[int, int]] = []  # (left, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source if source >= 0 else 0, 0
        for x in cluster if isinstance(cluster, list) else (cluster,):
            c |= 1 << x if x >= 0 else 0
        for k in range(bisect_left(order, (size, -1)), len(order)):
            b = order[k][1]
            if not (source_bits[b] & s or cluster_bits[b] & c):
                left = order.pop(k)[0] - size
                break
        else:
            b, left = len(source_bits), capacity - size
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        if left:
            insort(order, (left, b))
        out.append(b)
    return out


def numbered(values: np.ndarray, none: np.ndarray) -> list[int]:
    """Values that occur more than once as 0, 1, ...; the others, and those that are none, as -1: they conflict with nothing."""
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    small = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inverse]
    return np.where(none, -1, small).tolist()


RESULT = "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint"


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = measured(docs).select("doc_id", "n", "cluster", "bands", F.xxhash64("source").alias("src"), F.col("source").isNull().alias("no_source"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)).alias("piece"))
    pieces = work.stage(pieces.withColumns({"start": F.col("piece").cast("bigint") * capacity, "size": F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity)}).drop("n"), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def f(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        cluster = t.column("cluster").to_numpy()
        near = np.array([b or [0] * BANDS for b in t.column("bands").to_pylist()], dtype=np.int64).reshape(-1, BANDS)
        several = np.concatenate([cluster[:, None], near], axis=1)
        none = np.repeat((cluster == 0)[:, None], BANDS + 1, axis=1)
        several = np.array(numbered(several.ravel(), none.ravel()), dtype=np.int64).reshape(-1, BANDS + 1)
        clusters = [[c for c in set(row) if c >= 0] for row in several.tolist()]
        found = best_fit(t.column("size").to_pylist(), numbered(t.column("src").to_numpy(), np.array(t.column("no_source").to_pylist(), dtype=bool)), clusters, capacity)
        ids = np.array(found, dtype=np.int64) + (key[0].as_py() << BIN_BITS)
        return pa.table({"doc_id": t.column("doc_id"), "piece": t.column("piece"), "start": t.column("start"), "n_tokens": t.column("size"), "bin_id": ids})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(f, RESULT)
