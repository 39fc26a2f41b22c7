"""Substring dedup by sliding sentence spans: runs of consecutive sentences are hashed and joined over all documents.

A sentence ends after ".", "!" or "?" (one or more) before white space, or at a line end. A sentence of more than LONG words is
divided after its words of LONG_WORD characters or more, a part that still has more than LONG words after every WORDS words; the
parts count as sentences. So the inner parts of a long passage without marks mostly agree wherever it stands, but whether a sentence
is divided depends on its whole length: a passage that starts or ends in mid-sentence can lose its first and last sentence, and is
not found if no two whole parts of WORDS words are left between. From every sentence a run starts: it
and the sentences after it, SENTENCES of them at least and as many as make WORDS words (no run starts where the text ends
first). Runs are equal if their words are, A-Z lower-cased. Of the occurrences of a run the first stays: the first in the
document with the smallest doc_id. Sentences that any other occurrence covers are removed, all else stays byte for byte.

Runs are told apart by 96 bits, 64 of one hash and 32 of a second, both over two independent hashes of each sentence's words: among
a trillion different runs a false pair is expected once in about 100,000 tables.

Runs are arrays of hashes by document, staged once. They are counted by hash with partial sums, so a run on a third of all
documents is one row a task; joined back by hash (a join whose hot partitions Spark splits); gathered by document as two
arrays that are no longer than the document itself.

Defined results: a null text is empty, with no sentences, and stays as it is (text null). Very long texts are read whole. An empty
table gives no rows. Rows that repeat a doc_id are one
document in the order of occurrences: both keep their first. A null doc_id is the last in that order. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ODD, Workspace, map_batches, mix64

SENTENCES, WORDS = 2, 12
LONG, LONG_WORD = 24, 8
LAST = (1 << 63) - 1
END = re.compile(rb"(?<![.!?])[.!?]++(?=[\x20\x09-\x0D])|\n")
#: A word of so many code points, up to white space.
PART = re.compile(rb"(?<!\S)(?:[\x00-\x08\x0E-\x1F\x21-\x7F]|[\xC0-\xFF][\x80-\xBF]*){%d,}+(?=[\x20\x09-\x0D])" % LONG_WORD)
WORD = re.compile(rb"\S+")


def sentences(raw: bytes) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Byte spans of the sentences (pieces without words belong to none), their two hashes (a row each) and numbers of words."""
    spans, hashes, counts, at = [], [], [], 0
    low, one = raw.lower(), xxhash.xxh3_128_digest

    def add(a: int, b: int, words: list[bytes]) -> None:
        spans.append((a, b))
        hashes.append(one(b" ".join(words)))
        counts.append(len(words))

    for end in [*(m.end() for m in END.finditer(raw)), len(raw)]:
        words = low[at:end].split()
        if len(words) > LONG:
            for part in [*(m.end() for m in PART.finditer(raw, at, end)), end]:
                some = low[at:part].split()
                if len(some) > LONG:
                    for cut_at in [m.end() for m in WORD.finditer(raw, at, part)][WORDS - 1 : -1 : WORDS]:
                        add(at, cut_at, low[at:cut_at].split())
                        at = cut_at
                    some = low[at:part].split()
                if some:
                    add(at, part, some)
                at = part
        elif words:
            add(at, end, words)
        at = end
    return spans, np.frombuffer(b"".join(hashes), dtype=np.uint64).reshape(-1, 2).T, np.array(counts, dtype=np.int64)


def runs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a run its hash and end (exclusive). Starts are 0, 1, 2 ... up to the last that has a whole run."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(counts)])
    end = np.maximum(np.searchsorted(total, total[:-1] + WORDS), np.arange(n) + SENTENCES)
    end = end[end <= n]
    # a polynomial over the sentences' hashes, from prefix sums
    power = ODD ** np.arange(n + 1, dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes) * power[:-1], dtype=np.uint64)])
    start = np.arange(len(end))
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64)) ** start.astype(np.uint64)
    return mix64((prefix[end] - prefix[start]) * inverse + (end - start).astype(np.uint64)), end


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def run_hashes(docs: DataFrame) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, second = [], []
        for t in batch.column("text").to_pylist():
            _, hashes, counts = sentences((t or "").encode("utf-8", "surrogatepass"))
            found.append(runs(hashes[0], counts)[0].view(np.int64))
            second.append((runs(hashes[1], counts)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        both = pa.StructArray.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(second), pa.int32())], names=["h", "g"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32()), both)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "runs"])

    return map_batches(_slim(docs), f, "doc_id bigint, runs array<struct<h:bigint,g:int>>").withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))


def cut(text: str, first: set[int], later: set[int]) -> tuple[str, int, int]:
    """The text without the sentences of repeated runs (first: runs whose first occurrence is in this text), their number, and the number of all."""
    raw = text.encode("utf-8", "surrogatepass")
    spans, hashes, counts = sentences(raw)
    found, end = runs(hashes[0], counts)
    gone, seen = np.zeros(len(spans), dtype=bool), set()
    for k, h in enumerate(found.view(np.int64).tolist()):
        if h in later or h in seen:
            gone[k : end[k]] = True
        elif h in first:
            seen.add(h)
    if not gone.any():
        return text, 0, len(spans)
    out, at = [], 0
    for (a, b), drop in zip(spans, gone.tolist(), strict=True):
        if drop:
            out.append(raw[at:a])
            at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass"), int(gone.sum()), len(spans)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, text (what stays)."""
    work = Workspace(docs.sparkSession, "spans")
    by_doc = work.stage(run_hashes(docs).filter(F.size("runs") > 0), "runs")
    flat = by_doc.select("doc_id", F.inline("runs"))
    repeated = flat.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").select("h", "g", "first")
    hit = flat.join(work.stage(repeated, "repeated"), ["h", "g"])  # from a table, so both sides are plain exchanges and hot partitions split
    marks = hit.groupBy("doc_id").agg(F.collect_set(F.when(F.col("first") == F.col("doc_id"), F.col("h"))).alias("firsts"), F.collect_set(F.when(F.col("first") < F.col("doc_id"), F.col("h"))).alias("laters"))
    rows = _slim(docs).withColumn("_key", F.coalesce("doc_id", F.lit(LAST))).join(marks.withColumnRenamed("doc_id", "_key"), "_key", "left").select("doc_id", "text", "firsts", "laters")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, removed, count = [], [], []
        for t, a, b in zip(*(batch.column(k).to_pylist() for k in ("text", "firsts", "laters")), strict=True):
            kept, gone, n = cut(t or "", set(a or ()), set(b or ()))
            new.append(None if t is None else kept)
            removed.append(gone)
            count.append(n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(new, pa.string())], names=["doc_id", "n_sentences", "n_removed", "text"])

    return map_batches(rows, f, "doc_id bigint, n_sentences bigint, n_removed bigint, text string")
