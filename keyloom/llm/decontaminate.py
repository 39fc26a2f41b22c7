"""Benchmark decontamination: a broadcast set of the benchmark's word windows is held against every training window.

Words are the longest runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is WINDOW words in a row
of an item; an item of fewer words, but not none, is one window. A document word inside an occurrence of a window is hit.

The benchmark is measured before it is collected. Up to BROADCAST_CHARS characters of item text are broadcast as sorted arrays
of window hashes with places in the items' words (about 5 bytes a character) and a table of the items' different words (100 bytes or
so each), 200 MB in a worker at the very most; a hit counts if the words themselves agree. More
text is never gathered: a bit filter of FILTER_BITS, the same size for any benchmark, picks the document windows that can be
hits, and these are joined with the table of windows by two independent 64-bit hashes. So no executor's memory grows with the
benchmark. A join's hot window (in very many documents or items) is one that Spark splits.

Defined results: a null text has no words and no hits. A null item_id marks words as hit and counts in no n_items; item ids
that repeat count once. Very long texts are read whole, a text at a time. Empty tables give no rows, or rows without hits. Rows
that repeat are each answered. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, map_batches, texts

WINDOW = 8
#: A document with windows of so many items is contaminated.
MIN_ITEMS = 2
#: Characters of item text that are broadcast at most.
BROADCAST_CHARS = 4_000_000
#: Bits of the filter beyond that (16 MB), two of which a window sets.
FILTER_BITS = 1 << 27
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

#: Byte map: A-Z to a-z, other ASCII characters that are no digit or letter to a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SEEDS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Hashes:
    """Hashes of words and of windows. Words are kept in a cache with a bound."""

    def __init__(self, bound: int = 200_000) -> None:
        self.bound, self.known = bound, {}

    def words(self, found: list[bytes]) -> np.ndarray:
        known, one = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.bound:
            known.clear()
        out = list(map(known.get, found))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[found[i]] = one(found[i])
        return np.array(out, dtype=np.uint64)

    @staticmethod
    def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Of every n words in a row; two families, which = 0 or 1."""
        out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
        for k in range(n):
            out = (out ^ (h[k : k + len(out)] >> np.uint64(7 * which))) * SEEDS[which] + np.uint64(k + n)
        return out ^ (out >> np.uint64(29))


class Index:
    """The windows of some items: by length, ascending hashes with the item and the first word of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.hashes, self.items, self.window = Hashes(), [i for i, _ in items], window
        listed = [words(t or "") for _, t in items]
        size = np.array([len(w) for w in listed], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        flat = [w for one in listed for w in one]
        edge = np.cumsum([len(w) + 1 for w in flat], dtype=np.int64)
        self.edge = np.concatenate([np.zeros(1, dtype=np.int64), edge])  # of the words in text, each with a blank behind it
        self.text = b"".join(w + b" " for w in flat)
        h = self.hashes.words(flat)
        self.vocabulary = dict(zip(flat, h.tolist(), strict=True))  # words that no item has need no hash
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(window, int(x)) for x in size if x}):
            of = np.flatnonzero(size >= window if n == window else size == n)
            at = np.concatenate([np.arange(self.begin[k], self.begin[k + 1] - n + 1) for k in of])
            item = np.repeat(of, size[of] - n + 1).astype(np.int32)
            key = self.hashes.windows(h, n)[at]
            order = np.argsort(key, kind="stable")
            self.by_length[n] = key[order], item[order], at[order]

    def scan(self, found: list[bytes], hit: np.ndarray, got: set[str]) -> None:
        """Mark the hit words of one document and gather the items whose windows occur in it."""
        if not found or not self.by_length:
            return
        get = self.vocabulary.get
        h = np.array([get(w, 0) for w in found], dtype=np.uint64)
        run = np.concatenate([[0], np.cumsum(h != 0)])
        for n, (keys, item, at) in self.by_length.items():
            if len(found) < n:
                continue
            start = np.flatnonzero(run[n:] - run[:-n] == n)  # only where all words are some item's words
            if not len(start):
                continue
            here = self.hashes.windows(h, n)
            low = np.zeros(len(here), dtype=np.int64)
            low[start] = np.searchsorted(keys, here[start])
            start = start[keys[np.minimum(low[start], len(keys) - 1)] == here[start]]
            seen: dict[bytes, bool] = {}
            for k in start.tolist():
                words_here = b" ".join(found[k : k + n]) + b" "
                if words_here not in seen:
                    same = np.arange(low[k], np.searchsorted(keys, here[k], side="right"))
                    true = [j for j in same.tolist() if self.text[self.edge[at[j]] : self.edge[at[j] + n]] == words_here]  # the words themselves agree
                    got.update(i for j in true if (i := self.items[item[j]]) is not None)
                    seen[words_here] = bool(true)
                if seen[words_here]:
                    hit[k : k + n] = True


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")


#: What this worker built last, by the token of the broadcast.
_BUILT: dict[str, Index] = {}

Finder = Callable[[list[bytes], int], tuple[np.ndarray, list[str]]]


class Windows:
    """The benchmark's windows, held against document batches.

    marked() gives the documents with a column _marks where the benchmark is too large to be broadcast; finder() then reads it.
    """

    def __init__(self, items: DataFrame) -> None:
        self.items, self.spark = _items(items), items.sparkSession
        size = self.items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.small = size <= BROADCAST_CHARS
        self.token = uuid.uuid4().hex
        self.shared = self.spark.sparkContext.broadcast([tuple(r) for r in self.items.collect()]) if self.small else None

    def marked(self, docs: DataFrame, text: str) -> DataFrame:
        return docs if self.small else with_marks(docs, text, self.items)


def finder(batch: pa.RecordBatch, shared: object, token: str) -> Finder:
    """For a document's words and row: its hit words and the items found."""
    if shared is not None:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = Index(shared.value)
        index = _BUILT[token]

        def search(found: list[bytes], _: int) -> tuple[np.ndarray, list[str]]:
            hit, got = np.zeros(len(found), dtype=bool), set()
            index.scan(found, hit, got)
            return hit, sorted(got)

        return search
    marks = batch.column(batch.num_columns - 1)

    def read(found: list[bytes], row: int) -> tuple[np.ndarray, list[str]]:
        hit, mark = np.zeros(len(found), dtype=bool), marks[row].as_py() or {}
        for k, n in zip(mark.get("at") or (), mark.get("n") or (), strict=True):
            hit[k : k + n] = True
        return hit, sorted(mark.get("items") or ())

    return read


def with_marks(docs: DataFrame, text: str, items: DataFrame) -> DataFrame:
    """The documents with _marks (at, n: windows that are hit; items) as their last column, by a join of windows."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "windows")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, out = Hashes(), [[], [], [], []]
        for item, t in zip(batch.column("item").to_pylist(), texts(batch), strict=True):
            w = words(t)
            if w:
                h, n = hashes.words(w), min(WINDOW, len(w))
                a, b = (hashes.windows(h, n, k).view(np.int64) for k in (0, 1))
                for column, values in zip(out, ([item] * len(a), [n] * len(a), a.tolist(), b.tolist()), strict=True):
                    column += values
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "n", "h", "h2"])

    table = work.stage(map_batches(items, windows, "item string, n int, h bigint, h2 bigint").distinct(), "items")
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # WINDOW rows at most
    bit = F.explode(F.array(F.pmod("h", F.lit(FILTER_BITS)), F.pmod("h2", F.lit(FILTER_BITS)))).alias("bit")
    ones = table.select("h", "h2").distinct().select(bit).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("ones"))
    field = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for part in ones.toArrow().to_batches():  # FILTER_BITS / 32 rows at most
        field[part.column("at").to_numpy()] = part.column("ones").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(field)

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, out, field = Hashes(), [], shared.value
        for doc, print_, t in zip(batch.column("_doc").to_pylist(), batch.column("_print").to_pylist(), texts(batch, "_text"), strict=True):
            h = hashes.words(words(t))
            for n in lengths:
                a, b = (hashes.windows(h, n, k) for k in (0, 1))
                keep = np.ones(len(a), dtype=bool)
                for x in (a, b):
                    i = x % np.uint64(FILTER_BITS)  # a power of two, so that signed and unsigned remainders are one
                    keep &= (field[(i >> np.uint64(5)).astype(np.int64)] >> (i & np.uint64(31)).astype(np.uint32) & np.uint32(1)) == 1
                at = np.flatnonzero(keep)
                if len(at):
                    out.append((np.full(len(at), -1 if doc is None else doc), np.full(len(at), print_), np.full(len(at), n), at, a[at].view(np.int64), b[at].view(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["_doc", "_print", "n", "at", "h", "h2"])

    # rows with one id and one text have one answer; ids and texts are told apart by both
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_doc"), F.xxhash64(F.col(text).cast("string")).alias("_print"), F.col(text).cast("string").alias("_text"))
    hit = map_batches(keyed, candidates, "_doc bigint, _print bigint, n int, at int, h bigint, h2 bigint")
    hit = work.stage(hit.join(table.select("h", "h2", "n").distinct(), ["h", "h2", "n"], "left_semi"), "hits")
    of_items = hit.select("_doc", "_print", "n", "h", "h2").distinct().join(table, ["h", "h2", "n"]).filter("item is not null").select("_doc", "_print", "item").distinct()
    places = hit.select("_doc", "_print", "n", "at").distinct().groupBy("_doc", "_print").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    names = of_items.groupBy("_doc", "_print").agg(F.collect_list("item").alias("items"))
    marks = places.join(names, ["_doc", "_print"], "left").select(F.col("_doc").alias("_mark_doc"), F.col("_print").alias("_mark_print"), F.struct("at", "n", "items").alias("_marks"))
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-1)) == F.col("_mark_doc")) & (F.xxhash64(docs[text].cast("string")) == F.col("_mark_print"))
    return docs.join(marks, same, "left").drop("_mark_doc", "_mark_print")


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items found."""
    held = Windows(items)
    shared, token = held.shared, held.token

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        look = finder(batch, shared, token)
        for row, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)):
            found = words(text)
            hit, got = look(found, row)
            for k, v in zip(out, (doc, len(found), int(hit.sum()), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), len(got) >= MIN_ITEMS), strict=True):
                out[k].append(v)
        return pa.RecordBatch.from_pydict(out, schema=OUT)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(held.marked(slim, "text"), f, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what lies between two hit words in a row; one blank stands for a removed run."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(raw.translate(WORD_BYTES))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[at : spans[a][0]].rstrip(b" "))
        at = spans[b - 1][1]
        at += len(raw[at:]) - len(raw[at:].lstrip(b" .,;:!?"))
    out.append(raw[at:])
    return b" ".join(x for x in out if x.strip()).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Drop documents with windows of MIN_ITEMS items or more, cut hit words from the others. The columns stay as they are."""
    held, columns = Windows(items), docs.columns
    shared, token = held.shared, held.token
    where, counted = columns.index(text), columns.index(length) if length in columns else None

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        look, width = finder(batch, shared, token), len(columns)
        keep, new, sizes = [], batch.column(where).to_pylist(), batch.column(counted).to_pylist() if counted is not None else None
        for k, t in enumerate(new):
            hit, got = look(words(t or ""), k)
            if hit.any():
                new[k] = cut(t, hit)
                if sizes is not None:
                    sizes[k] = len(new[k])
            if len(got) < MIN_ITEMS and (new[k] or not t):  # a document that was nothing but benchmark text goes too
                keep.append(k)
        arrays = list(batch.columns)[:width]
        arrays[where] = pa.array(new, type=batch.schema.field(where).type)
        if sizes is not None:
            arrays[counted] = pa.array(sizes, type=batch.schema.field(counted).type)
        return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([batch.schema.field(k) for k in range(width)])).take(pa.array(keep, type=pa.int64()))

    return map_batches(held.marked(docs, text), f, docs.schema)
