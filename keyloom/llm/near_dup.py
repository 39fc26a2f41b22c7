"""MinHash near-duplicates by an inverted join over signature coordinates, confirmed on whole shingle sets.

1. Each text becomes its set of 5-word shingles (64-bit hashes), its size, a 128-bit fingerprint of the set and a signature of
   K minima. Texts with equal sets are one class; its representative is the smallest doc_id. From here on only
   representatives count, so a text copied a million times is one row.
2. Inverted join: every representative is posted under each (coordinate, value) pair that another shares. Two sets at
   similarity 0.75 agree in 48 of 64 coordinates on average; a pair needs T = 24 agreements. A link at exactly 0.75 has fewer with
   probability 5e-11 (the binomial tail; 7 standard deviations), a stronger one far less often. A document with fewer than T shared
   pairs has no partner. Prefix: of n shared pairs only the n - T + 1 rarest are posted, since two documents with T common pairs
   have at least one of those in common; the T - 1 most frequent pairs, those of passages on very many pages, are skipped.
3. Hubs: of each posting list, the member whose pairs are the most frequent (the likeliest common original) and one by hash are
   proposed to all others: linear in the postings, whatever the size of a list. Agreements are counted on whole signatures,
   each document's best proposal is confirmed on the shingle sets, and components are formed.
4. The rest: lists whose members lie in several components so far join these to loose groups. Inside a group the posting lists of
   documents from different components are merged and collisions counted, with prefix and skip: a document's rarest lists are
   merged, its T - 1 longest are skipped and looked up only for the candidates that the merge gives. Pairs of T collisions or more
   are confirmed on the sets. Pairs are counted inside a task; only links that join two components are emitted. A hot list is so
   split by pairs of slices: groups are cut into blocks of at most BLOCK_SHINGLES and, growing with the root of the group, at most
   BLOCK_DOCS documents; every pair of blocks meets, and the largest component of a group is not held against itself.

So no pair is lost to a cap, and neither copies nor near copies are expanded into all pairs.

Defined results: null or empty texts, or texts without words, have n_shingles 0 and are linked with nothing; texts of fewer
than 5 words are one shingle. Very long texts are read whole. An empty table gives no rows. Rows that repeat a doc_id are one document as far as links go, and each gets its row. A row with
a null doc_id has a null component_id, is linked with nothing and kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import WordHash, Workspace, broadcast_if_few, map_batches, runs_hash, texts
from keyloom.llm.components import components

SHINGLE, K, T = 5, 64, 24
#: A link: 100 * intersection >= LEAST * union.
LEAST = 75
#: Shingles (8 bytes each) and documents of one block; two blocks meet in a task. Blocks of a group have ROOTS times the root of its
#: documents, LEAST_DOCS at least, so that a group of some hundreds is not one task's.
BLOCK_SHINGLES, BLOCK_DOCS, LEAST_DOCS, ROOTS = 1_500_000, 2000, 150, 8
MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_HASH: list[WordHash] = []


def shingles(text: str) -> np.ndarray:
    """The distinct shingles' hashes, ascending. bytes.lower and bytes.split know ASCII letters and white space only."""
    if not _HASH:
        _HASH.append(WordHash())
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(runs_hash(_HASH[0](words), SHINGLE)) if words else np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(low, (s[k : k + 1024, None] * MULTIPLIERS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


SKETCH = "doc_id bigint, n bigint, f1 bigint, f2 bigint, sig array<int>"


def sketch(docs: DataFrame) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, prints, sigs = [], [], []
        for t in texts(batch):
            s = shingles(t)
            size.append(len(s))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sigs.append(signature(s))
        p = np.frombuffer(b"".join(prints), dtype=np.int64).reshape(-1, 2)
        sig = pa.ListArray.from_arrays(pa.array(np.arange(0, K * len(size) + 1, K, dtype=np.int32)), pa.array(np.concatenate(sigs)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), sig], names=["doc_id", "n", "f1", "f2", "sig"])

    return map_batches(_slim(docs), f, SKETCH)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def agreements(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The sets (ascending) are at the similarity of a link."""
    if min(len(a), len(b)) * 100 < LEAST * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= LEAST * (len(a) + len(b) - common)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("raw").alias(f"raw_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [linked(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(batch.column("raw_a"), batch.column("raw_b"), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select("a", "b", "raw_a", "raw_b"), f, "a bigint, b bigint")


def meet(ids: np.ndarray, side: np.ndarray, comp: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join two components, among documents of side 0 with those of side 1 (or among all, if there is one side).

    Candidates come from the posting lists of (coordinate, value) pairs: of a document's n lists with others the n - T + 1 shortest
    are merged, the T - 1 longest are skipped and looked up for the candidates alone.
    """
    one = bool((side == side[0]).all())
    _, inverse, df = np.unique((np.arange(K, dtype=np.int64) << 32) | (sigs.astype(np.int64) & 0xFFFFFFFF), return_inverse=True, return_counts=True)
    pairs = inverse.reshape(-1, K)
    posted = np.arange(len(sets)) if one else np.flatnonzero(side == 1)
    flat = pairs[posted].ravel()
    order = np.argsort(flat, kind="stable")
    owner, edges = posted[order // K], np.searchsorted(flat[order], np.arange(len(df) + 1))
    length = np.diff(edges)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    parent = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for k in range(len(sets)):
        if not one and side[k] == 1:
            continue
        lists = pairs[k][df[pairs[k]] > 1]
        if len(lists) < T:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")][: len(lists) - T + 1]
        c = np.unique(np.concatenate([owner[edges[e] : edges[e + 1]] for e in lists.tolist()]))
        c = c[(c > k) if one else slice(None)]
        c = c[(comp[c] != comp[k]) & (size[c] * 100 >= LEAST * size[k]) & (size[k] * 100 >= LEAST * size[c])]
        agree = (sigs[c] == sigs[k]).sum(axis=1)
        c, agree = c[agree >= T], agree[agree >= T]
        for j in c[np.argsort(-agree, kind="stable")].tolist():
            a, b = root(int(comp[k])), root(int(comp[j]))
            if a != b and linked(sets[k], sets[j]):
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[k]), int(ids[j])))
    return out


def _rest(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside loose groups. groups: id, comp, grp, n, sig."""
    sizes = groups.groupBy("grp", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    whole = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp", "docs")).alias("top"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    def parts(n: F.Column, docs: F.Column) -> F.Column:
        each = F.least(F.lit(float(BLOCK_DOCS)), F.greatest(F.lit(float(LEAST_DOCS)), ROOTS * F.sqrt(docs)))
        return F.greatest(F.lit(1), F.ceil(n / BLOCK_SHINGLES), F.ceil(docs / each)).cast("int")

    largest = whole.select("grp", F.col("top.comp").alias("top"), parts(F.col("top.n"), F.col("top.docs")).alias("nc"), parts(F.col("n") - F.col("top.n"), F.col("docs") - F.col("top.docs")).alias("nx"))
    g = groups.join(largest, "grp")
    main = F.col("comp") == F.col("top")
    block = F.when(main, F.pmod(F.xxhash64("id"), F.col("nc"))).otherwise(F.pmod(F.xxhash64("id"), F.col("nx"))).cast("int")
    g = g.withColumns({"main": main, "block": block})
    # a document of the largest component meets each block of the others; a document of the others meets all blocks
    rest = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"), (F.col("block") > j).cast("int").alias("side")))
    top = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"), F.lit(0).alias("side")))
    own = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda j: F.struct(j.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(1).alias("side")))
    g = g.withColumn("at", F.explode(F.when(F.col("main"), own).otherwise(F.concat(rest, top)))).select("grp", "at.i", "at.j", "at.side", "id", "comp", "sig")
    g = g.join(sets, "id").select("grp", "i", "j", "side", "id", "comp", "sig", "raw")

    def f(t: pa.Table) -> pa.Table:
        # which of two blocks a document is of; blocks of the others that meet themselves have one side
        found = meet(
            t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("comp").to_numpy(),
            np.array(t.column("sig").combine_chunks().flatten()).reshape(-1, K), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("raw")],
        ) if t.num_rows > 1 else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return g.groupBy("grp", "i", "j").applyInArrow(f, "a bigint, b bigint")


def classes(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(sketch, class to component): class key n, f1, f2, its representative and component."""
    sk = work.stage(sketch(docs), "sketch")
    cls = work.stage(sk.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes", sk.count())
    n = cls.count()
    posted = cls.select("id", F.posexplode("sig").alias("k", "v")).select("id", F.shiftleft(F.col("k").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("e"))
    # counts are joined from a table: both sides are then plain exchanges, and a pair on very many documents is split
    df = work.stage(posted.groupBy("e").count().filter("count > 1"), "frequent", 4 * n)
    shared = posted.join(df, "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "e"))).alias("l"), F.sum("count").alias("pop")).filter(F.size("l") >= T)
    pre = shared.select("id", "pop", F.transform(F.slice("l", F.lit(1), F.size("l") - T + 1), lambda x: x["e"]).alias("prefix"))
    pre = work.stage(pre.join(cls.select("id", "n", "sig"), "id"), "prefix", 8 * n)
    n = pre.count()
    postings = pre.select("id", "pop", F.explode("prefix").alias("e"))
    hubs = postings.groupBy("e").agg(F.max(F.struct("pop", "id")).alias("h1"), F.min(F.struct(F.xxhash64("e", "id").alias("h"), "id")).alias("h2"), F.count("*").alias("c")).filter("c > 1")
    hubs = work.stage(hubs.select("e", F.col("h1.id").alias("h1"), F.col("h2.id").alias("h2")), "hubs", 4 * n)
    near = postings.select("id", "e").join(hubs, "e").select("id", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("hub")).filter("id != hub").distinct()
    near = near.join(pre.select("id", F.col("sig").alias("sa")), "id").join(pre.select(F.col("id").alias("hub"), F.col("sig").alias("sb")), "hub")
    best = near.select("id", "hub", agreements("sa", "sb").alias("m")).filter(F.col("m") >= T).groupBy("id").agg(F.max(F.struct("m", "hub")).alias("x")).select("id", F.col("x.hub").alias("hub"))
    best = work.stage(best.select(F.col("id").alias("a"), F.col("hub").alias("b")), "best", 8 * n)
    members = pre.select("id").distinct()
    sets = work.stage(_sets(docs, members), "sets")
    links = work.stage(_confirm(best, sets), "links-1", 16 * n)
    first = components(links, work, "cc1", n)
    comp = lambda x: F.coalesce("component", x)
    pre_c = work.stage(pre.select("id", "n", "sig", "prefix").join(first.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "sig", "prefix", comp("id").alias("comp")), "placed", 4 * n)
    # lists with members of several components tie these to loose groups
    seen = pre_c.select("comp", F.explode("prefix").alias("e")).distinct()
    low = work.stage(seen.groupBy("e").agg(F.min("comp").alias("low"), F.count("*").alias("c")).filter("c > 1"), "low", 2 * n)
    ties = seen.join(low, "e").filter("comp != low").select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct()
    loose = components(ties, work, "cc2", n)
    groups = pre_c.select("id", "n", "sig", "comp").join(loose.select(F.col("node").alias("comp"), F.col("component").alias("grp")), "comp")
    more = work.stage(_rest(groups, sets), "links-2")
    final = components(links.unionAll(more), work, "cc3", n)
    of = cls.select("n", "f1", "f2", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("n", "f1", "f2", comp("id").alias("component_id"))
    work.drop("frequent", "low", "prefix", "hubs", "best", "sets", "placed")
    return sk, of


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(t).tobytes() for t in texts(batch)], pa.binary())], names=["id", "raw"])

    rows = _slim(docs).join(broadcast_if_few(members.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
    return map_batches(rows.select("doc_id", "text"), f, "id bigint, raw binary")


def near_duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sk, of = classes(docs, work or Workspace(docs.sparkSession, "neardup"))
    rows = sk.select("doc_id", "n", "f1", "f2").join(of, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that are near-duplicates of one with a smaller doc_id; columns as they are.

    If a doc_id repeats, each row is a document of its own, in the order of doc_id, text and other columns: different texts under
    one id all stay, of equal or near ones (and of those without words under one id) the first.
    """
    work = Workspace(docs.sparkSession, "neardup")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _keep_one_row(docs, work)
    found = work.stage(near_duplicates(docs, work), "result", docs.select("doc_id").count())
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone"))
    gone = broadcast_if_few(gone)  # else the texts would move
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def _keep_one_row(docs: DataFrame, work: Workspace) -> DataFrame:
    """As keep_one, by row numbers that keep the order of doc_id."""
    sortable = [F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    rows = work.stage(docs.sort(F.col("doc_id").asc_nulls_last(), "text", *sortable).withColumn("_row", F.monotonically_increasing_id()), "rows")
    numbered = rows.filter("doc_id is not null")
    found = work.stage(near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text"), work), "result")
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone"))
    blank = numbered.join(found.filter("n_shingles = 0").select(F.col("doc_id").alias("_row")), "_row", "left_semi").select("doc_id", "_row")
    first = blank.groupBy("doc_id").agg(F.min("_row").alias("_first"))
    gone = gone.unionAll(blank.join(first, "doc_id").filter("_row > _first").select(F.col("_row").alias("_gone")))
    gone = broadcast_if_few(work.stage(gone, "gone"))
    return rows.join(gone, rows["_row"] == gone["_gone"], "left_anti").select(*docs.columns)
