import random

import pytest

from keyloom.llm import near_dup
from keyloom.llm.components import components
from keyloom.llm.common import Workspace
from .helpers import AWKWARD, documents, table


def plain(rows):
    """(shingle set size, component) by comparing all pairs."""
    sets, of = {}, {}
    for doc, text in rows:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        if doc is not None:
            sets.setdefault(doc, []).append(s)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}, sets


def check(spark, rows):
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    component, sets = plain(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
            assert (r["component_id"], r["kept"]) == (component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"]), r
    return component


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_awkward_rows(spark):
    check(spark, AWKWARD)


def test_links_at_the_threshold(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    rows = [(k, " ".join(base[: 104 - cut])) for k, cut in enumerate((0, 25, 26, 44, 45))]  # 75 of 100 links, 74 does not
    component = check(spark, rows)
    assert component[1] == 0


@pytest.mark.parametrize("block", [1_500_000, 3_000])
def test_groups_of_near_copies_that_hardly_link(spark, monkeypatch, block):
    """Copies at distances around the threshold, exact copies, and a passage that all documents share."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 40)
    rng = random.Random(5)
    base, passage = [f"b{k}" for k in range(120)], " ".join(f"p{k}" for k in range(40))
    rows = [(1000 + k, edited(base, rng, rng.randrange(0, 9))) for k in range(150)]
    rows += [(2000 + k, " ".join(base)) for k in range(30)]
    rows += [(3000 + k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))) + " " + passage) for k in range(60)]
    rows += [(4000 + k, f"{passage} y{k}") for k in range(5)]
    rng.shuffle(rows)
    component = check(spark, rows)
    assert len(set(component.values())) < len(component)


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    check(spark, rows)


def test_keep_one_returns_the_same_columns(spark):
    rows = [(3, "a b c d e f"), (1, "A B C d e f"), (2, "other words that stand here alone"), (2, "other words that stand here alone"), (None, "no id"), (5, None)]
    docs = documents(spark, rows)
    kept = near_dup.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None and r["text"]) == [(1, "A B C d e f"), (2, "other words that stand here alone")]
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 5").count() == 1


def test_different_texts_under_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near_b = b.replace("b39", "other")
    rows = [(7, a), (7, b), (7, b), (3, a + " more"), (9, near_b), (9, c), (7, None), (7, " "), (8, ""), (None, b), (None, b)]
    kept = [sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dup.keep_one(documents(spark, order)).collect()) for order in (rows, rows[::-1])]
    assert kept[0] == kept[1] == sorted([(7, b), (3, a + " more"), (9, c), (7, ""), (8, ""), (0, b), (0, b)])


def test_empty_table(spark):
    assert near_dup.near_duplicates(documents(spark, AWKWARD).filter("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df, Workspace(spark, "t"), "cc").collect()}
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(df.filter("false"), Workspace(spark, "t"), "none").count() == 0


def test_a_link_is_hardly_ever_missed():
    from math import comb

    missed = sum(comb(near_dup.K, k) * 0.75**k * 0.25 ** (near_dup.K - k) for k in range(near_dup.T))
    assert missed < 1e-10


@pytest.mark.parametrize("one", [True, False])
def test_merged_lists_give_all_pairs_with_enough_collisions(one):
    """Components that are tied by pairs of T collisions and the sets' similarity, by plain comparison of all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    bases = rng.integers(0, 1 << 60, (6, 300)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(bases[i % 6])[: rng.integers(220, 301)], rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)])) for i in range(90)]
    sigs = np.stack([near_dup.signature(s) for s in sets])
    side = np.zeros(90, dtype=int) if one else np.arange(90) // 6 % 2
    ids = np.arange(90)
    got = near_dup.meet(ids, side, ids, sigs, sets)
    want = [(a, b) for a in range(90) for b in range(a + 1, 90) if (one or side[a] != side[b]) and (sigs[a] == sigs[b]).sum() >= near_dup.T and near_dup.linked(sets[a], sets[b])]

    def groups(links):
        parent = list(range(90))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(90)]

    assert groups(got) == groups(want) and 0 < len(got) <= len(want)
