import hashlib
import re

import numpy as np

from keyloom.llm import decontaminate as d
from .helpers import AWKWARD, documents, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, got = [False] * len(w), set()
        for item, t in items:
            v = words(t)
            n = min(8, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    if item is not None:
                        got.add(str(item))
        out.append((doc, len(w), sum(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(got) >= 2))
    return sorted(out, key=repr)


ITEMS = [(10, "Alpha beta, gamma delta; epsilon zeta eta theta iota."), (9, "alpha beta gamma delta epsilon zeta eta theta kappa"), (7, "short item"), (7, "short item"), (3, None), (4, "..."), (None, "an item that has no id but eight words here"), (100, "one")]
DOCS = [(1, "x ALPHA beta gamma delta epsilon zeta eta theta iota y"), (2, "a Short,Item b"), (3, "An item that has no id but eight words here!"), (4, "alpha beta gamma delta epsilon zeta eta"), (5, "alpha beta gamma delta epsilon zeta eta theta alpha beta gamma delta epsilon zeta eta theta iota")]


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_scan_equals_plain_version(spark):
    docs = DOCS + AWKWARD
    got = d.scan(documents(spark, docs), items_of(spark, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, ITEMS)


def test_beyond_the_broadcast_bound_the_same(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_CHARS", 60)
    docs = DOCS + AWKWARD
    assert not d.Windows(items_of(spark, ITEMS)).small
    got = d.scan(documents(spark, docs), items_of(spark, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, ITEMS)
    clean = d.decontaminate(documents(spark, docs), items_of(spark, ITEMS))
    assert clean.schema == documents(spark, docs).schema
    monkeypatch.setattr(d, "BROADCAST_CHARS", 4_000_000)
    want = d.decontaminate(documents(spark, docs), items_of(spark, ITEMS)).collect()
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, want))
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = sorted(map(tuple, d.scan(docs, items).collect()))
    monkeypatch.setattr(d, "BROADCAST_CHARS", 60)
    assert sorted(map(tuple, d.scan(docs, items).collect())) == want


def test_the_broadcast_is_a_few_bytes_a_character():
    import random

    rng = random.Random(3)
    items = [(str(k), " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(400))) for k in range(200)]
    index = d.Index(items)
    held = sum(x.nbytes for part in index.by_length.values() for x in part) + index.edge.nbytes + len(index.text)
    assert held < 8 * sum(len(t) for _, t in items)


def test_given_tables(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((tuple(r) for r in d.scan(docs, items).collect()), key=repr) == want


def test_decontaminate_cuts_hits_and_drops_documents(spark):
    docs = documents(spark, [*DOCS, (6, "clean text, left alone."), (7, None), (8, "short item")])
    out = d.decontaminate(docs, items_of(spark, ITEMS))
    assert out.schema == docs.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {2: ("a b", 3), 4: ("alpha beta gamma delta epsilon zeta eta", 39), 6: ("clean text, left alone.", 23), 7: (None, None)}
    assert d.scan(out, items_of(spark, ITEMS)).filter("n_hit > 0").count() == 0


def test_cut_keeps_what_is_not_hit():
    assert d.cut("é one two. Three four", np.array([False, True, True, False, False])) == "é Three four"
    assert d.cut("one", np.array([True])) == ""


def test_empty_tables(spark):
    docs, items = documents(spark, DOCS), items_of(spark, ITEMS)
    assert d.scan(docs.filter("false"), items).count() == 0
    assert d.scan(docs, items.filter("false")).filter("n_hit > 0 or n_items > 0").count() == 0
