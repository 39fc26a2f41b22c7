import random
from collections import defaultdict

from keyloom.llm import packing

from .helpers import AWKWARD, documents


def plain(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


def test_best_fit_equals_plain_version():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(60)
        sizes = sorted((rng.randrange(1, 51) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice([-1, 0, 0, 1, 2, 70]) for _ in range(n)], [rng.randrange(-1, 8) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 50) == plain(sizes, sources, clusters, 50)


def test_the_search_goes_on_to_the_tightest_compatible_bin():
    assert packing.best_fit([8, 7, 3, 2], [0, 1, 1, 0], [-1] * 4, 10) == [0, 1, 2, 1]


def rows(n, seed=3):
    rng = random.Random(seed)
    out = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))), "en", rng.choice(["hot", "hot", "a", "b", "c", None])) for k in range(n)]
    return out + [(n + k, "the very same copy of a text", "en", f"z{k}") for k in range(40)]


def check(spark, data, capacity=50, shard=64):
    got = packing.pack(documents(spark, data), capacity, shard).collect()
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_bin[r["bin_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    text, source = {d[0]: d[1] for d in data}, {d[0]: d[3] if len(d) > 3 else "s" for d in data}
    for b in by_bin.values():
        assert sum(r["n_tokens"] for r in b) <= capacity
        named = [source[r["doc_id"]] for r in b if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
        words = [tuple((text[r["doc_id"]] or "").lower().split()) for r in b if (text[r["doc_id"]] or "").split()]
        assert len(words) == len(set(words))
    return by_doc


def test_invariants(spark):
    data = rows(300) + [(1000, "long " * 333, "en", "a"), (1001, None, "en", None), (1002, "", "en", "b")]
    by_doc = check(spark, data)
    for doc, text, *_ in data:
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in pieces) == len((text or "").split()) + 1
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at)
            at += r["n_tokens"]
    assert len(by_doc[1000]) == 7


def test_awkward_rows_and_many_shards(spark):
    data = [r for r in AWKWARD]
    got = packing.pack(documents(spark, data), 2048, 4).collect()
    assert sum(r["piece"] == 0 for r in got) == len(data)
    same = [r["bin_id"] for r in got if r["doc_id"] == 10]
    assert len(same) == 2 and len(set(same)) == 2  # copies of one text
    assert packing.pack(documents(spark, data).filter("false")).count() == 0


def test_near_copies_do_not_share_a_bin(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(300)]  # one edit leaves pairs at a similarity of 0.93 at least
    edited = [" ".join(f"e{k}" if i == 7 * k else w for i, w in enumerate(base)) for k in range(40)]
    data = [(k, t, "en", f"s{k}") for k, t in enumerate(edited)] + [(100 + k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(300)), "en", f"s{100 + k}") for k in range(40)]
    got = packing.pack(documents(spark, data), 2048, 8192).collect()
    near = [r["bin_id"] for r in got if r["doc_id"] < 100]
    assert len(set(near)) >= 36 and len({r["bin_id"] for r in got}) <= 40  # others fill the same bins


def test_bands_of_equal_and_other_texts():
    assert packing.bands("") == [] and packing.bands("A b c") == packing.bands("a  B c") and not set(packing.bands("a b c d e f")) & set(packing.bands("g h i j k l"))
    assert len(packing.bands("one")) == packing.BANDS and len(packing.bands("word " * 100_000)) == packing.BANDS
