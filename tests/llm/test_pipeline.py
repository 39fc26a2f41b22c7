import random
from collections import Counter

import xxhash

import corpus_pipeline
from keyloom.llm import decontaminate, language_id, packing, pii, queries

from . import test_decontaminate, test_language_id, test_near_dup, test_pii
from .helpers import AWKWARD, documents, table


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").collect()
    extra = [
        (10_001, "12345 67890 !!!", "en"), (10_002, docs.orderBy("doc_id").first()["text"], "fr"), (10_003, items[0]["text"] + "\n" + items[1]["text"], "en"), (10_004, "Write to me at some.one@mail.example.com about the reading of these plain and simple words.", "en"),
    ]
    docs = docs.unionByName(documents(spark, extra, clash=False))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    language, near, clean, private = seen
    assert 10_001 not in language and 10_002 in language
    assert 10_002 not in near and 10_003 in near
    assert 10_003 not in clean
    assert "[EMAIL]" in private[10_004] and len(private) == len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(private)


def test_awkward_rows_pass_through_all_stages(spark, sf_dir):
    docs = documents(spark, AWKWARD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    docs.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "n_tokens", "bin_id"] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "packing"]


def test_queries_are_named_and_columns_agree(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    want = {
        "op1": ["page_id", "host", "path", "rule", "verdict"], "op2": ["page_id", "url", "text", "n_chars"], "op3": ["doc_id", "n_shingles", "component_id", "kept"], "op4": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op6": ["query_id", "rank", "vec_id", "score"], "op7": ["doc_id", "start", "n_tokens", "ids_crc32"], "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op9": ["doc_id", "held_out", "lang_pred", "score"],
    }
    for name, f in queries.QUERIES.items():
        if (op := name.split("_")[0]) in want:
            assert f(spark, sf_dir).columns[: len(want[op])] == want[op]


def small_corpus(rng):
    """Documents of two languages with copies, benchmark passages, personal data, junk, nulls."""
    words = {"en": "the of and house river stone walk green with over under light".split(), "de": "der die und haus fluss stein gehen mit unter licht nacht auf".split()}
    item = [" ".join(f"item{k}w{i}" for i in range(12)) for k in range(3)]
    draw = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(k, draw("de" if k % 2 else "en", rng.randrange(20, 120)), "de" if k % 2 else "en", f"s{rng.randrange(6)}") for k in range(70)]
    rows += [(100 + k, rows[k][1].upper() if k % 3 else rows[k][1].replace(rows[k][1].split()[9], "edited", 1), rows[k][2], f"t{k}") for k in range(20)]
    rows += [(200 + k, f"{draw('en', 15)} {item[k % 3]} {draw('en', 15)}" + (f" {item[(k + 1) % 3]}" if k % 2 else ""), "en", "bench") for k in range(8)]
    rows += [(300 + k, f"{draw('en', 10)} write to jo{k}@mail.example.com or +1 (864) 555-2{k:03} token = 24be64439e3e49cf46b2d7c90f36{k:04} {draw('en', 10)}", "en", None) for k in range(8)]
    return rows + [(400, None, "en", "x"), (401, "12345 !!", "en", "x"), (402, "", None, "x"), (403, item[0], "en", "x"), (404, draw("de", 5000), None, "long")], list(enumerate(item))


def brute(rows, items, network):
    """All stages one document at a time."""
    kept = []
    for doc, text, _, source in rows:
        raw = language_id.as_bytes(text or "")
        if any(c.isalpha() for c in text or "") and test_language_id.slow(network, raw).max() >= corpus_pipeline.LEAST_SCORE:
            kept.append((doc, text, source))
    component, _ = test_near_dup.plain([(d, t) for d, t, _ in kept])
    kept = [r for r in kept if component[r[0]] == r[0]]
    clean = []
    for doc, text, source in kept:
        w, found = test_decontaminate.words(text), set()
        hit = [False] * len(w)
        for k, t in items:
            v = test_decontaminate.words(t)
            for i in range(len(w) - 7):
                if any(w[i : i + 8] == v[j : j + 8] for j in range(len(v) - 7)):
                    hit[i : i + 8] = [True] * 8
                    found.add(k)
        left = decontaminate.cut(text, decontaminate.np.array(hit)) if any(hit) else text
        if len(found) < 2 and left:
            clean.append((doc, left, source))
    spans = lambda t: [x for x, _ in pii.clear_of(pii.other_candidates(t), test_pii.plain(t))]
    model = pii.Model(Counter(pii.pattern_of(t, x) for _, t, _ in clean for x in test_pii.plain(t) + spans(t)))
    hidden = []
    for doc, text, source in clean:
        for a, b, kind in sorted(test_pii.plain(text) + [x for x in spans(text) if model.probability(pii.pattern_of(text, x)) >= 0.5], reverse=True):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        hidden.append((doc, text, source))
    pieces = []
    for doc, text, source in hidden:
        w = text.encode().lower().split()
        cluster, n = xxhash.xxh3_64_intdigest(b" ".join(w)) >> 1, len(w) + 1
        pieces += [(-min(packing.CAPACITY, n - at), cluster, doc, k, at, source, packing.bands(text)) for k, at in enumerate(range(0, n, packing.CAPACITY))]
    pieces.sort(key=lambda x: x[:4])
    number = {}
    small = [[number.setdefault(("c", x[1]), len(number)), *(number.setdefault(b, len(number)) for b in x[6])] for x in pieces]
    bins, out = [], []
    for (n, _, doc, k, at, source, _), clusters in zip(pieces, small, strict=True):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= -n and (source is None or source not in b["s"]) and not b["c"] & set(clusters)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": packing.CAPACITY, "s": set(), "c": set()})
        bins[i]["left"] += n
        bins[i]["s"].add(source)
        bins[i]["c"] |= set(clusters)
        out.append((doc, k, at, -n, i))
    return sorted(out)


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = small_corpus(random.Random(4))
    docs = documents(spark, rows, clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    network = language_id.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, f"file://{tmp_path}").collect()))
    want = brute(rows, items, network)
    assert got == want and 60 < len({r[0] for r in want}) < len(rows)


def test_empty_tables(spark, tmp_path):
    rows, items = small_corpus(random.Random(5))
    docs, bench = documents(spark, rows, clash=False), spark.createDataFrame(items, "item_id bigint, text string")
    for name, d, b, n in (("none", docs.filter("false"), bench, 0), ("plain", docs, bench.filter("false"), 80)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        b.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert (corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").count() >= n) and (n or corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").count() == 0)
