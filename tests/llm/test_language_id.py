import zlib

import numpy as np

from keyloom.llm import language_id as li

from .helpers import AWKWARD, documents, table


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    net = li.Network.fresh(["a", "b", "c"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, w = rng.integers(0, 4, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((6, 5))
    w[4:, 0] = 0
    _, grads = net.gradients(x, y, w)
    for name in net.NAMES:
        a = net.weights[name]
        for _ in range(6):
            i = tuple(int(rng.integers(0, s)) for s in a.shape)
            i = (*i[:2], i[2] % 4) if name == "table" else i
            a[i] += 5e-3
            up = net.gradients(x, y, w)[0]
            a[i] -= 1e-2
            down = net.gradients(x, y, w)[0]
            a[i] += 5e-3
            assert abs(grads[name][i] - (up - down) / 1e-2) < 1e-4


def slow(net, raw):
    """Mean probabilities, one byte at a time."""
    t, u, w, b = (net.weights[k].astype(np.float64) for k in net.NAMES)
    hidden, out = u.shape[2], np.zeros(len(net.languages))
    starts = [min(k, max(len(raw) - li.STEPS, 0)) for k in range(0, len(raw), li.STEPS)]
    for k, s in zip(range(0, len(raw), li.STEPS), starts, strict=True):
        window = list(raw[s : s + li.STEPS].ljust(li.STEPS, b"\0"))
        states = np.zeros((2, li.STEPS, hidden))
        for d in (0, 1):
            h = np.zeros(hidden)
            for i in range(li.STEPS) if d == 0 else reversed(range(li.STEPS)):
                g, r = t[d, :, window[i]], u[d] @ h
                z, e = (1 / (1 + np.exp(-(g[j * hidden : (j + 1) * hidden] + r[j * hidden : (j + 1) * hidden]))) for j in (0, 1))
                c = np.tanh(g[2 * hidden :] + e * r[2 * hidden :])
                h = (1 - z) * c + z * h
                states[d, i] = h
        for i in range(k - s, min(len(raw) - s, li.STEPS)):
            o = w @ np.concatenate([states[0, i], states[1, i]]) + b[:, 0]
            p = np.exp(o - o.max())
            out += p / p.sum()
    return out / len(raw)


def test_fast_pass_equals_slow_pass():
    net, rng = li.Network.fresh(["a", "b", "c"]), np.random.default_rng(1)
    raw = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (1, 7, 63, 64, 65, 200)]
    got = net.documents([*raw, b""])
    assert np.allclose(got[:-1], [slow(net, x) for x in raw], atol=1e-5) and not got[-1].any()


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    rows = li.identify(docs, li.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97
    assert all(0 < r["score"] <= 1 for r in rows)


def test_language_column_of_held_out_rows_is_not_used(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    lied = docs.withColumn("lang", F.when(li.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = li.learn(docs), li.learn(lied)
    assert a.languages == b.languages and all((a.weights[k] == b.weights[k]).all() for k in a.NAMES)


def test_awkward_rows(spark):
    train = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 5, "en" if k % 2 else "de") for k in range(200, 260)]
    docs = documents(spark, train + AWKWARD)
    rows = li.identify(docs, li.learn(docs)).collect()
    assert len(rows) == len(train) + len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    for k in (1, 2, 3, 11):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert all(by[k]["lang_pred"] in ("en", "de") for k in (4, 5, 7, 8, 9)) and by[201]["lang_pred"] == "en" and by[200]["lang_pred"] == "de"
    assert not by[None]["held_out"]
    kept = li.keep_identified(docs, li.learn(docs), 0.4)
    assert kept.schema == docs.schema and {1, 2, 3, 11}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_every_language_is_learnt(spark):
    names = [f"l{k:02}" for k in range(70)]  # the last ones have the fewest rows
    word = {lang: chr(0x4E00 + 64 * (k // 10)) + chr(0x3041 + k % 10) for k, lang in enumerate(names)}  # letters without case
    rows = [(1000 * k + i, f"{word[lang]} " * 12, lang) for k, lang in enumerate(names) for i in range(8 if k < 64 else 6)]
    docs = documents(spark, rows)
    network = li.learn(docs)
    assert network.languages == names
    lang = {r[0]: r[2] for r in rows}
    late = [(r["lang_pred"], lang[r["doc_id"]]) for r in li.identify(docs, network).collect() if lang[r["doc_id"]] >= "l64"]
    assert sum(a == b for a, b in late) > len(late) / 2


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "text", None), (2, "text", None)])
    assert li.learn(docs) is None
    assert {r["lang_pred"] for r in li.identify(docs, None).collect()} == {"und"}
    assert li.learn(docs.filter("false")) is None and li.identify(docs.filter("false"), None).count() == 0


def test_wanted_languages_and_labels(spark, monkeypatch):
    train = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 5, "en" if k % 2 else "de") for k in range(200, 260)]
    docs = documents(spark, [*train, (300, "the cat and the dog " * 4, None), (301, "der hund und die katze " * 4, None), (302, "123", None), (303, None, "en")])
    network = li.learn(docs)
    kept = {r["doc_id"]: r["lang"] for r in li.keep_identified(docs, network, 0.4).collect()}
    assert kept[300] == "en" and kept[301] == "de" and 302 not in kept and 303 not in kept and len(kept) == 62
    german = {r["doc_id"]: r["lang"] for r in li.keep_identified(docs, network, 0.4, frozenset(["de"])).collect()}
    assert set(german.values()) == {"de"} and 301 in german and 300 not in german


def test_a_repeated_id_does_not_widen_the_sample(spark, monkeypatch):
    monkeypatch.setattr(li, "PER_LANGUAGE", 5)
    seen = []
    monkeypatch.setattr(li.Network, "train", lambda self, x, y, weight: seen.append(len(x)))
    li.learn(documents(spark, [(200, f"text number {k} with words", "en") for k in range(400)]))
    assert seen == [5 * li.WINDOWS]
