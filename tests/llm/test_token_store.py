import json
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import token_store as ts

from .helpers import AWKWARD, documents

vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def test_encoder_equals_the_library(library):
    rng, encode = random.Random(1), ts.WordEncoder(vocabulary, bound=50)
    letters = [*"aAbÉé 's'tḈ̧ \n\t  \x1c\x0b123 !?|<>ΣςΟ中文🙂", "<|endoftext|>", "don't", " <|startoftext|> ", " | "]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert np.frombuffer(encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), dtype=np.int64)
    m = ts.Mph.from_bytes(ts.Mph.build(k, np.arange(len(k))).to_bytes())
    assert m.lookup(k).tolist() == list(range(len(k)))
    assert len(m.fingerprint) == len(k)  # minimal
    absent = np.array([x for x in range(-50, 50) if x not in keys], dtype=np.int64)
    assert (m.lookup(absent) == ts.NO_POSITION).sum() >= len(absent) - 1


def plain(rows, library):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out, start


def test_files_are_read_back(spark, tmp_path, library):
    rows = [r for r in AWKWARD if r[0] != 8] + [(100 + k, f"Doc {k} " + "word " * (k % 7)) for k in range(200)] + [(-5, "negative key")]
    root = f"file://{tmp_path}/store"
    manifest = ts.write(documents(spark, rows), root, vocabulary, 2)
    got = ts.read_back(spark, root, manifest).collect()
    want, total = plain(rows, library)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [w[0] for w in want]
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1]]
    assert sum(os.path.getsize(tmp_path / "store" / f) for f in os.listdir(tmp_path / "store") if f.endswith(".ids")) == 2 * total
    store = ts.Store(root)
    assert [x.tolist() for x in store.get(5)] == [[*library.encode("one two three four five", add_special_tokens=False).ids, 2]]
    assert len(store.get(10)) == 2 and store.get(99) == [] and len(store.get(-5)) == 1
    assert [x.tolist() for x in store.get(1)] == [[2]]
    assert json.loads((tmp_path / "store/manifest.json").read_text())["end_id"] == 2
    assert not [f for f in os.listdir(tmp_path / "store") if len(f.split(".")) > 2]  # nothing half-written


def test_empty_table(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    manifest = ts.write(documents(spark, AWKWARD).filter("false"), root, vocabulary, 2)
    assert manifest["shards"] == [] and ts.read_back(spark, root, manifest).count() == 0 and ts.Store(root).get(1) == []


def test_a_lookup_reads_a_slot_and_no_table(tmp_path, spark, library, monkeypatch):
    monkeypatch.setattr(ts, "LEAST_IDS", 3000)
    root = f"file://{tmp_path}/many"
    rows = [(7 * k, f"Doc {k} has words") for k in range(2500)] + [(7, "again")] * 40
    manifest = ts.write(documents(spark, rows), root, vocabulary, 2)
    assert len(manifest["shards"]) > 2
    store = ts.Store(root)
    assert store.get(7 * 2000)[0].tolist() == [*library.encode("Doc 2000 has words", add_special_tokens=False).ids, 2] and len(store.get(7)) == 41
    assert [store.get(k) for k in (-1, 8, 7 * 2500, 10**12)] == [[], [], [], []]
    shard = next(iter(store.opened.values()))
    read, real = [], shard.index

    class Counting:
        def read_at(self, n, at):
            read.append(n)
            return real.read_at(n, at)

    shard.index = Counting()
    assert len(list(shard.get(7 * 2000))) == 1 and sum(read) <= ts.SLOT.itemsize + 16  # the slot, the key and its neighbour


def test_a_key_on_many_rows_is_dealt_to_several_shards(tmp_path, spark, library, monkeypatch):
    monkeypatch.setattr(ts, "LEAST_IDS", 1000)
    root = f"file://{tmp_path}/hot"
    rows = [(k, f"own text {k}") for k in range(300)] + [(150, f"text {k} under one key") for k in range(1500)] + [(None, f"no key {k}") for k in range(600)]
    manifest = ts.write(documents(spark, rows), root, vocabulary, 2)
    assert sum(s["first"] is not None and s["first"] <= 150 <= s["last"] for s in manifest["shards"]) > 2 and max(s["docs"] for s in manifest["shards"]) < 1200
    got = ts.read_back(spark, root, manifest).orderBy("start").collect()
    want, total = plain(rows, library)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert len(ts.Store(root).get(150)) == 1501


def test_a_vocabulary_that_splits_otherwise_goes_to_the_library(library, tmp_path):
    spec = json.loads(library.to_str())
    spec["normalizer"] = None  # case is kept, so words by their lower-cased letters would be wrong
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    encode = ts.WordEncoder(str(path))
    assert encode.plain and not ts.WordEncoder(vocabulary).plain
    t = "Some UPPER case Words"
    assert np.frombuffer(encode(t), "<u2").tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_nothing_is_left_of_a_failed_attempt(tmp_path):
    import pyarrow.fs as pafs

    def parts():
        yield b"half"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ts._put(pafs.LocalFileSystem(), f"{tmp_path}/x.ids", parts())
    assert os.listdir(tmp_path) == []
