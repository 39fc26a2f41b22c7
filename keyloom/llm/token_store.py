"""Token ids in raw shards with a minimal perfect hash index for keyed access.

Layout under the root, which must be a folder that all executors reach:

    manifest.json     end id, bytes an id, and of every shard: first and last key, documents, ids, ids of all shards before it
    shard-N.ids       the ids of the shard's documents one after another, little-endian, 2 or 4 bytes each, nothing else
    shard-N.mph       the index (see Mph) over the shard's keys; then, in file order, the documents' keys and where their ids start

Documents lie in ascending order of their keys over all shards; each ends with the end id. A lookup finds the shard by bisection in
the manifest, hashes the key, reads one slot and compares the fingerprint; the slot holds the document's place and the offset and
number of its ids. An opened shard reads its header and bit fields (about four bits a key), then 28 bytes a lookup, whatever its size.
A key that a shard lacks is told by its fingerprint (32 bits: one absent key in 4 billion passes) and then by the key table, so an
answer is never wrong.

Texts are encoded where they are read; ids are dealt by ranges of keys, once, never texts. There are about SHARDS shards, fewer or
more if they would have less than LEAST_IDS or more than MOST_IDS ids (about CHARS_AN_ID characters make one), whatever the
session's settings; their bounds are quantiles of the keys. A key on very many rows is dealt to several shards. A shard is written
by one task under a name of the attempt's own and then moved, so a task that is run again after the loss of an executor replaces its
file whole, and what a failed attempt wrote is deleted. Only one line a shard goes to the driver.

Defined results: a null text is empty (its end id remains). Very long texts and words are encoded whole; words of over LONGEST_KEPT
characters are not kept in the cache. Keys that repeat are kept, all of them, next to each other; the index gives the first and
their number. A null key comes first in the file and is not in the index. An empty table writes a manifest without shards. Other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import map_batches, mix64, small_batches, texts

NO_POSITION = 0xFFFFFFFFFFFFFFFF
#: Shards of a table, of LEAST_IDS to MOST_IDS ids each (4 MB to 1 GB at 2 bytes); levels of an index at most.
SHARDS, LEAST_IDS, MOST_IDS, CHARS_AN_ID, MAX_LEVELS = 1024, 2_000_000, 512_000_000, 3, 64
LOWEST = -(1 << 63)
#: Characters of a word that is kept for the next time it comes.
LONGEST_KEPT = 64
SLOT = np.dtype([("fingerprint", "<u4"), ("position", "<u8"), ("offset", "<u8"), ("ids", "<u8")])


class Mph:
    """Minimal perfect hash over distinct 64-bit keys, n slots for n keys.

    Keys are hashed into a field of 2 bits a key; those that are alone at their bit have it set, the others go to the next level's
    field, and so on. A key's slot is the number of set bits before its own. Building and lookups are array operations; a key takes
    1.6 levels on average.
    """

    BITS_A_KEY = 2

    def __init__(self, sizes: np.ndarray, words: np.ndarray, slots: np.ndarray) -> None:
        self.sizes, self.words, self.slots = sizes, words, slots
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)  # of the levels' fields, in words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)  # set bits before each word

    @property
    def fingerprint(self) -> np.ndarray:
        return self.slots["fingerprint"]

    @staticmethod
    def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(64 * size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, position: np.ndarray, offset: np.ndarray | None = None, ids: np.ndarray | None = None) -> Mph:
        h = mix64(np.asarray(keys, dtype=np.int64).view(np.uint64))
        left, sizes, fields = h, [], []
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys of an index must be distinct")
            size = -(-cls.BITS_A_KEY * len(left) // 64)
            at = cls._at(left, len(sizes), size)
            count = np.bincount(at, minlength=64 * size)
            fields.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            left = left[count[at] != 1]
            sizes.append(size)
        out = cls(np.array(sizes, dtype=np.int64), np.concatenate(fields) if fields else np.zeros(0, dtype=np.uint64), np.zeros(len(h), dtype=SLOT))
        slot = out._slot(h)
        for name, values in (("fingerprint", cls.fingerprints(h)), ("position", position), ("offset", offset), ("ids", ids)):
            if values is not None:
                out.slots[name][slot] = values
        return out

    @staticmethod
    def fingerprints(h: np.ndarray) -> np.ndarray:
        return (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for a hash that no level has."""
        out, todo = np.full(len(h), -1, dtype=np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self._at(h[todo], level, size)
            word, bit = self.start[level] + at // 64, (at % 64).astype(np.uint64)
            found = (self.words[word] >> bit & np.uint64(1)) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[found]] = (self.before[word] + np.bitwise_count(below))[found]
            todo = todo[~found]
        return out

    def slots_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and fingerprint of each key (slot -1: surely absent)."""
        h = mix64(np.asarray(keys, dtype=np.int64).view(np.uint64))
        return self._slot(h), self.fingerprints(h)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots' contents, and whether the fingerprint agrees."""
        slot, own = self.slots_of(keys)
        if not len(self.slots):
            return np.zeros(len(slot), dtype=SLOT), np.zeros(len(slot), dtype=bool)
        found = self.slots[np.maximum(slot, 0)]
        return found, (slot >= 0) & (found["fingerprint"] == own)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys, NO_POSITION where the fingerprint differs."""
        found, same = self.find(keys)
        return np.where(same, found["position"], np.uint64(NO_POSITION))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", len(self.sizes), len(self.words), len(self.slots)) + self.sizes.astype("<i8").tobytes() + self.words.astype("<u8").tobytes() + self.slots.tobytes()

    @staticmethod
    def header(raw: bytes) -> tuple[int, int, int]:
        """Levels, words and slots, from the first HEADER bytes."""
        return struct.unpack_from("<QQQ", raw)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Mph:
        levels, words, n = cls.header(raw)
        at = HEADER + 8 * levels
        return cls(np.frombuffer(raw, "<i8", levels, HEADER), np.frombuffer(raw, "<u8", words, at), np.frombuffer(raw, SLOT, n, at + 8 * words))


HEADER = 24


class WordEncoder:
    """Ids of texts, by the ids of their words.

    The tokenizer splits at white space before anything else joins, so a text's ids are those of its pieces between blanks and
    line ends. A piece of Latin letters and some marks after them splits further, into its letters, lower-cased, and its marks;
    letters go straight to the tokenizer's merges. The ids of pieces and parts seen last are kept, up to a bound; the library
    encodes the others, many as one text with bars between them: a bar between blanks is one id that no piece without one gives.
    """

    BAR = "|"
    SIMPLE = re.compile("([a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?*#$%&]*)")

    def __init__(self, path: str, bound: int = 900_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        bar = self.tokenizer.encode(self.BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        # as the tokenizer spells the bytes of letters beyond ASCII
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.merges = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.plain = not self.faithful()

    #: Texts whose ids by words are held against the library's when a vocabulary is loaded.
    TRIED = ("It's the 1st of MAY, isn't it?! Yes...", "Caf\u00e9 na\u00efve \u00c9t\u00e9, stra\u00dfe; \u00fcber \u00d8re \u00ff.", "a|b  | c\td\n\ne\r\nf", "don't we'll I'm x's 12,345.67 $5 #1 @home 50%", "snake_case camelCase ALLCAPS mixed3d 3d-print", "\u4e2d\u6587 \u65e5\u672c\u8a9e \ud55c\uad6d\uc5b4 \U0001f642\U0001f680", "<|endoftext|> <b>x</b> \u2014 \u201cq\u201d", " lead and trail ", "")

    def faithful(self) -> bool:
        """The vocabulary splits as this class takes for granted. If it does not, whole texts go to the library."""
        self.plain = False
        words = [w for t in self.TRIED for w in t.split()]
        tried = [*self.TRIED, *words, *(w.upper() for w in words), " ".join(words), "\n".join(reversed(words))]
        try:
            return all(np.frombuffer(self(t), f"<u{self.width}").tolist() == self.tokenizer.encode(t, add_special_tokens=False).ids for t in tried)
        except (KeyError, IndexError):
            return False

    def _encode(self, new: list[str], into: dict[str, bytes]) -> None:
        kind = f"<u{self.width}"
        plain = [w for w in new if self.BAR not in w] if self.bar is not None else []
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.BAR} ".join(some)], add_special_tokens=False)[0].ids, dtype=kind)
            raw = ids.tobytes()
            cuts = (np.flatnonzero(ids == self.bar) * self.width).tolist()
            into.update(zip(some, [raw[a:b] for a, b in zip([0, *(c + self.width for c in cuts)], [*cuts, len(raw)], strict=True)], strict=True))
        if odd := [w for w in new if w not in into]:
            for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                into[w] = np.array(e.ids, dtype=kind).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Take in pieces that are not known."""
        for kept in (self.known, self.parts):
            if len(kept) > self.bound:
                kept.clear()
                kept[""] = b""
        odd, known, parts, marks = [], self.known, self.parts, {}
        kind = "H" if self.width == 2 else "I"
        for w in pieces:
            if m := self.SIMPLE.fullmatch(w):
                letters, after = m[1].lower(), m[2]
                ids = parts.get(letters)
                if ids is None:
                    spelled = letters if letters.isascii() else letters.translate(self.spelling)
                    ids = parts[letters] = array(kind, [t.id for t in self.merges(spelled)]).tobytes()
                if after in parts:
                    known[w] = ids + parts[after]
                else:
                    marks[w] = ids, after
            else:
                odd.append(w)
        self._encode(list({after for _, after in marks.values()}), parts)
        known.update((w, ids + parts[after]) for w, (ids, after) in marks.items())
        self._encode(odd, known)

    def __call__(self, text: str) -> bytes:
        """The ids of a text, as little-endian bytes. A piece is looked up once, and text by text, so that the words stay in the processor's cache."""
        if self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()
        pieces = text.replace("\n", " ").split(" ")
        ids = list(map(self.known.get, pieces))
        if None in ids:
            new = [i for i, x in enumerate(ids) if x is None]
            self.learn({pieces[i] for i in new})
            for i in new:
                ids[i] = self.known[pieces[i]]
            for w in {pieces[i] for i in new if len(pieces[i]) > LONGEST_KEPT}:
                del self.known[w]
                self.parts.clear()
                self.parts[""] = b""
        return b"".join(ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _put(fs: pafs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    """Write under another name, then move: the file is there whole or not at all."""
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(own) as out:
            for x in parts:
                out.write(x)
    except BaseException:
        if fs.get_file_info(own).type == pafs.FileType.File:
            fs.delete_file(own)
        raise
    fs.move(own, path)


LEFT_OVER = re.compile(r"\.(?:ids|mph)\.[0-9a-f]{32}$")
SHARD = "shard bigint, first bigint, last bigint, docs bigint, ids bigint"


def bounds_of(docs: DataFrame) -> np.ndarray:
    """Keys between the shards, ascending: quantiles of the keys themselves, as many as the texts' size asks for. A key on many rows repeats."""
    key = F.coalesce("doc_id", F.lit(LOWEST))
    chars = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    ids = (chars["chars"] or 0) // CHARS_AN_ID + chars["n"]
    shards = max(1, -(-ids // min(MOST_IDS, max(LEAST_IDS, ids // SHARDS))))
    found = docs.agg(F.percentile_approx(key, [k / shards for k in range(1, shards)], 4 * max(2500, shards)).alias("b")).first()["b"] if shards > 1 else None
    return np.array(sorted(found or []), dtype=np.int64)


def encoded(docs: DataFrame, vocabulary: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """shard, doc_id, split (a hash that orders the rows of one key) and ids (bytes, the end id last), where the texts are."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype=f"<u{encode.width}").tobytes()
        ids = [encode(t) + end for t in texts(batch)]
        split = np.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in ids], dtype=np.int64)
        keys = np.array([LOWEST if k is None else k for k in batch.column("doc_id").to_pylist()], dtype=np.int64)
        low, high = (np.searchsorted(shared.value, keys, side=side) for side in ("left", "right"))
        shard = low + ((split >> 31) * (high - low + 1) >> 32)  # a key that is several bounds is dealt to the shards between them, in the order of the hash
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column("doc_id"), pa.array(split), pa.array(ids, pa.binary())], names=["shard", "doc_id", "split", "ids"])

    return map_batches(docs, f, "shard bigint, doc_id bigint, split bigint, ids binary")


def write(docs: DataFrame, root: str, vocabulary: str, end_id: int) -> dict:
    """Encode every text and write the shards; returns the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, base = _folder(root)
    fs.create_dir(base)
    width = encoder(vocabulary).width
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = bounds_of(docs)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            yield from ((int(shard[a]), batch.slice(a, b - a)) for a, b in zip(edges, edges[1:], strict=False) if a < b)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _folder(root)
        fs.create_dir(base)
        for shard, some in groupby(pieces(batches), key=lambda x: x[0]):
            keys, lengths, nulls = array("q"), array("q"), 0

            def payload() -> Iterator[bytes]:
                nonlocal nulls
                for _, batch in some:  # noqa: B023  used before the next shard
                    column, raw = batch.column("doc_id"), batch.column("ids").to_pylist()
                    nulls += column.null_count
                    keys.extend(column.fill_null(0).to_pylist())  # noqa: B023
                    lengths.extend(len(x) // width for x in raw)  # noqa: B023
                    yield b"".join(raw)

            name = f"{base}/shard-{shard:06d}"
            _put(fs, f"{name}.ids", payload())
            every = np.array(keys, dtype=np.int64)
            real = every[nulls:]
            starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], real[1:] != real[:-1]])) if len(real) else np.zeros(0, dtype=np.int64)
            at = first + nulls
            mph = Mph.build(real[first], at, starts[at], starts[at + 1] - starts[at])
            table = struct.pack("<QQ", len(every), nulls) + every.astype("<i8").tobytes() + starts.astype("<i8").tobytes()
            _put(fs, f"{name}.mph", iter([mph.to_bytes(), table]))
            row = {"shard": [shard], "first": [int(real[0]) if len(real) else None], "last": [int(real[-1]) if len(real) else None], "docs": [len(every)], "ids": [int(starts[-1])]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    dealt = encoded(docs, vocabulary, end_id, bounds).repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "split")
    rows = sorted((r.asDict() for r in dealt.mapInArrow(task, SHARD).collect()), key=lambda r: r["shard"])  # one row a shard
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if LEFT_OVER.search(f.base_name):  # of executors that were lost
            fs.delete_file(f.path)
    start = 0
    for r in rows:
        r["start"], start = start, start + r["ids"]
    manifest = {"end_id": end_id, "bytes": width, "shards": rows}
    _put(fs, f"{base}/manifest.json", iter([json.dumps(manifest).encode()]))
    return manifest


class Shard:
    """One shard's index and its ids, read from the files by range; the key table only if it is asked for."""

    def __init__(self, root: str, manifest: dict, shard: dict) -> None:
        fs, base = _folder(root)
        name = f"{base}/shard-{shard['shard']:06d}"
        self.width, self.index, self.file = manifest["bytes"], fs.open_input_file(f"{name}.mph"), fs.open_input_file(f"{name}.ids")
        levels, words, n = Mph.header(self.index.read_at(HEADER, 0))
        fields = self.index.read_at(8 * (levels + words), HEADER)
        self.slots_at = HEADER + 8 * (levels + words)
        self.mph = Mph(np.frombuffer(fields, "<i8", levels), np.frombuffer(fields, "<u8", words, 8 * levels), np.zeros(0, dtype=SLOT))
        self.table_at = self.slots_at + SLOT.itemsize * n
        self.docs, self.nulls = struct.unpack("<QQ", self.index.read_at(16, self.table_at))

    def whole(self) -> tuple[Mph, np.ndarray, np.ndarray]:
        """The index with all slots, the keys and the starts of the documents, for a pass over the shard."""
        raw = self.index.read_at(self.table_at - self.slots_at, self.slots_at)
        table = self.index.read_at(16 * self.docs + 8, self.table_at + 16)
        return Mph(self.mph.sizes, self.mph.words, np.frombuffer(raw, SLOT)), np.frombuffer(table, "<i8", self.docs), np.frombuffer(table, "<i8", self.docs + 1, 8 * self.docs)

    def _numbers(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.index.read_at(8 * n, self.table_at + 16 + 8 * at), "<i8")

    def _ids(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * self.width, start * self.width), f"<u{self.width}")

    def get(self, key: int) -> Iterator[np.ndarray]:
        """The ids of every document with a key: one hash, one slot, one comparison, and a look at the neighbours for repeats."""
        slot, own = self.mph.slots_of(np.array([key]))
        if slot[0] < 0:
            return
        found = np.frombuffer(self.index.read_at(SLOT.itemsize, self.slots_at + SLOT.itemsize * int(slot[0])), SLOT)[0]
        at = int(found["position"])
        if found["fingerprint"] != own[0] or self._numbers(at, 1)[0] != key:
            return
        yield self._ids(int(found["offset"]), int(found["ids"]))
        while (at := at + 1) < self.docs and self._numbers(at, 1)[0] == key:
            start, end = self._numbers(self.docs + at, 2).tolist()
            yield self._ids(start, end - start)


class Store:
    """Keyed access to what write() has written."""

    def __init__(self, root: str) -> None:
        self.root, (fs, base) = root, _folder(root)
        with fs.open_input_file(f"{base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.shards = [s for s in self.manifest["shards"] if s["first"] is not None]  # in the order of their keys
        self.last = [s["last"] for s in self.shards]
        self.opened: dict[int, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        out, at = [], bisect_left(self.last, key)
        while at < len(self.shards) and self.shards[at]["first"] <= key:  # more than one only if the key repeats over a shard's end
            s = self.shards[at]
            if s["shard"] not in self.opened:
                self.opened[s["shard"]] = Shard(self.root, self.manifest, s)
            out += self.opened[s["shard"]].get(key)
            at += 1
        return out


RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_back(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """Every document of the files, reached through the index by its key: where its ids start, how many, their checksum."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            shard = Shard(root, manifest, row)
            mph, keys, starts = shard.whole()
            n, nulls = shard.docs, shard.nulls
            found, same = mph.find(keys)
            place, begin, size = found["position"].astype(np.int64), found["offset"].astype(np.int64), found["ids"].astype(np.int64)
            if not same[nulls:].all():
                raise ValueError(f"shard {row['shard']}: a key is not in its index")
            # documents of a key that repeats follow its first; null keys are not in the index
            later = np.zeros(n, dtype=bool)
            later[1:] = keys[1:] == keys[:-1]
            later[nulls : nulls + 1] = False  # whatever the nulls' place holders are
            later[:nulls] = True
            place[:nulls] = np.arange(nulls)
            first = np.maximum.accumulate(np.where(later, 0, np.arange(n)))
            place = np.where(later & (np.arange(n) >= nulls), place + np.arange(n) - first, place)
            begin[later], size[later] = starts[place[later]], (starts[1:] - starts[:-1])[place[later]]
            for k in range(0, n, 4096):
                where = slice(k, min(n, k + 4096))
                crc = [zlib.crc32(shard._ids(a, m).astype("<u4").tobytes()) for a, m in zip(begin[where].tolist(), size[where].tolist(), strict=True)]
                null = np.arange(k, where.stop) < nulls
                yield pa.RecordBatch.from_arrays([pa.array(keys[where], mask=null), pa.array(begin[where] + row["start"]), pa.array(size[where]), pa.array(crc, type=pa.int64())], schema=RESULT)

    rows = manifest["shards"]
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    shards = spark.createDataFrame([(r["shard"], r["start"]) for r in rows], "shard bigint, start bigint").repartition(len(rows), "shard")
    manifest = {"bytes": manifest["bytes"]}  # all that the tasks need of it
    return shards.mapInArrow(task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
