import random
import re
from collections import Counter

from keyloom.llm import sentence_spans as s
from .helpers import AWKWARD, documents, table


def split(t):
    out, at = [], 0

    def add(a, b):
        w = tuple(t[a:b].encode("utf-8", "surrogatepass").lower().split())
        if w:
            out.append((a, b, w))

    for m in [*re.finditer(r"[.!?]+(?=[\x20\x09-\x0D])|\n", t), None]:
        end = m.end() if m else len(t)
        if len(t[at:end].encode("utf-8", "surrogatepass").split()) > s.LONG:
            cuts = [at + x.end() for x in re.finditer(r"[^\x20\x09-\x0D]{%d,}(?=[\x20\x09-\x0D])" % s.LONG_WORD, t[at:end])]
            for a, b in zip([at, *cuts], [*cuts, end]):
                ends = [a + x.end() for x in re.finditer(r"[^\x20\x09-\x0D]+", t[a:b])]
                more = ends[s.WORDS - 1 : -1 : s.WORDS] if len(ends) > s.LONG else []
                for c, d in zip([a, *more], [*more, b]):
                    add(c, d)
        else:
            add(at, end)
        at = end
    return out


def spans(sent):
    for k in range(len(sent)):
        j = n = k
        n = 0
        while j < len(sent) and (j - k < s.SENTENCES or n < s.WORDS):
            n += len(sent[j][2])
            j += 1
        if j - k >= s.SENTENCES and n >= s.WORDS:
            yield k, j, tuple(x[2] for x in sent[k:j])


def plain(rows):
    rows = sorted(rows, key=lambda r: r[0])
    first = {}
    for doc, t in rows:
        for k, _, key in spans(split(t or "")):
            first.setdefault(key, (doc, k))
    out = {}
    for doc, t in rows:
        sent = split(t or "")
        gone = {x for k, j, key in spans(sent) if first[key] != (doc, k) for x in range(k, j)}
        text, at = "", 0
        for x, (a, b, _) in enumerate(sent):
            if x in gone:
                text, at = text + (t or "")[at:a], b
        out[doc] = (len(sent), len(gone), None if t is None else text + t[at:])
    return out


def test_equals_plain_version(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "! ", "\n", "?\n"]) for _ in range(40)]
    rows = [(k, "".join(pool[x : x + rng.randrange(1, 8)][0] if False else "".join(pool[x : x + rng.randrange(1, 6)]) for x in (rng.randrange(40) for _ in range(rng.randrange(1, 5))))) for k in range(60)]
    rows += [r for r in AWKWARD if r[0] is not None and r[0] != 10 for r in [(1000 + r[0], r[1])]]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in s.dedup(documents(spark, rows)).collect()}
    assert got == plain(rows)
    assert sum(v[1] for v in got.values()) > 20


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in s.dedup(table(spark, sf_dir, "documents")).collect()}
    assert got == plain(rows)


def test_a_passage_stays_in_its_first_document_only(spark):
    passage = "This passage is long enough to be found again. It has three sentences of some words. The last one ends here. "
    rows = [(k, f"Own beginning number {k} with words. {passage}Own end number {k} and more words.") for k in range(5)]
    out = {r["doc_id"]: r["text"] for r in s.dedup(documents(spark, rows)).collect()}
    assert passage in out[0] and out[0] == rows[0][1]
    assert all(out[k] == f"Own beginning number {k} with words. Own end number {k} and more words." for k in range(1, 5))


def test_repeats_inside_a_document_and_rows_without_ids(spark):
    twice = "One sentence with enough words in it. Another sentence with enough words in it. "
    rows = [(None, twice * 2), (None, twice), (4, twice * 3), (5, "Short. One. Two. Short. One. Two. ")]
    got = Counter((r["doc_id"], r["n_removed"]) for r in s.dedup(documents(spark, rows)).collect())
    assert got == Counter({(4, 4): 1, (None, 4): 1, (None, 2): 1, (5, 0): 1})


def test_empty(spark):
    assert s.dedup(documents(spark, AWKWARD).filter("false")).count() == 0


def test_a_passage_without_marks_is_found_anywhere(spark):
    rng = random.Random(6)
    draw = lambda n: " ".join("".join(rng.choice("abcdefghéß") for _ in range(rng.randrange(2, 12))) for _ in range(n))
    passage = draw(60)
    rows = [(k, f"{draw(7 + 5 * k)} {passage} {draw(9)}") for k in range(4)]
    out = {r["doc_id"]: r["text"] for r in s.dedup(documents(spark, rows)).collect()}
    assert out == {k: v[2] for k, v in plain(rows).items()} and out[0] == rows[0][1]
    w = passage.split()
    for k in range(1, 4):
        assert not any(" ".join(w[i : i + 25]) in out[k] for i in range(36))


def test_linear_on_awkward_texts():
    import time

    began = time.time()
    for t in ("." * 300_000, "a " * 30 + "b" * 300_000, "!? " * 100_000, "\n" * 300_000, "the " * 100_000, "é" * 200_000 + " x" * 40):
        s.cut(t, set(), set())
    assert time.time() - began < 15


def test_runs_with_one_equal_hash_are_no_repeats(spark, monkeypatch):
    """The first hash is the same for all runs; the second tells them apart."""
    real = s.runs

    def poor(hashes, counts):
        h, end = real(hashes, counts)
        return (h, end) if poor.calls.append(0) or len(poor.calls) % 2 == 0 else (h * s.np.uint64(0), end)

    poor.calls = []
    monkeypatch.setattr(s, "runs", poor)
    batch = s.pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["One sentence with enough words in it. Another sentence with enough words in it. And one more of the kind is here too. "]})
    kept = []
    monkeypatch.setattr(s, "map_batches", lambda df, f, schema: kept.append(f) or df)
    s.run_hashes(documents(spark, [(1, "x")]))
    rows = kept[0](batch).column("runs").to_pylist()[0]
    assert {r["h"] for r in rows} == {0} and len({r["g"] for r in rows}) == len(rows) == 2
