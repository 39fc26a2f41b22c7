"""Language ID: a bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time.

Every byte position of the lower-cased UTF-8 text is labelled: the position's class probabilities come from a forward and a
backward state. A document's probabilities are the mean over all its positions; the largest is its language and score. Texts
go through the network in windows of STEPS bytes that cover each position once, many windows side by side.

A window's states start from zero, so what stands more than STEPS bytes away says nothing about a position by itself; the pooling
joins the windows.

Learning: rows with a language whose crc32(doc_id as text) mod 4 is not 2. Of each language, however many there are,
PER_LANGUAGE rows (the first by a hash of their id and text, WINDOWS windows at hashed places of the whole text each) are learnt
from; that sample, bounded for each language however often an id repeats, is all that reaches the driver. The input is the text alone.

Defined results: `und` with score 0 for a null text or one without a letter, or if there was nothing to learn from. A null
doc_id is not held out and not learnt from. Very long texts are labelled whole, a bounded number of windows at a time. Repeated
rows are each answered. An empty table teaches nothing and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import map_batches

HIDDEN, STEPS, SIDE_BY_SIDE = 8, 64, 1024
PER_LANGUAGE, WINDOWS = 500, 4
#: Languages up to which SIDE_BY_SIDE windows go together; of more, fewer do, so that their probabilities take no more memory.
AT_FULL_WIDTH = 64
EPOCH_STEPS, TRAIN_BATCH, RATE = 300, 256, 0.02
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Network:
    """Two recurrent layers, one for each direction, of HIDDEN units. A byte's part of the gates is a table row.

    table: (2, 3H, 256) gates z, r and candidate n of each byte; u: (2, 3H, H) recurrent weights; w: (C, 2H), b: (C, 1) output.
    """

    NAMES = ("table", "u", "w", "b")

    def __init__(self, languages: list[str], **weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(languages, table=draw(2, 3 * hidden, 256, by=0.3), u=draw(2, 3 * hidden, hidden, by=hidden**-0.5), w=draw(len(languages), 2 * hidden, by=0.3), b=np.zeros((len(languages), 1), np.float32))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """x: (L, B) bytes; y: (B,) classes; weight: (L, B) of the positions. Mean cross-entropy and its gradients."""
        table, u, w, b = (self.weights[k] for k in self.NAMES)
        (steps, n), hidden = x.shape, u.shape[2]
        both = np.stack([x, x[::-1]], axis=1)  # (L, 2, B): what each direction reads at each step
        sigmoid = lambda a: 0.5 + 0.5 * np.tanh(0.5 * a)
        h = np.zeros((steps + 1, 2, hidden, n), np.float32)
        z, r, c, un = (np.empty((steps, 2, hidden, n), np.float32) for _ in range(4))
        for s in range(steps):
            g = np.stack([table[d][:, both[s, d]] for d in (0, 1)])
            rec = u @ h[s]
            z[s], r[s] = sigmoid(g[:, :hidden] + rec[:, :hidden]), sigmoid(g[:, hidden : 2 * hidden] + rec[:, hidden : 2 * hidden])
            un[s] = rec[:, 2 * hidden :]
            c[s] = np.tanh(g[:, 2 * hidden :] + r[s] * un[s])
            h[s + 1] = c[s] + z[s] * (h[s] - c[s])
        out = np.concatenate([h[1:, 0], h[:0:-1, 1]], axis=1)  # (L, 2H, B) by position
        logits = w @ out + b
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        total = float(weight.sum()) or 1.0
        loss = -float((np.log(p[:, y, np.arange(n)] + 1e-12) * weight).sum()) / total
        dl = p
        dl[:, y, np.arange(n)] -= 1
        dl *= (weight / total)[:, None, :]
        dw, db = np.einsum("lcb,lhb->ch", dl, out, optimize=True), dl.sum(axis=(0, 2))[:, None]
        dout = w.T @ dl
        dh_out = np.stack([dout[:, :hidden], dout[::-1, hidden:]], axis=1)
        carry, du = np.zeros((2, hidden, n), np.float32), np.zeros_like(u)
        dx = np.empty((steps, 2, 3 * hidden, n), np.float32)
        for s in reversed(range(steps)):
            dh = dh_out[s] + carry
            dn = dh * (1 - z[s]) * (1 - c[s] ** 2)
            dz = dh * (h[s] - c[s]) * z[s] * (1 - z[s])
            dr = dn * un[s] * r[s] * (1 - r[s])
            dx[s] = np.concatenate([dz, dr, dn], axis=1)
            rec = np.concatenate([dz, dr, dn * r[s]], axis=1)
            du += rec @ h[s].transpose(0, 2, 1)
            carry = dh * z[s] + u.transpose(0, 2, 1) @ rec
        dt = np.zeros_like(table)
        for d in (0, 1):
            flat, at = dx[:, d].transpose(1, 0, 2).reshape(3 * hidden, -1), both[:, d].ravel()
            for k in range(3 * hidden):
                dt[d, k] = np.bincount(at, weights=flat[k], minlength=256)
        return loss, {"table": dt, "u": du, "w": dw, "b": db}

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = EPOCH_STEPS, seed: int = 11) -> list[float]:
        """x: (N, L) bytes. Adam with a falling rate over batches drawn with a fixed seed."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(a) for k, a in self.weights.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), TRAIN_BATCH)
            loss, grads = self.gradients(x[pick].T, y[pick], weight[pick].T)
            losses.append(loss)
            norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def sums(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """x: (L, B) bytes. Probabilities summed over the weighted positions of each window: (C, B).

        Gates are computed as tanh(a/2), so a sigmoid s is (1 + t) / 2; the halves are folded into the weights.
        """
        table, u, w, b = (self.weights[k] for k in self.NAMES)
        (steps, n), hidden = x.shape, u.shape[2]
        two = 2 * hidden
        half = np.concatenate([np.full(two, 0.5, np.float32), np.ones(hidden, np.float32)])[:, None]
        table, u = table * half, u * np.float32(0.5)
        h, kept = np.zeros((2, hidden, n), np.float32), np.empty((steps, two, n), np.float32)
        g, rec, t = np.empty((2, 3 * hidden, n), np.float32), np.empty((2, 3 * hidden, n), np.float32), np.empty((2, hidden, n), np.float32)
        for s in range(steps):
            np.take(table[0], x[s], axis=1, out=g[0], mode="clip")
            np.take(table[1], x[steps - 1 - s], axis=1, out=g[1], mode="clip")
            np.matmul(u, h, out=rec)
            gates, c, un = g[:, :two], g[:, two:], rec[:, two:]
            gates += rec[:, :two]
            np.tanh(gates, out=gates)
            np.multiply(gates[:, hidden:], un, out=t)
            t += un
            c += t
            np.tanh(c, out=c)
            h -= c
            np.multiply(gates[:, :hidden], h, out=t)
            h += t
            h *= np.float32(0.5)
            h += c
            kept[s, :hidden] = h[0]
            kept[steps - 1 - s, hidden:] = h[1]
        p = np.matmul(w, kept)
        p += b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (weight / p.sum(axis=1))[:, None, :]
        return p.sum(axis=0)

    def documents(self, raw: list[bytes]) -> np.ndarray:
        """Mean class probabilities of each text: (documents, C). Texts of no bytes get zeros."""
        out = np.zeros((len(raw), len(self.languages)))
        size = np.array([len(x) for x in raw], dtype=np.int64)
        if not size.sum():
            return out
        data = np.frombuffer(b"".join(raw) + bytes(STEPS), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        count = -(-size // STEPS)
        doc = np.repeat(np.arange(len(raw)), count)
        k = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        # the last window of a text ends with it and weighs only what the one before has not covered
        start = np.minimum(k * STEPS, np.maximum(size[doc] - STEPS, 0))
        low, high = k * STEPS - start, np.minimum(size[doc] - start, STEPS)
        at = np.arange(STEPS)[:, None]
        width = max(1, SIDE_BY_SIDE * AT_FULL_WIDTH // max(AT_FULL_WIDTH, len(self.languages)))
        for i in range(0, len(doc), width):
            j = slice(i, i + width)
            x = data[(begin[doc[j]] + start[j])[None, :] + at]
            inside = at < high[j]
            p = self.sums(np.where(inside, x, 0), (inside & (at >= low[j])).astype(np.float32))
            for c in range(len(self.languages)):
                out[:, c] += np.bincount(doc[j], weights=p[c], minlength=len(raw))
        return out / np.maximum(size, 1)[:, None]


def learn(docs: DataFrame) -> Network | None:
    """Train on the bounded sample; None if no row can be learnt from."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null").filter(~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = docs.sparkSession.createDataFrame([(k, int((1 << 30) * min(1.0, 1.3 * PER_LANGUAGE / n))) for k, n in counts.items()], "lang string, share bigint")
    picked = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id")  # of what the share has left
    picked = picked.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= PER_LANGUAGE).select("doc_id", "text", "lang")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text and LETTER.search(text):
                raw = as_bytes(text)
                for k in range(WINDOWS):
                    h = xxhash.xxh3_64_intdigest(f"{doc}/{k}")
                    at = h % max(1, len(raw) - STEPS + 1)
                    out.append((lang, h, raw[at : at + STEPS]))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array([h >> 1 for h in cols[1]], pa.int64()), pa.array(cols[2], pa.binary())], names=["lang", "h", "raw"])

    rows = sorted((r["lang"], r["h"], bytes(r["raw"])) for r in map_batches(picked, windows, "lang string, h bigint, raw binary").collect())
    most, left = PER_LANGUAGE * WINDOWS, dict.fromkeys(counts, 0)
    sample = []
    for lang, _, raw in rows:
        left[lang] += 1
        if left[lang] <= most:
            sample.append((lang, raw))
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    # each language is drawn as often as any other
    by: dict[str, list[bytes]] = {k: [] for k in languages}
    for lang, raw in sample:
        by[lang].append(raw)
    largest = max(map(len, by.values()))
    even = [(c, by[k][i % len(by[k])]) for c, k in enumerate(languages) for i in range(largest)]
    x = np.frombuffer(b"".join(raw.ljust(STEPS, b"\0") for _, raw in even), dtype=np.uint8).reshape(-1, STEPS)
    weight = np.array([[len(raw)] for _, raw in even]) > np.arange(STEPS)[None, :]
    network = Network.fresh(languages)
    network.train(x, np.array([c for c, _ in even]), weight.astype(np.float32))
    return network


def predict(raw_texts: list[str | None], network: Network | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    kept = [as_bytes(t) if t and LETTER.search(t) else b"" for t in raw_texts]
    if network is None:
        return [UNKNOWN] * len(kept), [0.0] * len(kept)
    p = network.documents(kept)
    best = p.argmax(axis=1)
    return [network.languages[c] if x else UNKNOWN for c, x in zip(best, kept, strict=True)], [min(1.0, float(v)) if x else 0.0 for v, x in zip(p[np.arange(len(kept)), best], kept, strict=True)]


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """One row per document: held_out, lang_pred, score."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(batch.column("text").to_pylist(), network)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, f, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: Network | None, least: float, wanted: frozenset[str] | None = None) -> DataFrame:
    """Documents with a language (one of those wanted, if any are named) and a score of `least` or more.

    Columns are as they are, but that a null lang becomes the language found.
    """
    where, label = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(batch.column(where).to_pylist(), network)
        keep = pa.array([x != UNKNOWN and s >= least and (wanted is None or x in wanted) for x, s in zip(lang, score, strict=True)])
        arrays = list(batch.columns)
        if label is not None and arrays[label].null_count:
            arrays[label] = pc.coalesce(arrays[label], pa.array(lang, arrays[label].type))
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(keep)

    return map_batches(docs, f, docs.schema)
