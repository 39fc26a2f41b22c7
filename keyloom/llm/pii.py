"""PII by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates come from patterns that are wide on
purpose: any long mixed token, any run of capitalised words, any number before one, any keyed value. Patterns alone are wrong about
them in both directions, so on every candidate five labelers vote yes, no or abstain: form (a strict pattern), check (digit sums,
ranges, variety), gazetteer (known prefixes, given names, kinds of streets, endings), context (cue words shortly before) and texture
(mix of characters). Equal patterns of kind, votes and span features (length, share of digits, case, entropy, what stands before)
are counted over all documents; their number is bounded by the kinds, votes and classes, so it is those counts that reach the
driver. There EM (one latent class a span; for each kind a prior, and for each labeler two rates, anchored at right more often than
wrong with a weight of ANCHOR of the kind's spans) gives each pattern its probability, and a logistic classifier on votes and span
features is fitted to these. Its weights, not the patterns seen, go to a second pass over the texts, so a pattern that was never
counted is judged too. Candidates of probability 1/2 or more that touch no base span are added; of a secret that touches some, its
parts of LEAST_VALUE characters or more between them. No kind has a greatest length.

Matching is linear in the text: patterns start at "@", "+", "=", ":", a bracketed "at" or at the first character of a run, and a
value that holds further key words is read once.

Defined results: a null text is empty: no spans, the hash of the empty string. Very long texts are read whole. Offsets are code
points, ends exclusive. Rows that repeat are each answered. An empty table gives no rows; a corpus without candidates adds
nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import map_batches, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "ssn", "national", "spelled", "name", "address")
KINDS = BASE + ADDED
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("form", "check", "gazetteer", "context", "texture")
THRESHOLD = 0.5
#: Share of a kind's spans that its labelers' anchors weigh, and the least weight.
ANCHOR, LEAST_ANCHOR = 0.25, 5.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: At the first digit of a run only: a run that fails there fails at each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")

KEY = re.compile(r"(?i)(password|passwd|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth)[\"']?[\x20\t]*\Z")
LEAST_VALUE = 6
VALUE = re.compile(r"[\x20\t]*[\"']?([^\s\"'<>,;&]{%d,})" % LEAST_VALUE)
HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")
#: Access keys of known makes, by their prefixes.
ISSUED = re.compile(
    r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,})(?![0-9A-Za-z_-])"
)
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
#: The middle of an address that is spelled out.
AT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]+)+")
#: Candidates that are mostly no personal data: long tokens, capitalised words in a row, a number before one.
TOKEN = re.compile(r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{16,}={0,2}")
NAME = re.compile(r"(?<![\w'’-])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*+(?:\x20[A-ZÀ-ÖØ-Þ](?:\.|[a-zß-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*+))+(?![\w'’-])")
ADDRESS = re.compile(r"(?<![\w.,-])[0-9]{1,6}[A-Za-z]?,?\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*+(?!\w)|(?<!\w)[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*+\x20[0-9]{1,5}[a-z]?(?![\w.,-]*[0-9])")

ENDINGS = frozenset("com org net edu gov io de fr es uk info biz co".split())
# Common given names of the four languages, in natural order; kinds of streets.
GIVEN = frozenset(
    "adam alan albert alejandro alice amelia ana anders andrea andreas angela anna anne antonio barbara benjamin bernard carla carlos carmen caroline catherine charles charlotte christian christine claire claudia claus daniel david diana "
    "diego dorothy edward elena elizabeth emily emma eric erik eva felix fernando francisco frank gabriel george grace hans heinrich helen helga henry ines ingrid isabel jack jacques james jan jane javier jean jennifer joan john jonas jorge jose "
    "joseph juan julia julie jurgen karen karl katrin klaus laura lena linda lisa louis louise lucas lucia luis manuel marc maria marie mark martin mary matthias michael michel miguel monica nicolas olivia otto pablo patricia paul pedro peter "
    "philippe pierre rachel ramon richard robert rosa ruth samuel sara sarah simon sofia sophie stefan stephen susan teresa thomas uwe ursula victor vincent walter werner william wolfgang".split()
)
STREETS = re.compile(r"(?i)(?:street|st|avenue|ave|road|rd|lane|ln|drive|boulevard|blvd|court|square|terrace|stra(?:ss|ß)e|weg|platz|gasse|allee|rue|calle|avenida|paseo|plaza)$")
CALLING = ("+1", "+33", "+34", "+44", "+49")
NEAR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile"),
    "secret": ("pass", "secret", "token", "key", "auth", "cred", "pwd"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social"), "national": ("tel", "phone", "call", "fax"), "spelled": ("mail", "contact", "write"),
    "name": ("mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "dr ", "dr. ", "prof. ", "herr ", "frau ", "monsieur ", "madame ", "señor ", "señora ", "name: ", "name is ", "contact: ", "dear ", "signed "), "address": ("address", "live", "resid", "street", "adresse", "dirección", "wohn"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, "@" and a domain with a dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                yield start, m.end()
                done = m.end()
            else:
                done = max(done, at + 1)
        at = text.find("@", at + 1)


def valid(kind: str, s: str) -> bool:
    """The rule that a base match must pass."""
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in s.split(".")))
    if kind == "card":
        return 12 <= len(d := digits_of(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end, ...) sorted as the result asks: start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() > 6 and valid(kind, m[0])]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def other_candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the classifier may add."""
    out, end = [], 0
    for m in re.finditer("[=:]", text):
        if KEY.search(text, max(0, m.start() - 32), m.start()):
            if m.end() < end:  # inside the value before: a value from here ends where that does and is not read again
                if end - m.end() >= LEAST_VALUE:
                    out.append((m.end(), end, "secret"))
            elif v := VALUE.match(text, m.end()):
                end = v.end(1)
                out.append((v.start(1), end, "secret"))
    if DIGIT.search(text):
        for kind, pattern in (("secret", HEX), ("secret", ISSUED), ("iban", IBAN), ("ssn", SSN), ("national", NATIONAL), ("address", ADDRESS)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
        out += [(m.start(), m.end(), "secret") for m in TOKEN.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])]
    out += [(m.start(), m.end(), "name") for m in NAME.finditer(text)]
    if "[" in text or "(" in text:
        done = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start() and (v := SPELLED_DOMAIN.match(text, m.end())):
                out.append((start, v.end(), "spelled"))
            done = m.end()
    kept, end = [], -1
    for a, b, kind in sorted(set(out), key=lambda x: (x[0], -x[1], ORDER[x[2]])):
        if a >= end:
            kept.append((a, b, kind))
            end = b
    return kept


def iban_sum(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """1 yes, 0 no, -1 abstains, of each labeler."""
    s, before = text[start:end], text[max(0, start - 32) : start].lower()
    letters, numbers = sum(c.isalpha() for c in s), len(DIGIT.findall(s))
    check = known = -1
    form = True
    texture = int(len(set(s)) > 3)
    if kind == "email":
        form, known, texture = s.count("@") == 1 and not s.startswith("."), int(s.rpartition(".")[2].lower() in ENDINGS), int(letters > 2)
    elif kind == "ip":
        form, check = s.count(".") == 3, int(valid(kind, s))
    elif kind == "card":
        form, check, known = numbers in (15, 16), int(valid(kind, s)), int(s[0] in "3456")
    elif kind == "phone":
        form, check, known = "  " not in s, int(valid(kind, s)), 1 if s.startswith(CALLING) else -1
    elif kind == "secret":
        # words joined by strokes, or one word and a number, are names of things
        parts = re.split(r"[-_/+=.]+", s)
        form = len(s) >= 12 and not all(p.isalpha() or p.isdigit() for p in parts)
        check = int(entropy_of(s) >= 3) if len(s) >= 16 else -1
        known = int(bool(KEY.search(before.rstrip("\"' =:")) or ISSUED.fullmatch(s)))
        texture = int(letters > 0 and numbers > 0 and changes(s) * 5 >= len(s))
    elif kind == "iban":
        form, check = 15 <= len(s.replace(" ", "")) <= 34, int(iban_sum(s))
    elif kind == "ssn":
        form, check = "-" in s, int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    elif kind == "national":
        form, check = s[-5] in "-.", int(s.lstrip("(")[0] not in "01")
    elif kind == "spelled":
        known, texture = int(re.split(r"[^a-z]+", s.lower())[-1] in ENDINGS), int(letters > 2)
    elif kind == "name":
        w = [x.lower() for x in re.split(r"[\s'’.-]+", s) if x]
        form, check, known, texture = 2 <= s.count(" ") + 1 <= 4, int(len(set(w)) == len(w)), int(w[0] in GIVEN), int(not (before.rstrip() or ".").endswith((".", "!", "?", ":")))
    elif kind == "address":
        known = int(any(STREETS.search(x) for x in re.split(r"[\s,]+", s) if not x.isdigit()))
        form, check = s[0].isdigit() or s[-1].isdigit(), int(0 < int(DIGIT_RUN.search(s)[0]) < 30_000)
    context = 1 if any(w in before for w in NEAR[kind]) else 0 if kind in ("name", "address") else -1
    return int(form), check, known, context, texture


DIGIT_RUN = re.compile(r"[0-9]+")


def entropy_of(s: str) -> float:
    """Bits a character."""
    n = Counter(s)
    total = sum(n.values())
    return -sum(c / total * math.log2(c / total) for c in n.values())


def changes(s: str) -> int:
    """How often letters and digits take turns."""
    kinds = ["d" if c in "0123456789" else "a" for c in s if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def features_of(text: str, start: int, end: int) -> str:
    """Classes of what the span is like: share of digits, case, entropy, what stands before; one digit each."""
    s = text[start:end]
    digits, upper, lower = len(DIGIT.findall(s)), sum(c.isupper() for c in s), sum(c.islower() for c in s)
    share = 0 if not digits else 1 if digits * 3 < len(s) else 2 if digits < len(s) else 3
    case = 0 if not upper and not lower else 1 if not upper else 2 if not lower else 3 if s[0].isupper() else 4
    e = entropy_of(s)
    before = text[start - 1 : start]
    return f"{share}{case}{0 if e < 2.5 else 1 if e < 3.5 else 2}{0 if not before or before.isspace() else 1 if before in '=:' else 2 if not before.isalnum() else 3}"


def pattern_of(text: str, span: tuple[int, int, str]) -> str:
    """What the models see of a span: kind, votes, length class, classes of features."""
    a, b, kind = span
    return f"{kind}|{','.join(map(str, votes(text, a, b, kind)))}|{min(3, (b - a) // 12)}|{features_of(text, a, b)}"


CLASSES = (4, 5, 3, 4)


class Model:
    """EM over patterns, and a logistic classifier on their votes and features. The classifier's weights judge any pattern."""

    WIDTH = 1 + len(KINDS) * (1 + 2 * len(LABELERS)) + 4 + sum(CLASSES)

    def __init__(self, counts: dict[str, int], rounds: int = 60) -> None:
        names = sorted(counts)
        self.theta: np.ndarray | None = None
        self.known: dict[str, float] = {}
        if not names:
            return
        weight = np.array([counts[k] for k in names], dtype=float)
        kind = np.array([ORDER[k.split("|")[0]] for k in names], dtype=int)
        v = np.array([[int(x) for x in k.split("|")[1].split(",")] for k in names])
        said, yes = v >= 0, v == 1
        of_kind = np.bincount(kind, weight, len(KINDS))
        anchor = np.maximum(LEAST_ANCHOR, ANCHOR * of_kind)[:, None]

        def by_kind(x: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(kind, x[:, j], len(KINDS)) for j in range(x.shape[1])], axis=1)

        q = np.clip((yes.sum(axis=1) + 0.5) / (said.sum(axis=1) + 1), 0.05, 0.95)  # share of yes among the votes to begin with
        for _ in range(rounds):
            w1, w0 = (weight * q)[:, None], (weight * (1 - q))[:, None]
            right = (by_kind(w1 * yes) + 0.8 * anchor) / (by_kind(w1 * said) + anchor)
            wrong = (by_kind(w0 * yes) + 0.2 * anchor) / (by_kind(w0 * said) + anchor)
            prior = (np.bincount(kind, weight * q, len(KINDS)) + 1) / (of_kind + 2)
            up = np.log(prior[kind]) + (said * np.where(yes, np.log(right[kind]), np.log(1 - right[kind]))).sum(1)
            down = np.log(1 - prior[kind]) + (said * np.where(yes, np.log(wrong[kind]), np.log(1 - wrong[kind]))).sum(1)
            q = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        mean = lambda x: (x * of_kind[:, None]).sum(0) / of_kind.sum()
        self.reliability = dict(zip(LABELERS, zip(mean(right).tolist(), mean(wrong).tolist(), strict=True), strict=True))
        self.estimated = dict(zip(names, q.tolist(), strict=True))
        x = self.features(names)
        scale, theta = 10 * weight / of_kind[kind], np.zeros(x.shape[1])  # every kind weighs the same
        for _ in range(30):  # Newton steps on the weighted, regularised likelihood with EM's probabilities as targets
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (scale * (p - q)) + 1e-2 * theta
            theta -= np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(theta)), grad)
        self.theta = theta

    @classmethod
    def features(cls, names: list[str]) -> np.ndarray:
        """Kind, votes by kind, classes of length and of the span's features."""
        out, votes_at, size_at = np.zeros((len(names), cls.WIDTH)), 1 + len(KINDS), 1 + len(KINDS) * (1 + 2 * len(LABELERS))
        for i, name in enumerate(names):
            kind, v, size, *more = name.split("|")
            out[i, 0] = out[i, 1 + ORDER[kind]] = out[i, size_at + int(size)] = 1
            for j, x in enumerate(v.split(",")):
                if x != "-1":
                    out[i, votes_at + 2 * (len(LABELERS) * ORDER[kind] + j) + int(x)] = 1
            at = size_at + 4
            for c, n in zip(more[0] if more else "", CLASSES, strict=False):
                out[i, at + int(c)] = 1
                at += n
        return out

    def probability(self, pattern: str) -> float:
        if self.theta is None:
            return 0.0
        p = self.known.get(pattern)
        if p is None:
            p = self.known[pattern] = float(1 / (1 + np.exp(-np.clip(self.features([pattern])[0] @ self.theta, -30, 30))))
        return p


def learn(docs: DataFrame) -> Model:
    """Counts patterns over all documents, then fits on the counts."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[str] = Counter()
        for t in texts(batch):
            base = base_spans(t)
            for span in base + [whole for whole, _ in clear_of(other_candidates(t), base)]:
                seen[pattern_of(t, span)] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    counts = map_batches(docs.select(F.col("text").cast("string").alias("text")), f, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    return Model({r["pattern"]: r["n"] for r in counts.collect()})  # at most kinds x 3^labelers x classes rows, some hundreds in practice


def clear_of(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[tuple[int, int, str], list[tuple[int, int, str]]]]:
    """The spans that touch no base span, each with itself as its one part; and secrets that do, with their parts between base spans.

    Spans are disjoint, and both ascend by start.
    """
    union: list[list[int]] = []
    for a, b in sorted((a, b) for a, b, _ in base):
        if union and a <= union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    out, k = [], 0
    for a, b, kind in spans:
        while k < len(union) and union[k][1] <= a:
            k += 1
        if k == len(union) or union[k][0] >= b:
            out.append(((a, b, kind), [(a, b, kind)]))
        elif kind == "secret":
            at, parts, j = a, [], k
            while j < len(union) and union[j][0] < b:
                parts.append((at, union[j][0], kind))
                at, j = union[j][1], j + 1
            if parts := [x for x in (*parts, (at, b, kind)) if x[1] - x[0] >= LEAST_VALUE]:
                out.append(((a, b, kind), parts))
    return out


def spans_of(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, in order."""
    base = base_spans(text)
    added = [x for whole, parts in clear_of(other_candidates(text), base) if model.probability(pattern_of(text, whole)) >= THRESHOLD for x in parts]
    return base, sorted(base + added, key=lambda x: (x[0], ORDER[x[2]])) if added else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for t in texts(batch):
            base, every = spans_of(t, model)
            n = Counter(kind for _, _, kind in base)
            counts.append([n[k] for k in BASE])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        by_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *by_kind, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), f, RESULT)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; what a span overlaps of the one before is gone with that."""
    out, at = [], 0
    for a, b, kind in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with their spans replaced; columns as they are, n_chars counted anew."""
    columns = docs.columns
    where, counted = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, sizes = batch.column(where).to_pylist(), batch.column(counted).to_pylist() if counted is not None else None
        for k, t in enumerate(new):
            if t and (spans := spans_of(t, model)[1]):
                new[k] = redacted(t, spans)
                if sizes is not None:
                    sizes[k] = len(new[k])
        arrays = list(batch.columns)
        arrays[where] = pa.array(new, type=batch.schema.field(where).type)
        if sizes is not None:
            arrays[counted] = pa.array(sizes, type=batch.schema.field(counted).type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_batches(docs, f, docs.schema)
