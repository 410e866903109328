"""Personal data by candidates and boosted trees.

Base spans are exact: four patterns, leftmost and non-overlapping per kind, each with a check (octets, checksum, digits).
Beside them, high-recall generators propose many overlapping spans: every run of digit groups inside a longer number,
telephone shapes without a plus, addresses written apart, and so on.  Boosted trees score each candidate by its format and
its context, and the threshold of its kind, calibrated on held-out candidates to a precision, decides whether it is taken.
Taken spans that overlap neither a base span nor a better one are added.

The trees learn from weak labels that all documents give: a base span is positive; a candidate that overlaps a base span
without being one is negative (wrong ends, or of another kind), and so are one that lies apart and fails its kind's check and
a base span that was spoilt; a candidate apart that passes its check is unknown, and is what the trees decide.  All labelled
candidates, each distinct one once, are written as a small table.  The trees are fitted on about ``per_label`` of them of each
kind and label, picked by a hash among those of all documents; those of a third of the documents are left out, and all of these
are scored and counted in bins, from which each kind's threshold follows.  A kind with too few of them for the precision asked adds nothing.

Defined cases: a null or empty text has no spans.  Very long runs of digits or address characters are scanned in linear
time.  Columns of the input that bear a result's name are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwise.llm.boosting import BoostedTrees
from labelwise.llm.common import Shipped, pieces, sha256_hex, written

# Kinds in their listed order, and the base patterns.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

PER_LABEL = 2000
PRECISION = 0.97
#: Bins of the scores that calibrate the thresholds.
BINS = 1000
_email, _ip, _card, _phone = map(re.compile, (EMAIL, IP, CARD, PHONE))
_at_run = re.compile(r"[A-Za-z0-9._%+@-]*")
_number_run = re.compile(r"[0-9+(][0-9+().\x20-]{5,}")
_group = re.compile(r"[0-9]+")
_apart = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\]|@)\x20?)[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,}+)+")
_cue = {"email": re.compile(r"mail|contact|e-mail", re.I), "ip": re.compile(r"\bip\b|host|server|addr", re.I),
        "card": re.compile(r"card|visa|master|credit|pay", re.I), "phone": re.compile(r"tel|phone|call|fax|mobile|whats", re.I)}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(_group.findall(text))


def checked(kind: str, text: str) -> bool:
    if kind == "ip":
        return _octets(text)
    if kind == "card":
        d = _digits(text)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; looks only around the at signs, each stretch once."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = _email.match(text, begin)
        if m:
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for k, pattern in ((1, _ip), (2, _card), (3, _phone)):
        if k == 3 and "+" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if (k != 2 or m.end() - m.start() >= 12) and checked(KINDS[k], m.group())]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals (start, kind index, end), many of them wrong; linear in the text but for a constant."""
    out = set()
    for m in _number_run.finditer(text):
        groups = [(a + m.start(), b + m.start()) for a, b in (g.span() for g in _group.finditer(m.group()))]
        for i, (a, _) in enumerate(groups):
            before = text[a - 1] if a else ""
            start = a - 1 if before == "+" or before == "(" else a
            if before == "(" and a > 1 and text[a - 2] == "+":
                start = a - 2
            n = 0
            for j in range(i, len(groups)):  # ends with the 20th digit
                b = groups[j][1]
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                inner = text[a:b]
                if j == i + 3 and inner.count(".") == 3 and " " not in inner:
                    out.add((a, 1, b))
                if 12 <= n and not set(inner) - set("0123456789 -"):
                    out.add((a, 2, b))
                if 7 <= n <= 15:
                    out.add((start, 3, b))
    if "@" in text or "(at)" in text or "[at]" in text:
        out.update((m.start(), 0, m.end()) for m in _apart.finditer(text))
    return sorted(out)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of the span and the characters and words around it."""
    span = text[start:end]
    groups = _group.findall(span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    left, right = text[max(0, start - 2):start], text[end:end + 2]
    word = lambda c: float(c.isalnum()) if c else 0.0
    context = text[max(0, start - 32):start]
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(sizes[0]), float(sizes[-1]), float(max(sizes)), float(min(sizes)),
        float(len(set(sizes)) == 1), float(bool(digits) and luhn(digits)), float(span[0] == "+"), float("(" in span), float("-" in span),
        float("." in span), float(" " in span), float(kind == 1 and _octets(span)), float(max((int(g[:6]) for g in groups), default=0) > 255),
        float(any(len(g) > 1 and g[0] == "0" for g in groups)), word(left[-1:]), word(right[:1]), float(left[-1:] in (".", "-", "+", "(")),
        float(right[:1] == "." and right[1:].isdigit()), float(right[:1] == "-"), float(left[-1:] == " " and left[:1].isdigit()),
        float(right[:1] == " " and right[1:].isdigit()), float(bool(_cue[KINDS[kind]].search(context))),
        float(span.rpartition(".")[2].isalpha()) if kind == 0 else 0.0, float("@" in span), float(span.count("("))]


class Detector:
    """Trees and a threshold per kind; without enough labels of a kind nothing is added for it."""

    def __init__(self, model: BoostedTrees | None = None, cuts: list[float] | None = None):
        self.model, self.cuts = model, cuts or [2.0] * len(KINDS)

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        if not text:
            return [], []
        base = base_spans(text)
        if self.model is None:
            return base, base
        taken = [(a, b) for a, _, b in base]
        free = [c for c in candidates(text) if not _overlaps(taken, c[0], c[2])]
        if not free:
            return base, base
        scores = self.model.predict(np.array([features(text, *c) for c in free])).tolist()
        added: list[tuple[int, int, int]] = []
        reach = 64  # buckets of this many characters hold what is taken, so that a text with many spans stays linear
        held: dict[int, list[tuple[int, int]]] = {}
        for _, (a, k, b) in sorted((x for x in zip(scores, free) if x[0] >= self.cuts[x[1][1]]), key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
            near = range(a // reach, (b - 1) // reach + 1)
            if not any(_overlaps(held.get(n, []), a, b) for n in near):
                added.append((a, k, b))
                for n in near:
                    held.setdefault(n, []).append((a, b))
        return base, sorted(base + added)


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the spans, which are sorted by start and hardly overlap each other."""
    at = bisect.bisect_left(spans, (end, 0))
    return any(start < b for _, b in spans[max(0, at - 4):at])


def _spoilt(text: str, start: int, kind: int, end: int) -> str | None:
    """The text with a span changed so that it fails its check: a known negative of the same shape."""
    span = text[start:end]
    if kind == 0:
        head, _, last = span.rpartition(".")
        return text[:start] + head + "." + "7" * len(last) + text[end:]
    if kind == 2:
        return text[:end - 1] + str((int(span[-1]) + 1) % 10) + text[end:]
    if kind == 1:
        first = span.index(".")
        return text[:start] + ("9" * first if first > 2 else "999") + text[start + first:]
    return None


Example = tuple[list[float], int, int, int, int]


def weak_examples(text: str | None) -> list[Example]:
    """(features, kind, label, h, e) of the labelled candidates of a text; h is a hash of the text, e one of the example."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(a, b) for a, _, b in base]
    known = set(base)
    found = [(features(text, *s), s, 1, 0) for s in base]
    for s in base:
        start, kind, end = s
        if wrong := _spoilt(text, start, kind, end):
            found.append((features(wrong, start, kind, end + len(wrong) - len(text)), s, 0, 1))
    for c in candidates(text):
        if c not in known and (_overlaps(spans, c[0], c[2]) or not checked(KINDS[c[1]], text[c[0]:c[2]])):
            found.append((features(text, *c), c, 0, 0))
    whole = hashlib.blake2b(text.encode(errors="replace"), digest_size=16).digest()
    h = int.from_bytes(whole[:8], "little", signed=True)
    return [(x, s[1], y, h, int.from_bytes(hashlib.blake2b(repr((s, y, spoilt)).encode(), digest_size=7, key=whole).digest(), "little")) for x, s, y, spoilt in found]


#: Hashes of examples lie below this.
_HASHES = 1 << 56


def train(rows: list[Example]) -> BoostedTrees | None:
    """Trees of the sampled examples, in the order of their hashes; None if they are of one label."""
    rows = sorted(rows, key=lambda r: (r[4], r[1], r[2]))
    if len({r[2] for r in rows}) < 2:
        return None
    return BoostedTrees().fit(np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float))


def _bin(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * BINS).astype(np.int64), BINS - 1)


def cuts(bins: dict[tuple[int, int, int], int], precision: float) -> list[float]:
    """Thresholds of the kinds from counts by (kind, label, bin of the score): the lowest from which on the share of positives, one
    negative added, is at least ``precision``, and one half at least; 2 if there is none."""
    out = []
    for k in range(len(KINDS)):
        hits = np.array([bins.get((k, 1, b), 0) for b in range(BINS)])[::-1].cumsum()[::-1]
        every = hits + np.array([bins.get((k, 0, b), 0) for b in range(BINS)])[::-1].cumsum()[::-1]
        good = np.flatnonzero((hits / (every + 1) >= precision) & (hits > 0))
        out.append(max(0.5, float(good[0]) / BINS) if len(good) else 2.0)
    return out


def held_out(h: int) -> bool:
    return h % 3 == 0


def fit(docs: DataFrame, text: str = "text", per_label: int = PER_LABEL, precision: float = PRECISION) -> Detector:
    """Trees from about ``per_label`` training examples of each kind and label (all, where there are fewer), and thresholds from all
    held-out examples of all documents."""
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("kind", T.IntegerType()),
                           T.StructField("y", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("e", T.LongType())])
    types = [pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            rows = [r for t in batch.column(0).to_pylist() for r in weak_examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], schema.names)

    # copies of a text give the same examples: each is there once
    found = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, schema)
    examples = written(found.groupBy("kind", "y", "h", "e").agg(F.first("x").alias("x")), "pii-examples")
    own = F.col("h") % 3 == 0
    sizes = examples.where(~own).groupBy("kind", "y").agg(F.count("*").alias("n")).collect()
    least = F.lit(False)
    for r in sizes:
        least = least | ((F.col("kind") == r["kind"]) & (F.col("y") == r["y"]) & (F.col("e") < min(_HASHES, int(_HASHES * (per_label / r["n"])))))
    model = train([(r["x"], r["kind"], r["y"], r["h"], r["e"]) for r in examples.where(~own & least).collect()])
    if model is None:
        return Detector()
    shipped = Shipped(docs.sparkSession, model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.open()
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                at = _bin(trees.predict(flat.reshape(batch.num_rows, -1)))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at.astype(np.int32))], ["kind", "y", "bin"])

    told = examples.where(own).select("x", "kind", "y").mapInArrow(score, "kind int, y int, bin int").groupBy("kind", "y", "bin").agg(F.count("*").alias("n")).collect()
    return Detector(model, cuts({(r["kind"], r["y"], r["bin"]): r["n"] for r in told}, precision))


def fit_examples(rows: list[Example], per_label: int = PER_LABEL, precision: float = PRECISION) -> Detector:
    """:func:`fit` on a list of examples."""
    rows = list({r[1:]: r for r in rows}.values())
    sizes: dict[tuple[int, int], int] = {}
    for r in rows:
        if not held_out(r[3]):
            sizes[r[1], r[2]] = sizes.get((r[1], r[2]), 0) + 1
    model = train([r for r in rows if not held_out(r[3]) and r[4] < min(_HASHES, int(_HASHES * (per_label / sizes[r[1], r[2]])))])
    if model is None:
        return Detector()
    bins: dict[tuple[int, int, int], int] = {}
    for r in rows:
        if held_out(r[3]):
            key = (r[1], r[2], int(_bin(model.predict(np.array([r[0]])))[0]))
            bins[key] = bins.get(key, 0) + 1
    return Detector(model, cuts(bins, precision))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, done, a0, k0 = [], 0, -1, 0
    reach = 0
    for a, k, b in spans:
        if a0 >= 0 and a < reach:
            reach = max(reach, b)
            continue
        if a0 >= 0:
            out += [text[done:a0], f"[{KINDS[k0].upper()}]"]
            done = reach
        a0, k0, reach = a, k, b
    if a0 >= 0:
        out += [text[done:a0], f"[{KINDS[k0].upper()}]"]
        done = reach
    return "".join(out) + text[done:]


def _map(docs: DataFrame, text: str, own: list[str], made: list[T.StructField], detector: Detector, rows) -> DataFrame:
    shipped = Shipped(docs.sparkSession, detector)  # some hundred tree nodes
    names = [f.name for f in made]
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in made]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = shipped.open()
        for batch in pieces(batches, text):
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            found = [rows(t, *detector.spans(t)) for t in column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(c) for c in own] + [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], own + names)

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in own] + made))


def find_pii(docs: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """``docs`` (without its text) with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all, joined)."""
    made = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    own = [c for c in docs.columns if c != text and c not in {f.name for f in made}]

    def row(_text, base, spans):
        count = [0] * len(KINDS)
        for _, k, _ in base:
            count[k] += 1
        return (*count, sha256_hex(_joined(base).encode()), _joined(spans))

    return _map(docs, text, own, made, detector or fit(docs, text), row)


def redact_documents(docs: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced by their kinds; column order and types stay."""
    own = [c for c in docs.columns if c != text]
    made = [T.StructField(text, T.StringType())]
    out = _map(docs, text, own, made, detector or fit(docs, text), lambda t, _base, spans: (t if not spans else redact(t, spans),))
    return out.select(docs.columns)
