"""Removal of long repeated word passages with a compressed FM-index per shard.

A shard indexes the spans that share anchors (see ``repeats``): their words as one sequence, its suffix order, the
Burrows-Wheeler transform of that order in a wavelet matrix of packed bits with rank counts.  The spans' windows are
streamed through it by backward search, all at once: every step takes one more word to the left and narrows the interval
of suffixes; the steps a window survives with company are its matching statistic, capped at the threshold ``width``.  A
window that reaches the threshold reports its interval, and the smallest document in the interval decides: the words of a
window go in every document with a larger doc_id.

The order only has to be right for the first ``width`` words of the suffixes, so the sort stops there.

Defined cases: a null doc_id comes after all others and never makes another document's words go; rows of one doc_id do not
affect each other; null texts have no words; texts with fewer than ``width`` words stay whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.repeats import remove_repeats

WIDTH, SEED = 50, 16
_NONE = np.iinfo(np.int64).max


class BitRank:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            self.levels.append((bit, BitRank(ones), int(len(ones) - ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        symbols = np.arange(sigma)
        self.start = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, rank, zeros in self.levels:
            ones = rank.ones(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        return self._down(symbol, i) - self.start[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling."""
    rank, reach, n = text.astype(np.int64), 1, len(text)
    while reach < depth:
        after = np.zeros(n, np.int64)
        after[:max(n - reach, 0)] = rank[reach:] + 1
        _, rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)
        reach *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Index of sequences of symbols 1 .. sigma - 1; symbol 0 ends each of them."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.suffixes = suffix_order(text, depth)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.transform = WaveletMatrix(text[self.suffixes - 1], sigma)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffixes that begin with the symbol and go on like those in [low, high)."""
        return self.counts[symbol] + self.transform.rank(symbol, low), self.counts[symbol] + self.transform.rank(symbol, high)

    def matching_statistics(self, text: np.ndarray, last: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place ``last`` of ``text`` (itself indexed): how far back, up to ``cap`` symbols, the words that end
        there occur elsewhere too, and the interval of suffixes that was reached."""
        length = np.zeros(len(last), np.int64)
        low, high = np.zeros(len(last), np.int64), np.full(len(last), len(self.suffixes), np.int64)
        going = np.arange(len(last))
        for k in range(cap):
            low[going], high[going] = self.step(text[last[going] - k], low[going], high[going])
            going = going[high[going] - low[going] > 1]
            length[going] = k + 1
            if not len(going):
                break
        return length, low, high


class RangeMin:
    """Minimum of a range, from minima of power-of-two lengths up to the longest range asked for."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        while (1 << len(self.rows)) <= longest:
            half, prev = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(prev[:len(prev) - half], prev[half:]))

    def ask(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][low[at]], self.rows[k][high[at] - (1 << k)])
        return out


def first_documents(contents: list[bytes], n: np.ndarray, off: np.ndarray, times: np.ndarray, least: list, width: int = WIDTH,
                    seed: int = SEED, batch: int = 200_000) -> list:
    """For each span the smallest document of each of its windows, or None where no window occurs in two documents."""
    own = np.array([_NONE if x is None else x for x in least], np.int64)
    first = [np.full(k, d) for k, d in zip(n.tolist(), own.tolist())]
    lead = [c[8 * o:8 * (o + seed)] for c, o in zip(contents, off.tolist())]
    shared = [k for k, x in enumerate(lead) if (k and lead[k - 1] == x) or (k + 1 < len(lead) and lead[k + 1] == x)]
    changed = times > 1
    if shared:
        size = np.array([len(contents[k]) // 8 for k in shared])
        words, ids = np.unique(np.frombuffer(b"".join([contents[k] for k in shared]), np.uint64), return_inverse=True)
        of = np.repeat(np.arange(len(shared)), size)
        text = np.zeros(len(ids) + len(shared), np.int64)
        text[np.arange(len(ids)) + of] = ids + 1  # one 0 after each span
        begin = np.cumsum(size + 1) - size - 1
        index = FMIndex(text, len(words) + 1, width)
        owner = np.repeat(np.arange(len(shared)), size + 1)
        spans = np.array(shared)
        docs = own[spans][owner[index.suffixes]]
        asked = n[spans]
        span = np.repeat(np.arange(len(shared)), asked)
        window = np.arange(len(span)) - np.repeat(np.cumsum(asked) - asked, asked)
        last = begin[span] + window + width - 1
        for a in range(0, len(last), batch):
            length, low, high = index.matching_statistics(text, last[a:a + batch], width)
            hit = np.flatnonzero(length >= width)
            if not len(hit):
                continue
            found = RangeMin(docs, int((high[hit] - low[hit]).max())).ask(low[hit], high[hit])
            for s, w, d in zip(spans[span[a + hit]].tolist(), window[a + hit].tolist(), found.tolist()):
                if d < first[s][w]:
                    first[s][w] = d
                    changed[s] = True
    return [x.astype("<i8").tobytes() if c else None for x, c in zip(first, changed.tolist())]


def _whole(_times: np.ndarray, least: list) -> bytes:
    return np.array([_NONE if x is None else x for x in least], "<i8").tobytes()


def _flags(answer: bytes, n: int, doc) -> np.ndarray:
    return np.frombuffer(answer, "<i8", count=n) < (_NONE if doc is None else doc)


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, **options) -> DataFrame:
    """(rid, doc_id, n_words, n_removed, n_spans, kept_sha256, and kept with keep_text=True) of every row."""
    def solver(contents, n, off, times, least):
        return first_documents(contents, n, off, times, least, width, seed)

    ids = docs.withColumn(doc_id, F.col(doc_id).cast("long"))
    out = remove_repeats(ids, True, width, seed, solver, _whole, _flags, "fm", doc_id, text, **options)
    return out.withColumnRenamed("n_units", "n_words")
