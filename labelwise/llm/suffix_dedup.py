"""Exact substring de-duplication of bytes by suffix arrays over range partitions.

The suffixes that matter begin at the anchors of the windows (see ``repeats``); sampled splitters range-partition them by
their leading bytes.  A partition sorts its suffixes, and the reversed texts before them, by multikey quicksort: eight
bytes at a time, three-way, going on only inside runs that are still equal, and noting the common prefix of neighbours.
A window that reaches ``l`` bytes to the left of its anchor occurs again if another suffix agrees with it on the
``width - l`` bytes to the right and the ``l`` bytes to the left, that is if both lie in one run of either order at those
depths.  Splitters never part suffixes that agree on their leading bytes, so suffixes that face each other across a
boundary differ within the seed and share no window.

Every byte covered by a window that also starts anywhere else, in the same text too, is removed; all copies go.

Defined cases: a null text is empty; texts shorter than the window stay whole; repeated rows are copies of each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.repeats import remove_repeats

WIDTH, SEED = 200, 64


def multikey_sort(raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings raw[begin:begin + length], and the common prefix of each with the one before it in that order.

    Strings are compared as bytes plus one, so that the end of a string comes before any byte.
    """
    n = len(begin)
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order that still stand in a run of equals
    run = np.zeros(n, np.int64)
    depth = 0
    padded = np.concatenate([raw + np.uint8(1), np.zeros(8, np.uint8)])
    while len(open_):
        who = order[open_]
        left = length[who] - depth
        cells = padded[np.minimum(begin[who, None] + depth + np.arange(8), len(padded) - 1)]
        cells[np.arange(8)[None, :] >= left[:, None]] = 0
        word = np.ascontiguousarray(cells).view(">u8").ravel().astype(np.uint64)
        rank = np.lexsort((word, run))
        who, word, left, run = who[rank], word[rank], left[rank], run[rank]
        order[open_] = who
        same_run = np.zeros(len(open_), bool)
        same_run[1:] = run[1:] == run[:-1]
        differ = np.zeros(len(open_), np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        equal = same_run & (differ == 0)
        agree = np.full(len(open_), 8)
        split = same_run & (differ != 0)
        agree[split] = _equal_bytes(differ[split])
        common[open_[same_run]] = depth + agree[same_run]
        ended = left < 8  # the word holds the end: equal strings
        goes_on = equal & ~ended
        keep = goes_on.copy()
        keep[:-1] |= goes_on[1:]
        run = np.cumsum(~equal)
        open_, run = open_[keep], run[keep]
        depth += 8
    common[1:] = np.minimum(common[1:], np.minimum(length[order[1:]], length[order[:-1]]))
    return order, common


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading equal bytes of two words, from their difference."""
    out = np.zeros(len(differ), np.int64)
    for shift in (56, 48, 40, 32, 24, 16, 8):
        out += differ >> np.uint64(shift) == 0
    return out


def repeated_windows(contents: list[bytes], n: np.ndarray, off: np.ndarray, times: np.ndarray, least: list, width: int = WIDTH,
                     seed: int = SEED) -> list:
    """For each span the packed flags of its windows that occur at least twice in the corpus, or None."""
    flags = [np.ones(k, bool) if t > 1 else np.zeros(k, bool) for k, t in zip(n.tolist(), times.tolist())]
    lead = [c[o:o + seed] for c, o in zip(contents, off.tolist())]
    alone = [(k == 0 or lead[k - 1] != x) and (k + 1 == len(lead) or lead[k + 1] != x) for k, x in enumerate(lead)]
    rest = np.array([k for k, a in enumerate(alone) if not a], np.int64)
    if len(rest):
        size = np.array([len(contents[k]) for k in rest.tolist()])
        raw = np.frombuffer(b"".join([contents[k] for k in rest.tolist()]), np.uint8)
        begin = np.cumsum(size) - size
        o, m, t = off[rest], n[rest], times[rest]
        right, r_common = multikey_sort(raw, begin + o, size - o)
        left, l_common = multikey_sort(raw[::-1], len(raw) - begin - o, o)
        r_class, l_class = np.empty(len(rest), np.int64), np.empty(len(rest), np.int64)
        for reach in range(int(o.max()) + 1):
            owner = np.flatnonzero((reach <= o) & (o - reach < m))
            if len(owner) < 2:
                continue
            r_class[right] = np.cumsum(r_common < width - reach)
            l_class[left] = np.cumsum(l_common < reach)
            _, group, size_ = np.unique(r_class[owner] * (len(rest) + 1) + l_class[owner], return_inverse=True, return_counts=True)
            for k in owner[size_[group] > 1].tolist():
                flags[rest[k]][o[k] - reach] = True
    return [np.packbits(f).tobytes() if f.any() else None for f in flags]


def _whole(times: np.ndarray, _least: list) -> bytes | None:
    return np.packbits(times > 1).tobytes() if (times > 1).any() else None


def _flags(answer: bytes, n: int, _doc) -> np.ndarray:
    return np.unpackbits(np.frombuffer(answer, np.uint8), count=n).astype(bool)


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, **options) -> DataFrame:
    """(rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept with keep_text=True) of every row."""
    def solver(contents, n, off, times, least):
        return repeated_windows(contents, n, off, times, least, width, seed)

    out = remove_repeats(docs, False, width, seed, solver, _whole, _flags, "suffix", doc_id, text, **options)
    return out.withColumnRenamed("n_units", "n_bytes")
