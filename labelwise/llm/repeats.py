"""Repeated windows in a corpus: the frame shared by the suffix-array and the FM-index de-duplication.

A text is a sequence of units (bytes or words); a window is ``width`` consecutive units.  Which windows occur elsewhere is
decided in shards by a solver (an operator's method); this module brings together what can match, and applies the answer.

1. Every window has an anchor: the place in it where the hash of ``seed`` consecutive units is least (leftmost).  Equal
   windows have the same anchor content at the same offset.  Neighbouring windows mostly share an anchor, so a text is
   covered by few spans: an anchor, and the windows that it owns, about (width - seed) / 2 of them.
2. Anchors are dealt by their hash; those whose content occurs once in the corpus are dropped, streaming.  Of an anchor
   that a piece of the scan already holds twice, one row is dealt so and the others anywhere, so no anchor is hot.
3. The spans of what is left are cut from the texts; equal spans are combined with their count and smallest document, so
   a passage that a third of the corpus shares is one row in its interior.
4. Spans are range-partitioned by the ``seed`` units at their anchor (Spark samples the splitters), sorted, and handed to
   the solver in chunks that never separate equal anchors.  An anchor with too many distinct spans for one task is
   solved by its windows instead.
5. The answer goes back to the occurrences of each span and is applied to the texts.

Rows are identified by their number in the scan; the input must be read in the same order each time, as files are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import (BASE_A, BASE_B, as_long, byte_symbols, mix64, pieces, sha256_hex, slice_hash, text_buffer, word_bounds,
                                  word_hashes, written)

PIECE = 1 << 20
#: Bytes of text of which the symbols and hashes, some hundred bytes for each, are held at once.
SLICE = 1 << 17
CHUNK = 4_000_000
#: Distinct spans of one anchor that one task may solve together, and the most anchors that are dealt by window instead.
HOT_SPANS, MAX_HOT = 100_000, 10_000


class Units:
    """The units of some texts: symbols end to end, and the n + 1 offsets of the texts."""

    def __init__(self, column: pa.Array, words: bool):
        self.data, self.offsets = text_buffer(column)
        self.words = words
        if words:
            self.starts, self.ends, self.first = word_bounds(self.data, self.offsets, "space")
            self.symbols = word_hashes(self.data, self.starts, self.ends, fold=False)
        else:
            self.first, self.symbols = self.offsets, byte_symbols(self.data)

    def content(self) -> np.ndarray:
        """What a span's content is cut from."""
        return self.symbols if self.words else self.data

    def kept(self, row: int, covered: np.ndarray) -> bytes:
        """The units of a text that are not covered: words joined by one space, or bytes."""
        a = int(self.first[row])
        if not self.words:
            return self.data[a:a + len(covered)][~covered].tobytes()
        data = self.data
        return b" ".join([data[self.starts[i]:self.ends[i]].tobytes() for i in (a + np.flatnonzero(~covered)).tolist()])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - width + 1], prefix[width - 1:n])


def anchors(units: Units, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, place of the anchor in the span, and anchor hash of every span."""
    symbols, first = units.symbols, units.first
    n, none = len(symbols), np.zeros(0, np.int64)
    size = np.diff(first)
    if not (size >= width).any():
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(n - seed + 1)
    hashes = slice_hash(symbols, at, at + seed, BASE_A)
    least = sliding_min((hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), width - seed + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:len(anchor)]
    inside = np.arange(len(anchor)) + width <= first[1:][row]
    window = np.flatnonzero(inside)
    anchor, row = anchor[window], row[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    start = window[head]
    return row[head], start - first[row[head]], count, anchor[head] - start, hashes[anchor[head]]


def piece_anchors(texts: pa.RecordBatch, words: bool, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of the column text of a piece, found slice by slice: they never cross texts."""
    found, rows = [], 0
    for batch in pieces([texts], "text", SLICE):
        row, *rest = anchors(Units(batch.column(batch.schema.get_field_index("text")), words), width, seed)
        found.append((row + rows, *rest))
        rows += batch.num_rows
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(texts: DataFrame, words: bool, width: int, seed: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            row, start, count, off, h = piece_anchors(batch, words, width, seed)
            # an anchor met twice here is known to be repeated: one row (1) tells the others, the rest (2) need not meet them
            _, head, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            told = np.where(times[of] > 1, 2, 0).astype(np.int8)
            told[head[times > 1]] = 1
            span = start << 32 | count << 16 | off
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(told), batch.column(0).take(pa.array(row)), pa.array(span)],
                                             ["anchor", "told", "rid", "span"])

    return texts.mapInArrow(run, "anchor long, told tinyint, rid long, span long")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose anchor occurs at least twice, in one pass over sorted rows; without the anchor."""
    names = ["rid", "span"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the last row if it is not known to be repeated; the last anchor
        for batch in batches:
            if not batch.num_rows:
                continue
            h, repeated = batch.column(0).to_numpy(), batch.column(1).to_numpy() > 0
            same = h[1:] == h[:-1]
            repeated[1:] |= same
            repeated[:-1] |= same
            if h[0] == last:
                repeated[0] = True  # a run goes on; its further rows equal their neighbours
                if held is not None:
                    yield held
            if repeated.any():
                yield batch.select(names).filter(pa.array(repeated))
            last = h[-1]
            held = None if repeated[-1] else batch.select(names).slice(batch.num_rows - 1, 1)

    deal = F.when(F.col("told") == 2, F.xxhash64("anchor", "rid", "span")).otherwise(F.col("anchor"))
    return rows.repartition(deal).sortWithinPartitions("anchor").mapInArrow(run, "rid long, span long")


def _keys(units: Units, begin: np.ndarray, end: np.ndarray, n: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of spans, from content, number of windows and anchor place."""
    salt = n.astype(np.uint64) << np.uint64(32) | off.astype(np.uint64)
    with np.errstate(over="ignore"):
        return tuple(slice_hash(units.symbols, begin, end, base) + salt * np.uint64(k) for base, k in
                     ((BASE_A, 0x9E6C63D0876A9A47), (BASE_B, 0xD1342543DE82EF95)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column; null counts as empty."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), lengths.astype(np.int64)


def _unpacked(column: pa.Array) -> pa.Array:
    """Compressed texts as a binary column; null stays null."""
    return pa.array([None if x is None else zlib.decompress(x) for x in column.to_pylist()], pa.large_binary())


def _packed(numbered: DataFrame) -> DataFrame:
    """The texts compressed, before they are shuffled."""
    kind = dict(numbered.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            packed = [None if t is None else zlib.compress(t.encode(), 1) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["rid", "doc_id", "packed"])

    return numbered.mapInArrow(run, f"rid long, doc_id {kind}, packed binary")


_STAGED = "rid long, doc_id {kind}, n_units long, kept_sha256 string, packed binary, starts array<int>, ns array<int>, offs array<int>, h1 array<long>, h2 array<long>"


def _staged(numbered: DataFrame, marks: DataFrame, words: bool, width: int) -> DataFrame:
    """Every document once: texts without repeated anchors are finished (kept as they are), others carry text and spans."""
    lists = marks.groupBy("rid").agg(F.sort_array(F.collect_list("span")).alias("spans"))  # bounded by one text
    joined = _packed(numbered).join(lists.hint("merge"), "rid", "left").select("rid", "doc_id", "packed", "spans")
    schema = _STAGED.format(kind=dict(numbered.dtypes)["doc_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", SLICE // 3):
            units = Units(_unpacked(batch.column(2)), words)
            span, size = _flat(batch.column(3))
            start, n, off = span >> 32, span >> 16 & 0xFFFF, span & 0xFFFF
            row = np.repeat(np.arange(batch.num_rows), size)
            begin = units.first[:-1][row] + start
            h1, h2 = (as_long(h) for h in _keys(units, begin, begin + n + width - 1, n, off))
            edge = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            plain = [None if size[r] else sha256_hex(units.kept(r, np.zeros(int(units.first[r + 1] - units.first[r]), bool))) for r in range(batch.num_rows)]
            packed = pa.array([t if m else None for t, m in zip(batch.column(2).to_pylist(), size.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(units.first), pa.int64()), pa.array(plain, pa.string()), packed,
                 *[pa.ListArray.from_arrays(edge, pa.array(x)) for x in (start.astype(np.int32), n.astype(np.int32), off.astype(np.int32), h1, h2)]],
                ["rid", "doc_id", "n_units", "kept_sha256", "packed", "starts", "ns", "offs", "h1", "h2"])

    return joined.mapInArrow(run, schema)


def _spans(staged: DataFrame, words: bool, width: int, seed: int) -> DataFrame:
    """Distinct spans: lead (the units at the anchor), content, n, off, times, least (smallest doc_id)."""
    kind = dict(staged.dtypes)["doc_id"]
    unit = 8 if words else 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", SLICE // 3):
            units = Units(_unpacked(batch.column(1)), words)
            (start, size), (n, _), (off, _) = (_flat(batch.column(i)) for i in (2, 3, 4))
            row = np.repeat(np.arange(batch.num_rows), size)
            begin = units.first[:-1][row] + start
            raw, end = units.content().tobytes(), begin + n + width - 1
            cut = [raw[a * unit:b * unit] for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)),
                                              batch.column(0).take(pa.array(row))], ["content", "n", "off", "doc_id"])

    rows = staged.where("packed IS NOT NULL").select("doc_id", "packed", "starts", "ns", "offs").mapInArrow(
        run, f"content binary, n int, off int, doc_id {kind}")
    merged = rows.groupBy("content", "n", "off").agg(F.count("*").alias("times"), F.min("doc_id").alias("least"))
    lead = F.expr(f"substring(content, 1 + off * {unit}, {seed * unit})")
    return merged.select(lead.alias("lead"), "content", "n", "off", "times", "least")


#: A solver gets contents, n, off, times, least of a chunk and returns for each span None or the bytes of its answer.
Solver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, list], list]


#: Makes a span's answer from the count and the smallest document of each of its windows.
Whole = Callable[[np.ndarray, list], "bytes | None"]


def _solved(spans: DataFrame, words: bool, width: int, solver: Solver, whole: Whole, chunk: int, hot_spans: int) -> DataFrame:
    """(h1, h2, answer) of the spans that are answered.

    An anchor with more distinct spans than ``hot_spans``, and more than a MAX_HOT-th of all, is not solved in one task:
    its windows are dealt one by one.  So at most MAX_HOT anchors are singled out, whatever the size of the corpus.
    """
    name = F.xxhash64("lead")
    sizes = spans.groupBy(name.alias("anchor")).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    hot = [r["anchor"] for r in sizes.where(F.col("count") > max(hot_spans, total // MAX_HOT)).collect()]
    if not hot:
        return _in_chunks(spans, words, solver, chunk)
    return _in_chunks(spans.where(~name.isin(hot)), words, solver, chunk).unionByName(_by_window(spans.where(name.isin(hot)), words, width, whole))


def _by_window(spans: DataFrame, words: bool, width: int, whole: Whole) -> DataFrame:
    """The answers of spans whose anchor is hot: every window is a row, combined by its 128-bit name before the shuffle."""
    kind = dict(spans.dtypes)["least"]

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content", SLICE):
            contents = batch.column(1).to_pylist()
            n, off, times = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            h1, h2 = span_names(contents, n, off, words)
            raw = np.frombuffer(b"".join(contents), np.uint64 if words else np.uint8)
            first = np.concatenate([[0], np.cumsum([len(c) // (8 if words else 1) for c in contents])]).astype(np.int64)[:-1]
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = first[row] + at
            symbols = raw if words else byte_symbols(raw)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(as_long(slice_hash(symbols, begin, begin + width, b))) for b in (BASE_A, BASE_B)], pa.array(as_long(h1)[row]), pa.array(as_long(h2)[row]),
                 pa.array(at), pa.array(times[row]), batch.column(5).take(pa.array(row))], ["w1", "w2", "h1", "h2", "at", "times", "least"])

    windows = spans.mapInArrow(explode, f"w1 long, w2 long, h1 long, h2 long, at long, times long, least {kind}")
    summed = windows.groupBy("w1", "w2").agg(F.sum("times").alias("times"), F.min("least").alias("least"))
    back = windows.select("w1", "w2", "h1", "h2", "at").join(summed, ["w1", "w2"]).groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list(F.struct("at", "times", "least"))).alias("x")).select("h1", "h2", "x.times", "x.least")  # at most ``width`` windows

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [whole(np.array(t), x) for t, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["h1", "h2", "answer"])
            yield out.filter(out.column(2).is_valid())

    return back.mapInArrow(answer, "h1 long, h2 long, answer binary")


def _in_chunks(spans: DataFrame, words: bool, solver: Solver, chunk: int) -> DataFrame:

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > chunk and r[0] != rows[-1][0]:
                    yield answer(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[1])
        if rows:
            yield answer(rows)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        contents = [r[1] for r in rows]
        n, off, times = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        found = solver(contents, n, off, times, [r[5] for r in rows])
        some = np.array([k for k, x in enumerate(found) if x is not None], np.int64)
        h1, h2 = span_names([contents[k] for k in some.tolist()], n[some], off[some], words)
        return pa.RecordBatch.from_arrays([pa.array(as_long(h1)), pa.array(as_long(h2)), pa.array([found[k] for k in some.tolist()], pa.binary())],
                                          ["h1", "h2", "answer"])

    parts = spans.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return spans.repartitionByRange(int(parts), "lead").sortWithinPartitions("lead").mapInArrow(run, "h1 long, h2 long, answer binary")


def span_names(contents: list[bytes], n: np.ndarray, off: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The names that ``_keys`` gives the spans in their texts."""
    units = Units.__new__(Units)
    raw = np.frombuffer(b"".join(contents), np.uint64 if words else np.uint8)
    units.symbols = raw if words else byte_symbols(raw)
    edge = np.concatenate([[0], np.cumsum([len(c) // (8 if words else 1) for c in contents])]).astype(np.int64)
    return _keys(units, edge[:-1], edge[1:], n, off)


def remove_repeats(docs: DataFrame, words: bool, width: int, seed: int, solver: Solver, whole: Whole, flags: Callable[[bytes, int, object], np.ndarray],
                   name: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, hot_spans: int = HOT_SPANS, keep_text: bool = False) -> DataFrame:
    """(rid, doc_id, n_units, n_removed, n_spans, kept_sha256, and kept with ``keep_text``) of every row.

    ``flags(answer, n, doc_id)`` says which of a span's n windows are to be removed in a document.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = _repeated(_anchor_rows(numbered.select("rid", "text"), words, width, seed))
    staged = written(_staged(numbered, marks, words, width), f"{name}-staged")
    solved = _solved(written(_spans(staged, words, width, seed), f"{name}-spans"), words, width, solver, whole, chunk, hot_spans)
    places = staged.where("packed IS NOT NULL").select("rid", F.explode(F.arrays_zip("starts", "ns", "h1", "h2")).alias("p")).select(
        "rid", F.col("p.starts").alias("start"), F.col("p.ns").alias("n"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"))
    answers = places.join(solved.hint("merge"), ["h1", "h2"]).groupBy("rid").agg(F.collect_list(F.struct("start", "n", "answer")).alias("a"))  # bounded by one text
    joined = staged.select("rid", "doc_id", "n_units", "kept_sha256", "packed").join(answers.hint("merge"), "rid", "left").select(
        "rid", "doc_id", "n_units", "kept_sha256", "packed", F.col("a.start").alias("starts"), F.col("a.n").alias("ns"), F.col("a.answer").alias("answers"))
    kind = dict(numbered.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", SLICE // 3):
            ids, sizes, sha, texts, starts, ns, answers_ = (batch.column(i).to_pylist() for i in range(1, 8))
            units = Units(_unpacked(batch.column(4)), words)
            removed, runs, kept = [0] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows
            for r in range(batch.num_rows):
                if texts[r] is None:
                    continue
                change = np.zeros(sizes[r] + 1, np.int64)
                for s, n, a in zip(starts[r] or [], ns[r] or [], answers_[r] or []):
                    at = s + np.flatnonzero(flags(a, n, ids[r]))
                    change[at] += 1
                    change[at + width] -= 1
                covered = np.cumsum(change[:-1]) > 0
                removed[r] = int(covered.sum())
                runs[r] = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                left = units.kept(r, covered)
                sha[r] = sha256_hex(left)
                kept[r] = left
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()),
                 *([pa.array(kept, pa.binary())] if keep_text else [])],
                ["rid", "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    schema = f"rid long, doc_id {kind}, n_units long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return joined.mapInArrow(run, schema)
