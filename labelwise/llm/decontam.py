"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a few MB of documents) is written as numbers: a word of the benchmark gets its rank, any other word 0.  The
suffixes that begin like some benchmark window are sorted by their leading words, which is the shard's suffix array (no
other suffix can match).  Each benchmark window is then looked up by two binary searches; all suffixes between them are
verbatim occurrences.  Occurrences on one diagonal join to the longest verbatim matches, with their places in document
and item.  Words of a document inside an occurrence are hit, and documents with a hit are affected.

A window is WINDOW consecutive words of an item; a shorter item is one window.  The benchmark is read in blocks of at
most BLOCK_BYTES of text, chosen by a hash of the item id, so what is held at once is bounded whatever its size; every
block is searched in every shard.

Defined cases: null, empty or wordless texts have no hit; items without words have no window; an item with a null id
hits words but cannot be listed.  Repeated rows are judged one by one.  Columns of the input that bear the name of a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwise.llm.common import Shipped, pieces, text_buffer, word_bounds, word_hashes

WINDOW = 10
LEAD = 3
BLOCK_BYTES = 16 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.IntegerType()),
                      T.StructField("item_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])


def _rows(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int, pad: int = 0) -> np.ndarray:
    """The ``width`` numbers from each place on, cut at ``ends`` and padded, as byte strings that sort like the numbers."""
    cells = at[:, None] + np.arange(width)
    inside = cells < ends[:, None]
    out = np.where(inside, ids[np.minimum(cells, max(len(ids) - 1, 0))], np.uint32(pad)).astype(">u4")
    return np.ascontiguousarray(out).view(f"S{4 * width}").ravel()


class Block:
    """Windows of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.names = [i for i, _ in items]
        data, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = word_bounds(data, offsets, "alnum")
        hashes = word_hashes(data, starts, ends, fold=True)
        self.words, ids = np.unique(hashes, return_inverse=True)
        ids = (ids + 1).astype(np.uint32)
        size = np.diff(first)
        self.lead = min([LEAD, *size[size > 0].tolist()]) if len(size) else LEAD
        item = np.repeat(np.arange(len(items)), np.where(size == 0, 0, np.maximum(size - window, 0) + 1))
        pos = np.concatenate([np.arange(max(n - window, 0) + 1) for n in size if n] or [np.zeros(0, int)]).astype(np.int64)
        at = first[:-1][item] + pos
        length = np.minimum(size[item], window)
        low, high = _rows(ids, at, at + length, window), _rows(ids, at, at + length, window, 0xFFFFFFFF)
        order = np.lexsort((high, low))
        self.item, self.pos, self.length = item[order], pos[order], length[order]
        self.low, self.high = low[order], high[order]
        self.leads = np.unique(_rows(ids, at, at + self.lead, self.lead))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of every word of the benchmark, 0 for others."""
        out = np.zeros(len(hashes), np.uint32)
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        out[maybe] = np.where(self.words[at] == hashes[maybe], at + 1, 0)
        return out

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and place of every occurrence in the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.low) or not len(hashes):
            return none, none
        ids = self.number(hashes)
        doc_end = np.repeat(first[1:], np.diff(first))
        maybe = np.flatnonzero(ids)
        if self.lead > 1 and len(maybe):  # only suffixes whose first words begin some window
            full = maybe[maybe + self.lead <= doc_end[maybe]]
            maybe = full[np.logical_and.reduce([ids[full + k] > 0 for k in range(self.lead)])] if len(full) else full
        if not len(maybe):
            return none, none
        lead = _rows(ids, maybe, doc_end[maybe], self.lead)
        near = np.minimum(np.searchsorted(self.leads, lead), len(self.leads) - 1)
        places = maybe[self.leads[near] == lead]
        if not len(places):
            return none, none
        keys = _rows(ids, places, doc_end[places], self.window)
        order = np.argsort(keys, kind="stable")  # the suffix array of the shard
        keys, places = keys[order], places[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        return window, places[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]


def _matches(block: Block, window: np.ndarray, place: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins occurrences that continue each other to longest matches: row, item, document word, item word, length."""
    item, pos, doc = block.item[window], block.pos[window], place - first[row]
    order = np.lexsort((pos, doc - pos, item, row))
    row, item, pos, doc, size = row[order], item[order], pos[order], doc[order], block.length[window][order]
    new = np.ones(len(row), bool)
    if len(row) > 1:
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (doc[1:] - pos[1:] != doc[:-1] - pos[:-1]) | (pos[1:] != pos[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(row))[:len(start)] - 1
    return row[start], item[start], doc[start], pos[start], pos[last] - pos[start] + size[last]


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, each collected on its own."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // limit) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield Block([(r["i"], r["t"]) for r in part.collect()])


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words (long), hit (array of [start, end) word spans, merged) and matches (array of MATCH)."""
    made = [T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("matches", T.ArrayType(MATCH))]
    names = [f.name for f in made]
    out = docs.drop(*[c for c in names if c != text])
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        own = [f for f in out.schema if f.name not in names]
        shipped = Shipped(docs.sparkSession, block)  # at most block_bytes of text
        out = out.mapInArrow(_searcher(shipped, text, [f.name for f in own], names, k > 0), T.StructType(own + made))
    return out


def _searcher(shipped, text: str, own: list[str], names: list[str], again: bool):
    hit_type, match_type = pa.list_(pa.list_(pa.int32())), pa.list_(pa.struct(
        [("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.open()
        for batch in pieces(batches, text):
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            data, offsets = text_buffer(column(text))
            starts, ends, first = word_bounds(data, offsets, "alnum")
            window, place = block.search(word_hashes(data, starts, ends, fold=True), first)
            row = np.searchsorted(first, place, side="right") - 1
            spans: list[list] = [list(x or []) for x in column(names[1]).to_pylist()] if again else [[] for _ in range(batch.num_rows)]
            found: list[list] = [list(x or []) for x in column(names[2]).to_pylist()] if again else [[] for _ in range(batch.num_rows)]
            for r, i, d, p, n in zip(*(x.tolist() for x in _matches(block, window, place, row, first))):
                found[r].append({"item_id": block.names[i], "doc_word": d, "item_word": p, "n_words": n})
                spans[r].append((d, d + n))
            yield pa.RecordBatch.from_arrays(
                [column(c) for c in own] + [pa.array(np.diff(first), pa.int64()), pa.array([_merged(s) for s in spans], hit_type),
                                            pa.array(found, match_type)], own + names)

    return run


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (longs), items_sha256 and contaminated, from the matches."""
    out = find_matches(docs.drop("n_hit", "n_items", "items_sha256", "contaminated"), benchmark, text, **options)
    items = F.sort_array(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    return out.withColumn("_items", items).withColumns({
        "n_hit": n_hit, "n_items": F.size("_items").cast("long"), "items_sha256": F.sha2(F.array_join("_items", ","), 256),
        "contaminated": F.size("hit") > 0}).drop("_items", "hit", "matches")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns."""
    own = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return find_matches(own, benchmark, "_text", **options).where(F.size("hit") == 0).select("_row.*")
