"""Similarity join on word n-grams with an exact Jaccard bound, by T-occurrence search.

1. A text becomes the set of its distinct n-grams (64-bit hashes).  Equal sets are one class; everything below is about
   classes, so exact copies cost one row each.
2. A partner of a set holds T = 80 (90, ...) percent of its elements, so at least T of its inverted lists have a second member.
   Sets with fewer such lists link with nothing and leave, before anything else is sent; one row of every class is counted.
   A task combines the lists of every HELD n-grams it meets: one entry each, however frequent an n-gram is.
3. Two sets within the bound differ in at most d elements, d from their sizes.  The elements are dealt by hash into
   parts; at most d parts then differ, so of a set with elements in f > d parts at least f - d are equal in its partner
   (pigeonhole).  If fewer than f - d of the parts hold a single element, some equal part has several.  A set emits a
   signature for every part with several elements, and for the others only where that doesn't hold: chance brings single
   n-grams together, all the more in larger inputs, but hardly ever the same few in one part.  Sets with elements in d
   parts or less, which may miss each other, are dealt again under another name, at last the name alone.
   Signatures are counted as n-grams are in 2: sets with too few shared ones leave, be their n-grams ever so common.
4. Classes that share a signature form clusters.  Nothing else can link, and unrelated texts hardly ever meet, however
   frequent a single n-gram is.
5. In a cluster the T-occurrence search runs: inverted lists of the members' n-grams; for each member the short lists
   are merged and counted, members short of T minus the number of long lists drop out, the others are probed in the long
   lists by binary search (DivideSkip), and those that reach the required overlap are links.
6. A cluster of more than BLOCK_TOKENS n-grams is dealt over blocks, each holding the cluster's first member as well.
   Members that do not reach that member inside their block are then sought in every other block, so no link is lost and
   no task holds more than a block.

Links are returned as a spanning set: all pairs inside a group are implied by its component.

Defined cases: a text without words (null, empty, blank) has an empty set and links with nothing; with fewer than n words
the whole sequence is its one n-gram.  Repeated rows are members of one class.  Row order must be the same at every read
of the input, as it is for files.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import BASE_B, as_long, mix64, pieces, release, slice_hash, text_buffer, word_bounds, word_hashes, written
from labelwise.llm.graph import components

NGRAM, PERCENT = 3, 90
BLOCK_TOKENS = 1_500_000
LEVEL = 1.5
#: Times that a set is dealt, if too few parts get elements.
DEALS = 8
PIECE = 2 << 20
#: Sets that a task remembers to have emitted.
MET = 1 << 20
#: N-grams that a task combines before it sends them, and that one bucket of inverted lists holds.
HELD, BUCKET = 1_500_000, 1_500_000
_KEY = np.uint64(0x5851F42D4C957F2D)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, end to end, and the n + 1 offsets of the sets."""
    starts, ends, first = word_bounds(data, offsets, "space")
    words = word_hashes(data, starts, ends, fold=True)
    size = np.diff(first)
    count = np.where(size == 0, 0, np.maximum(size - n, 0) + 1)
    row = np.repeat(np.arange(len(size)), count)
    begin = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    grams = slice_hash(words, begin, np.minimum(begin + n, first[1:][row]), BASE_B)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    own = np.ones(len(row), bool)
    own[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return grams[own], np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(size)))])


def set_keys(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, from its elements and size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams ^ _KEY))])
    with np.errstate(over="ignore"):
        return mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _parts(low: int, d: int, percent: int) -> int:
    """Parts over which sets of ``low`` elements or more are dealt: more than d of them get elements, with many to spare.

    At 1.35 to 2.5 elements a part, 0.29 of a set's elements or more is the excess of its parts over those with one element;
    at 80 percent d is up to 0.25 of them.  A smaller d leaves room for longer parts.
    """
    p, enough = d + 1, d + 1 + 2 * math.sqrt(d)
    while d and p < 4 * low and p * (1 - math.exp(-low / p)) < min(enough, 0.9 * low):
        p += 1 + p // 32
    return max(p, round(low / (1.35 + 0.085 * max(0, percent - 80)))) if d else 1


def levels(size: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(level, parts, d) for which a set of this size emits signatures; it differs from a partner there in d elements at most.

    Level k holds the sizes of the smaller set of a pair.  A set joins the levels of all sizes its smaller partners, or
    itself as the smaller one, can have.
    """
    differ = lambda a, b: (a + b) * (100 - percent) // (100 + percent)
    low, k, out = 1, 0, []
    least = -(-percent * size // 100)
    while low <= size:
        high = max(low + 1, math.ceil(low * LEVEL)) if low >= 9 else low + 1
        if high > least:
            largest = high - 1
            own = max(differ(low, 100 * low // percent), min(1, differ(largest, 100 * largest // percent)))
            out.append((k, _parts(low, own, percent), differ(size, 100 * size // percent if size < high else largest)))
        low, k = high, k + 1
    return out


def _turns(at: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, parts, d, name) of the sets with a first, a second, ... level."""
    size = np.diff(at)
    plan = {int(s): levels(int(s), percent) for s in np.unique(size) if s}
    for turn in range(max([len(v) for v in plan.values()] or [0])):
        rows = np.array([r for r, s in enumerate(size.tolist()) if s and len(plan[s]) > turn], np.int64)
        level, parts, d = (np.array([plan[s][turn][i] for s in size[rows].tolist()], np.int64) for i in range(3))
        yield rows, parts, d, mix64(level.astype(np.uint64) + np.uint64(1))


def signatures(grams: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every set."""
    rows_out, sigs_out = [], []
    for rows, parts, d, name in _turns(at, percent):
        for _ in range(DEALS):
            if not len(rows):
                break
            owner, s, few, _ = _deal(grams, at, rows, parts, d, name)
            rows_out.append(rows[owner])
            sigs_out.append(s)
            rows, parts, d, name = rows[few], parts[few], d[few], mix64(name[few] + np.uint64(0xE7037ED1A0B428DB))
        if len(rows):  # still in too few parts: the name alone, which all such sets share
            rows_out.append(rows)
            sigs_out.append(mix64(name + np.uint64(7)))
    return (np.concatenate(rows_out), np.concatenate(sigs_out)) if rows_out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _deal(grams, at, rows, parts, d, name):
    """Deals each set into its parts under a name.

    Numbers in ``rows`` and signatures of the parts that are emitted, in order; which sets have elements in d parts or less;
    and how many of a set's signatures a partner emits at least (a partner may keep its single elements back).
    """
    n = (at[1:] - at[:-1])[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    element = grams[np.repeat(at[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    with np.errstate(over="ignore"):
        part = (mix64(element + name[owner]) % parts[owner].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(parts) - parts
        cell = base[owner] + part
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, cell, mix64(element ^ np.uint64(0xA0761D6478BD642F)))
        held = np.bincount(cell, minlength=len(total))
        of = np.repeat(np.arange(len(rows)), parts)
        filled = np.bincount(of[held > 0], minlength=len(rows))
        alone = np.bincount(of[held == 1], minlength=len(rows))
        several = filled - d > alone  # so one of the equal parts has several elements
        sent = (held > 1) | ((held == 1) & ~several[of])
        number = (np.flatnonzero(sent) - base[of[sent]]).astype(np.uint64)
        label = mix64(name[of[sent]] + (number + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        signature = mix64(total[sent] + label)
    return of[sent], signature, filled <= d, np.where(several, filled - d - alone, filled > d)


def overlap_needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least intersection of two sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Lists:
    """Inverted lists over the sets of one block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.members = tokens[order], owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.tokens, self.begin = tokens[new], np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(tokens))

    def search(self, query: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """All members that reach the bound with ``query``."""
        if not len(self.tokens) or not len(query):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        need = -(-percent * len(query) // 100)  # of any partner
        if len(at) < need:
            return np.zeros(0, np.int64)
        length = self.end[at] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        n_long = min(need - 1, int(need / (0.01 * math.log2(longest + 1) + 1)))
        short, long = at[:len(at) - n_long], at[len(at) - n_long:]
        counts = np.bincount(self.members[_spread(self.begin[short], self.end[short])], minlength=len(self.sizes))
        left = np.flatnonzero(counts >= need - n_long)
        total = counts[left]
        for done, t in enumerate(long):
            list_ = self.members[self.begin[t]:self.end[t]]
            total += list_[np.minimum(np.searchsorted(list_, left), len(list_) - 1)] == left
            if done % 64 == 63:  # drop what cannot reach the bound any more
                keep = total + (len(long) - done - 1) >= need
                left, total = left[keep], total[keep]
            if not len(left):
                break
        a = self.sizes[left] + len(query)
        return left[(100 + percent) * total >= percent * a]


def _spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(keys: list[int], sets: list[np.ndarray], asked: list[bool], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning set of the links between the members of a block, found by searching with every asked member."""
    lists, groups, out = Lists(sets), _Union(len(sets)), []
    for q, query in enumerate(sets):
        if asked[q]:
            for m in lists.search(query, percent).tolist():
                if m != q and groups.join(q, m):
                    out.append((keys[q], keys[m]))
    return out


def _links_in_blocks(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of a table (cluster, block, key, asked, text); a block is bounded, and is searched in one piece."""
    dealt = rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "key", F.desc("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets, asked = None, [], [], []
        found: list[tuple[int, int]] = []
        for batch in pieces(batches, "text", PIECE):
            grams, at = ngram_sets(*text_buffer(batch.column(4)), n)
            for c, b, k, q, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), at[:-1].tolist(), at[1:].tolist()):
                if (c, b) != now:
                    found += block_links(keys, sets, asked, percent) if len(keys) > 1 else []
                    now, keys, sets, asked = (c, b), [], [], []
                if not keys or keys[-1] != k:  # a class that is both asked and a member counts once
                    keys.append(k)
                    sets.append(grams[start:end])
                    asked.append(q)
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found)], ["a", "b"])
                found = []
        found += block_links(keys, sets, asked, percent) if len(keys) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found)], ["a", "b"])

    return dealt.select("cluster", "block", "key", "asked", "text").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(rid, doc_id, size, key) of every text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            grams, at = ngram_sets(*text_buffer(batch.column(2)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(as_long(set_keys(grams, at)), pa.int64())],
                                             ["rid", "doc_id", "size", "key"])

    return docs.mapInArrow(run, f"rid long, doc_id {kind}, size long, key long")


def _held_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, grams, offsets) of rows (key, grams)."""
    for batch in pieces(batches, "grams", 4 * PIECE):
        data, offsets = text_buffer(batch.column(1))
        yield batch.column(0).to_numpy(), np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def _text_sets(n: int):
    """A reader of rows (text) as (keys, grams, offsets): a set that the task has met already is left out."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        met: set[int] = set()
        for batch in pieces(batches, "text", PIECE):
            grams, at = ngram_sets(*text_buffer(batch.column(0)), n)
            keys = as_long(set_keys(grams, at))
            distinct, first = np.unique(keys, return_index=True)
            first = np.sort(first[[k not in met for k in distinct.tolist()]])
            first = first[at[first + 1] > at[first]]
            if len(met) > MET:  # forgetting only sends a set again
                met.clear()
            met.update(distinct.tolist())
            size = at[first + 1] - at[first]
            yield keys[first], grams[_spread(at[first], at[first + 1])], np.concatenate([[0], np.cumsum(size)])

    return read


def _signed_sets(read, percent: int):
    """A reader of what ``read`` reads as (keys, signatures, offsets, needed): each level of a set by itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for keys, grams, at in read(batches):
            for rows, parts, d, name in _turns(at, percent):
                owner, signature, _, needed = _deal(grams, at, rows, parts, d, name)
                yield keys[rows], signature, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]), needed

    return run


def _kind(sets: int) -> type:
    """Type of the numbers of so many sets, with one to spare."""
    return np.uint16 if sets < 1 << 16 else np.uint32


def _lists_of_task(found: list[tuple[np.ndarray, ...]], number: int, buckets: int, percent: int) -> pa.RecordBatch:
    """The inverted lists of some sets by bucket, and a head: the sets' keys and how many shared lists each still misses.

    A list is 32 bits of its element and its only member, or the largest number.  Lists with equal bits count as one, which
    lets a set stay and never removes one.
    """
    keys, elements = (np.concatenate([f[i] for f in found]) for i in range(2))
    size = np.concatenate([np.diff(f[2]) for f in found])
    needed = np.concatenate([f[3] for f in found]) if len(found[0]) > 3 else -(-percent * size // 100)
    kind = _kind(len(size))
    member = np.repeat(np.arange(len(size), dtype=kind), size)
    order = np.argsort(elements)
    elements, member = elements[order], member[order]
    new = np.ones(len(elements), bool)
    new[1:] = elements[1:] != elements[:-1]
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(elements))) > 1
    shared = np.bincount(member[many[np.cumsum(new) - 1]], minlength=len(size))
    only = np.where(many, kind(np.iinfo(kind).max), member[begin])
    bucket = ((elements[begin] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    bits = elements[begin].astype(np.uint32)
    to = np.unique(bucket)
    cut = np.append(np.searchsorted(bucket, to), len(bucket)).tolist()
    missing = (needed - shared).astype(np.int32)
    spans = list(zip(cut[:-1], cut[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array([*to.tolist(), number % buckets], pa.int64()), pa.array([number] * (len(to) + 1), pa.int64()), pa.array([False] * len(to) + [True]),
         pa.array([*(bits[a:b].tobytes() for a, b in spans), keys.tobytes()], pa.binary()),
         pa.array([*(only[a:b].tobytes() for a, b in spans), missing.tobytes()], pa.binary())], ["bucket", "number", "head", "what", "who"])


def _shared_members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads as they are; of every bucket, the members of lists that a second row has as well."""
    names = ["number", "head", "what", "who"]

    def answer(numbers: list[int], what: list[np.ndarray], who: list[np.ndarray]) -> pa.RecordBatch:
        bits = np.concatenate(what)
        order = np.argsort(bits)
        same = bits[order][1:] == bits[order][:-1]
        twice = np.zeros(len(bits), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        parts = [o[t & (o != np.iinfo(o.dtype).max)].tobytes() for o, t in zip(who, np.split(twice, np.cumsum([len(w) for w in who])[:-1]))]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([False] * len(numbers)), pa.array([None] * len(numbers), pa.binary()),
                                           pa.array(parts, pa.binary())], names)

    now, numbers, what, who = None, [], [], []
    for batch in batches:
        heads = batch.filter(batch.column(2))
        if heads.num_rows:
            yield pa.RecordBatch.from_arrays(heads.columns[1:], names)
        lists = batch.filter(pc.invert(batch.column(2)))
        for b, k, x, y in zip(*(lists.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if b != now and numbers:
                yield answer(numbers, what, who)
                numbers, what, who = [], [], []
            now = b
            numbers.append(k)
            what.append(np.frombuffer(x, np.uint32))
            who.append(np.frombuffer(y, np.uint16 if len(y) < len(x) else np.uint32))
    if numbers:
        yield answer(numbers, what, who)


def _enough_shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the sets that miss no shared list any more; the head comes before the answers to it."""
    now, keys, missing = None, None, None

    def stay() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[missing <= 0])], ["key"])

    for batch in batches:
        for number, head, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if head:
                if now is not None:
                    yield stay()
                now, keys, missing = number, np.frombuffer(x, np.int64), np.frombuffer(y, np.int32).copy()
            else:
                missing -= np.bincount(np.frombuffer(y, _kind(len(keys))), minlength=len(missing)).astype(np.int32)
    if now is not None:
        yield stay()


def _possible(rows: DataFrame, read, elements: int, percent: int) -> DataFrame:
    """Keys of the sets that share enough elements with other sets to have a partner; ``read`` makes sets of the rows."""
    buckets = max(1, -(-elements // BUCKET))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found, n = TaskContext.get().partitionId() << 32, [], 0
        for sets in read(batches):
            if len(sets[0]):
                found.append(sets)
                n += len(sets[1])
            if n >= HELD:
                yield _lists_of_task(found, number, buckets, percent)
                number, found, n = number + 1, [], 0
        if found:
            yield _lists_of_task(found, number, buckets, percent)

    lists = rows.mapInArrow(send, "bucket long, number long, head boolean, what binary, who binary")
    shared = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_members, "number long, head boolean, what binary, who binary")
    dealt = shared.repartition("number").sortWithinPartitions("number", F.desc("head"))
    return dealt.mapInArrow(_enough_shared, "key long").distinct()


def _marks(rids: DataFrame, name: str) -> DataFrame:
    """A bit for every rid of a written table, in buckets: 8 MB at most, whatever their number."""
    spots = 1 << min(26, max(15, (16 * rids.count()).bit_length()))
    at = rids.select(F.pmod(F.xxhash64("rid"), F.lit(spots)).alias("at"))
    bits = at.groupBy(F.expr("at div 32768").alias("_bucket")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("_bits"))
    return written(bits.withColumn("_spots", F.lit(spots).cast("long")), name)


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows``, where they lie, and _marked: true for every rid that ``marks`` has, and for some others."""
    spots = marks.first()
    at = F.pmod(F.xxhash64("rid"), F.lit(spots["_spots"] if spots else 1))
    byte = "conv(hex(substring(_bits, cast(_at % 32768 div 8 + 1 as int), 1)), 16, 10)"
    placed = rows.withColumn("_at", at).withColumn("_bucket", F.expr("_at div 32768"))
    return placed.join(F.broadcast(marks.select("_bucket", "_bits")), "_bucket", "left").select(
        *[F.col(f"`{c}`") for c in rows.columns], F.expr(f"coalesce(getbit(cast({byte} as int), cast(_at % 8 as int)) = 1, false)").alias("_marked"))


def _candidates(held: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes (key, text) that share a signature: each to the smallest one."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            row, signature = signatures(*ngram_sets(*text_buffer(batch.column(1)), n), percent)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(signature), pa.int64()), batch.column(0).take(pa.array(row))], ["sig", "key"])

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_centre = None
        for batch in batches:
            sig, key = (batch.column(i).to_numpy() for i in range(2))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            new[0] = sig[0] != last_sig if last_sig is not None else True
            run_of = np.cumsum(new) - 1
            centres = key[new]
            if not new[0]:
                centres, run_of = np.concatenate([[last_centre], centres]), run_of + 1
            centre = centres[run_of]
            last_sig, last_centre = sig[-1], centre[-1]
            edge = np.unique(np.stack([key, centre], 1)[key != centre], axis=0)
            if len(edge):
                yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])

    made = held.select("key", "text").mapInArrow(emit, "sig long, key long")
    return made.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(stars, "a long, b long")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rid and more, a written table) with the texts of those rows: shorter than their n-grams, which are made when they are needed."""
    near = _marked(docs, _marks(wanted, "ngram-marks")).where("_marked")
    return near.join(wanted.hint("merge"), "rid").select(*wanted.columns, "text")  # one plan at every size


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = PERCENT,
                      block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(rid, doc_id, n_shingles, class_id, component_id, root) of every row; rid is the row's number in the scan.

    component_id is the smallest doc_id that links reach (null where all of them are null); class_id names equal sets, root
    the component itself, whatever its doc_ids are (null for an empty set, which links with nothing).
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = numbered.select("rid", "text")
    sized = written(_sets(numbered, n), "ngram-sets")
    classes = written(sized.where("size > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.first("size").alias("size")),
                      "ngram-classes")
    possible = classes
    for read in (_text_sets(n), _signed_sets(_text_sets(n), percent)):
        elements = possible.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        once = _marked(texts, _marks(possible, "ngram-marks")).where("_marked")
        possible = written(possible.join(_possible(once.select("text"), read, elements, percent), "key", "left_semi"), "ngram-possible")
        release(docs.sparkSession)
    paired = written(_with_texts(texts, possible.select("rid", "key")).select("key", "text"), "ngram-paired")
    release(docs.sparkSession)
    clusters = components(_candidates(paired, n, percent), "ngram-cluster").withColumnRenamed("node", "key").withColumnRenamed("root", "cluster")
    members = paired.join(clusters, "key")
    weight = clusters.join(classes, "key").groupBy("cluster").agg(F.sum("size").alias("tokens"))
    dealt = members.join(weight, "cluster").withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long")).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    release(docs.sparkSession)
    held = written(dealt.select("cluster", "block", "blocks", "key", "text"), "ngram-held")
    release(docs.sparkSession)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rooted = held.withColumn("block", F.explode(F.when(F.col("key") == F.col("cluster"), every).otherwise(F.array("block"))))
    links = written(_links_in_blocks(rooted.withColumn("asked", F.lit(True)), n, percent), "ngram-links")
    many = held.where("blocks > 1")
    if not many.select("key").isEmpty():
        # members of a dealt cluster that their block did not tie to the root are sought in every block
        tied = components(links, "ngram-tied")
        at_root = tied.select(F.col("node").alias("cluster"), F.col("root").alias("main"))
        loose = many.join(tied.withColumnRenamed("node", "key"), "key", "left").join(at_root, "cluster", "left").where(
            "key <> cluster AND NOT (coalesce(root, key) <=> main)")
        asked = loose.withColumn("block", F.explode(every)).select("cluster", "block", "key", F.lit(True).alias("asked"), "text")
        base = many.select("cluster", "block", "key", F.lit(False).alias("asked"), "text")
        links = links.unionByName(written(_links_in_blocks(base.unionByName(asked), n, percent), "ngram-more"))
    release(docs.sparkSession)
    roots = components(links, "ngram-linked").withColumnRenamed("node", "key")
    grouped = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("key", "component_id", "root")
    return sized.join(named, "key", "left").select(
        "rid", "doc_id", F.col("size").alias("n_shingles"), F.col("key").alias("class_id"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of every component: that of the smallest doc_id, and of the first such row in the scan; own columns only."""
    found = similar_documents(docs, doc_id, text, **options).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))).alias("best")
    best = found.groupBy("root").agg(first).select("root", F.col("best.rid").alias("best"))
    gone = written(found.join(best, "root").where("rid <> best").select("rid"), "ngram-gone")
    numbered = docs.select(F.struct("*").alias("_row")).withColumn("rid", F.monotonically_increasing_id())
    seen = _marked(numbered, _marks(gone, "ngram-marks"))  # only rows that may go are moved
    return seen.where("NOT _marked").unionByName(seen.where("_marked").join(gone.hint("merge"), "rid", "left_anti")).select("_row.*")
