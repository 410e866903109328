"""Prefix trie of conversations by fixed-length block hashing.

A conversation's turns are cut into blocks of ``BLOCK`` turns.  The digest of a prefix is a 128-bit sum over its turns of
a hash of (position, role, text), so a block's digest is the difference of two prefixes, and the prefix digest names the whole
sequence up to there.  Conversations are grouped by the digests at block boundaries first.  A block after which all members
of its group go on alike needs no more: its turns are nodes with the group's members.  Only in groups where siblings
diverge are the distinct blocks (not the conversations) cut at turn boundaries and grouped again.

Sums over subtrees need no walk over the trie.  A node belongs to its smallest member; a conversation so owns the nodes of
its path below some depth.  What a conversation owns (words and leaves) is one small value per conversation, and the
sum of these over a node's members is the node's subtree but for the node's own smallest member, whose owned
nodes above the node do not count.  The same block grouping that counts members adds them up, at any depth of the trie.

Groups of any size are combined before each shuffle.  A conversation of any length is ranked and summed over partitions
(``runs.running``).  The digest over a node's ends is sequential by its contract: pieces of the sorted list are made where the
sort put them and stream through one task in order.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role, then MD5 of the text; a null
conv_id is a conversation of its own that takes no turns from others, is the smallest member only of nodes without another one,
and adds nothing to ends_sha256; a conversation without turns is one of the root; an empty table has no node; other columns
are ignored.  Two different prefixes share a digest with probability 2**-128.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import pieces, written
from labelwise.llm.runs import running

#: Turns of a block.
BLOCK = 4
#: Conversations c - c % FAMILY lend up to HEADS - 1 first turns.
FAMILY, HEADS = 20, 4
PIECE_BYTES = 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"


def wrapping(*terms: Column | str) -> Column:
    """Sum of longs modulo 2**64, as a long."""
    total = sum((F.col(t).cast("decimal(38,0)") if isinstance(t, str) else t.cast("decimal(38,0)") for t in terms[1:]),
                F.col(terms[0]).cast("decimal(38,0)") if isinstance(terms[0], str) else terms[0].cast("decimal(38,0)"))
    half, full = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (63, 64))
    return (F.pmod(total + half, full) - half).cast("bigint")


def prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, digest, h1, h2, words): a turn without its text."""
    clean = turns.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                         F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return clean.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
                        F.size(F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1))).cast("bigint").alias("words"))


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (c, depth, g1, g2, words, length) and all conversations (c, length), both written."""
    own = running(prepared(turns, conv_id, turn, role, text), "conv_id", ["turn", "role", "digest"], [], parts, "ranked")
    heads = own.where((F.col("row_no") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).select(
        F.col("conv_id").alias("lender"), F.col("row_no").alias("head_no"), "role", "digest", "words")
    heads = written(heads, "heads")
    sizes = own.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"))
    h = F.when(F.col("c").isNull(), 0).otherwise(F.crc32(F.col("c").cast("string").cast("binary")) % HEADS)
    lent = heads.groupBy("lender").agg(F.count("*").alias("has"))
    convs = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base")).join(lent, F.col("base") == F.col("lender"), "left")
    convs = convs.select("c", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"))
    convs = written(convs.select("c", "base", "h", "taken", (F.col("taken") + F.col("rest")).alias("length")), "conversations")
    first = convs.where("taken > 0").join(heads, (F.col("base") == F.col("lender")) & (F.col("head_no") < F.col("taken"))).select(
        "c", "length", (F.col("head_no") + 1).alias("depth"), "role", "digest", "words")
    then = own.join(convs, F.col("conv_id").eqNullSafe(F.col("c"))).where("row_no >= h").select(
        "c", "length", (F.col("taken") + F.col("row_no") - F.col("h") + 1).alias("depth"), "role", "digest", "words")
    mark = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest", "role").cast("binary"))
    half = [F.conv(F.substring(mark, a, 16), 16, -10).cast("bigint") for a in (1, 17)]
    rows = first.unionByName(then).select("c", "length", "depth", "words", half[0].alias("g1"), half[1].alias("g2"))
    return rows, convs.select("c", "length")


def blocks(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per conversation and block: its turns as columns, the prefix digest and words before it (p1, p2, pw) and with it
    (q1, q2), len turns, and is_end where the conversation ends with it.  A written table."""
    place = (F.col("depth") - 1) % BLOCK
    cells = [F.max(F.when(place == i, F.col(c))).alias(f"{c}_{i}") for i in range(BLOCK) for c in ("g1", "g2", "words")]
    grouped = rows.groupBy("c", F.floor((F.col("depth") - 1) / BLOCK).cast("bigint").alias("block")).agg(
        F.count("*").alias("len"), F.max("length").alias("length"), *cells)
    zero = F.lit(0).cast("bigint")
    s = [wrapping(*[F.coalesce(F.col(f"{c}_{i}"), zero) for i in range(BLOCK)]).alias(n) for c, n in (("g1", "s1"), ("g2", "s2"), ("words", "sw"))]
    summed = running(grouped.select("*", *s), "c", ["block"], ["s1", "s2", "sw"], parts, "blocks")
    before = [wrapping(F.col(f"run_{x}"), -F.col(x).cast("decimal(38,0)")) for x in ("s1", "s2", "sw")]
    return summed.select("c", "block", "len", "length", *[f"{c}_{i}" for i in range(BLOCK) for c in ("g1", "g2", "words")],
                         *[b.alias(n) for b, n in zip(before, ("p1", "p2", "pw"))], F.col("run_s1").alias("q1"), F.col("run_s2").alias("q2"),
                         (F.col("block") * BLOCK + F.col("len") == F.col("length")).alias("is_end"))


_CELLS = [f"{c}_{i}" for i in range(BLOCK) for c in ("g1", "g2", "words")]
_GROUP = ["block", "p1", "p2"]


def block_groups(member_blocks: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Distinct blocks after distinct prefixes, with ``measures`` aggregated over the conversations that hold them."""
    made = [m.alias(n) for n, m in measures.items()]
    same = [F.first(x).alias(x) for x in [*_CELLS, "pw", "len"]]
    return member_blocks.groupBy(*_GROUP, "q1", "q2").agg(*same, *made)


def turn_nodes(groups: DataFrame, again: dict[str, Column], measures: list[str]) -> DataFrame:
    """Nodes (depth, n1, n2: the prefix digest, a1, a2: the parent's, words, before, measures) of distinct blocks.

    Groups with one block give its turns as they are.  Others are cut at turns and grouped again (``again``: how measures combine).
    """
    counts = groups.groupBy(*_GROUP).agg(F.count("*").alias("kinds"), *[F.first(c).alias(c) for c in ["q1", "q2", *_CELLS, "pw", "len", *measures]])
    single = counts.where("kinds = 1").drop("kinds")
    split = counts.where("kinds > 1").select(*[F.col(c).alias(f"of_{c}") for c in _GROUP])
    diverging = groups.where("block > 0").join(split.where("of_block > 0"), [F.col(c) == F.col(f"of_{c}") for c in _GROUP])
    if groups.where("block = 0").limit(2).count() > 1:  # the root's blocks are many: no join for them
        diverging = diverging.drop(*[f"of_{c}" for c in _GROUP]).unionByName(groups.where("block = 0"))

    def turns(df: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        cells = []
        for i in range(BLOCK):
            upto = [[F.coalesce(F.col(f"{c}_{k}"), zero) for k in range(i + 1)] for c in ("g1", "g2", "words")]
            digest = [wrapping(F.col(p), *u).alias(n) for p, u, n in zip(("p1", "p2"), upto, ("n1", "n2"))]
            above = [wrapping(F.col(p), *u[:-1]).alias(n) for p, u, n in zip(("p1", "p2"), upto, ("a1", "a2"))]
            words = sum(upto[2][:-1], F.col("pw"))
            cells.append(F.struct((F.col("block") * BLOCK + i + 1).alias("depth"), *digest, *above, F.coalesce(F.col(f"words_{i}"), zero).alias("words"),
                                  words.alias("before"), (F.lit(i + 1) == F.col("len")).alias("closes")))
        each = df.select(F.explode(F.slice(F.array(*cells), F.lit(1), F.col("len").cast("int"))).alias("x"), *measures)
        ending = [F.when(F.col("closes"), F.col(m)).otherwise(F.lit(0)).alias(m) if m == "ends" else F.col(m) for m in measures]
        return each.select("x.*", *measures).select("depth", "n1", "n2", "a1", "a2", "words", "before", *ending)

    merged = turns(diverging).groupBy("depth", "n1", "n2").agg(*[F.first(c).alias(c) for c in ("a1", "a2", "words", "before")],
                                                                  *[again[m].alias(m) for m in measures])
    return turns(single).unionByName(merged.select("depth", "n1", "n2", "a1", "a2", "words", "before", *measures))




def ends_digests(ends: DataFrame, parts: int | None = None) -> DataFrame:
    """(depth, n1, n2, ends_sha256) of (depth, n1, n2, c): hash of the decimal ids in ascending order, comma-joined."""
    keys = ["depth", "n1", "n2"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "from", "ids"]
        types = [pa.int64()] * 4 + [pa.binary()]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)

        out, size = [], 0
        rows = (r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
        for key, group in itertools.groupby(rows, key=lambda r: r[:3]):
            while ids := [r[3] for r in itertools.islice(group, PIECE_BYTES // 16)]:
                out.append((*key, ids[0], ",".join(map(str, ids)).encode()))
                size += len(out[-1][4]) + 40
                if size > PIECE_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = (r for b in pieces(batches, "ids") for r in zip(*(x.to_pylist() for x in b.columns)))
        for key, group in itertools.groupby(rows, key=lambda r: r[:3]):
            h = hashlib.sha256()
            for k, r in enumerate(group):
                h.update((b"," if k else b"") + r[4])
            out.append((*key, h.hexdigest()))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "ends_sha256"])

    by = [*keys, "c"]
    dealt = ends.select(*by).repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    packed = dealt.mapInArrow(pack, "depth bigint, n1 bigint, n2 bigint, `from` bigint, ids binary")
    return packed.repartition(*keys).sortWithinPartitions(*keys, "from").mapInArrow(digest, "depth bigint, n1 bigint, n2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                parts: int | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns, conv_id, turn, role, text, parts)
    table = blocks(rows, parts)
    again = {"n_convs": F.sum("n_convs"), "first_c": F.min("first_c"), "ends": F.sum("ends")}
    counted = block_groups(table, {"n_convs": F.count("*"), "first_c": F.min("c"), "ends": F.count_if("is_end")})
    nodes = written(turn_nodes(written(counted, "groups"), again, list(again)), "nodes")

    # what every conversation owns: words and leaves of the nodes of which it is the smallest member
    owned = nodes.groupBy(F.col("first_c").alias("owner")).agg(F.sum("words").alias("own_words"),
                                                                F.count_if(F.col("ends") == F.col("n_convs")).alias("own_leaves"))
    # the words of a conversation: those before its last block, and those of that block
    zero = F.lit(0).cast("bigint")
    total = sum((F.coalesce(F.col(f"words_{i}"), zero) for i in range(BLOCK)), F.col("pw"))
    spoken = table.where("is_end").select(F.col("c").alias("who"), F.col("block").alias("last_block"), total.alias("all_words"), "q1", "q2", "length")
    scored = written(spoken.join(owned, F.col("who").eqNullSafe(F.col("owner")), "left").select(
        "who", "length", "q1", "q2", "all_words", F.coalesce("own_words", F.lit(0)).alias("own_words"),
        F.coalesce("own_leaves", F.lit(0)).alias("own_leaves")), "scored")

    slim = table.join(scored.select("who", "all_words", "own_words", "own_leaves"), F.col("c").eqNullSafe(F.col("who")))
    # ids compare with null last, as min() leaves it out: min_by over the same ids finds the owner's other words
    by_id = F.coalesce(F.col("c").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    measures = {"all_words": F.sum("all_words"), "own_words": F.sum("own_words"), "leaves": F.sum("own_leaves"), "low": F.min(by_id),
                "low_other": F.min_by(F.col("all_words") - F.col("own_words"), by_id)}
    summed = {"all_words": F.sum("all_words"), "own_words": F.sum("own_words"), "leaves": F.sum("leaves"), "low": F.min("low"),
              "low_other": F.min_by("low_other", "low")}
    sums = turn_nodes(written(block_groups(slim, measures), "sums"), summed, list(summed)).select(
        F.col("depth").alias("depth_"), F.col("n1").alias("n1_"), F.col("n2").alias("n2_"), *summed)

    here = [F.col(c) == F.col(f"{c}_") for c in ("depth", "n1", "n2")]
    # members' words from this node on, less those of the nodes themselves: the smallest member's from here, the others' owned ones
    saved = F.col("all_words") - F.col("n_convs") * F.col("before") - (F.col("own_words") + F.col("low_other") - F.col("before"))
    full = nodes.join(sums, here).select("depth", "n1", "n2", "a1", "a2", F.col("first_c").alias("conv"), "n_convs", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"))
    full = written(full, "full")

    whole = convs.agg(F.min("c").alias("conv"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("idle")).first()
    if whole.n_convs == 0:
        spark = turns.sparkSession
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
                                         "saved_tokens bigint, ends_sha256 string")
    top = full.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("n_leaves"),
                                      F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero = F.lit(0).cast("bigint")
    root = top.select(zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), F.lit(whole.conv).cast("bigint").alias("conv"), F.lit(whole.n_convs).cast("bigint").alias("n_convs"),
                      "n_children", F.greatest("n_leaves", (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"), "saved_tokens",
                      F.lit(None).cast("bigint").alias("parent_conv_id"))
    children = full.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth_"), F.col("a1").alias("n1_"), F.col("a2").alias("n2_")).agg(F.count("*").alias("kids"))
    counted = full.join(children, here, "left").select("depth", "n1", "n2", "a1", "a2", "conv", "n_convs", F.coalesce("kids", F.lit(0)).alias("n_children"),
                                                       "n_leaves", "saved_tokens")
    parents = full.select(F.col("depth").alias("depth_"), F.col("n1").alias("n1_"), F.col("n2").alias("n2_"), F.col("conv").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("depth_")) & (F.col("a1") == F.col("n1_")) & (F.col("a2") == F.col("n2_"))
    below = counted.where("depth > 1").join(parents, above)
    columns = ["depth", "n1", "n2", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id"]
    first = counted.where("depth = 1").withColumn("parent_conv_id", F.lit(whole.conv).cast("bigint"))
    every = root.unionByName(first.select(*columns)).unionByName(below.select(*columns))

    finished = scored.where("who IS NOT NULL").select(F.col("length").alias("depth"), F.col("q1").alias("n1"), F.col("q2").alias("n2"), F.col("who").alias("c"))
    idle = convs.where("length = 0 AND c IS NOT NULL").select(zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), "c")
    digests = ends_digests(finished.unionByName(idle), parts).select(
        F.col("depth").alias("depth_"), F.col("n1").alias("n1_"), F.col("n2").alias("n2_"), "ends_sha256")
    return every.join(digests, here, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
