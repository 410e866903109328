"""Byte-level BPE with recursive DuckDB queries, one in-process database per partition.

A text is cut into matches of the published pattern, and every distinct match (word) of a partition is encoded once.  Its
bytes become token-position rows; the recursive query joins neighbouring tokens with the merge table and contracts each
word's leftmost pair of least rank, until no pair of any word is in the table.  Decoding aggregates the tokens' bytes of a
word in order.

One step also contracts pairs that the one-at-a-time order is bound to contract unchanged; that halves the steps.  A pair of rank m between neighbours a and z is one of these when
every merge that could still take one of its tokens, or its result, away sooner ranks above m: merges with any token that
ends as a ends on the left, and with any that begins as z begins on the right.  Both limits are tables made from the merge
table.  In a run of one token the pairs overlap and tie; there every other pair counts, from the left, as the order takes them.
A word above ``LONG_BYTES`` is encoded in pieces, all in one recursive query, which are joined two by two: a window over the
join is encoded again, and stands if its first and last token are those that were there; else the window grows, at last
over both pieces.  (Tokens are the encoding of their bytes if every two neighbours are that of theirs.)

Defined cases: null texts are empty; empty texts have no token; bytes that are not UTF-8 are replaced by U+FFFD first; rows
are independent, so repeated rows, other columns and their names change nothing.  Held at once in a task: a piece of the
scan (``pieces``; a longer text stands alone, at some forty times its size), the words of ``KNOWN_BYTES`` and a
recursive query of ``STATE_ROWS`` rows (more only for a single longer word).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import Shipped, pieces, sha256_hex, text_buffer

#: Bytes of distinct words that one recursive query takes together, those that a task remembers, and the texts cut at once.
QUERY_BYTES = 1 << 19
KNOWN_BYTES = 32 << 20
PART_BYTES = 2 << 20
#: Words above this are encoded in pieces, whose joins are encoded again.
LONG_BYTES, PIECE_BYTES = 256, 64
#: Rows that the steps of one recursive query may add up to; it is then begun again from its last state.
STATE_ROWS = 8_000_000

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Fixed values of the pattern: what may follow an apostrophe as one match.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def character_classes() -> np.ndarray:
    """Class of every code point, asked of the regular expressions that the tiktoken library itself uses (its Unicode version)."""
    import tiktoken

    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        enc = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        kept = enc.decode_bytes(enc.encode_ordinary(chars)).decode()
        out[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = kind
    return out


def merge_tables(ranks: dict[bytes, int]) -> dict[str, pa.Table]:
    """merges (l, r, m): every split of a token into two tokens.  ends (x, y, m, longer): the least rank of a merge of y with a
    token on its left that ends as x ends; begins likewise on the right; ``longer`` leaves out the merge of x and y itself."""
    none = 1 << 30
    tokens = {r: t for t, r in ranks.items()}
    rows = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    ends: dict[tuple[int, int], list[int]] = {}
    begins: dict[tuple[int, int], list[int]] = {}

    def note(table, key, m, whole):
        at = table.setdefault(key, [none, none])
        at[0] = min(at[0], m)
        if not whole:
            at[1] = min(at[1], m)

    for l, r, m in rows:
        left, right = tokens[l], tokens[r]
        for i in range(len(left)):
            if left[i:] in ranks:
                note(ends, (ranks[left[i:]], r), m, i == 0)
        for i in range(1, len(right) + 1):
            if right[:i] in ranks:
                note(begins, (l, ranks[right[:i]]), m, i == len(right))

    def columns(names, values):
        return pa.table({n: pa.array([v[k] for v in values], pa.int32()) for k, n in enumerate(names)})

    return {"merges": columns(["l", "r", "m"], rows), "ends": columns(["x", "y", "m", "longer"], [(*k, *v) for k, v in ends.items()]),
            "begins": columns(["x", "y", "m", "longer"], [(*k, *v) for k, v in begins.items()]),
            "vocabulary": pa.table({"t": pa.array(list(tokens), pa.int32()), "bytes": pa.array(list(tokens.values()), pa.binary())})}


def split_points(chars: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a match of the pattern begins.  ``chars``: code points of texts end to end; ``first``: True at each text's first.

    White space before something else leaves its last character to it: a space joins the next match, another one stands alone.
    """
    n = len(chars)
    if n == 0:
        return np.zeros(0, bool)
    kind = classes[chars]
    last = np.append(first[1:], True)  # of its text
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    run_end = np.append(run[1:], True)
    joins = np.zeros(n, bool)  # follows a space of the same text
    joins[1:] = (chars[:-1] == 0x20) & ~first[1:]
    begins = run & ~((kind != SPACE) & joins)
    begins |= (kind == SPACE) & run_end & ~last
    quote = np.flatnonzero(begins & (chars == 0x27) & run & run_end & ~last)
    if len(quote):
        ends = np.append(np.flatnonzero(first)[1:], n)  # of the texts
        until = ends[np.searchsorted(ends, quote, side="right")]
        for suffix in SUFFIXES:
            at = quote
            for k, letter in enumerate(suffix, 1):
                at = at[chars[np.minimum(at + k, n - 1)] == ord(letter)]
                at = at[at + k < until[np.searchsorted(quote, at)]]
            begins[at + 1] = False
            after = at + 1 + len(suffix)
            begins[after[after < n]] = True
    return begins


#: Rows (w, g, t): word, place of the token's first byte in all words, token.  Only words that are still changing go on.
_STEP = """
WITH near AS (SELECT *, lag(t) OVER o AS a, lead(t) OVER o AS d, lead(t, 2) OVER o AS z, lead(g) OVER o AS e FROM state
    WINDOW o AS (PARTITION BY w ORDER BY g)),
  pairs AS MATERIALIZED (SELECT w, g, e, a, t, d, z, m FROM near JOIN merges ON l = t AND r = d WHERE step < {steps}),
  least_pair AS (SELECT w, min(m::BIGINT << 40 | g) AS best FROM pairs GROUP BY w),
  judged AS MATERIALIZED (SELECT p.w, p.g, p.e, p.a, p.t, p.d, p.m, best & 1099511627775 = p.g AS is_least,
      p.m < least(if(a = t AND t = d, el.longer, el.m), ec.m) IS NOT FALSE AS free_left,
      p.m < least(if(t = d AND d = z, br.longer, br.m), bc.m) IS NOT FALSE AS free_right
    FROM pairs p JOIN least_pair USING (w)
    LEFT JOIN ends el ON el.x = a AND el.y = t LEFT JOIN ends ec ON ec.x = a AND ec.y = p.m
    LEFT JOIN begins br ON br.x = d AND br.y = z LEFT JOIN begins bc ON bc.x = p.m AND bc.y = z),
  twins AS (SELECT g, e, m, is_least, free_right, e - g AS size, max(if(a IS DISTINCT FROM t, g, NULL)) OVER o AS start,
      arg_max(free_left, g) FILTER (a IS DISTINCT FROM t) OVER o AS start_free
    FROM judged WHERE t = d WINDOW o AS (PARTITION BY w ORDER BY g ROWS UNBOUNDED PRECEDING)),
  hits AS MATERIALIZED (SELECT g, e, m, w FROM judged WHERE t <> d AND (is_least OR free_left AND free_right)
    UNION ALL SELECT k.g, k.e, k.m, j.w FROM twins k JOIN judged j ON j.g = k.g
    WHERE k.is_least OR k.start_free AND k.free_right AND (k.g - k.start) // k.size % 2 = 0)
SELECT s.step + 1, s.w, s.g, coalesce(h.m, s.t) FROM state s SEMI JOIN hits k ON k.w = s.w LEFT JOIN hits h ON h.g = s.g ANTI JOIN hits x ON x.e = s.g"""

_ENCODE = f"""
WITH RECURSIVE state(step, w, g, t) AS (SELECT 0, w, g, t FROM start UNION ALL ({_STEP}))
SELECT s.w, s.g, s.t, l.last FROM state s JOIN (SELECT w, max(step) AS last FROM state GROUP BY w) l ON l.w = s.w AND l.last = s.step"""

_DECODE = """
SELECT w, unhex(string_agg(hex(bytes), '' ORDER BY g)) AS bytes FROM coded JOIN vocabulary USING (t) GROUP BY w ORDER BY w"""


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1 of all i, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


class _Words:
    """A task's words: each encoded and decoded once, by the recursive query."""

    def __init__(self, ranks_by_byte: np.ndarray, tables: dict[str, pa.Table]):
        import duckdb

        self.by_byte, self.vocabulary = ranks_by_byte, tables["vocabulary"]
        self.token_sizes = np.zeros(pc.max(self.vocabulary["t"]).as_py() + 1, np.int64)
        self.token_sizes[self.vocabulary["t"].to_numpy()] = pc.binary_length(self.vocabulary["bytes"]).to_numpy()
        # in memory and without a folder of its own: nothing is written to the machine's disk
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        for name, table in tables.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.id_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.text, self.text_sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where ``words`` (distinct) stand among the known ones, after encoding those that are new."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        if len(new):
            if self.known.nbytes + new.nbytes > KNOWN_BYTES:
                self.forget()
                new = words
            sizes = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)
            total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
            while begin < len(new):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + QUERY_BYTES, side="right")) - 1)
                self._learn(new.slice(begin, end - begin))
                begin = end
            at = pc.index_in(words, value_set=self.known)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _contract(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every data[start:end], each a word of its own, end to end, and their numbers."""
        sizes = ends - starts
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        state = pa.table({"w": word, "g": np.arange(len(word)), "t": self.by_byte[data[_ragged(starts, sizes)]]})
        w, g, t = [], [], []
        while state.num_rows:
            steps = max(1, STATE_ROWS // state.num_rows)
            self.db.register("start", state)
            out = self.db.sql(_ENCODE.format(steps=steps)).to_arrow_table()
            self.db.unregister("start")
            going_on = pc.equal(out["last"], steps)  # stopped by the bound on the rows
            done = out.filter(pc.invert(going_on))
            for have, name in ((w, "w"), (g, "g"), (t, "t")):
                have.append(done[name].to_numpy())
            state = out.filter(going_on).select(["w", "g", "t"])
        if not w:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        w, g, t = np.concatenate(w), np.concatenate(g), np.concatenate(t)
        return t[np.argsort(g)], np.bincount(w, minlength=len(sizes))

    def _tokens(self, data: np.ndarray) -> np.ndarray:
        """Tokens of one long word: of its pieces, joined two by two.  The tokens around a join are those of a window that
        begins and ends with a token of the pieces; the window grows until it does, at last over both pieces."""
        cuts = np.arange(0, len(data), PIECE_BYTES)
        ids, counts = self._contract(data, cuts, np.minimum(cuts + PIECE_BYTES, len(data)))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        while len(parts) > 1:
            begin = np.concatenate([[0], np.cumsum([int(self.token_sizes[p].sum()) for p in parts])])
            joined: list[np.ndarray | None] = [None] * (len(parts) // 2)
            reach = 4
            while any(j is None for j in joined):
                open_ = [k for k, j in enumerate(joined) if j is None]
                tails = [parts[2 * k][-reach:] for k in open_]
                heads = [parts[2 * k + 1][:reach] for k in open_]
                middle = begin[[2 * k + 1 for k in open_]]
                starts = middle - np.array([int(self.token_sizes[x].sum()) for x in tails])
                ends = middle + np.array([int(self.token_sizes[x].sum()) for x in heads])
                ids, counts = self._contract(data, starts, ends)
                for k, tail, head, new in zip(open_, tails, heads, np.split(ids, np.cumsum(counts)[:-1])):
                    left, right = parts[2 * k], parts[2 * k + 1]
                    if (len(tail) == len(left) or new[0] == tail[0]) and (len(head) == len(right) or new[-1] == head[-1]):
                        joined[k] = np.concatenate([left[:len(left) - len(tail)], new, right[len(head):]])
                reach *= 4
            parts = joined + parts[2 * len(joined):]
        return parts[0]

    def _learn(self, words: pa.Array) -> None:
        data, offsets = text_buffer(words)
        sizes = np.diff(offsets)
        whole = pc.index_in(words, value_set=self.vocabulary["bytes"].combine_chunks().cast(pa.large_binary()))
        is_token = pc.is_valid(whole).to_numpy(zero_copy_only=False)
        short = np.flatnonzero(~is_token & (sizes <= LONG_BYTES))
        ids, counts = self._contract(data, offsets[short], offsets[short + 1])
        own = dict(zip(np.flatnonzero(is_token), self.vocabulary["t"].to_numpy()[whole.drop_null().to_numpy()][:, None]))
        own |= {i: self._tokens(data[offsets[i]:offsets[i + 1]]) for i in np.flatnonzero(~is_token & (sizes > LONG_BYTES))}
        numbers = np.zeros(len(sizes), np.int64)
        numbers[short] = counts
        numbers[list(own)] = [len(v) for v in own.values()]
        begin = np.cumsum(numbers) - numbers
        tokens = np.zeros(int(numbers.sum()), np.int32)
        tokens[_ragged(begin[short], counts)] = ids
        for i, v in own.items():
            tokens[begin[i]:begin[i] + len(v)] = v
        self.db.register("coded", pa.table({"w": np.repeat(np.arange(len(sizes)), numbers), "g": np.arange(len(tokens)), "t": tokens}))
        decoded = self.db.sql(_DECODE).to_arrow_table()["bytes"].combine_chunks()
        self.db.unregister("coded")
        text, text_offsets = text_buffer(decoded)
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.id_sizes = np.concatenate([self.ids, tokens]), np.concatenate([self.id_sizes, numbers])
        self.text, self.text_sizes = np.concatenate([self.text, text]), np.concatenate([self.text_sizes, np.diff(text_offsets)])


def _clean(column: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """Bytes and offsets of the texts, and all of them as one string; what is not UTF-8 is replaced."""
    data, offsets = text_buffer(column)
    try:
        return data, offsets, data.tobytes().decode()
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(offsets, offsets[1:])]
        return *text_buffer(pa.array(rows, pa.large_binary())), b"".join(rows).decode()


def _encode_piece(column: pa.Array, classes: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows end to end with the rows' n + 1 offsets, and the decoded bytes likewise."""
    data, offsets, text = _clean(column)
    rows = len(offsets) - 1
    none = np.zeros(rows + 1, np.int64)
    if len(data) == 0:
        return np.zeros(0, np.int32), none, data, none
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # a character's first byte
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    at = starts[split_points(chars, first[starts], classes)]
    del chars, starts, first, text
    bounds = np.append(at, len(data))
    matches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = matches.dictionary_encode()
    place = words.places(coded.dictionary)[coded.indices.to_numpy()]
    row_match = np.searchsorted(at, offsets)

    def gather(values, sizes):
        begin = np.cumsum(sizes) - sizes
        sizes = sizes[place]
        return values[_ragged(begin[place], sizes)], np.concatenate([[0], np.cumsum(sizes)])[row_match]

    return *gather(words.ids, words.id_sizes), *gather(words.text, words.text_sizes)


def _map(docs: DataFrame, path: str, text: str, schema: str, rows) -> DataFrame:
    """``docs`` with the columns that ``rows(ids, id offsets, bytes, byte offsets)`` makes of its last column, the text."""
    ranks = load_ranks(path)
    shipped = Shipped(docs.sparkSession, (np.array([ranks[bytes([i])] for i in range(256)], np.int32), merge_tables(ranks), character_classes()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = None, None
        for batch in pieces(batches, text, PART_BYTES):
            if words is None:
                by_byte, tables, classes = shipped.open()
                words = _Words(by_byte, tables)
            made = rows(*_encode_piece(batch.column(batch.num_columns - 1), classes, words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.values()], names=[*batch.schema.names[:-1], *made])

    return docs.mapInArrow(run, schema)


def _keys(docs: DataFrame, text: str, new: list[str]) -> tuple[DataFrame, str]:
    clash = [c for c in docs.columns if c != text and c.lower() in new]
    if clash:
        raise ValueError(f"columns {clash} would be made twice; rename or drop them")
    kept = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").cast("string").alias(text)), f"{fields}, " if kept else ""


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) in place of the text."""
    docs, fields = _keys(docs, text, ["ids"])

    def rows(ids, offsets, _bytes, _offsets):
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))}

    return _map(docs, path, text, f"{fields}ids array<int>", rows)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``coded`` with the decoded bytes (binary, a byte string need not be UTF-8) in place of its ids; an unknown id raises."""
    kept = [c for c in coded.columns if c != ids]
    tables = Shipped(coded.sparkSession, merge_tables(load_ranks(path))["vocabulary"])
    fields = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        db.register("vocabulary", tables.open())
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            rows = pa.table({"w": np.repeat(np.arange(len(sizes)), sizes), "g": np.arange(len(flat)), "t": flat})
            known = db.sql("SELECT count(*) FROM rows JOIN vocabulary USING (t)").fetchall()[0][0]
            if known != len(flat):
                raise ValueError(f"{len(flat) - known} ids are not in the vocabulary")
            db.register("coded", rows)
            got = db.sql(f"SELECT coalesce(bytes, ''::BLOB) AS bytes FROM range({len(sizes)}) r(w) LEFT JOIN ({_DECODE}) USING (w) ORDER BY w").to_arrow_table()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got["bytes"].combine_chunks().cast(pa.binary())], names=[*kept, out])

    return coded.select(*[f"`{c}`" for c in kept], f"`{ids}`").mapInArrow(run, f"{fields}, `{out}` binary" if kept else f"`{out}` binary")


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (little-endian unsigned 32-bit ids) and decoded_sha256 in place of the text."""
    docs, fields = _keys(docs, text, ["n_tokens", "ids_sha256", "decoded_sha256"])

    def rows(ids, offsets, decoded, byte_offsets):
        raw, decoded = memoryview(ids.astype("<u4").tobytes()), memoryview(np.ascontiguousarray(decoded))
        return {"n_tokens": pa.array(np.diff(offsets), pa.int64()),
                "ids_sha256": pa.array([sha256_hex(raw[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:])], pa.string()),
                "decoded_sha256": pa.array([sha256_hex(decoded[a:b]) for a, b in zip(byte_offsets, byte_offsets[1:])], pa.string())}

    return _map(docs, path, text, f"{fields}n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows)
