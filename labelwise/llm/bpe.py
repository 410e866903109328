"""BPE encoding and decoding with a published vocabulary (a tokenizers JSON file with word-end merges).

Text is cut at special tokens, normalised (NFC, lower case character by character), split by the file's pattern and
written as byte symbols.  A split that is no longer than LEAF symbols is encoded by merging pairs in rank order.  A
longer one (unsplit text such as an encoded blob) is a tree: its halves are encoded on their own, and each join is
repaired by encoding a window of tokens around it again, twice as wide each time, until the window begins with the left
half's token and ends with the right half's.  Token sequences whose neighbouring pairs are all stable are exactly what a
whole encoding gives, so nothing outside the agreed window can change.

The vocabulary has a fixed size and is read on the driver from ``path`` and shipped to the workers as plain dictionaries.

Defined cases: a null or empty text has no tokens and decodes to the empty string.  Very long texts are encoded whole.
Columns of the input that bear a result's name are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelwise.llm.common import Shipped, pieces, sha256_hex

#: Symbols of a leaf of the tree; symbols up to which pairs are searched without a heap; distinct splits kept per worker.
LEAF = 48
SHORT = 24
CACHE_WORDS = 300_000
_NEVER = 1 << 40


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: its own where Latin-1 prints it, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def latin_pattern(pattern: str) -> str:
    """The pattern for texts of Latin-1 characters only, with the classes spelled out, as the faster ``re`` takes it."""
    chars = [chr(c) for c in range(256)]
    classes = {"\\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"],
               "\\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"],
               "\\p{White_Space}": [*"\t\n\x0b\x0c\r \x85\xa0"]}
    for name, members in classes.items():
        pattern = pattern.replace(name, "".join(map(re.escape, members)))
    return pattern


class Vocabulary:
    """What a tokenizers JSON file of this kind says: token ids, merge ranks, pattern, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.suffix: str = model["end_of_word_suffix"] or ""
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern: str = splitter.replace("\\s", "\\p{White_Space}")
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token


class _Cache(dict):
    """Encodings of the splits met so far; long ones are not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word)
        if len(word) <= LEAF:
            self[word] = ids
        return ids


class Encoder:
    """Encodes and decodes texts; keeps the encodings of up to CACHE_WORDS distinct splits."""

    def __init__(self, vocabulary: Vocabulary, leaf: int = LEAF):
        self.v, self.leaf = vocabulary, leaf
        self.split = regex.compile(vocabulary.pattern).findall
        self.split_latin = re.compile(latin_pattern(vocabulary.pattern)).findall
        self.cut = regex.compile("|".join(map(regex.escape, vocabulary.special))).split if vocabulary.special else None
        self.found = regex.compile("|".join(map(regex.escape, vocabulary.special))).findall if vocabulary.special else None
        chars = byte_chars()
        self.inner = [vocabulary.ids[c] for c in chars]
        self.last = [vocabulary.ids[c + vocabulary.suffix] for c in chars]
        self.cache = _Cache(self)
        self.parts: dict[int, tuple[int, ...]] = {i: (i,) for i in [*self.inner, *self.last]}
        for (a, b), (_, made) in sorted(vocabulary.merges.items(), key=lambda x: x[1][0]):
            self.parts[made] = self.parts[a] + self.parts[b]
        self.rank = {a << 20 | b: r for (a, b), (r, _) in vocabulary.merges.items()}
        self.made = [m for _, m in sorted(vocabulary.merges.values())]
        self.table = np.array(vocabulary.tokens, dtype=object)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        merges, n = self.v.merges, len(symbols)
        if n <= SHORT:
            return self._merge_short(list(symbols))
        out, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if out[i] == a else n
            if j >= n or out[j] != b:
                continue  # one of the two has been merged meanwhile
            out[i], out[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, out[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, out[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((out[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], out[h], made))
        return [x for x in out if x >= 0]

    def _merge_short(self, out: list[int]) -> list[int]:
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, _NEVER) for a, b in zip(out, out[1:])]
        while ranks and (low := min(ranks)) != _NEVER:
            at = ranks.index(low)
            out[at:at + 2] = (made[low],)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(out[at] << 20 | out[at + 1], _NEVER)
            if at:
                ranks[at - 1] = rank(out[at - 1] << 20 | out[at], _NEVER)
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours, from their own encodings."""
        width = 1
        while True:
            i, j = min(width, len(left)), min(width, len(right))
            window = self.merge([s for t in [*left[len(left) - i:], *right[:j]] for s in self.parts[t]])
            if (i == len(left) or window[0] == left[-i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:len(left) - i] + window + right[j:]
            width *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        """Leaves are encoded on their own, then neighbours are joined level by level."""
        level = [self.merge(symbols[i:i + self.leaf]) for i in range(0, len(symbols), self.leaf)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        ids = self.merge(symbols) if len(symbols) <= self.leaf else self.tree(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        """Little-endian ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is not treated apart
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, text = self.cache, text.lower()
        try:
            text.encode("latin-1")
            words = self.split_latin(text)
        except UnicodeEncodeError:
            words = self.split(text)
        return b"".join([cache[w] for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.cut is None or "<" not in text or not (marks := self.found(text)):
            return np.frombuffer(self.plain(text), "<u4")
        out = []
        for k, part in enumerate(self.cut(text)):
            out.append(self.plain(part))
            if k < len(marks):
                out.append(np.array([self.v.special[marks[k]]], "<u4").tobytes())
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, joined by spaces: the vocabulary names no decoder."""
        return " ".join(self.table[ids].tolist())


def _map(df: DataFrame, path: str, names: list[tuple[str, T.DataType]], column: str, values) -> DataFrame:
    """Adds columns made from one column; ``values(encoder, cell)`` returns a tuple."""
    taken = {n for n, _ in names}
    base = df.drop(*[c for c in df.columns if c in taken and c != column])
    keep = [c for c in base.columns if c not in taken]
    schema = T.StructType([base.schema[c] for c in keep] + [T.StructField(n, t) for n, t in names])
    vocabulary = Shipped(base.sparkSession, Vocabulary(path))  # a fixed vocabulary, a few MB
    kinds = [pa.list_(pa.int32()) if isinstance(t, T.ArrayType) else pa.int64() if isinstance(t, T.LongType) else pa.string() for _, t in names]

    by_bytes = isinstance(base.schema[column].dataType, T.StringType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.open())
        for batch in pieces(batches, column) if by_bytes else batches:
            rows = [values(encoder, cell) for cell in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + made, keep + [n for n, _ in names])

    return base.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without its text column and with the token ids (array of int) of every whole text."""
    kept = docs.withColumnRenamed(text, "_text")
    df = _map(kept, path, [(out, T.ArrayType(T.IntegerType()))], "_text", lambda e, t: (e.encode(t).astype(np.int32),))
    return df.drop("_text")


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of its id arrays."""
    return _map(encoded, path, [(out, T.StringType())], ids, lambda e, x: (e.decode(np.array(x or [], np.int64)),))


def _digest(encoder: Encoder, text: str | None) -> tuple[int, str, str]:
    ids = encoder.encode(text)
    return len(ids), sha256_hex(ids.tobytes()), sha256_hex(encoder.decode(ids).encode("utf-8"))


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (the decoded text)."""
    names = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _map(docs.withColumnRenamed(text, "_text"), path, names, "_text", _digest).drop("_text")
