"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a sample of labelled text recognises exactly the substrings of that sample.  A
text is parsed greedily into longest matches: walk the automaton until it has no transition, count one phrase, start
again.  Text in the sample's language needs few, long phrases; the language with the fewest phrases per character,
normalised by the sample's size, wins.

The samples are bounded by parameters: at most ``docs_per_lang`` distinct texts per language, chosen by a hash (copies
count once), of each SLICES pieces of ``chars_per_doc`` characters in all, spread over the whole text; and
``chars_per_lang`` characters of each language in all, less where there are many languages (``total_chars``).  Prediction
reads whole texts, many at once: every text is cut into lanes of LANE characters that walk side by side.

Defined cases: a text that is null or has no letter gets ``und`` with score 0.  With a single learned language the score
is 1.  Every letter of the samples is a symbol, whatever the script; a letter that no sample has matches nothing.  Ties go
to the alphabetically first language.  Without any labelled text everything is ``und``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwise.llm.common import Shipped, pieces

DOCS_PER_LANG, CHARS_PER_DOC, CHARS_PER_LANG, TOTAL_CHARS = 160, 400, 48_000, 600_000
LANE = 256
SLICES = 4
DENSE_CELLS = 50_000_000
MAX_LANGS = 1000


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start and no transition leads to it."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = cur
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return after


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts end to end, and their lengths."""
    low = [t.lower() for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    return data, np.array([len(t) for t in low], np.int64)


class LanguageModel:
    """One automaton per language; symbol 0 is any non-letter, 1 any letter that no sample has, the others one letter each.

    An automaton is a table of states by symbols, or, where all tables had more than DENSE_CELLS cells (large scripts), the
    sorted list of its transitions and the row of its start.
    """

    def __init__(self, samples: dict[str, str], chars: int):
        self.langs = sorted(samples)
        self.symbols = {c: i + 2 for i, c in enumerate(sorted({c for t in samples.values() for c in t.lower() if c.isalpha()}))}
        self.width = len(self.symbols) + 2
        texts = [[self.symbols[c] if c.isalpha() else 0 for c in samples[lang].lower()[:chars]] for lang in self.langs]
        automata = [suffix_automaton(text) for text in texts]
        dense = self.width * sum(map(len, automata)) <= DENSE_CELLS
        self.tables = [self._dense(states) if dense else self._sparse(states) for states in automata]
        self.norm = [math.log2(len(text) + 2) for text in texts]

    def _dense(self, states: list[dict[int, int]]) -> np.ndarray:
        table = np.zeros((len(states), self.width), np.int32)
        for s, after in enumerate(states):
            if after:
                table[s, list(after)] = list(after.values())
        return table.ravel()

    def _sparse(self, states: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state * width + symbol of every transition, sorted; where it leads; the row of the start)."""
        keys = np.array([s * self.width + c for s, after in enumerate(states) for c in sorted(after)] + [1 << 62], np.int64)
        targets = np.array([after[c] for after in states for c in sorted(after)] + [0], np.int32)
        start = np.zeros(self.width, np.int32)
        start[list(states[0])] = list(states[0].values())
        return keys, targets, start

    def lookup(self) -> np.ndarray:
        """Symbol of every code point."""
        out = _letters().astype(np.int32)
        for c, i in self.symbols.items():
            out[ord(c)] = i
        return out

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray, table: np.ndarray | tuple) -> np.ndarray:
        """Number of phrases of each text under one automaton."""
        lanes = -(-sizes // LANE)
        of = np.repeat(np.arange(len(sizes)), lanes)
        begin = (np.cumsum(sizes) - sizes)[of] + LANE * (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(begin + LANE, np.cumsum(sizes)[of])
        order = np.argsort(begin - end, kind="stable")
        begin, length = begin[order], (end - begin)[order]
        active = np.searchsorted(-length, -np.arange(LANE), side="left")  # lanes longer than t come first
        state, count = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        width = self.width
        start = table[2] if isinstance(table, tuple) else table
        for t in range(LANE):
            a = int(active[t])
            if not a:
                break
            c = symbols[begin[:a] + t]
            if isinstance(table, tuple):
                key = state[:a].astype(np.int64) * width + c
                at = np.searchsorted(table[0], key)
                step = np.where(table[0][at] == key, table[1][at], 0)
            else:
                step = table[state[:a] * width + c]
            fail = step == 0
            count[:a] += fail
            state[:a] = np.where(fail, start[c], step)
        return np.bincount(of[order], weights=count, minlength=len(sizes))

    def predict(self, texts: list[str | None], lookup: np.ndarray) -> tuple[list[str], list[float]]:
        data, sizes = code_points([t or "" for t in texts])
        symbols = lookup[data]
        letters = np.add.reduceat(np.append(symbols > 0, False).astype(np.int64), np.minimum(np.cumsum(sizes) - sizes, len(symbols)))
        letters[sizes == 0] = 0
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = np.stack([(self.phrases(symbols, sizes, table) + 1) * norm for table, norm in zip(self.tables, self.norm)])
        best = cost.argmin(0)
        low = cost.min(0)
        rest = np.partition(cost, 1, axis=0)[1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.clip(1 - low / rest, 0, 1)
        some = letters > 0
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], np.where(some, score, 0.0).tolist()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC,
        chars_per_lang: int = CHARS_PER_LANG, total_chars: int = TOTAL_CHARS) -> LanguageModel:
    """Automata from a bounded sample of ``labelled``; rows without language or text are passed over."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # distinct texts, to a few per cent: copies share a hash and would be taken or passed over together
    distinct = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    counts = {r["lang"]: max(r["texts"], 1) for r in distinct.orderBy(F.desc("rows")).limit(MAX_LANGS).collect()}
    if not counts:
        return LanguageModel({}, 0)
    # a hash picks about three times the wanted texts of each language, so that what is ranked is small
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    stride, width = F.floor(F.length("text") / SLICES), chars_per_doc // SLICES
    shift = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(stride - width, F.lit(0)) + 1)
    cuts = [F.substring(F.col("text"), (stride * i + shift + 1).cast("int"), F.lit(width)) for i in range(SLICES)]
    cut = F.when(F.length("text") <= chars_per_doc, F.col("text")).otherwise(F.concat_ws("\n", *cuts))
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 3 * docs_per_lang / n) * (1 << 30)))])
    few = rows.where(F.col("lang").isin(list(counts))).withColumn("h", h).where(F.col("h") < F.element_at(shares, F.col("lang")))
    ranked = few.select("lang", "h", cut.alias("text")).distinct().withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= docs_per_lang)
    samples: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "k").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    chars = min(chars_per_lang, total_chars // len(counts), max(len("\n".join(x)) for x in samples.values()))
    return LanguageModel({k: "\n".join(x) for k, x in samples.items()}, chars)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without its text and with lang_pred and score."""
    own = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    shipped = Shipped(docs.sparkSession, model)  # bounded by total_chars

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.open()
        lookup = model.lookup()
        for batch in pieces(batches, text, 2 << 20):
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            langs, scores = model.predict(column(text).to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays([column(c) for c in own] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*own, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in own] + ["lang_pred string", "score double"]))


def cross_fold(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out, predicted for all."""
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(marked.where(out != 0))
    return identify(marked.select("doc_id", F.coalesce(out == 0, F.lit(False)).alias("held_out"), "text"), model)
