"""Quality rules by weak supervision, in DataFrame functions only.

Every rule looks at one signal of a text and votes good (1), bad (-1) or abstains (0).  Rules are noisy and disagree, so
no rule decides alone: expectation-maximisation over the table of vote patterns estimates, without labels, how often each
rule votes each way on good and on bad texts, and a text is kept when its posterior probability of being good reaches
``threshold``.  The pattern table has at most 3 ** len(RULES) rows whatever the size of the corpus; it is what the fit
reads.

Defined cases: a null or blank text has no words, fails the base rule and is not kept.  Columns of the input that bear
the name of a result column are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import written

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
ITERATIONS = 25
SMOOTHING = 1.0

#: Signal, SQL condition of a bad vote, SQL condition of a good vote.  Ratios are integer comparisons, so Spark and any
#: other SQL engine agree on them.
RULES = [
    ("length", "n_words > 1000000", "n_words >= 50"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words",
     "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
    ("symbols", "5 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_chars", "40 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("shouting", "3 * n_exclaim > n_words", "20 * n_exclaim <= n_words"),
    ("dup_lines", "3 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    ("repeats", "100 * n_repeat_words > 15 * n_words", "20 * n_repeat_words <= n_words"),
    ("sentences", "300 * n_stops < n_words", "50 * n_stops >= n_words"),
    ("line_words", "n_words < 2 * n_lines", "n_words >= 5 * n_lines"),
]

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_exclaim", "n_stops", "n_lines", "n_dup_lines", "n_repeat_words"]
_CHARS = " \t\n\x0b\x0c\r"
_SPACE = " \\t\\n\\x0B\\f\\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """How many words the windows at the sorted, distinct ``positions`` cover together."""
    return F.aggregate(
        positions, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")),
        lambda a: a["sum"])


def _count(char: str) -> Column:
    return (F.length("_t") - F.length(F.replace("_t", F.lit(char), F.lit("")))).cast("long")


def _window_hashes(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def _sorted_windows(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_at(pairs: Column) -> Column:
    """Positions of the windows that equal a neighbour in the sorted order."""
    same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
    return F.transform(F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the SIGNALS of every whole text (longs)."""
    # Lambdas see every array through _let, so that it is computed once per row whatever the optimizer inlines.
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(_CHARS))
    out = docs.withColumn("_t", t).withColumn(
        "_w", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{_SPACE}]+")))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_CHARS)) != ""))
    out = out.withColumn("_h", F.when(F.size("_w") >= WINDOW, _let(F.col("_w"), _window_hashes)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _let(_sorted_windows(F.col("_h")), _repeated_at)))
    repeated = F.when(F.col("_p").isNull(), F.lit(0)).otherwise(_covered(F.sort_array("_p")))
    return out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long"),
        "n_exclaim": _count("!"),
        "n_stops": _count("."),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    }).drop("_t", "_w", "_lines", "_h", "_p")


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words")


def votes() -> Column:
    """The vote pattern as one string: a character of b, a, g (bad, abstain, good) per rule, empty where the base rule fails.

    Later steps select by the pattern alone: a filter on the signals themselves would be pushed below the projection
    that makes them and compute them again.
    """
    return F.when(base_failed(), F.lit("")).otherwise(F.concat(*[F.expr(f"CASE WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE 'a' END") for _, bad, good in RULES]))


def fit_label_model(patterns: dict[str, int], iterations: int = ITERATIONS) -> dict[str, float]:
    """EM over vote patterns and their counts: the posterior probability of 'good' for every pattern.

    Two classes; given the class, rules vote independently.  Starts from the vote balance of each pattern, which also
    fixes which class is called good.
    """
    total = sum(patterns.values())
    good = {p: _start(p) for p in patterns}
    for _ in range(iterations if total else 0):
        weight = sum(patterns[p] * good[p] for p in patterns)
        prior = (weight + SMOOTHING) / (total + 2 * SMOOTHING)
        logs = []
        for r in range(len(RULES)):
            for vote in "bag":
                g = sum(patterns[p] * good[p] for p in patterns if p[r] == vote)
                n = sum(patterns[p] for p in patterns if p[r] == vote)
                logs.append((r, vote, math.log((g + SMOOTHING) / (weight + 3 * SMOOTHING)),
                             math.log((n - g + SMOOTHING) / (total - weight + 3 * SMOOTHING))))
        table = {(r, v): gl - bl for r, v, gl, bl in logs}
        good = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, math.log(prior / (1 - prior)) + sum(table[r, v] for r, v in enumerate(p))))))
                for p in patterns}
    return good


def _start(pattern: str) -> float:
    g, b = pattern.count("g"), pattern.count("b")
    return (g + 1) / (g + 3 * b + 2)


def pattern_counts(featured: DataFrame) -> dict[str, int]:
    """Counts of the vote patterns of the texts that pass the base rule; at most 3 ** len(RULES) rows reach the driver."""
    rows = featured.groupBy(votes().alias("pattern")).count().collect()
    return {r["pattern"]: r["count"] for r in rows if r["pattern"]}


def _pattern_table(spark, posterior: dict[str, float]) -> DataFrame:
    rows = sorted(posterior.items()) or [("-", 0.0)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}', {v!r}D)" for p, v in rows) + " AS t(_pattern, p_good)")


def verdict(featured: DataFrame, posterior: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, p_good and kept.  The broadcast table has at most 3 ** len(RULES) rows."""
    out = featured.drop("p_good", "base_failed", "kept").withColumn("_pattern", votes())
    out = out.join(F.broadcast(_pattern_table(featured.sparkSession, posterior)), "_pattern", "left")
    return out.withColumns({
        "base_failed": F.col("_pattern") == "", "p_good": F.coalesce("p_good", F.lit(0.0)),
        "kept": F.coalesce("p_good", F.lit(0.0)) >= threshold}).drop("_pattern")


def rate_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with signals, base_failed, p_good and kept.  Two passes over the text: fit, then score."""
    featured = signals(docs, text)
    return verdict(featured, fit_label_model(pattern_counts(featured)), threshold)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.  The text is read once: the rows are written with their votes."""
    own = signals(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text")
    voted = written(own.select("_row", votes().alias("_pattern")), "quality-votes")
    counts = {r["_pattern"]: r["n"] for r in voted.where("_pattern <> ''").groupBy("_pattern").agg(F.count("*").alias("n")).collect()}
    posterior = {p: v for p, v in fit_label_model(counts).items() if v >= threshold}
    return voted.join(F.broadcast(_pattern_table(docs.sparkSession, posterior)), "_pattern", "left_semi").select("_row.*")
