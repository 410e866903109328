"""The pipeline against a plain version of every stage, and the registered queries."""

import hashlib
import re
import tempfile
from collections import Counter

import duckdb
import numpy as np

import __spark_entry__ as se
import corpus_pipeline
from labelwise.llm import pii, quality
from labelwise.llm.queries import bpe_path

from .conftest import SF, WORD, fold
from .test_dedup import brute_roots
from .test_text_operators import ALNUM, luhn  # noqa: F401


def brute_quality(rows):
    def signals(text):
        w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
        return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_exclaim": (text or "").count("!"),
                "n_stops": (text or "").count("."), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover)}

    def says(condition, s):
        return eval(condition.replace(" = ", " == ").replace("OR", "or").replace("AND", "and"), {}, s)

    patterns = []
    for _, t in rows:
        s = signals(t)
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        patterns.append("" if failed else "".join("b" if says(bad, s) else "g" if says(good, s) else "a" for _, bad, good in quality.RULES))
    good = quality.fit_label_model(dict(Counter(p for p in patterns if p)))
    return [r for r, p in zip(rows, patterns) if p and good[p] >= 0.5]


def brute_groups(rows):
    """Rows of the smallest id of each group: five words, 0.8."""
    best = {}
    for i, root in enumerate(brute_roots(rows, 5, 80)[1]):
        best[root] = min(best.get(root, (rows[i][0], i)), (rows[i][0], i))
    return [rows[i] for _, i in best.values()]


def brute_pipeline(rows, items):
    from tokenizers import Tokenizer

    rows = brute_groups(brute_quality(rows))
    windows = set()
    for _, t in items:
        w = ALNUM.findall(fold(t))
        windows |= {tuple(w[k:k + 10]) for k in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = ALNUM.findall(fold(text))
        return any(tuple(w[k:k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    rows = [r for r in rows if not leaks(r[1])]
    detector = pii.fit_examples([e for _, t in rows for e in pii.weak_examples(t)])
    library = Tokenizer.from_file(bpe_path())
    for d, t in rows:
        text = pii.redact(t, detector.spans(t)[1])
        ids = library.encode(text, add_special_tokens=False).ids
        yield (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_pipeline_equals_plain_version(spark, documents):
    rows = [(d, t, None, "s", len(t or "")) for d, t in documents if d is not None]
    sf_dir = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf_dir}/benchmark.parquet")
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    want = Counter(brute_pipeline([r[:2] for r in rows], items))
    assert got == want and 50 < len(want) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []


def test_registered():
    names = se.queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert {"op3_decontamination", "op7_quality_rules"} <= set(se.oracle_sql())


def test_query_columns(spark):
    want = {
        "op1": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op2": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op3": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op5": ["doc_id", "n_shingles", "component_id"],
        "op6": ["page_id", "url", "text", "n_chars"], "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8": ["doc_id", "held_out", "lang_pred", "score"], "op9": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op11": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op13": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
        "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]}
    for name, query in se.queries().items():
        if columns := want.get(name.split("_")[0]):
            out = query(spark, SF)
            assert [c for c in out.columns if c in columns] == columns
