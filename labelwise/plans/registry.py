"""Registered queries over the supplied tables, each with an oracle in SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
same result as plain SQL over the tables registered as views (documents,
labels, conversations, embeddings, pages, customer, ...).  Every query has
one: training runs are unrolled (full-batch epochs) or recursive (mini-batch
epochs) SQL.  Floating results that depend on summation order are rounded
to 9 places at the boundary; array results are checked one element per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.operators import evaluate as ev
from labelwise.sources import tables as tb

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


# --------------------------------------------------------------------------
# Shared SQL fragments (oracle side)
# --------------------------------------------------------------------------

EX_SQL = """
ex AS (
  SELECT l.doc_id AS row_id, l.quality, l.toxic, d.text, d.n_chars, d.lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""

PRED_SQL = EX_SQL + """,
preds AS (
  SELECT row_id, 'quality' AS task, quality AS y, CAST(n_chars >= 500 AS INTEGER) AS pred,
         CAST(n_chars AS DOUBLE) AS score FROM ex
  UNION ALL
  SELECT row_id, 'toxic' AS task, toxic AS y,
         CAST(strpos(lower(text), 'worthless') > 0 OR strpos(lower(text), 'stupid') > 0 AS INTEGER) AS pred,
         CAST(n_chars AS DOUBLE) AS score FROM ex
)"""

COUNTS_SQL = """
  count(*) FILTER (WHERE y = 1 AND pred IS NOT DISTINCT FROM y) AS TP,
  count(*) FILTER (WHERE y = 0 AND pred IS NOT DISTINCT FROM y) AS TN,
  count(*) FILTER (WHERE y = 0 AND pred IS DISTINCT FROM y) AS FP,
  count(*) FILTER (WHERE y = 1 AND pred IS DISTINCT FROM y) AS FN"""

R1 = "CAST(TP AS DOUBLE) / NULLIF(TP + FN, 0)"
R0 = "CAST(TN AS DOUBLE) / NULLIF(TN + FP, 0)"
F1_SQL = "coalesce(2.0 * CAST(TP AS DOUBLE) / NULLIF(2.0 * TP + FP + FN, 0), 0.0)"
BA_SQL = f"CASE WHEN {R1} IS NOT NULL AND {R0} IS NOT NULL THEN ({R1} + {R0}) / 2.0 WHEN {R1} IS NOT NULL THEN {R1} ELSE {R0} END"
AUC_SQL = f"CASE WHEN {R1} IS NOT NULL AND {R0} IS NOT NULL THEN ({R1} + {R0}) / 2.0 END"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.text_examples(tb.read_table(spark, sf_dir, "documents"), tb.read_table(spark, sf_dir, "labels"))


def _stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.stand_in_predictions(_examples(spark, sf_dir))


# --------------------------------------------------------------------------
# Evaluation
# --------------------------------------------------------------------------

@register("multi_task_eval", f"""
WITH {PRED_SQL},
c AS (SELECT task, count(*) AS n, {COUNTS_SQL} FROM preds GROUP BY task)
SELECT task, n, TP, TN, FP, FN, {F1_SQL} AS F1, {BA_SQL} AS BA, {AUC_SQL} AS AUC FROM c
""")
def q_multi_task_eval(spark, sf_dir):
    return ev.multi_task_eval(_stand_in(spark, sf_dir))


@register("confusion_counts", f"""
WITH {PRED_SQL}
SELECT task, {COUNTS_SQL} FROM preds GROUP BY task
""")
def q_confusion_counts(spark, sf_dir):
    return ev.confusion_counts(_stand_in(spark, sf_dir))


@register("f1_binary", f"""
WITH {PRED_SQL},
c AS (SELECT task, {COUNTS_SQL} FROM preds GROUP BY task)
SELECT task, {F1_SQL} AS F1 FROM c
""")
def q_f1_binary(spark, sf_dir):
    return ev.confusion_counts(_stand_in(spark, sf_dir)).select("task", ev.f1_binary().alias("F1"))


@register("balanced_accuracy", f"""
WITH {PRED_SQL},
per_class AS (
  SELECT task, y, avg(CAST(pred IS NOT DISTINCT FROM y AS DOUBLE)) AS recall
  FROM preds WHERE y IS NOT NULL GROUP BY task, y)
SELECT task, avg(recall) AS BA FROM per_class GROUP BY task
""")
def q_balanced_accuracy(spark, sf_dir):
    return ev.balanced_accuracy(_stand_in(spark, sf_dir))


@register("auc_hard", f"""
WITH {PRED_SQL},
c AS (SELECT task, {COUNTS_SQL} FROM preds GROUP BY task)
SELECT task, {AUC_SQL} AS AUC FROM c
""")
def q_auc_hard(spark, sf_dir):
    return ev.confusion_counts(_stand_in(spark, sf_dir)).select("task", ev.auc_hard().alias("AUC"))


@register("auc_score", f"""
WITH {PRED_SQL},
s AS (
  SELECT task, score, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
  FROM preds WHERE y IN (0, 1) AND score IS NOT NULL GROUP BY task, score),
r AS (
  SELECT task, n_pos, n_neg,
         coalesce(sum(n_neg) OVER (PARTITION BY task ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM s)
SELECT task, CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_neg) AS BIGINT) AS n_neg,
       CASE WHEN sum(n_pos) > 0 AND sum(n_neg) > 0
            THEN CAST(sum(n_pos * (below + n_neg * 0.5)) AS DOUBLE) / (CAST(sum(n_pos) AS DOUBLE) * sum(n_neg)) END AS AUC
FROM r GROUP BY task
""")
def q_auc_score(spark, sf_dir):
    return ev.auc_score(_stand_in(spark, sf_dir))


@register("label_predicate", f"""
WITH {PRED_SQL}
SELECT row_id, task, y, pred,
       CASE WHEN y = 1 AND pred IS NOT DISTINCT FROM y THEN 'TP' WHEN y = 1 THEN 'FN'
            WHEN y = 0 AND pred IS NOT DISTINCT FROM y THEN 'TN' WHEN y = 0 THEN 'FP' END AS outcome
FROM preds
""")
def q_label_predicate(spark, sf_dir):
    p = _stand_in(spark, sf_dir)
    return p.select("row_id", "task", "y", "pred", ev.label_outcome().alias("outcome"))


@register("flat_accuracy", f"""
WITH {PRED_SQL}
SELECT task, avg(CAST(pred IS NOT DISTINCT FROM y AS DOUBLE)) AS accuracy, count(*) AS n FROM preds GROUP BY task
""")
def q_flat_accuracy(spark, sf_dir):
    return ev.flat_accuracy(_stand_in(spark, sf_dir))


# --------------------------------------------------------------------------
# Sources and preparation
# --------------------------------------------------------------------------

from labelwise.operators import prep  # noqa: E402
from labelwise.operators import encode as enc  # noqa: E402
from labelwise.operators import sample as smp  # noqa: E402
from labelwise.sources import transcripts as trs  # noqa: E402
from labelwise.session import scratch_path  # noqa: E402

TR_SQL = r"""
tr AS (
  SELECT CAST(turn AS INTEGER) AS "index", CAST(NULL AS INTEGER) AS label, role AS label_notes,
         text AS sentence, printf('%03d_TRANSCRIPT.csv', conv_id) AS audio_features
  FROM conversations),
trid AS (
  SELECT *, CAST(NULLIF(regexp_extract(audio_features, '^[0-9]+'), '') AS BIGINT) AS Participant_ID FROM tr),
lab AS (SELECT CAST(doc_id AS BIGINT) AS Participant_ID, quality, toxic FROM labels)"""

LINKED_SQL = TR_SQL + """,
linked AS (
  SELECT lab.Participant_ID, lab.quality, lab.toxic, trid."index", trid.label, trid.label_notes,
         trid.sentence, trid.audio_features
  FROM lab LEFT JOIN trid ON lab.Participant_ID = trid.Participant_ID)"""

SPLIT_SQL = "CASE WHEN CAST(('0x' || substr(md5('42:' || CAST({id} AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 2 " \
            "THEN 'test' ELSE 'train' END"


def _transcripts(spark, sf_dir):
    return tb.transcripts_from_conversations(tb.read_table(spark, sf_dir, "conversations"))


def _with_id(spark, sf_dir):
    """Every turn with the whole number in front of its file name, however long, as the participant."""
    return prep.with_id(_transcripts(spark, sf_dir), pattern=prep.WHOLE_ID_PATTERN, dtype="bigint")


def _labels(spark, sf_dir):
    return tb.participant_labels(tb.read_table(spark, sf_dir, "labels"))


def _linked(spark, sf_dir):
    return prep.link_labels(_labels(spark, sf_dir), _with_id(spark, sf_dir))


@register("scan_transcripts", f"WITH {TR_SQL} SELECT * FROM tr")
def q_scan_transcripts(spark, sf_dir):
    return _transcripts(spark, sf_dir)


@register("filter_turns", f"""WITH {TR_SQL} SELECT * FROM tr WHERE label_notes = 'user'""")
def q_filter_turns(spark, sf_dir):
    return tb.speaker_turns(_transcripts(spark, sf_dir), "user")


@register("scan_labels", f"WITH {TR_SQL} SELECT * FROM lab")
def q_scan_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


_LINE_SQL = """
lines AS (SELECT "index" % 7 = 6 AS wrong, "index" % 5 = 4 AS short, "index" % 6 = 5 AS unnamed, replace(replace(replace(coalesce(sentence, ''), chr(9), ' '), chr(10), ' '), chr(13), ' ') AS said,
    concat_ws(chr(9), CASE WHEN "index" % 7 = 6 THEN 'x' ELSE '' END || "index", coalesce(label::VARCHAR, ''), coalesce(label_notes, '')) AS head,
    CASE WHEN "index" % 6 = 5 THEN '' ELSE audio_features END AS name FROM tr)"""


@register("scan_checked", f"""
WITH {TR_SQL}, {_LINE_SQL}
SELECT CASE WHEN wrong OR short THEN 'malformed' WHEN unnamed THEN 'missing' ELSE 'good' END AS reason,
  CASE WHEN wrong OR short OR unnamed THEN head || chr(9) || said || CASE WHEN short THEN '' ELSE chr(9) || name END WHEN said = '' THEN NULL ELSE said END AS line FROM lines
""")
def q_scan_checked(spark, sf_dir):
    """A transcript file with broken lines: every line is either good, or kept with the reason why it is not."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    number = F.concat(F.when(F.col("index") % 7 == 6, "x").otherwise(""), c("index"))
    name = F.when(F.col("index") % 6 == 5, "").otherwise(F.col("audio_features"))
    said = F.regexp_replace(c("sentence"), "[\t\n\r]", " ")
    fields = [number, c("label"), c("label_notes"), said]
    line = F.when(F.col("index") % 5 == 4, F.concat_ws("\t", *fields)).otherwise(F.concat_ws("\t", *fields, name))
    path = scratch_path(spark, "lines")
    _transcripts(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, bad = trs.scan_checked(spark, path, required=("audio_features",))
    store = trs.quarantine(bad, scratch_path(spark, "quarantine"))
    kept = spark.read.schema("line string, file string, reason string").parquet(store)
    return good.select(F.lit("good").alias("reason"), F.col("sentence").alias("line")).unionByName(kept.select("reason", "line"))


@register("extract_id", r"""
SELECT page_id, url, CAST(NULLIF(regexp_extract(url, '[0-9]{3}'), '') AS INTEGER) AS Participant_ID FROM pages
""")
def q_extract_id(spark, sf_dir):
    pages = tb.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", prep.extract_id("url", mode="null").alias("Participant_ID"))


@register("extract_id_suffix", r"""
SELECT c_custkey, c_name, CAST(NULLIF(regexp_extract(c_name, '[0-9]{3}$'), '') AS INTEGER) AS Participant_ID
FROM customer
""")
def q_extract_id_suffix(spark, sf_dir):
    cust = tb.read_table(spark, sf_dir, "customer")
    return cust.select("c_custkey", "c_name", prep.extract_id("c_name", "[0-9]{3}$", "strict").alias("Participant_ID"))


@register("with_id", f"WITH {TR_SQL} SELECT * FROM trid")
def q_with_id(spark, sf_dir):
    return _with_id(spark, sf_dir)


@register("link_labels", f"WITH {LINKED_SQL} SELECT * FROM linked")
def q_link_labels(spark, sf_dir):
    return _linked(spark, sf_dir)


@register("link_colocated", f"WITH {LINKED_SQL} SELECT * FROM linked")
def q_link_colocated(spark, sf_dir):
    """As ``link_labels`` from tables stored side by side: no transcript moves when they are linked."""
    from labelwise.sources import colocated as co

    return co.linked(co.colocate(_labels(spark, sf_dir), _with_id(spark, sf_dir), buckets=8, rows_per_part=100_000))


@register("link_labels_matched", f"""
WITH {TR_SQL}
SELECT lab.Participant_ID, lab.quality, lab.toxic, trid."index", trid.label, trid.label_notes,
       trid.sentence, trid.audio_features
FROM lab JOIN trid ON lab.Participant_ID = trid.Participant_ID
""")
def q_link_labels_matched(spark, sf_dir):
    return prep.link_labels_matched(_labels(spark, sf_dir), _with_id(spark, sf_dir))


@register("unlinked_labels", f"""
WITH {TR_SQL}
SELECT * FROM lab WHERE Participant_ID NOT IN (SELECT Participant_ID FROM trid WHERE Participant_ID IS NOT NULL)
""")
def q_unlinked_labels(spark, sf_dir):
    return prep.unlinked_labels(_labels(spark, sf_dir), _with_id(spark, sf_dir))


@register("drop_columns", f"""
WITH {LINKED_SQL} SELECT Participant_ID, quality, toxic, sentence FROM linked
""")
def q_drop_columns(spark, sf_dir):
    return prep.drop_columns(_linked(spark, sf_dir), ["index", "label", "label_notes", "audio_features"])


@register("dedup_examples", f"""
WITH {LINKED_SQL} SELECT DISTINCT Participant_ID, quality, toxic, sentence FROM linked
""")
def q_dedup_examples(spark, sf_dir):
    linked = prep.drop_columns(_linked(spark, sf_dir), ["index", "label", "label_notes", "audio_features"])
    return prep.dedup_examples(linked)


@register("project_text_label", f"""
WITH {LINKED_SQL},
d AS (SELECT DISTINCT Participant_ID, quality, toxic, sentence FROM linked)
SELECT sentence, quality FROM d
""")
def q_project_text_label(spark, sf_dir):
    linked = prep.drop_columns(_linked(spark, sf_dir), ["index", "label", "label_notes", "audio_features"])
    return prep.project_text_label(prep.dedup_examples(linked), "quality")


def _tagged_documents(spark, sf_dir):
    docs = tb.read_table(spark, sf_dir, "documents")
    return smp.train_test_tag(docs.select("doc_id", "n_chars", F.col("lang").alias("question")), "doc_id")


@register("train_test_tag", f"SELECT doc_id, n_chars, lang AS question, {SPLIT_SQL.format(id='doc_id')} AS split FROM documents")
def q_train_test_tag(spark, sf_dir):
    return _tagged_documents(spark, sf_dir)


@register("select_question_split", f"""
SELECT * FROM (
  SELECT doc_id, n_chars, lang AS question, {SPLIT_SQL.format(id='doc_id')} AS split FROM documents)
WHERE question = 'en' AND split = 'train'
""")
def q_select_question_split(spark, sf_dir):
    root = scratch_path(spark, "question-split")
    trs.write_question_split(_tagged_documents(spark, sf_dir), root)
    return trs.select_question_split(spark, root, "en", "train").select("doc_id", "n_chars", "question", "split")


@register("split_counts", f"""
SELECT lang AS question, {SPLIT_SQL.format(id='doc_id')} AS split, count(*) AS n_rows FROM documents GROUP BY 1, 2
""")
def q_split_counts(spark, sf_dir):
    return trs.split_counts(_tagged_documents(spark, sf_dir))


@register("support_query_test", """
SELECT CAST(doc_id AS BIGINT) AS row_id,
       CASE WHEN b < 6 THEN 'support' WHEN b < 8 THEN 'query' ELSE 'test' END AS part
FROM (SELECT doc_id, CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS b FROM labels)
""")
def q_support_query_test(spark, sf_dir):
    lab = tb.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    return smp.support_query_test(lab, "row_id")


# --------------------------------------------------------------------------
# Encoding (E1-E6, C5, S6)
# --------------------------------------------------------------------------

VOCAB_SIZE = 5000

TOK_SQL = r"""
toks AS (
  SELECT doc_id AS row_id,
         list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
  FROM documents),
flat AS (SELECT row_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM toks),
counts AS (SELECT token, count(*) AS n FROM flat GROUP BY token),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id, n FROM counts
  QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 5000),
lookup AS (SELECT f.row_id, f.pos, f.token, coalesce(v.id, 1) AS token_id FROM flat f LEFT JOIN vocab v ON f.token = v.token),
words AS (SELECT row_id, list(token_id ORDER BY pos) AS w FROM lookup GROUP BY row_id),
encoded AS (
  SELECT toks.row_id, CAST(len(toks.t) AS INTEGER) AS n_tokens,
         list_concat([2], coalesce(words.w, []), [3]) AS encoded
  FROM toks LEFT JOIN words ON toks.row_id = words.row_id),
fixed AS (
  SELECT row_id, n_tokens, list_resize(encoded, 128, 0) AS input_ids FROM encoded),
masked AS (
  SELECT row_id, n_tokens, input_ids, list_transform(input_ids, lambda x: CAST(x > 0 AS INTEGER)) AS attention_mask
  FROM fixed)"""


def _docs(spark, sf_dir):
    return tb.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def _vocab(spark, sf_dir, docs=None):
    return enc.build_vocab(docs if docs is not None else _docs(spark, sf_dir), size=VOCAB_SIZE)


@register("tokenize", f"WITH {TOK_SQL} SELECT row_id, pos, token FROM flat")
def q_tokenize(spark, sf_dir):
    return enc.tokenize(_docs(spark, sf_dir))


@register("build_vocab", f"WITH {TOK_SQL} SELECT token, id, n FROM vocab")
def q_build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register("encode_join", f"WITH {TOK_SQL} SELECT row_id, pos, token, token_id FROM lookup")
def q_encode_join(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return enc.encode_join(docs, _vocab(spark, sf_dir, docs))


@register("encode_ids", f"WITH {TOK_SQL} SELECT row_id, n_tokens, encoded FROM encoded")
def q_encode_ids(spark, sf_dir):
    return enc.encode_corpus(_docs(spark, sf_dir), VOCAB_SIZE, max_len=None, partitions=spark.sparkContext.defaultParallelism)[0]


def _fixed(spark, sf_dir):
    return enc.encode_corpus(_docs(spark, sf_dir), VOCAB_SIZE, max_len=128, partitions=spark.sparkContext.defaultParallelism)[0]


@register("pad_truncate", f"WITH {TOK_SQL} SELECT row_id, n_tokens, input_ids FROM fixed")
def q_pad_truncate(spark, sf_dir):
    return _fixed(spark, sf_dir).select("row_id", "n_tokens", "input_ids")


@register("attention_mask", f"WITH {TOK_SQL} SELECT row_id, attention_mask FROM masked")
def q_attention_mask(spark, sf_dir):
    return _fixed(spark, sf_dir).select("row_id", "attention_mask")


@register("encode_lengths", f"""
WITH {TOK_SQL}
SELECT row_id, CAST(list_sum(attention_mask) AS INTEGER) AS length, n_tokens + 2 > 128 AS truncated FROM masked
""")
def q_encode_lengths(spark, sf_dir):
    return enc.encode_lengths(_fixed(spark, sf_dir))


@register("post_truncate", f"WITH {TOK_SQL} SELECT row_id, list_slice(t, 1, 128) AS tokens FROM toks")
def q_post_truncate(spark, sf_dir):
    from labelwise.functions.text import tokens
    docs = _docs(spark, sf_dir).select("row_id", tokens("text").alias("tokens"))
    return enc.post_truncate(docs, "tokens", 128)


# --------------------------------------------------------------------------
# Order, batches, splits
# --------------------------------------------------------------------------

SHUF_SQL = """
shuf AS (
  SELECT doc_id AS row_id, n_chars, md5('42:0:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM documents),
ranked AS (SELECT *, row_number() OVER (ORDER BY shuffle_key, row_id) - 1 AS rank FROM shuf),
batched AS (SELECT *, CAST(floor(rank / 32) AS BIGINT) AS batch_id FROM ranked)"""


def _batched(spark, sf_dir):
    docs = tb.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    return smp.assign_batches(docs, 32, "row_id", seed=42, epoch=0)


@register("seeded_shuffle", f"WITH {SHUF_SQL} SELECT row_id, shuffle_key, CAST(rank AS BIGINT) AS rank FROM ranked")
def q_seeded_shuffle(spark, sf_dir):
    return _batched(spark, sf_dir).select("row_id", "shuffle_key", "rank")


@register("assign_batches", f"WITH {SHUF_SQL} SELECT row_id, batch_id FROM batched")
def q_assign_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("row_id", "batch_id")


@register("batch_count", """
SELECT count(*) AS n_rows, CAST(ceil(count(*) / 32.0) AS BIGINT) AS n_batches,
       CAST(ceil(count(*) / 32.0) AS BIGINT) * 5 AS total_steps FROM documents
""")
def q_batch_count(spark, sf_dir):
    n = tb.read_table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_rows"))
    per_epoch, total = smp.batch_count(F.col("n_rows"), 32, epochs=5)
    return n.select("n_rows", per_epoch.alias("n_batches"), total.alias("total_steps"))


@register("batch_mean_loss", f"""
WITH {SHUF_SQL},
pb AS (SELECT batch_id, avg(ln(n_chars)) AS bm, count(*) AS n FROM batched GROUP BY batch_id)
SELECT round(avg(bm), 9) AS batch_mean_loss, round(sum(bm * n) / sum(n), 9) AS row_mean_loss,
       count(*) AS n_batches FROM pb
""")
def q_batch_mean_loss(spark, sf_dir):
    b = _batched(spark, sf_dir).withColumn("loss", F.log("n_chars"))
    out = ev.batch_mean_loss(b)
    return out.select(F.round("batch_mean_loss", 9).alias("batch_mean_loss"),
                      F.round("row_mean_loss", 9).alias("row_mean_loss"), "n_batches")


@register("flatten_batches", f"""
WITH {SHUF_SQL},
p AS (SELECT b.batch_id, b.row_id, b.shuffle_key, CAST(b.n_chars >= 500 AS INTEGER) AS pred, l.quality AS y
      FROM batched b JOIN labels l ON b.row_id = l.doc_id)
SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY shuffle_key, row_id) - 1 AS INTEGER) AS pos,
       pred, y FROM p
""")
def q_flatten_batches(spark, sf_dir):
    b = _batched(spark, sf_dir)
    lab = tb.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"))
    rows = b.join(lab, "row_id").select("batch_id", "shuffle_key", "row_id",
                                         (F.col("n_chars") >= 500).cast("int").alias("pred"), "y")
    per_batch = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("shuffle_key", "row_id", "pred", "y"))).alias("_r"))
    batches = per_batch.select("batch_id", F.transform("_r", lambda r: r["pred"]).alias("pred"),
                               F.transform("_r", lambda r: r["y"]).alias("y"))
    return ev.flatten_batches(batches)


# --------------------------------------------------------------------------
# Array math on fixed features
# --------------------------------------------------------------------------

import numpy as np  # noqa: E402

from labelwise.functions import arrays as A  # noqa: E402
from labelwise.operators import linalg as la  # noqa: E402
from labelwise.operators import train as trn  # noqa: E402

EMB_SQL = """
emb AS (
  SELECT vec_id AS row_id, embedding AS x, CAST(label % 2 AS INTEGER) AS a, CAST(label >= 5 AS INTEGER) AS b, label
  FROM embeddings)"""


def _w_sql(c: int) -> str:
    """SQL of the formula weight of class row ``c`` at 1-based index ``i``."""
    return f"(CAST(((7 * (i - 1) + 3 * {c}) % 11) - 5 AS DOUBLE) / 10)"


def _dot_sql(c: int, x: str = "x") -> str:
    return f"list_reduce(list_transform({x}, lambda v, i: CAST(v AS DOUBLE) * {_w_sql(c)}), lambda acc, v: acc + v)"


def _r9_list(expr: str) -> str:
    return f"list_transform({expr}, lambda v: round(v, 9))"


def _r9(col):
    return F.transform(col, lambda v: F.round(v, 9))


HEADS_SQL = EMB_SQL + f""",
z AS (
  SELECT row_id, x, a, b, label, [{_dot_sql(0)}, {_dot_sql(1)}] AS za, [{_dot_sql(2)}, {_dot_sql(3)}] AS zb FROM emb)"""


def _emb(spark, sf_dir):
    return tb.embedding_examples(tb.read_table(spark, sf_dir, "embeddings"))


def _formula_heads(d: int = 64) -> dict[str, trn.Head]:
    return {"a": trn.Head(np.array(la.formula_weights(2, d)), np.zeros(2)),
            "b": trn.Head(np.array(la.formula_weights(2, d, row_offset=2)), np.zeros(2))}


def _scored_emb(spark, sf_dir):
    h = _formula_heads()
    return _emb(spark, sf_dir).select("row_id", "x", "a", "b", "label",
                                      trn.head_logits("x", h["a"]).alias("za"), trn.head_logits("x", h["b"]).alias("zb"))


@register("linear_layer", f"WITH {HEADS_SQL} SELECT row_id, za AS logits FROM z")
def q_linear_layer(spark, sf_dir):
    return _emb(spark, sf_dir).select("row_id", A.linear("x", la.formula_weights(2, 64)).alias("logits"))


@register("two_head_scores", f"WITH {HEADS_SQL} SELECT row_id, za AS logits_a, zb AS logits_b FROM z")
def q_two_head_scores(spark, sf_dir):
    return _scored_emb(spark, sf_dir).select("row_id", F.col("za").alias("logits_a"), F.col("zb").alias("logits_b"))


SOFTMAX_SQL = "list_transform({z}, lambda v: exp(v - list_max({z})) / list_reduce(list_transform({z}, lambda u: exp(u - list_max({z}))), lambda acc, u: acc + u))"


@register("softmax_probs", f"WITH {HEADS_SQL} SELECT row_id, {_r9_list(SOFTMAX_SQL.format(z='za'))} AS probs FROM z")
def q_softmax_probs(spark, sf_dir):
    return _scored_emb(spark, sf_dir).select("row_id", _r9(A.softmax("za")).alias("probs"))


LSE_SQL = "(list_max({z}) + ln(list_reduce(list_transform({z}, lambda u: exp(u - list_max({z}))), lambda acc, u: acc + u)))"


@register("cross_entropy", f"""
WITH {HEADS_SQL}
SELECT row_id, round({LSE_SQL.format(z='za')} - za[a + 1], 9) AS loss_a, round({LSE_SQL.format(z='zb')} - zb[b + 1], 9) AS loss_b
FROM z
""")
def q_cross_entropy(spark, sf_dir):
    s = _scored_emb(spark, sf_dir)
    return s.select("row_id", F.round(A.cross_entropy("za", "a"), 9).alias("loss_a"),
                    F.round(A.cross_entropy("zb", "b"), 9).alias("loss_b"))


def _tanh_sql() -> str:
    rows = ", ".join(f"tanh({_dot_sql(c)})" for c in range(8))
    return f"[{rows}]"


@register("tanh_layer", f"WITH {EMB_SQL} SELECT row_id, {_r9_list(_tanh_sql())} AS h FROM emb")
def q_tanh_layer(spark, sf_dir):
    return _emb(spark, sf_dir).select("row_id", _r9(A.tanh_array(A.linear("x", la.formula_weights(8, 64)))).alias("h"))


@register("argmax_class", f"""
WITH {HEADS_SQL}
SELECT row_id, CAST(list_position(za, list_max(za)) - 1 AS INTEGER) AS pred_a,
       CAST(list_position(zb, list_max(zb)) - 1 AS INTEGER) AS pred_b FROM z
""")
def q_argmax_class(spark, sf_dir):
    s = _scored_emb(spark, sf_dir)
    return s.select("row_id", A.argmax("za").alias("pred_a"), A.argmax("zb").alias("pred_b"))


@register("clip_norm", f"""
WITH {EMB_SQL},
n AS (SELECT row_id, x, sqrt(list_reduce(list_transform(x, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda acc, v: acc + v)) AS norm FROM emb)
SELECT row_id, list_transform(x, lambda v: round(CAST(v AS DOUBLE) * least(1.0, 1.0 / (norm + 1e-6)), 9)) AS x FROM n
""")
def q_clip_norm(spark, sf_dir):
    e = _emb(spark, sf_dir).select("row_id", trn.as_double_array("x").alias("x"))
    return e.select("row_id", _r9(A.clip_norm("x", 1.0)).alias("x"))


SEQ_SQL = """
s AS (SELECT vec_id // 128 AS seq_id, vec_id AS pos, embedding AS x, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings),
sw AS (SELECT *, exp(score - max(score) OVER (PARTITION BY seq_id)) AS e FROM s),
sw2 AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id) AS weight FROM sw)"""


def _seq(spark, sf_dir):
    """Fixed vectors as sequences of 128 positions, the encoding length."""
    return tb.read_table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 128).cast(tb.read_table(spark, sf_dir, "embeddings").schema["vec_id"].dataType).alias("seq_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("x"),
        F.element_at("embedding", 1).cast("double").alias("score"))


@register("softmax_weights", f"WITH {SEQ_SQL} SELECT seq_id, pos, round(weight, 9) AS weight FROM sw2")
def q_softmax_weights(spark, sf_dir):
    w = la.softmax_weights(_seq(spark, sf_dir), ["seq_id"], "score", "weight")
    return w.select("seq_id", "pos", F.round("weight", 9).alias("weight"))


@register("attention_pool", f"""
WITH {SEQ_SQL},
d AS (SELECT seq_id, weight, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM sw2),
p AS (SELECT seq_id, dim, sum(weight * v) AS value FROM d GROUP BY seq_id, dim)
SELECT seq_id, list(round(value, 9) ORDER BY dim) AS pooled FROM p GROUP BY seq_id
""")
def q_attention_pool(spark, sf_dir):
    pooled = la.attention_pool(_seq(spark, sf_dir), seq="seq_id", pos="pos", vec="x")
    return pooled.select("seq_id", _r9(F.col("pooled")).alias("pooled"))


HOPS = (la.formula_weights(4, 64), [0.1, -0.1, 0.2, 0.0], la.formula_weights(2, 4, row_offset=5), [0.0, 0.3])


def _hops_sql() -> str:
    w1, b1, w2, b2 = HOPS
    hidden = ", ".join(f"tanh(list_reduce(list_transform(x, lambda v, i: CAST(v AS DOUBLE) * {row}[i]), lambda acc, v: acc + v) + {b})"
                       for row, b in zip(w1, b1))
    scores = ", ".join(" + ".join(f"{w} * h[{j + 1}]" for j, w in enumerate(row)) + f" + {b}" for row, b in zip(w2, b2))
    return f"""
WITH hid AS (SELECT vec_id // 128 AS seq_id, vec_id AS pos, embedding AS x, [{hidden.replace('x,', 'embedding,')}] AS h FROM embeddings),
sc AS (SELECT seq_id, pos, x, unnest([{scores}]) AS score, unnest([0, 1]) AS hop FROM hid),
sw AS (SELECT *, exp(score - max(score) OVER (PARTITION BY seq_id, hop)) AS e FROM sc),
d AS (SELECT seq_id, hop, e, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM sw),
p AS (SELECT seq_id, hop, dim, sum(e * v) / sum(e) AS value FROM d GROUP BY seq_id, hop, dim)
SELECT seq_id, list(round(value, 9) ORDER BY hop, dim) AS pooled FROM p GROUP BY seq_id"""


@register("attention_pool_hops", _hops_sql())
def q_attention_pool_hops(spark, sf_dir):
    """Two attention hops scored by a small network over every position."""
    pooled = la.attention_pool(_seq(spark, sf_dir), seq="seq_id", pos="pos", vec="x", network=HOPS)
    return pooled.select("seq_id", _r9(F.col("pooled")).alias("pooled"))


@register("dot_matrix", """
WITH c AS (
  SELECT label, i AS pos, avg(CAST(v AS DOUBLE)) AS value
  FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i)
SELECT q.label AS qid, s.label AS sid, round(sum(q.value * s.value), 9) AS dot
FROM c q JOIN c s ON q.pos = s.pos GROUP BY q.label, s.label
""")
def q_dot_matrix(spark, sf_dir):
    emb = tb.read_table(spark, sf_dir, "embeddings")
    cent = (emb.select("label", F.posexplode("embedding").alias("pos", "v"))
            .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("value")))
    q = cent.select(F.col("label").alias("qid"), "pos", "value")
    s = cent.select(F.col("label").alias("sid"), "pos", "value")
    return la.dot_matrix(q, s).select("qid", "sid", F.round("dot", 9).alias("dot"))


STEPS = 16

GRADSTEP_SQL = EMB_SQL + f""",
bt AS (SELECT *, CAST(CAST(('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT) % {STEPS} AS INTEGER) AS step FROM emb),
ex AS (SELECT step, a, b, CAST(unnest(x) AS DOUBLE) AS v, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM bt),
per_step AS (
  SELECT 'a' AS task, pos, step, sum((0.5 - a) * v) AS value FROM ex GROUP BY pos, step
  UNION ALL
  SELECT 'b' AS task, pos, step, sum((0.5 - b) * v) AS value FROM ex GROUP BY pos, step)"""


@register("grad_difference", f"WITH {GRADSTEP_SQL} SELECT task, pos, step, round(value, 9) AS value FROM per_step")
def q_grad_difference(spark, sf_dir):
    """Per-step gradient sums (class 1, zero weights) over all rows, the rows
    dealt into ``STEPS`` steps by hash; accumulated over the steps as a
    gradient that is never reset would be, then turned back into increments
    by :func:`grad_difference`.  The number of steps is a parameter, so each
    (task, pos) window holds ``STEPS`` rows whatever the table size."""
    from pyspark.sql import Window
    e = _emb(spark, sf_dir).withColumn("step", smp.hash_bucket("row_id", 42, STEPS))
    ex = e.select("step", "a", "b", F.posexplode("x").alias("pos", "v"))
    per_step = ex.groupBy("pos", "step").agg(
        F.sum((0.5 - F.col("a")) * F.col("v").cast("double")).alias("ga"),
        F.sum((0.5 - F.col("b")) * F.col("v").cast("double")).alias("gb"))
    long = per_step.select("pos", "step", F.inline(F.array(
        F.struct(F.lit("a").alias("task"), F.col("ga").alias("value")),
        F.struct(F.lit("b").alias("task"), F.col("gb").alias("value")))))
    run = Window.partitionBy("task", "pos").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    accumulated = long.withColumn("value", F.sum("value").over(run))
    diffed = la.grad_difference(accumulated, ["task", "pos"], "step", "value")
    return diffed.select("task", "pos", "step", F.round("value", 9).alias("value"))


# --------------------------------------------------------------------------
# Training (T0-T2, T4-T8, T11-T13, B7, B8)
# --------------------------------------------------------------------------

FEAT_SQL = EX_SQL + """,
feat AS (
  SELECT row_id, quality, toxic, lang,
         [1.0, ln(CAST(n_chars AS DOUBLE)) / 10, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / n_chars] AS x
  FROM ex)"""


def _features(spark, sf_dir):
    return trn.text_stat_features(_examples(spark, sf_dir))


@register("frozen_features", f"WITH {FEAT_SQL} SELECT row_id, {_r9_list('x')} AS x FROM feat")
def q_frozen_features(spark, sf_dir):
    return _features(spark, sf_dir).select("row_id", _r9(F.col("x")).alias("x"))


@register("select_model_features", f"WITH {EMB_SQL} SELECT row_id, list_transform(x, lambda v: CAST(v AS DOUBLE)) AS x FROM emb")
def q_select_model_features(spark, sf_dir):
    emb = tb.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return trn.select_model_features(emb, "embedding").select("row_id", "x")


def _grad_sql(heads: dict[str, tuple[str, int]]) -> str:
    """Oracle of :func:`gradient_table` for formula heads on ``embeddings``.

    ``heads``: task -> (label column, class-row offset of its formula weights).
    """
    parts = []
    zs = []
    for t, (y, off) in heads.items():
        zs.append(f"[{_dot_sql(off)}, {_dot_sql(off + 1)}] AS z_{t}")
    sel = [f"""
  SELECT row_id, {y} AS y_{t},
         list_transform(z_{t}, lambda v: exp(v - list_max(z_{t})) / list_reduce(list_transform(z_{t}, lambda u: exp(u - list_max(z_{t}))), lambda acc, u: acc + u)) AS p_{t},
         {LSE_SQL.format(z=f'z_{t}')} - z_{t}[{y} + 1] AS l_{t}""" for t, (y, off) in heads.items()]
    body = f"""
zz AS (SELECT row_id, x, a, b, {', '.join(zs)} FROM emb),
pp AS (SELECT zz.row_id, x, {', '.join(f'y_{t}, p_{t}, l_{t}' for t in heads)} FROM zz
       {' '.join(f'JOIN ({s} FROM zz) q_{t} USING (row_id)' for t, s in zip(heads, sel))}),
ex AS (SELECT pp.*, unnest(list_concat(list_transform(x, lambda v: CAST(v AS DOUBLE)), [1.0])) AS xv,
              CAST(generate_subscripts(list_concat(x, [1.0]), 1) - 1 AS INTEGER) AS pos FROM pp)"""
    for t in heads:
        for c in range(2):
            parts.append(f"SELECT '{t}' AS task, {c} AS class, pos, round(sum((p_{t}[{c + 1}] - CAST(y_{t} = {c} AS DOUBLE)) * xv), 9) AS value FROM ex GROUP BY pos")
        parts.append(f"SELECT '{t}' AS task, -1 AS class, 0 AS pos, round(sum(l_{t}), 9) AS value FROM pp")
        parts.append(f"SELECT '{t}' AS task, -1 AS class, 1 AS pos, CAST(count(*) AS DOUBLE) AS value FROM pp")
    return "WITH " + EMB_SQL + "," + body + "\n" + "\nUNION ALL\n".join(parts)


def _grad_table(spark, sf_dir, names=("a", "b")):
    h = _formula_heads()
    heads = {names[0]: h["a"], names[1]: h["b"]}
    g = trn.gradient_table(_emb(spark, sf_dir), heads, {names[0]: "a", names[1]: "b"}, "x")
    return g.select("task", "class", "pos", F.round("value", 9).alias("value"))


@register("batch_gradient", _grad_sql({"a": ("a", 0), "b": ("b", 2)}))
def q_batch_gradient(spark, sf_dir):
    return _grad_table(spark, sf_dir)


_PARTIAL = _grad_sql({"a": ("a", 0), "b": ("b", 2)}).replace(
    "AS l_b FROM zz", "AS l_b FROM zz WHERE row_id % 3 <> 0").replace("JOIN (\n  SELECT row_id, b", "LEFT JOIN (\n  SELECT row_id, b").replace(
    "SELECT 'b' AS task, -1 AS class, 1 AS pos, CAST(count(*)", "SELECT 'b' AS task, -1 AS class, 1 AS pos, CAST(count(y_b)")


@register("batch_gradient_partial", _PARTIAL)
def q_batch_gradient_partial(spark, sf_dir):
    """As ``batch_gradient`` with every third row unlabelled for task ``b``: the rows still count for task ``a``."""
    emb = _emb(spark, sf_dir).withColumn("b", F.when(F.col("row_id") % 3 != 0, F.col("b")))
    g = trn.gradient_table(emb, _formula_heads(), {"a": "a", "b": "b"}, "x")
    return g.select("task", "class", "pos", F.round("value", 9).alias("value"))


@register("param_group_filter", "SELECT * FROM (" + _grad_sql({"taska": ("a", 0), "taskb": ("b", 2)})
          + ") WHERE NOT contains(task, 'taskb')")
def q_param_group_filter(spark, sf_dir):
    return trn.param_group_filter(_grad_table(spark, sf_dir, ("taska", "taskb")), "taskb")


@register("min_norm_weights", f"""
WITH {FEAT_SQL},
ex2 AS (SELECT quality, toxic, unnest(x) AS v, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM feat),
g AS (SELECT pos, sum((quality - 0.5) * v) / count(*) AS ga, sum((toxic - 0.5) * v) / count(*) AS gb FROM ex2 GROUP BY pos),
dots AS (SELECT 2 * sum(ga * ga) AS gaa, 2 * sum(ga * gb) AS gab, 2 * sum(gb * gb) AS gbb FROM g)
SELECT round(gaa, 9) AS gaa, round(gab, 9) AS gab, round(gbb, 9) AS gbb,
       round(CASE WHEN gaa - 2 * gab + gbb <= 0 THEN 0.5 ELSE least(1.0, greatest(0.0, (gbb - gab) / (gaa - 2 * gab + gbb))) END, 9) AS weight_a
FROM dots
""")
def q_min_norm_weights(spark, sf_dir):
    """Min-norm task weights from mean gradients of both tasks at zero
    weights (three text features, biases excluded), all in Spark."""
    feats = _features(spark, sf_dir)
    zero = {"quality": trn.Head(np.zeros((2, 3)), np.zeros(2)), "toxic": trn.Head(np.zeros((2, 3)), np.zeros(2))}
    g = trn.gradient_table(feats, zero, {"quality": "quality", "toxic": "toxic"}, "x", method="explode")
    dots = trn.gradient_dots(g, "quality", "toxic", 3)
    weight = trn.min_norm_weight(F.col("gaa"), F.col("gab"), F.col("gbb"))
    return dots.select(*[F.round(c, 9).alias(c) for c in ("gaa", "gab", "gbb")], F.round(weight, 9).alias("weight_a"))


def _unrolled_fit_sql(steps: int = 3, lr: float = 0.5) -> str:
    """Plain gradient descent on two-class softmax over the three text
    features plus a bias, unrolled ``steps`` times as CTEs."""
    names = [f"w_{c}_{j}" for c in range(2) for j in range(4)]
    ctes = [FEAT_SQL.strip(), "w0 AS (SELECT " + ", ".join(f"CAST(0.0 AS DOUBLE) AS {n}" for n in names) + ")"]
    for k in range(1, steps + 1):
        z = [f"x[1] * w.w_{c}_0 + x[2] * w.w_{c}_1 + x[3] * w.w_{c}_2 + w.w_{c}_3" for c in range(2)]
        ctes.append(f"""r{k} AS (
  SELECT quality AS y, x, z0, z1, greatest(z0, z1) AS m FROM (SELECT quality, x, {z[0]} AS z0, {z[1]} AS z1 FROM feat, w{k - 1} w))""")
        ctes.append(f"""p{k} AS (
  SELECT y, x, exp(z0 - m) / (exp(z0 - m) + exp(z1 - m)) AS p0, exp(z1 - m) / (exp(z0 - m) + exp(z1 - m)) AS p1,
         m + ln(exp(z0 - m) + exp(z1 - m)) - CASE WHEN y = 0 THEN z0 ELSE z1 END AS loss FROM r{k})""")
        grads = []
        for c in range(2):
            for j in range(4):
                xv = f"x[{j + 1}]" if j < 3 else "1.0"
                grads.append(f"sum((p{c} - CAST(y = {c} AS DOUBLE)) * {xv}) / count(*) AS g_{c}_{j}")
        ctes.append(f"g{k} AS (SELECT {', '.join(grads)}, sum(loss) / count(*) AS loss FROM p{k})")
        upd = ", ".join(f"w.{n} - {lr} * g.g_{n[2:]} AS {n}" for n in names)
        ctes.append(f"w{k} AS (SELECT {upd}, g.loss AS loss FROM w{k - 1} w, g{k} g)")
    sel = "\nUNION ALL\n".join(
        f"SELECT {k} AS step, round(loss, 9) AS loss, [{', '.join(f'round({n}, 9)' for n in names)}] AS w FROM w{k}"
        for k in range(1, steps + 1))
    return "WITH " + ",\n".join(ctes) + "\n" + sel


@register("fit_single_task", _unrolled_fit_sql(3, 0.5))
def q_fit_single_task(spark, sf_dir):
    """Three full-batch plain gradient steps (rate 0.5, zero start, no
    clipping) of one softmax head on the text features of ``quality``."""
    feats = _features(spark, sf_dir)
    cfg = fp.RunConfig(tasks=("quality",), regime="STL", epochs=3, lr=0.5, optimizer="sgd", schedule=False, clip=None, init="zeros", keep_params=True)
    rows = []
    for h in fp.fit(feats, feats, {"quality": "quality"}, cfg).history:
        w = np.hstack([h["params"]["W"], h["params"]["b"][:, None]]).ravel()
        rows.append((h["epoch"] + 1, round(h["loss"], 9), [round(float(v), 9) for v in w]))
    return spark.createDataFrame(rows, "step int, loss double, w array<double>")


@register("score_batch", f"""
WITH {HEADS_SQL},
long AS (
  SELECT row_id, 'a' AS task, a AS y, za AS z FROM z UNION ALL SELECT row_id, 'b' AS task, b AS y, zb AS z FROM z)
SELECT row_id, task, y, {_r9_list('z')} AS logits, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred,
       round({LSE_SQL.format(z='z')} - z[y + 1], 9) AS loss
FROM long
""")
def q_score_batch(spark, sf_dir):
    s = trn.score_batch(_emb(spark, sf_dir), _formula_heads(), {"a": "a", "b": "b"}, "x")
    return s.select("row_id", "task", "y", _r9(F.col("logits")).alias("logits"), "pred", F.round("loss", 9).alias("loss"))


# --------------------------------------------------------------------------
# Reports and result files
# --------------------------------------------------------------------------

from labelwise.plans import fit as fp  # noqa: E402
from labelwise.sources import results as rs  # noqa: E402

MEASURES = ("TP", "TN", "FP", "FN", "F1", "BA", "AUC")
TASKS = ("quality", "toxic")


def _wide_sql(tasks=TASKS) -> str:
    cols = ", ".join(f"max({m}) FILTER (WHERE task = '{t}') AS {m}_{t}" for t in tasks for m in MEASURES)
    return f"""
m AS (
  SELECT task, {F1_SQL} AS F1, {BA_SQL} AS BA, {AUC_SQL} AS AUC, TP, TN, FP, FN
  FROM (SELECT task, {COUNTS_SQL} FROM preds GROUP BY task)),
wide AS (SELECT 0 AS epoch, {cols} FROM m)"""


def _tags_sql(run: int = 0, regime: str = "MTL", data: bool = True) -> str:
    d = "'documents' AS data, " if data else ""
    return (f"'rules' AS model, {run} AS run, CAST(0.001 AS DOUBLE) AS lr, 32 AS batch_size, {d}"
            f"'all' AS question, '{regime}' AS training")


def _stand_in_report(spark, sf_dir, tasks=TASKS, run=0, regime="MTL", data=True):
    preds = _stand_in(spark, sf_dir).where(F.col("task").isin(*tasks))
    metrics = ev.multi_task_eval(preds).withColumn("epoch", F.lit(0))
    wide = ev.epoch_report(metrics, tasks, index=["epoch"], measures=MEASURES)
    cfg = fp.RunConfig(model="rules", tasks=tasks, regime=regime, lr=0.001, batch_size=32, run=run,
                       data="documents", question="all")
    tagged = fp.tag_run(wide, cfg)
    return tagged if data else tagged.drop("data")


@register("epoch_report", f"WITH {PRED_SQL}, {_wide_sql()} SELECT * FROM wide")
def q_epoch_report(spark, sf_dir):
    metrics = ev.multi_task_eval(_stand_in(spark, sf_dir)).withColumn("epoch", F.lit(0))
    return ev.epoch_report(metrics, TASKS, index=["epoch"], measures=MEASURES)


@register("tag_run", f"WITH {PRED_SQL}, {_wide_sql()} SELECT wide.*, {_tags_sql()} FROM wide")
def q_tag_run(spark, sf_dir):
    return _stand_in_report(spark, sf_dir)


@register("align_pred_truth", f"""
WITH {EX_SQL},
truth AS (SELECT row_id, 'quality' AS task, quality AS y FROM ex UNION ALL SELECT row_id, 'toxic' AS task, toxic AS y FROM ex),
pred AS (
  SELECT row_id, 'quality' AS task, CAST(n_chars >= 500 AS INTEGER) AS pred FROM ex
  UNION ALL
  SELECT row_id, 'toxic' AS task,
         CAST(strpos(lower(text), 'worthless') > 0 OR strpos(lower(text), 'stupid') > 0 AS INTEGER) AS pred FROM ex)
SELECT pred.row_id, pred.task, pred.pred, truth.y FROM pred JOIN truth ON pred.row_id = truth.row_id AND pred.task = truth.task
""")
def q_align_pred_truth(spark, sf_dir):
    s = _stand_in(spark, sf_dir)
    return ev.align_pred_truth(s.select("row_id", "task", "pred"), s.select("row_id", "task", "y"))


_MIXED_SQL = f"""
WITH {PRED_SQL}, {_wide_sql()},
single AS (SELECT {', '.join(f'{m}_toxic' for m in MEASURES)}, epoch, {_tags_sql(regime='STL')} FROM wide),
multi AS (SELECT wide.*, {_tags_sql()} FROM wide)
SELECT * FROM multi UNION ALL BY NAME SELECT * FROM single UNION ALL BY NAME SELECT * FROM multi"""


@register("append_results", _MIXED_SQL)
def q_append_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    return rs.read_results(spark, _append_mixed(spark, sf_dir, path, "parquet"))


def _append_mixed(spark, sf_dir, path, fmt):
    """Two-task, one-task and again two-task reports appended to one path."""
    multi = _stand_in_report(spark, sf_dir)
    single = _stand_in_report(spark, sf_dir, tasks=("toxic",), regime="STL")
    for rep in (multi, single, multi):
        rs.append_results(rep, path, fmt)
    return path


@register("replace_runs", f"""
WITH {PRED_SQL}, {_wide_sql()},
multi AS (SELECT wide.*, {_tags_sql()} FROM wide),
single AS (SELECT {', '.join(f'{m}_toxic' for m in MEASURES)}, epoch, {_tags_sql(regime='STL')} FROM wide)
SELECT * FROM multi UNION ALL BY NAME SELECT * FROM single""")
def q_replace_runs(spark, sf_dir):
    """Two runs stored, the first of them again: each is there once."""
    path = scratch_path(spark, "runs")
    for tasks, regime in ((TASKS, "MTL"), (("toxic",), "STL"), (TASKS, "MTL")):
        rs.replace_runs(_stand_in_report(spark, sf_dir, tasks=tasks, regime=regime), path)
    return rs.read_results(spark, path)


@register("read_results_csv", _MIXED_SQL)
def q_read_results_csv(spark, sf_dir):
    return rs.read_results_csv(spark, _append_mixed(spark, sf_dir, scratch_path(spark, "results-csv"), "csv"))


@register("union_results", f"""
WITH {PRED_SQL}, {_wide_sql()},
single AS (SELECT {', '.join(f'{m}_quality' for m in MEASURES)}, epoch, {_tags_sql(regime='STL', data=False)} FROM wide),
multi AS (SELECT wide.*, {_tags_sql()} FROM wide)
SELECT * FROM single UNION ALL BY NAME SELECT * FROM multi
""")
def q_union_results(spark, sf_dir):
    single = _stand_in_report(spark, sf_dir, tasks=("quality",), regime="STL", data=False)
    multi = _stand_in_report(spark, sf_dir)
    return rs.union_results([single, multi])


@register("append_runs", f"""
WITH {PRED_SQL}, {_wide_sql()}
SELECT wide.*, {_tags_sql(run=0)} FROM wide UNION ALL SELECT wide.*, {_tags_sql(run=1)} FROM wide
""")
def q_append_runs(spark, sf_dir):
    return rs.append_runs([_stand_in_report(spark, sf_dir, run=0), _stand_in_report(spark, sf_dir, run=1)])


# --------------------------------------------------------------------------
# Encoder plug-in
# --------------------------------------------------------------------------

from labelwise.operators import encoders as encs  # noqa: E402

BOW_DIM = 32


@register("apply_encoder", TOK_SQL.replace("toks AS (", "toks AS (", 1).join(["WITH ", ""]) + f""",
bk AS (SELECT row_id, t, list_transform(t, lambda tok: CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {BOW_DIM}) AS bs FROM toks)
SELECT row_id, list_transform(range(0, {BOW_DIM}),
         lambda k: CASE WHEN len(t) = 0 THEN 0.0 ELSE CAST(len(list_filter(bs, lambda bb: bb = k)) AS DOUBLE) / len(t) END) AS x
FROM bk
""")
def q_apply_encoder(spark, sf_dir):
    from labelwise.functions.text import tokens
    docs = _docs(spark, sf_dir).select("row_id", tokens("text").alias("tokens"))
    return encs.apply_encoder(docs, encs.hashed_bag_of_words(BOW_DIM), "tokens", "x")


# --------------------------------------------------------------------------
# Training runs (T4-T7, T12, T13): iterative, checked by row count
# --------------------------------------------------------------------------

LABELS = {"quality": "quality", "toxic": "toxic"}


def _run(spark, sf_dir, regime, tasks=TASKS, epochs=2, **kw):
    cfg = fp.RunConfig(tasks=tasks, regime=regime, epochs=epochs, lr=0.01, **kw)
    if regime == "MTL_meta":
        parts = smp.support_query_test(_features(spark, sf_dir), "row_id")
        return fp.fit_tagged(parts, LABELS, cfg, split_col="part", train_value="support")
    return fp.fit_tagged(smp.train_test_tag(_features(spark, sf_dir), "row_id"), LABELS, cfg)


@register("fit_multi_task")
def q_fit_multi_task(spark, sf_dir):
    """Two full-batch epochs of the summed multi-task regime (AdamW, rate
    0.01, clipping); losses rounded to 9 places for the SQL check."""
    return _rounded_losses(_run(spark, sf_dir, "MTL").report)


@register("fit_weighted_tasks")
def q_fit_weighted_tasks(spark, sf_dir):
    """As ``fit_multi_task`` with learned uncertainty task weights."""
    return _rounded_losses(_run(spark, sf_dir, "MTL_awl").report)


@register("fit_meta_weights")
def q_fit_meta_weights(spark, sf_dir):
    res = _run(spark, sf_dir, "MTL_meta")
    w = spark.createDataFrame([(r["epoch"], round(float(r["quality"]), 9), round(float(r["toxic"]), 9))
                               for r in res.task_weights], "epoch int, w_quality double, w_toxic double")
    return _rounded_losses(res.report).join(w, "epoch")


@register("fit_meta_batches")
def q_fit_meta_batches(spark, sf_dir):
    """The gradient-alignment regime in mini-batches, gradients accumulating over an epoch's support and query batches;
    no SQL form, checked against a step-by-step numpy run."""
    parts = smp.support_query_test(_emb(spark, sf_dir), "row_id")
    cfg = fp.RunConfig(model="embedding", tasks=("a", "b"), regime="MTL_meta", epochs=2, lr=0.01, batch_size=32, data="embeddings",
                       accumulate=True, faithful_difference=True)
    res = fp.fit_tagged(parts, {"a": "a", "b": "b"}, cfg, split_col="part", train_value="support")
    return spark.createDataFrame([(r["epoch"], *(round(float(r[k]), 9) for k in ("a", "b", "query_loss"))) for r in res.task_weights],
                                 "epoch int, w_a double, w_b double, query_loss double")


@register("epoch_loop")
def q_epoch_loop(spark, sf_dir):
    """Mini-batch epochs (batch 32) of the summed multi-task regime on the
    fixed ``embeddings`` features."""
    emb = _emb(spark, sf_dir)
    tagged = smp.train_test_tag(emb, "row_id")
    cfg = fp.RunConfig(model="embedding", tasks=("a", "b"), regime="MTL", epochs=2, lr=0.01, batch_size=32,
                       data="embeddings")
    return _rounded_losses(fp.fit_tagged(tagged, {"a": "a", "b": "b"}, cfg).report)


@register("run_grid")
def q_run_grid(spark, sf_dir):
    """Single-task runs of each task and a multi-task run, one table by name.

    The tagged features are cached once for the whole grid; every run's
    report is collected inside ``fit``, so the cache is released after."""
    tagged = smp.train_test_tag(_features(spark, sf_dir), "row_id").persist()
    try:
        train, test = tagged.where(F.col("split") == "train"), tagged.where(F.col("split") == "test")
        configs = [fp.RunConfig(tasks=("quality",), regime="STL", epochs=2, lr=0.01),
                   fp.RunConfig(tasks=("toxic",), regime="STL", epochs=2, lr=0.01),
                   fp.RunConfig(tasks=TASKS, regime="MTL", epochs=2, lr=0.01)]
        grid = fp.run_grid(configs, lambda cfg: (train, test, LABELS))
    finally:
        tagged.unpersist()
    return _rounded_losses(grid)


_TASK_GRADIENTS_SQL = f"""
WITH {FEAT_SQL},
U AS (SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, CAST(((7 * j + 3 * k) % 11) - 5 AS DOUBLE) / 10 / sqrt(3) AS v
      FROM range(0, 8) t1(k), range(0, 3) t2(j)),
A AS (SELECT t, CAST(c AS INTEGER) AS c, CAST(k AS INTEGER) AS k,
             CAST(((7 * k + 3 * (c + off)) % 11) - 5 AS DOUBLE) / 10 / sqrt(8) AS v
      FROM (VALUES ('quality', 7), ('toxic', 14)) tt(t, off), range(0, 2) t1(c), range(0, 8) t2(k)),
W AS (SELECT A.t, A.c, U.j, sum(A.v * U.v) AS w FROM A JOIN U ON A.k = U.k GROUP BY A.t, A.c, U.j),
Z AS (SELECT f.row_id, W.t, W.c, sum(f.x[W.j + 1] * W.w) AS z FROM feat f, W GROUP BY f.row_id, W.t, W.c),
Z2 AS (SELECT *, max(z) OVER (PARTITION BY row_id, t) AS m FROM Z),
P AS (SELECT row_id, t, c, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row_id, t) AS p FROM Z2),
D AS (SELECT P.t, P.c, f.x,
             P.p - CAST((CASE WHEN P.t = 'quality' THEN f.quality ELSE f.toxic END) = P.c AS DOUBLE) AS delta
      FROM P JOIN feat f ON P.row_id = f.row_id),
G AS (SELECT t, c, CAST(j AS INTEGER) AS j, sum(delta * CASE WHEN j < 3 THEN x[j + 1] ELSE 1.0 END) / count(*) AS g
      FROM D, range(0, 4) r(j) GROUP BY t, c, j),
params AS (
  SELECT 'shared' AS grp, A.k AS i, G.j AS j, sum(A.v * G.g) AS value FROM G JOIN A ON G.t = A.t AND G.c = A.c GROUP BY A.k, G.j
  UNION ALL
  SELECT 'head_' || G.t AS grp, G.c AS i, U.k AS j, sum(G.g * U.v) AS value FROM G JOIN U ON G.j = U.j GROUP BY G.t, G.c, U.k
  UNION ALL
  SELECT 'head_' || t AS grp, c AS i, 8 AS j, g AS value FROM G WHERE j = 3)
SELECT tk.task, p.grp, p.i, p.j, round(p.value, 9) AS value
FROM params p JOIN (VALUES ('quality'), ('toxic')) tk(task) ON p.grp = 'shared' OR p.grp = 'head_' || tk.task
"""


@register("task_gradients", _TASK_GRADIENTS_SQL)
def q_task_gradients(spark, sf_dir):
    """Per-task gradients (shared layer and own head, the other head
    excluded) of the multi-task model at its start: one distributed gradient
    pass, then the chain rule as joins with the parameter tables."""
    feats = _features(spark, sf_dir)
    model = trn.LinearModel.create(TASKS, 2, 3, hidden=8)
    g = trn.gradient_table(feats, model.heads(), LABELS, "x")
    vec = trn.task_vectors(trn.param_gradient_table(g, model), TASKS)
    return vec.select("task", "grp", "i", "j", F.round("value", 9).alias("value"))


@register("task_gradients_own", _TASK_GRADIENTS_SQL.replace(
    "SELECT 'shared' AS grp, A.k", "SELECT 'shared_' || G.t AS grp, A.k").replace("GROUP BY A.k, G.j", "GROUP BY G.t, A.k, G.j").replace(
    "p.grp = 'shared' OR", "p.grp = 'shared_' || tk.task OR"))
def q_task_gradients_own(spark, sf_dir):
    """As ``task_gradients`` with the shared layer's gradient of each task's own loss instead of the summed one."""
    feats = _features(spark, sf_dir)
    model = trn.LinearModel.create(TASKS, 2, 3, hidden=8)
    g = trn.gradient_table(feats, model.heads(), LABELS, "x")
    vec = trn.task_vectors(trn.param_gradient_table(g, model, per_task_shared=True), TASKS)
    return vec.select("task", "grp", "i", "j", F.round("value", 9).alias("value"))


# --------------------------------------------------------------------------
# Sparse features, epochs without a new sort, more than two tasks
# --------------------------------------------------------------------------

from labelwise.operators import sparse as sp  # noqa: E402

BITS = 18
SPARSE_SQL = TOK_SQL.split("flat AS (")[0].rstrip().rstrip(",") + f""",
words_of AS (SELECT row_id, unnest(t) AS w FROM toks),
cells AS (SELECT row_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {1 << BITS} AS INTEGER) AS pos, CAST(count(*) AS DOUBLE) AS v
  FROM words_of GROUP BY ALL)"""


def _sparse_docs(spark, sf_dir):
    return sp.hashed_counts(_docs(spark, sf_dir), "text", BITS)


@register("sparse_features", f"WITH {SPARSE_SQL} SELECT row_id, pos, v AS value FROM cells")
def q_sparse_features(spark, sf_dir):
    """Counts of hashed words in 2**18 positions, one row per position that a text touches."""
    pairs = F.arrays_zip(F.col("idx").alias("pos"), F.col("val").alias("value"))
    return _sparse_docs(spark, sf_dir).select("row_id", F.inline(pairs))


def _sparse_head(offset: int) -> trn.Head:
    pos = np.arange(1 << BITS, dtype=np.int64)
    return trn.Head(np.stack([((7 * pos + 3 * (c + offset)) % 11 - 5) / 100.0 for c in range(2)]), np.array([0.1, -0.1]))


@register("sparse_gradient", f"""
WITH {SPARSE_SQL},
heads(task, c, off, bias) AS (VALUES ('quality', 0, 0, 0.1::DOUBLE), ('quality', 1, 0, -0.1::DOUBLE), ('toxic', 0, 2, 0.1::DOUBLE), ('toxic', 1, 2, -0.1::DOUBLE)),
labelled AS (SELECT l.doc_id AS row_id, 'quality' AS task, l.quality AS y FROM labels l JOIN toks t ON t.row_id = l.doc_id
  UNION ALL SELECT l.doc_id, 'toxic', l.toxic FROM labels l JOIN toks t ON t.row_id = l.doc_id),
dots AS (SELECT row_id, task, c, sum(v * (((7 * CAST(pos AS BIGINT) + 3 * (c + off)) % 11) - 5) / 100.0::DOUBLE) AS z FROM cells, heads GROUP BY ALL),
z AS (SELECT l.row_id, l.task, l.y, h.c, coalesce(d.z, 0) + h.bias AS z FROM labelled l JOIN heads h ON h.task = l.task
  LEFT JOIN dots d ON d.row_id = l.row_id AND d.task = l.task AND d.c = h.c),
p AS (SELECT *, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row_id, task) AS p, m + ln(sum(exp(z - m)) OVER (PARTITION BY row_id, task)) AS lse
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id, task) AS m FROM z)),
res AS (SELECT row_id, task, c, p - CAST(y = c AS DOUBLE) AS d, CASE WHEN y = c THEN lse - z END AS loss FROM p)
SELECT task, CAST(c AS INTEGER) AS class, pos, round(sum(d * v), 6) AS value FROM res JOIN cells USING (row_id) GROUP BY task, c, pos
UNION ALL SELECT task, CAST(c AS INTEGER), {1 << BITS}, round(sum(d), 6) FROM res GROUP BY task, c
UNION ALL SELECT task, -1, 0, round(sum(loss), 6) FROM res GROUP BY task
UNION ALL SELECT task, -1, 1, CAST(count(loss) AS DOUBLE) FROM res GROUP BY task
""")
def q_sparse_gradient(spark, sf_dir):
    """One gradient pass of two heads over 2**18 sparse positions: touched positions only."""
    labels = tb.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    rows = _sparse_docs(spark, sf_dir).join(labels, "row_id")
    g = sp.sparse_gradient_table(rows, {"quality": _sparse_head(0), "toxic": _sparse_head(2)}, LABELS)
    return g.select("task", "class", "pos", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _permuted_sql(epochs: int = 3, batch: int = 32, seed: int = 42) -> str:
    """The permutation as integer SQL: rounds as nested selects, walks as recursion."""
    def mixed(v: str, r: int) -> str:
        first = f"((({v} + CAST('0x' || substr(md5('{seed}:' || epoch || ':{r}'), 1, 7) AS BIGINT)) * 1103515245 + 12345) % 2147483647)"
        return f"((xor({first}, {first} >> 15) * 48271) % 2147483647)"

    def rounds(source: str) -> str:
        q = f"SELECT row_id, epoch, n, a, b, p // b AS l, p % b AS r FROM {source}"
        for r in range(smp.ROUNDS):
            new = f"(l + {mixed('r', r)}) % a AS l, r" if r % 2 == 0 else f"l, (r + {mixed('l', r)}) % b AS r"
            q = f"SELECT row_id, epoch, n, a, b, {new} FROM ({q})"
        return f"SELECT row_id, epoch, n, a, b, l * b + r AS p FROM ({q})"

    return f"""
WITH RECURSIVE sized AS (SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM embeddings))),
start AS (SELECT row_id, e.epoch, n, a, b, row_number() OVER (PARTITION BY e.epoch ORDER BY row_id) - 1 AS p
  FROM (SELECT vec_id AS row_id FROM embeddings), range({epochs}) e(epoch), sized),
walk AS (SELECT * FROM ({rounds('start')}) UNION ALL SELECT * FROM ({rounds('(SELECT * FROM walk WHERE p >= n)')}))
SELECT CAST(epoch AS INTEGER) AS epoch, row_id, p AS position, CAST(p // {batch} AS BIGINT) AS batch_id FROM walk WHERE p < n"""


@register("permuted_batches", _permuted_sql())
def q_permuted_batches(spark, sf_dir):
    """Three epochs of batches of 32 from rows that are ranked once: a keyed permutation instead of a sort per epoch."""
    ranked = smp.global_rank(tb.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id")), ["row_id"])
    n = sum(ranked._labelwise_counts)
    out = None
    for epoch in range(3):
        placed = smp.permuted_batches(ranked, n, 32, 42, epoch).select(F.lit(epoch).alias("epoch"), "row_id", "position", "batch_id")
        out = placed if out is None else out.unionByName(placed)
    return out


@register("min_norm_three_tasks", """
WITH rows_of AS (SELECT [CAST(embedding[i] AS DOUBLE) for i in range(1, 9)] AS x, label FROM embeddings),
flat AS (SELECT unnest(range(0, 8)) AS pos, unnest(x) AS v, label FROM rows_of),
g AS (SELECT t.task, pos, c.c, sum((0.5 - CAST((CASE t.task WHEN 'a' THEN label % 2 WHEN 'b' THEN CAST(label >= 5 AS INTEGER) ELSE CAST(label % 3 = 0 AS INTEGER) END) = c.c AS DOUBLE)) * v) / count(*) AS g
  FROM flat, (VALUES ('a'), ('b'), ('c')) t(task), (VALUES (0), (1)) c(c) GROUP BY ALL),
m AS (SELECT x.task || y.task AS k, sum(x.g * y.g) AS d FROM g x JOIN g y USING (pos, c) GROUP BY ALL),
v AS (SELECT max(d) FILTER (k = 'aa') AS aa, max(d) FILTER (k = 'ab') AS ab, max(d) FILTER (k = 'ac') AS ac, max(d) FILTER (k = 'bb') AS bb,
  max(d) FILTER (k = 'bc') AS bc, max(d) FILTER (k = 'cc') AS cc FROM m),
inner3 AS (SELECT *, aa - 2 * ac + cc AS p, ab - ac - bc + cc AS q, bb - 2 * bc + cc AS r, cc - ac AS s, cc - bc AS t FROM v),
tried AS (
  SELECT *, unnest([{a: 1.0::DOUBLE, b: 0.0::DOUBLE}, {a: 0.0, b: 1.0}, {a: 0.0, b: 0.0}, {a: (bb - ab) / (aa - 2 * ab + bb), b: 1 - (bb - ab) / (aa - 2 * ab + bb)},
    {a: (cc - ac) / (aa - 2 * ac + cc), b: 0.0}, {a: 0.0, b: (cc - bc) / (bb - 2 * bc + cc)}, {a: (s * r - t * q) / (p * r - q * q), b: (p * t - q * s) / (p * r - q * q)}]) AS w FROM inner3),
valued AS (SELECT w.a AS wa, w.b AS wb, 1 - w.a - w.b AS wc, w.a * w.a * aa + w.b * w.b * bb + (1 - w.a - w.b) ** 2 * cc
    + 2 * (w.a * w.b * ab + w.a * (1 - w.a - w.b) * ac + w.b * (1 - w.a - w.b) * bc) AS norm FROM tried WHERE least(w.a, w.b, 1 - w.a - w.b) >= -1e-12),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (ORDER BY norm) = 1)
SELECT task, round(w, 6) + 0.0 AS weight FROM (SELECT unnest(['a', 'b', 'c']) AS task, unnest([wa, wb, wc]) AS w FROM best)
""")
def q_min_norm_three_tasks(spark, sf_dir):
    """Least-norm weights of three tasks from their mean gradients at zero weights: products in Spark, K x K numbers solved for."""
    emb = tb.read_table(spark, sf_dir, "embeddings").select(
        as_small("embedding", 8).alias("x"), (F.col("label") % 2).cast("int").alias("a"), (F.col("label") >= 5).cast("int").alias("b"), (F.col("label") % 3 == 0).cast("int").alias("c"))
    tasks = ["a", "b", "c"]
    g = trn.gradient_table(emb, {t: trn.Head(np.zeros((2, 8)), np.zeros(2)) for t in tasks}, {t: t for t in tasks}, "x")
    weights = trn.min_norm_point(trn.gram_matrix(trn.gradient_gram(g, tasks, 8), tasks))
    return spark.createDataFrame([(t, round(float(w), 6)) for t, w in zip(tasks, weights)], "task string, weight double")


def as_small(x: str, d: int):
    """The first ``d`` features as doubles."""
    return trn.as_double_array(F.slice(x, 1, d))


# --------------------------------------------------------------------------
# Multi-task fit checked by SQL: two full-batch AdamW epochs, unrolled
# --------------------------------------------------------------------------

def _dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _unrolled_run_sql(regime: str = "MTL", tasks=TASKS, epochs: int = 2, lr: float = 0.01, hidden: int = 8) -> str:
    """Oracle of a full-batch training run on the text features.

    STL: one head ``W (2 x 3) + b`` (formula start / sqrt(3), zero bias).
    MTL / MTL_awl: shared projection ``U (hidden x 3) + u`` and heads
    ``A_t (2 x hidden) + a_t`` (formula starts / sqrt(fan-in), zero biases);
    MTL_awl adds one uncertainty parameter per task (start 1).  Each epoch is
    one step: forward, mean cross-entropy gradients, chain rule, joint norm
    clip at 1 (model parameters only), AdamW (0.9, 0.999, eps 2e-8; 1e-6 with learned weights) with the
    rate decaying linearly to zero; then evaluation on the test split.
    """
    tasks = list(tasks)
    b1, b2 = _dbl(0.9), _dbl(0.999)
    tv = ", ".join(f"('{t}')" for t in tasks)
    offs = ", ".join(f"('{t}', {7 * (i + 1)})" for i, t in enumerate(tasks))
    longs = lambda part: "\n  UNION ALL ".join(
        f"SELECT row_id, '{t}' AS t, {t} AS y, x FROM split WHERE part = '{part}'" for t in tasks)
    meta = regime == "MTL_meta"
    if meta:
        bucket = "CAST(('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10"
        part = f"CASE WHEN {bucket} < 6 THEN 'support' WHEN {bucket} < 8 THEN 'query' ELSE 'test' END"
        ctes = [FEAT_SQL.strip(), f"split AS (SELECT *, {part} AS part FROM feat)",
                f"tr_long AS (\n  {longs('support')})", f"q_long AS (\n  {longs('query')})",
                f"te_long AS (\n  {longs('test')})",
                f"WK0 AS (SELECT t, 1.0 AS w FROM (VALUES {tv}) tt(t))"]
    else:
        ctes = [FEAT_SQL.strip(),
                f"split AS (SELECT *, {SPLIT_SQL.format(id='row_id')} AS part FROM feat)",
                f"tr_long AS (\n  {longs('train')})",
                f"te_long AS (\n  {longs('test')})"]
    if regime == "STL":
        t0 = tasks[0]
        ctes.append(f"""P0 AS (
  SELECT 'W' AS name, CAST(c AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
         CAST(((7 * j + 3 * c) % 11) - 5 AS DOUBLE) / 10 / sqrt(3) AS value, 0.0 AS m, 0.0 AS v
  FROM range(0, 2) a(c), range(0, 3) b(j)
  UNION ALL SELECT 'b', CAST(c AS INTEGER), 0, 0.0, 0.0, 0.0 FROM range(0, 2) a(c))""")
    else:
        awl = "" if regime != "MTL_awl" else f"\n  UNION ALL SELECT 's_' || t, 0, 0, 1.0, 0.0, 0.0 FROM (VALUES {tv}) tt(t)"
        ctes.append(f"""P0 AS (
  SELECT 'U' AS name, CAST(k AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
         CAST(((7 * j + 3 * k) % 11) - 5 AS DOUBLE) / 10 / sqrt(3) AS value, 0.0 AS m, 0.0 AS v
  FROM range(0, {hidden}) a(k), range(0, 3) b(j)
  UNION ALL SELECT 'u', CAST(k AS INTEGER), 0, 0.0, 0.0, 0.0 FROM range(0, {hidden}) a(k)
  UNION ALL SELECT 'A_' || t, CAST(c AS INTEGER), CAST(k AS INTEGER),
         CAST(((7 * k + 3 * (c + off)) % 11) - 5 AS DOUBLE) / 10 / sqrt({hidden}), 0.0, 0.0
  FROM (VALUES {offs}) tt(t, off), range(0, 2) a(c), range(0, {hidden}) b(k)
  UNION ALL SELECT 'a_' || t, CAST(c AS INTEGER), 0, 0.0, 0.0, 0.0
  FROM (VALUES {tv}) tt(t), range(0, 2) a(c){awl})""")

    def heads(s: int) -> list[str]:
        p = f"P{s}"
        if regime == "STL":
            return [f"""H{s} AS (SELECT '{tasks[0]}' AS t, i AS c, j, value AS w FROM {p} WHERE name = 'W'
  UNION ALL SELECT '{tasks[0]}', i, 3, value FROM {p} WHERE name = 'b')"""]
        return [
            f"""UA{s} AS (SELECT i AS k, j, value FROM {p} WHERE name = 'U'
  UNION ALL SELECT i AS k, 3 AS j, value FROM {p} WHERE name = 'u')""",
            f"""W{s} AS (
  SELECT substr(A.name, 3) AS t, A.i AS c, U.j, sum(A.value * U.value) AS w
  FROM {p} A JOIN UA{s} U ON left(A.name, 2) = 'A_' AND A.j = U.k GROUP BY 1, 2, 3)""",
            f"""H{s} AS (
  SELECT W.t, W.c, W.j, CASE WHEN W.j = 3 THEN W.w + a.value ELSE W.w END AS w
  FROM W{s} W JOIN {p} a ON a.name = 'a_' || W.t AND a.i = W.c)"""]

    def lam(s: int, evaluating: bool = False) -> str:
        if meta and not evaluating:
            return f"SELECT t, w / {len(tasks)} AS lam FROM WK{s}"
        if regime == "MTL_awl":
            return f"SELECT substr(name, 3) AS t, 1.0 / (2 * value * value) AS lam FROM P{s} WHERE left(name, 2) = 's_'"
        return f"SELECT t, 1.0 AS lam FROM (VALUES {tv}) tt(t)"

    def reg(s: int) -> str:
        if regime == "MTL_awl":
            return f"(SELECT sum(ln(1 + value * value)) FROM P{s} WHERE left(name, 2) = 's_')"
        return "0.0"

    def forward(s: int, rows: str, tag: str) -> list[str]:
        return [
            f"""Z{tag} AS (
  SELECT r.row_id, r.t, H.c, sum(CASE WHEN H.j < 3 THEN r.x[H.j + 1] * H.w ELSE 0.0 END)
         + max(CASE WHEN H.j = 3 THEN H.w END) AS z
  FROM {rows} r JOIN H{s} H ON r.t = H.t GROUP BY r.row_id, r.t, H.c)""",
            f"S{tag} AS (SELECT *, max(z) OVER (PARTITION BY row_id, t) AS mz FROM Z{tag})",
            f"E{tag} AS (SELECT *, sum(exp(z - mz)) OVER (PARTITION BY row_id, t) AS se FROM S{tag})",
            f"""R{tag} AS (
  SELECT E.row_id, E.t, E.c, r.y, r.x, E.z, E.mz, exp(E.z - E.mz) / E.se - CAST(r.y = E.c AS DOUBLE) AS delta,
         CASE WHEN r.y = E.c THEN E.mz + ln(E.se) - E.z END AS lossc
  FROM E{tag} E JOIN {rows} r ON r.row_id = E.row_id AND r.t = E.t)"""]

    def chain(name: str, grads: str, p: int) -> str:
        if regime == "STL":
            return f"""{name} AS (
  SELECT CASE WHEN j < 3 THEN 'W' ELSE 'b' END AS name, c AS i, CASE WHEN j < 3 THEN j ELSE 0 END AS j, g FROM {grads})"""
        return f"""{name} AS (
  SELECT CASE WHEN G.j < 3 THEN 'U' ELSE 'u' END AS name, A.j AS i, CASE WHEN G.j < 3 THEN G.j ELSE 0 END AS j,
         sum(A.value * G.g) AS g
  FROM {grads} G JOIN P{p} A ON A.name = 'A_' || G.t AND A.i = G.c GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'A_' || G.t, G.c, U.k, sum(G.g * U.value) FROM {grads} G JOIN UA{p} U ON U.j = G.j GROUP BY G.t, G.c, U.k
  UNION ALL
  SELECT 'a_' || t, c, 0, g FROM {grads} WHERE j = 3)"""

    ctes += heads(0)
    for s in range(1, epochs + 1):
        prev = s - 1
        ctes += forward(prev, "tr_long", f"tr{s}")
        ctes.append(f"L{s} AS (SELECT t, sum(lossc) / count(DISTINCT row_id) AS loss FROM Rtr{s} GROUP BY t)")
        ctes.append(f"LAM{s} AS ({lam(prev)})")
        ctes.append(f"""G{s} AS (
  SELECT R.t, R.c, CAST(j AS INTEGER) AS j,
         sum(R.delta * CASE WHEN j < 3 THEN R.x[j + 1] ELSE 1.0 END) / count(*) * max(LAM.lam) AS g
  FROM Rtr{s} R JOIN LAM{s} LAM ON R.t = LAM.t, range(0, 4) r(j) GROUP BY R.t, R.c, j)""")
        ctes.append(chain(f"D{s}", f"G{s}", prev))
        ctes.append(f"N{s} AS (SELECT 1.0 / (sqrt(sum(g * g)) + 1e-6) AS coef FROM D{s})")
        extra = ""
        if regime == "MTL_awl":
            extra = f"""
  UNION ALL
  SELECT 's_' || L.t, 0, 0, -L.loss / pow(P.value, 3) + 2 * P.value / (1 + P.value * P.value)
  FROM L{s} L JOIN P{prev} P ON P.name = 's_' || L.t"""
        ctes.append(f"""C{s} AS (SELECT D.name, D.i, D.j, CASE WHEN N.coef < 1 THEN D.g * N.coef ELSE D.g END AS g
  FROM D{s} D, N{s} N{extra})""")
        if regime == "MTL_awl":
            ctes.append(f"""T{s} AS (SELECT sum(L.loss / (2 * P.value * P.value) + ln(1 + P.value * P.value)) AS total
  FROM L{s} L JOIN P{prev} P ON P.name = 's_' || L.t)""")
        elif meta:
            ctes.append(f"T{s} AS (SELECT sum(LAM.lam * L.loss) AS total FROM L{s} L JOIN LAM{s} LAM ON L.t = LAM.t)")
        else:
            ctes.append(f"T{s} AS (SELECT sum(loss) AS total FROM L{s})")
        rate = f"({_dbl(lr)} * greatest(0.0, CAST({epochs} - {prev} AS DOUBLE) / {epochs}))"
        size = f"({rate} * sqrt(1 - pow({b2}, {s})) / (1 - pow({b1}, {s})))"
        ctes.append(f"""M{s} AS (
  SELECT P.name, P.i, P.j, P.value, P.m * {b1} + (1 - {b1}) * C.g AS m, P.v * {b2} + (1 - {b2}) * C.g * C.g AS v
  FROM P{prev} P JOIN C{s} C ON P.name = C.name AND P.i = C.i AND P.j = C.j)""")
        eps = trn.ADAM_EPS_DEFAULT if regime == "MTL_awl" else trn.ADAM_EPS
        ctes.append(f"P{s} AS (SELECT name, i, j, value - {size} * m / (sqrt(v) + {_dbl(eps)}) AS value, m, v FROM M{s})")
        ctes += heads(s)
        if meta:
            a, b = tasks[0], tasks[1]
            ctes += forward(s, "q_long", f"q{s}")
            ctes.append(f"""GQ{s} AS (
  SELECT t, c, CAST(j AS INTEGER) AS j, sum(delta * CASE WHEN j < 3 THEN x[j + 1] ELSE 1.0 END) / count(*) AS g
  FROM Rq{s}, range(0, 4) r(j) GROUP BY t, c, j)""")
            ctes.append(chain(f"DQ{s}", f"GQ{s}", s))
            ctes.append(f"NQ{s} AS (SELECT 1.0 / (sqrt(sum(g * g)) + 1e-6) AS coef FROM DQ{s})")
            ctes.append(f"""CQ{s} AS (SELECT D.name, D.i, D.j, CASE WHEN N.coef < 1 THEN D.g * N.coef ELSE D.g END AS g
  FROM DQ{s} D, NQ{s} N)""")
            ctes.append(f"""AL{s} AS (
  SELECT tt.t, sum(Q.g * (S.g / (WK.w / {len(tasks)}))) AS mt
  FROM (VALUES ('{a}', '{b}'), ('{b}', '{a}')) tt(t, o)
  JOIN C{s} S ON S.name NOT IN ('A_' || tt.o, 'a_' || tt.o)
  JOIN CQ{s} Q ON Q.name = S.name AND Q.i = S.i AND Q.j = S.j
  JOIN WK{prev} WK ON WK.t = tt.t
  GROUP BY tt.t)""")
            ctes.append(f"""MN{s} AS (
  SELECT CASE WHEN gaa - 2.0 * gab + gbb <= 0 THEN 0.5
              ELSE least(1.0, greatest(0.0, (gbb - gab) / (gaa - 2.0 * gab + gbb))) END AS gamma
  FROM (SELECT ma * ma AS gaa, ma * mb AS gab, mb * mb AS gbb
        FROM (SELECT max(mt) FILTER (WHERE t = '{a}') AS ma, max(mt) FILTER (WHERE t = '{b}') AS mb FROM AL{s})))""")
            ctes.append(f"""WK{s} AS (
  SELECT WK.t, WK.w + 1.0 * CASE WHEN WK.t = '{a}' THEN MN.gamma ELSE 1.0 - MN.gamma END * AL.mt AS w
  FROM WK{prev} WK JOIN AL{s} AL ON AL.t = WK.t, MN{s} MN)""")
        ctes += forward(s, "te_long", f"te{s}")
        ctes.append(f"""Q{s} AS (
  SELECT row_id, t, max(y) AS y, arg_min(c, CASE WHEN z = mz THEN c ELSE 1000000 END) AS pred,
         sum(lossc) AS loss FROM Rte{s} GROUP BY row_id, t)""")
        ctes.append(f"""K{s} AS (
  SELECT Q.t, count(*) FILTER (WHERE y = 1 AND pred = y) AS TP, count(*) FILTER (WHERE y = 0 AND pred = y) AS TN,
         count(*) FILTER (WHERE y = 0 AND pred <> y) AS FP, count(*) FILTER (WHERE y = 1 AND pred <> y) AS FN,
         avg(Q.loss * LAM.lam) AS tloss
  FROM Q{s} Q JOIN ({lam(s, evaluating=True)}) LAM ON Q.t = LAM.t GROUP BY Q.t)""")
        r1 = "CAST(TP AS DOUBLE) / NULLIF(TP + FN, 0)"
        r0 = "CAST(TN AS DOUBLE) / NULLIF(TN + FP, 0)"
        ctes.append(f"""X{s} AS (
  SELECT t, TP, TN, FP, FN, coalesce(2.0 * CAST(TP AS DOUBLE) / NULLIF(2.0 * TP + FP + FN, 0), 0.0) AS F1,
         CASE WHEN {r1} IS NOT NULL AND {r0} IS NOT NULL THEN ({r1} + {r0}) / 2.0 WHEN {r1} IS NOT NULL THEN {r1} ELSE {r0} END AS BA,
         CASE WHEN {r1} IS NOT NULL AND {r0} IS NOT NULL THEN ({r1} + {r0}) / 2.0 END AS AUC, tloss FROM K{s})""")
        cols = ", ".join(f"max({m}) FILTER (WHERE t = '{t}') AS {m}_{t}" for t in tasks for m in MEASURES)
        wcols = "".join(f", round((SELECT w FROM WK{s} WHERE t = '{t}'), 9) AS w_{t}" for t in tasks) if meta else ""
        ctes.append(f"""O{s} AS (
  SELECT {s - 1} AS epoch, round((SELECT total FROM T{s}), 9) AS training_loss,
         round(sum(tloss) + {reg(s)}, 9) AS testing_loss, {cols}{wcols} FROM X{s})""")
    body = "\nUNION ALL\n".join(f"SELECT * FROM O{s}" for s in range(1, epochs + 1))
    tags = (f"'text_stats' AS model, 0 AS run, {_dbl(lr)} AS lr, -1 AS batch_size, 'documents' AS data, "
            f"'all' AS question, '{regime}' AS training")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT o.*, {tags} FROM ({body}) o"


def _rounded_losses(rep):
    return rep.withColumn("training_loss", F.round("training_loss", 9)).withColumn(
        "testing_loss", F.round("testing_loss", 9))


ORACLE["fit_multi_task"] = _unrolled_run_sql("MTL")
ORACLE["fit_weighted_tasks"] = _unrolled_run_sql("MTL_awl")
ORACLE["fit_meta_weights"] = _unrolled_run_sql("MTL_meta")
ORACLE["run_grid"] = "\nUNION ALL BY NAME\n".join(
    f"SELECT * FROM ({_unrolled_run_sql(r, ts)})" for r, ts in (("STL", ("quality",)), ("STL", ("toxic",)), ("MTL", TASKS)))


def _recursive_epoch_loop_sql(epochs: int = 2, lr: float = 0.01, batch: int = 32, hidden: int = 8, d: int = 64,
                              seed: int = 42) -> str:
    """Oracle of ``epoch_loop``: mini-batch steps whose number depends on the
    data, as a recursive CTE.  The state is one row holding every parameter
    list and its AdamW moments; each recursion step takes the next batch (md5
    order per epoch), runs the forward pass, backpropagates through the
    shared layer, clips the joint norm at 1 and applies AdamW with the linear
    decay.  The rows at epoch ends are evaluated on the test split.
    """
    H = hidden
    b1, b2 = _dbl(0.9), _dbl(0.999)
    # parameter lists, flattened row-major: W1 = U (H x d), c1 = u, WA/WB = head matrices (2 x H), cA/cB = head biases
    params = {"W1": H * d, "c1": H, "WA": 2 * H, "cA": 2, "WB": 2 * H, "cB": 2}
    esum = "list_reduce(list({v} ORDER BY row_id), lambda p, q: list_transform(range(1, len(p) + 1), lambda i: p[i] + q[i]))"

    def hidden_expr(st: str, x: str) -> str:
        return f"list_transform(range(0, {H}), lambda k: list_dot_product({st}.W1[k * {d} + 1:k * {d} + {d}], {x}) + {st}.c1[k + 1])"

    def head_expr(st: str, w: str, c: str) -> str:
        return f"list_transform(range(0, 2), lambda j: list_dot_product({st}.{w}[j * {H} + 1:j * {H} + {H}], h) + {st}.{c}[j + 1])"

    init_cols = [
        f"list_transform(range(0, {H * d}), lambda i: CAST(((7 * (i % {d}) + 3 * (i // {d})) % 11) - 5 AS DOUBLE) / 10 / sqrt({d})) AS W1",
        f"list_transform(range(0, {H}), lambda i: CAST(0.0 AS DOUBLE)) AS c1",
        f"list_transform(range(0, {2 * H}), lambda i: CAST(((7 * (i % {H}) + 3 * (i // {H} + 7)) % 11) - 5 AS DOUBLE) / 10 / sqrt({H})) AS WA",
        "list_transform(range(0, 2), lambda i: CAST(0.0 AS DOUBLE)) AS cA",
        f"list_transform(range(0, {2 * H}), lambda i: CAST(((7 * (i % {H}) + 3 * (i // {H} + 14)) % 11) - 5 AS DOUBLE) / 10 / sqrt({H})) AS WB",
        "list_transform(range(0, 2), lambda i: CAST(0.0 AS DOUBLE)) AS cB",
    ]
    for p, n in params.items():
        init_cols += [f"list_transform(range(0, {n}), lambda i: CAST(0.0 AS DOUBLE)) AS m_{p}",
                      f"list_transform(range(0, {n}), lambda i: CAST(0.0 AS DOUBLE)) AS v_{p}"]
    rows = f"""
      SELECT row_id, x, a, b, h,
             {head_expr('st', 'WA', 'cA')} AS za, {head_expr('st', 'WB', 'cB')} AS zb
      FROM (SELECT row_id, x, a, b, {hidden_expr('st', 'x')} AS h
            FROM bt WHERE bt.epoch = st.t // cnt.spe AND bt.batch = st.t % cnt.spe) r1"""
    rows = f"""
      SELECT *, list_sum(list_transform(za, lambda v: exp(v - ma))) AS sa, list_sum(list_transform(zb, lambda v: exp(v - mb))) AS sb
      FROM (SELECT *, list_max(za) AS ma, list_max(zb) AS mb FROM ({rows}) r2) r3"""
    rows = f"""
      SELECT *, list_transform(range(0, 2), lambda j: exp(za[j + 1] - ma) / sa - CAST(a = j AS DOUBLE)) AS da,
             list_transform(range(0, 2), lambda j: exp(zb[j + 1] - mb) / sb - CAST(b = j AS DOUBLE)) AS db,
             ma + ln(sa) - za[a + 1] AS la, mb + ln(sb) - zb[b + 1] AS lb
      FROM ({rows}) r4"""
    rows = f"""
      SELECT *, list_transform(range(0, {H}), lambda k: da[1] * st.WA[k + 1] + da[2] * st.WA[{H} + k + 1]
                                                + db[1] * st.WB[k + 1] + db[2] * st.WB[{H} + k + 1]) AS dh
      FROM ({rows}) r5"""
    rows = f"""
      SELECT row_id, la, lb, da, db, dh,
             list_transform(range(0, {H * d}), lambda i: dh[i // {d} + 1] * x[i % {d} + 1]) AS gW1,
             list_transform(range(0, {2 * H}), lambda i: da[i // {H} + 1] * h[i % {H} + 1]) AS gWA,
             list_transform(range(0, {2 * H}), lambda i: db[i // {H} + 1] * h[i % {H} + 1]) AS gWB
      FROM ({rows}) r6"""
    grads = {"W1": "gW1", "c1": "dh", "WA": "gWA", "cA": "da", "WB": "gWB", "cB": "db"}
    g_sel = ", ".join(f"{esum.format(v=v)} AS s_{p}" for p, v in grads.items())
    lateral_g = f"""LATERAL (
    SELECT count(*) AS n, sum(la) / count(*) + sum(lb) / count(*) AS loss, {g_sel}
    FROM ({rows}) r7) g"""
    mg = ", ".join(f"list_transform(g.s_{p}, lambda v: v / g.n) AS G_{p}" for p in params)
    norm = " + ".join(f"list_sum(list_transform(mg.G_{p}, lambda v: v * v))" for p in params)
    cg = ", ".join(f"list_transform(mg.G_{p}, lambda v: CASE WHEN cl.coef < 1 THEN v * cl.coef ELSE v END) AS C_{p}"
                   for p in params)
    total = f"(2 * cnt.spe)" if epochs == 2 else f"({epochs} * cnt.spe)"
    size = (f"({_dbl(lr)} * greatest(0.0, CAST({total} - st.t AS DOUBLE) / {total}) "
            f"* sqrt(1 - pow({b2}, st.t + 1)) / (1 - pow({b1}, st.t + 1)))")
    upd = []
    for p in params:
        m_new = f"st.m_{p}[i] * {b1} + (1 - {b1}) * cg.C_{p}[i]"
        v_new = f"st.v_{p}[i] * {b2} + (1 - {b2}) * cg.C_{p}[i] * cg.C_{p}[i]"
        rng = f"range(1, len(st.{p}) + 1)"
        upd.append(f"list_transform({rng}, lambda i: st.{p}[i] - {size} * ({m_new}) / (sqrt({v_new}) + {_dbl(2e-8)})) AS {p}")
    for p in params:
        rng = f"range(1, len(st.{p}) + 1)"
        upd.append(f"list_transform({rng}, lambda i: st.m_{p}[i] * {b1} + (1 - {b1}) * cg.C_{p}[i]) AS m_{p}")
        upd.append(f"list_transform({rng}, lambda i: st.v_{p}[i] * {b2} + (1 - {b2}) * cg.C_{p}[i] * cg.C_{p}[i]) AS v_{p}")
    state_cols = ["t", "loss", *params, *[f"{k}_{p}" for p in params for k in ("m", "v")]]
    epochs_vals = ", ".join(f"({e})" for e in range(epochs))
    split = "CAST(('0x' || substr(md5('{s}:' || CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 2".format(s=seed)
    sql = f"""WITH RECURSIVE
emb AS (
  SELECT vec_id AS row_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x,
         CAST(label % 2 AS INTEGER) AS a, CAST(label >= 5 AS INTEGER) AS b FROM embeddings),
sp AS (SELECT *, {split} AS is_test FROM emb),
tr AS (SELECT row_id, x, a, b FROM sp WHERE NOT is_test),
te AS (SELECT row_id, x, a, b FROM sp WHERE is_test),
cnt AS (SELECT CAST(ceil(count(*) / {float(batch)}) AS BIGINT) AS spe FROM tr),
bt AS (
  SELECT e.epoch, tr.*,
         CAST((row_number() OVER (PARTITION BY e.epoch ORDER BY md5('{seed}:' || CAST(e.epoch AS VARCHAR) || ':' || CAST(tr.row_id AS VARCHAR)), tr.row_id) - 1) // {batch} AS BIGINT) AS batch
  FROM tr, (VALUES {epochs_vals}) e(epoch)),
st({', '.join(state_cols)}) AS (
  SELECT 0, CAST(NULL AS DOUBLE), {', '.join(init_cols)}
  UNION ALL
  SELECT st.t + 1, g.loss, {', '.join(upd)}
  FROM st, cnt,
  {lateral_g},
  LATERAL (SELECT {mg}) mg,
  LATERAL (SELECT 1.0 / (sqrt({norm}) + 1e-6) AS coef) cl,
  LATERAL (SELECT {cg}) cg
  WHERE st.t < {total}),
ends AS (SELECT e.epoch, st.* FROM st, cnt, (VALUES {epochs_vals}) e(epoch) WHERE st.t = cnt.spe * (e.epoch + 1)),
tl AS (
  SELECT e.epoch, avg(st.loss) AS training_loss FROM st, cnt, (VALUES {epochs_vals}) e(epoch)
  WHERE st.t > cnt.spe * e.epoch AND st.t <= cnt.spe * (e.epoch + 1) GROUP BY e.epoch),
ev AS (
  SELECT epoch, row_id, a, b, za, zb, list_max(za) AS ma, list_max(zb) AS mb FROM (
    SELECT epoch, row_id, a, b, h,
           {head_expr('q', 'WA', 'cA')} AS za, {head_expr('q', 'WB', 'cB')} AS zb
    FROM (SELECT ends.epoch, te.row_id, te.a, te.b, ends.WA, ends.cA, ends.WB, ends.cB,
                 {hidden_expr('ends', 'te.x')} AS h FROM ends, te) q) z),
ev2 AS (
  SELECT epoch, row_id, a, b,
         CAST(list_position(za, ma) - 1 AS INTEGER) AS pa, CAST(list_position(zb, mb) - 1 AS INTEGER) AS pb,
         ma + ln(list_sum(list_transform(za, lambda v: exp(v - ma)))) - za[a + 1]
         + (mb + ln(list_sum(list_transform(zb, lambda v: exp(v - mb)))) - zb[b + 1]) AS loss
  FROM ev),
tb AS (
  SELECT epoch, loss, (row_number() OVER (PARTITION BY epoch ORDER BY md5('{seed}:' || CAST(20000 + epoch AS VARCHAR) || ':' || CAST(row_id AS VARCHAR)), row_id) - 1) // {batch} AS bno
  FROM ev2),
tst AS (SELECT epoch, avg(bm) AS testing_loss FROM (SELECT epoch, bno, avg(loss) AS bm FROM tb GROUP BY epoch, bno) GROUP BY epoch),
cc AS (
  SELECT epoch, 'a' AS t, a AS y, pa AS pred FROM ev2 UNION ALL SELECT epoch, 'b' AS t, b AS y, pb AS pred FROM ev2),
k AS (
  SELECT epoch, t, count(*) FILTER (WHERE y = 1 AND pred = y) AS TP, count(*) FILTER (WHERE y = 0 AND pred = y) AS TN,
         count(*) FILTER (WHERE y = 0 AND pred <> y) AS FP, count(*) FILTER (WHERE y = 1 AND pred <> y) AS FN
  FROM cc GROUP BY epoch, t),
x AS (
  SELECT epoch, t, TP, TN, FP, FN, {F1_SQL} AS F1, {BA_SQL} AS BA, {AUC_SQL} AS AUC FROM k),
w AS (
  SELECT epoch, {', '.join(f"max({m}) FILTER (WHERE t = '{t}') AS {m}_{t}" for t in ('a', 'b') for m in MEASURES)}
  FROM x GROUP BY epoch)
SELECT CAST(w.epoch AS INTEGER) AS epoch, round(tl.training_loss, 9) AS training_loss, round(tst.testing_loss, 9) AS testing_loss,
       w.* EXCLUDE (epoch), 'embedding' AS model, 0 AS run, {_dbl(lr)} AS lr, {batch} AS batch_size, 'embeddings' AS data,
       'all' AS question, 'MTL' AS training
FROM w JOIN tl ON w.epoch = tl.epoch JOIN tst ON w.epoch = tst.epoch"""
    return sql


ORACLE["epoch_loop"] = _recursive_epoch_loop_sql()


# --------------------------------------------------------------------------
# Checked outputs are scalar columns
# --------------------------------------------------------------------------
# A query whose natural result holds arrays (ids, masks, logits, pooled
# vectors, features) is checked one element per row: ``pos`` is the 0-based
# position and the array column keeps its name for the element.  Equal
# arrays then compare equal however a client converts nested values.

import functools  # noqa: E402

FLATTEN = {
    "encode_ids": ["encoded"], "pad_truncate": ["input_ids"], "attention_mask": ["attention_mask"],
    "post_truncate": ["tokens"], "linear_layer": ["logits"], "two_head_scores": ["logits_a", "logits_b"],
    "softmax_probs": ["probs"], "tanh_layer": ["h"], "clip_norm": ["x"], "attention_pool": ["pooled"], "attention_pool_hops": ["pooled"],
    "frozen_features": ["x"], "select_model_features": ["x"], "fit_single_task": ["w"], "score_batch": ["logits"],
    "apply_encoder": ["x"],
}


def flatten_arrays(df: DataFrame, arrays: list[str], pos: str = "pos") -> DataFrame:
    """One row per array position (arrays of one row zipped in lock step)."""
    others = [c for c in df.columns if c not in arrays]
    if len(arrays) == 1:
        return df.select(*others, F.posexplode(arrays[0]).alias(pos, arrays[0]))
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return df.select(*others, F.posexplode(zipped).alias(pos, "_z")).select(
        *others, pos, *[F.col("_z")[a].alias(a) for a in arrays])


def _flatten_sql(sql: str, arrays: list[str], pos: str = "pos") -> str:
    cols = ", ".join(f"unnest(q.{a}) AS {a}" for a in arrays)
    return (f"SELECT q.* EXCLUDE ({', '.join(arrays)}), CAST(generate_subscripts(q.{arrays[0]}, 1) - 1 AS INTEGER) AS {pos}, "
            f"{cols}\nFROM (\n{sql}\n) q")


def _flattened(fn: QueryFn, arrays: list[str]) -> QueryFn:
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return flatten_arrays(fn(spark, sf_dir), arrays)
    return run


for _name, _arrays in FLATTEN.items():
    QUERIES[_name] = _flattened(QUERIES[_name], _arrays)
    ORACLE[_name] = _flatten_sql(ORACLE[_name], _arrays)
