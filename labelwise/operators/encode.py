"""Text to fixed-length id sequences: tokens, vocabulary, ids, padding, masks.

Corpus-scale design: tokens are counted with a map-side-combined aggregate;
the vocabulary is the top ``size`` tokens (a bounded top-k, never a window
over the corpus); and ids are looked up inside each row against that bounded
vocabulary, so encoding is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from labelwise.functions.arrays import attention_mask as mask_expr
from labelwise.functions.arrays import pad_truncate as pad_expr
from labelwise.functions.text import tokens as tokens_expr
from labelwise.session import BROADCAST_LIMIT_BYTES, scratch_path

# Reserved ids of the vocabulary.
PAD_ID = 0
UNK_ID = 1
START_ID = 2
END_ID = 3
FIRST_WORD_ID = 4
MAX_SEQ_LEN = 128


def _token_array(text: str | None, tokens_col: str | None):
    if tokens_col is not None:
        return F.col(tokens_col)
    return tokens_expr(text or "text")


def tokenized(df: DataFrame, id_col: str = "row_id", text: str = "text", carry: Sequence[str] = (),
              out: str = "tokens") -> DataFrame:
    """Keep the id (and ``carry`` columns) with the token array of the text."""
    return df.select(id_col, *carry, tokens_expr(text).alias(out))


def tokenize(df: DataFrame, id_col: str = "row_id", text: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row per token: (id, pos, token), pos 0-based, over the whole text."""
    return df.select(id_col, F.posexplode(_token_array(text, tokens_col)).alias("pos", "token"))


def token_counts(df: DataFrame, text: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Corpus frequency of every token (partial counts combine map-side)."""
    return df.select(F.explode(_token_array(text, tokens_col)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, text: str = "text", size: int = 5000, tokens_col: str | None = None,
                materialize: bool = True) -> DataFrame:
    """Top ``size`` tokens by (count desc, token), ids from ``FIRST_WORD_ID``.

    ``orderBy(...).limit(size)`` plans as a distributed top-k: each partition
    keeps its best ``size`` rows, so the numbering window below only ever
    sees ``size`` rows.  With ``materialize`` the (bounded) result is cached
    at once, so later size checks and joins do not recount the corpus.
    """
    top = token_counts(df, text, tokens_col).orderBy(F.desc("n"), F.asc("token")).limit(size)
    order = Window.orderBy(F.desc("n"), F.asc("token"))
    vocab = top.select("token", (F.row_number().over(order) + (FIRST_WORD_ID - 1)).cast("int").alias("id"), "n")
    if materialize:
        vocab = vocab.persist()
        # one job both fills the cache and measures the vocabulary for the broadcast check
        vocab._labelwise_size = _measure(vocab)
    return vocab


def _measure(vocab: DataFrame) -> int:
    stats = vocab.agg(F.count(F.lit(1)).alias("rows"),
                      F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("chars")).first()
    return int(stats["rows"]) * 32 + int(stats["chars"]) * 4


def _small(vocab: DataFrame) -> bool:
    """Whether the vocabulary's measured size allows it to be shipped.

    It has at most ``size`` rows by construction; its byte size is measured anyway (tokens can be long).
    """
    est = getattr(vocab, "_labelwise_size", None)
    return (_measure(vocab) if est is None else est) <= BROADCAST_LIMIT_BYTES


def _vocab_side(vocab: DataFrame) -> DataFrame:
    side = vocab.select("token", "id")
    return F.broadcast(side) if _small(vocab) else side


def encode_join(df: DataFrame, vocab: DataFrame, id_col: str = "row_id", text: str = "text",
                tokens_col: str | None = None) -> DataFrame:
    """Token to id lookup: (id, pos, token, token_id); unknown tokens get UNK."""
    toks = tokenize(df, id_col, text, tokens_col)
    joined = toks.join(_vocab_side(vocab), "token", "left")
    return joined.select(id_col, "pos", "token", F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("token_id"))


def encode_ids(df: DataFrame, vocab: DataFrame, id_col: str = "row_id", text: str = "text",
               carry: Sequence[str] = (), max_len: int | None = None, tokens_col: str | None = None) -> DataFrame:
    """Start marker, word ids (UNK when unknown), end marker, per row.

    Adds ``n_tokens`` (words in the whole text) and ``encoded`` (the id list).
    With ``max_len`` the list is cut to that length, and only the words that
    can survive the cut are looked up -- the same result as cutting after
    encoding, with a bounded amount of work per row.

    A vocabulary whose measured size is under the broadcast limit is looked
    up inside each row's batch: no token leaves its row, so rows may share an
    id, and nothing is exploded, shuffled or cached.  A larger vocabulary is
    joined, the rows told apart by their number in the scan.
    """
    carry = list(carry)
    base = df.select(id_col, *carry, _token_array(text, tokens_col).alias("_t"))
    keep = F.col("_t") if max_len is None else F.slice("_t", 1, max(max_len - 1, 0))
    base = base.select(id_col, *carry, F.size("_t").alias("n_tokens"), keep.alias("_t"))
    found = _lookup_in_row(base, vocab) if _small(vocab) else _lookup_by_join(base, vocab)
    encoded = F.concat(F.array(F.lit(START_ID)), F.col("_ids"), F.array(F.lit(END_ID)))
    if max_len is not None:
        encoded = F.slice(encoded, 1, max_len)
    return found.select(id_col, *carry, "n_tokens", encoded.alias("encoded"))


def _lookup_in_row(base: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replaces the token array ``_t`` by the id array ``_ids``, batch by batch."""
    rows = vocab.select("token", "id").collect()  # at most the vocabulary's size, measured before
    words, ids = pa.array([r["token"] for r in rows], pa.string()), np.array([r["id"] for r in rows], np.int32)
    schema = StructType([f for f in base.schema if f.name != "_t"] + [StructField("_ids", ArrayType(IntegerType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            tokens = rb.column(rb.num_columns - 1)
            at = pc.index_in(tokens.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
            flat = np.where(at >= 0, ids[np.maximum(at, 0)], UNK_ID).astype(np.int32) if len(ids) else np.full(len(at), UNK_ID, np.int32)
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            edges = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.ListArray.from_arrays(edges, pa.array(flat))], names)

    return base.mapInArrow(run, schema)


def _lookup_by_join(base: DataFrame, vocab: DataFrame) -> DataFrame:
    rows = base.withColumn("_row", F.monotonically_increasing_id())
    keys = [c for c in rows.columns if c != "_t"]
    exploded = rows.select(*keys, F.posexplode_outer("_t").alias("pos", "token"))
    joined = exploded.join(vocab.select("token", "id"), "token", "left")
    pair = F.when(F.col("pos").isNotNull(), F.struct(F.col("pos"), F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id")))
    grouped = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("_p"))
    return grouped.withColumn("_ids", F.transform("_p", lambda p: p["id"])).drop("_p", "_row")


def encode_fixed(df: DataFrame, vocab: DataFrame, id_col: str = "row_id", text: str = "text",
                 carry: Sequence[str] = (), max_len: int = MAX_SEQ_LEN, tokens_col: str | None = None,
                 keep_end: bool = False) -> DataFrame:
    """``input_ids`` of exactly ``max_len`` (end cut, zero padded) and the mask.

    Truncation cuts the encoded list, so a long text loses its end marker;
    with ``keep_end`` the marker takes the place of the last id instead.
    """
    enc = encode_ids(df, vocab, id_col, text, carry, max_len, tokens_col)
    if keep_end:
        ended = F.concat(F.slice("encoded", 1, max_len - 1), F.array(F.lit(END_ID)))
        enc = enc.withColumn("encoded", F.when(F.col("n_tokens") + 2 > max_len, ended).otherwise(F.col("encoded")))
    ids = pad_expr("encoded", max_len, PAD_ID)
    return enc.select(id_col, *carry, "n_tokens", ids.alias("input_ids")).withColumn(
        "attention_mask", mask_expr("input_ids"))


def encode_lengths(encoded: DataFrame, id_col: str = "row_id", max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """Real (unpadded) length and whether the row was cut, from the mask."""
    real = F.aggregate("attention_mask", F.lit(0), lambda acc, m: acc + m)
    return encoded.select(id_col, real.alias("length"),
                          ((F.col("n_tokens") + 2) > F.lit(max_len)).alias("truncated"))


def post_truncate(df: DataFrame, col: str, n: int = MAX_SEQ_LEN) -> DataFrame:
    """Keep the first ``n`` elements of an array column."""
    return df.withColumn(col, F.slice(col, 1, n))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` in at least ``partitions`` parts, where a scan of few large files has fewer: rows are then dealt round-robin, which
    moves every row once.  A scan with enough splits stays as it is, as does any without ``partitions``."""
    if partitions is None or df.rdd.getNumPartitions() >= partitions:
        return df
    return df.repartition(partitions)


def encode_corpus(df: DataFrame, size: int = 5000, max_len: int | None = MAX_SEQ_LEN, id_col: str = "row_id",
                  text: str = "text", carry: Sequence[str] = (), partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and encoded rows.  Texts are tokenised once, into a written table of token arrays in the shared checkpoint
    folder, from which one pass counts the tokens and one encodes.

    Returns ``(encoded, vocab)``; with ``max_len`` the rows are fixed length
    with masks, else the full encoded lists.  Only the vocabulary is cached.
    ``partitions``: see :func:`spread`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "tokens")
    base = spread(df.select(id_col, *carry, text), partitions)
    table = tokenized(base, id_col, text, carry)
    table.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    vocab = build_vocab(table, size=size, tokens_col="tokens")
    if max_len is None:
        return encode_ids(table, vocab, id_col, carry=carry, tokens_col="tokens"), vocab
    return encode_fixed(table, vocab, id_col, carry=carry, max_len=max_len, tokens_col="tokens"), vocab
