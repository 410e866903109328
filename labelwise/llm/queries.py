"""Registered queries of the text operators, opN_<name>, and the SQL oracles of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelwise.llm import bpe, byte_bpe, chat, decontam, fm_dedup, html_extract, langid, ngram_join, pii, prefix_trie, quality, structure, suffix_dedup
from labelwise.llm.common import read_table, written

#: Vocabulary of op10; a parameter of the operator.
BPE_FILE = "word_bpe_49k.json"
#: Ranks of op12; a parameter of the operator.
RANK_FILE = "byte_bpe_50k.tiktoken"


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(read_table(spark, sf_dir, "documents")).drop("rid")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontam.contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = written(quality.signals(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    rated = quality.verdict(featured, quality.fit_label_model(quality.pattern_counts(featured)))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.cross_fold(read_table(spark, sf_dir, "documents"))


def op9_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeated_passages(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), bpe_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), rank_path())


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_damaged(read_table(spark, sf_dir, "conversations"))


def _op7_sql() -> str:
    """The same rules and the same EM, as a recursive query over the vote patterns."""
    votes = " || ".join(f"CASE WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE 'a' END" for _, bad, good in quality.RULES)
    rules = range(1, len(quality.RULES) + 1)
    s = quality.SMOOTHING
    logs = " + ".join(f"ln((g{r} + {s}) / (weight + {3 * s})) - ln((n{r} - g{r} + {s}) / (total - weight + {3 * s}))" for r in rules)
    sums = ", ".join(f"sum(n * good) OVER (PARTITION BY pattern[{r}]) AS g{r}, sum(n) OVER (PARTITION BY pattern[{r}]) AS n{r}" for r in rules)
    balance = "(len(replace(replace(pattern, 'a', ''), 'b', '')) + 1.0)", "3 * len(replace(replace(pattern, 'a', ''), 'g', '')) + 1"
    return rf"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT rid, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i,
    unnest(list_transform(range(1, len(w) - {quality.WINDOW - 2}), lambda k: array_to_string(w[k:k + {quality.WINDOW - 1}], ' '))) AS g
  FROM src WHERE len(w) >= {quality.WINDOW}),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, sum(least({quality.WINDOW}, gap)) AS n FROM (
  SELECT rid, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -{quality.WINDOW}) AS gap FROM twice) GROUP BY rid),
sig AS (SELECT s.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim, (length(t) - length(replace(t, '.', '')))::BIGINT AS n_stops,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM src s LEFT JOIN covered c ON c.rid = s.rid),
base AS (SELECT *, n_lines - n_own AS n_dup_lines,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM sig),
voted AS (SELECT *, {votes} AS pattern FROM base),
em AS (
  SELECT 0 AS step, pattern, count(*)::DOUBLE AS n, {balance[0]}::DOUBLE / ({balance[0]} + {balance[1]}) AS good
  FROM voted WHERE NOT base_failed GROUP BY pattern
  UNION ALL
  SELECT step + 1, pattern, n, 1 / (1 + exp(-greatest(-500, least(500,
      ln((weight + {s}) / (total - weight + {s})) + {logs}))))
  FROM (SELECT *, sum(n * good) OVER () AS weight, sum(n) OVER () AS total, {sums} FROM em WHERE step < {quality.ITERATIONS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(good, 0) >= 0.5 AS kept
FROM voted v LEFT JOIN em ON em.pattern = v.pattern AND em.step = {quality.ITERATIONS}"""


_OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT DISTINCT g.rid, g.i, g.m, w.item_id FROM grams g JOIN windows w ON g.m = w.m AND g.g = w.g),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY rid)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_hit, coalesce(y.n, 0)::BIGINT AS n_items,
  sha256(coalesce(y.s, '')) AS items_sha256, x.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words x USING (rid) LEFT JOIN named y USING (rid)""".replace(
    "lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_OP1_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT rid, i, b[i:i + 199] AS g FROM (SELECT rid, b, unnest(range(1, n - 198)) AS i FROM docs WHERE n >= 200)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
steps AS (SELECT rid, i, coalesce(i > 200 + lag(i) OVER (PARTITION BY rid ORDER BY i), true) AS opens FROM twice),
numbered AS (SELECT rid, i, sum(opens::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM steps),
runs AS (SELECT rid, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS f, a AS t FROM runs
  UNION ALL SELECT rid, max(z), max(n) + 1 FROM runs JOIN docs USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(CASE WHEN t > f THEN hex(b[f:t - 1]) ELSE '' END, '' ORDER BY f) AS h FROM gaps JOIN docs USING (rid) GROUP BY rid),
sums AS (SELECT rid, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM docs LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)"""

_OP5_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 90 * (s.n + t.n - c)),
paired AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, e.y FROM reach r JOIN paired e ON e.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)"""

_OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (g) WHERE first < doc_id)),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""

def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit: -1 stands for a shift."""
    steps = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [ord(({text})[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {steps}), "
            "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))")


#: Whole paths stand for nodes; every node adds to each of its ancestors.
_OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i FROM conversations),
own AS (SELECT conv_id AS c, list(struct_pack(r := r, x := x) ORDER BY i) AS seq FROM t GROUP BY conv_id),
drawn AS (SELECT c, seq, CASE WHEN c IS NULL THEN 0 ELSE %CRC% % 4 END AS h, c - c % 20 AS base FROM (SELECT *, coalesce(c::VARCHAR, '-') AS named FROM own)),
re AS (SELECT d.c, coalesce(b.seq[1:d.h], []) || d.seq[d.h + 1:] AS seq FROM drawn d LEFT JOIN own b ON b.c = d.base),
nodes AS (SELECT seq[1:d] AS path, d AS depth, min(c) AS conv_id, count(*) AS n_convs FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM re) GROUP BY 1, 2),
valued AS (SELECT *, path[1:depth - 1] AS above, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].x, '[^ 	-]+')) END AS saved FROM nodes),
kids AS (SELECT above AS path, count(*) AS n FROM valued WHERE depth > 0 GROUP BY above),
sums AS (SELECT path[1:k] AS path, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT v.path, saved, k.n IS NULL AS leaf, unnest(range(0, depth + 1)) AS k FROM valued v LEFT JOIN kids k ON k.path = v.path) GROUP BY 1),
ends AS (SELECT seq AS path, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c), '')) AS digest FROM re GROUP BY seq)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  coalesce(e.digest, sha256('')) AS ends_sha256
FROM valued v JOIN sums s ON s.path = v.path LEFT JOIN kids k ON k.path = v.path LEFT JOIN ends e ON e.path = v.path
LEFT JOIN valued p ON v.depth > 0 AND p.path = v.above""".replace("%CRC%", _crc32_sql("named"))

#: Least strings are carried along the rows, one for each state.
_OP13_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    %CRC% % 20 AS k FROM (SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS named FROM conversations)),
hit AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    NOT regexp_matches(text, '[^ 	-
]') AS blank FROM hit),
told AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
    concat(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i), role[1]) AS two FROM placed),
fault AS (SELECT *, blank OR dup AS gone, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM told),
puts(s, x, c, e) AS (VALUES ('n','n',0,''),('n','u',3,'I'),('n','a',6,'II'),('s','s',0,''),('s','u',3,'I'),('s','a',6,'II'),('u','u',0,''),('u','a',3,'I'),('a','a',0,''),('a','u',3,'I')),
nexts(x, y) AS (VALUES ('n','u'),('s','u'),('u','a'),('a','u')),
moves AS (SELECT conv_id, i, p.s, p.x AS t, p.c + 4 AS c, p.e || 'D' AS e FROM fault, puts p
  UNION ALL SELECT conv_id, i, p.s, role[1], p.c + 3 * cut::INT, p.e || 'K' FROM fault, puts p JOIN nexts USING (x) WHERE NOT gone AND (role[1] = y OR role[1] = 's' AND x = 'n')
  UNION ALL SELECT conv_id, i, p.s, y, p.c + 3 + 3 * cut::INT, p.e || 'R' FROM fault, puts p JOIN nexts USING (x) WHERE NOT gone),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 'n' AS t, 0 AS c, '' AS e FROM fault GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, t, b.c, b.e FROM (
    SELECT m.conv_id, m.i, m.t, min(struct_pack(c := w.c + m.c, e := w.e || m.e)) AS b
    FROM ways w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.s = w.t GROUP BY m.conv_id, m.i, m.t)),
sizes AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY conv_id),
finals AS (SELECT w.conv_id, min(struct_pack(c := w.c + p.c, e := w.e || p.e)) AS b
  FROM ways w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i JOIN puts p ON p.s = w.t AND p.x IN ('n', 'a') GROUP BY w.conv_id),
edits AS (SELECT conv_id, b.e AS audit, unnest(string_split(b.e, '')) AS edit, unnest(range(1, len(b.e) + 1)) AS nr FROM finals WHERE len(b.e) > 0),
seen AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY nr) AS i FROM edits),
kept AS (SELECT s.conv_id, s.nr, s.edit, f.role, f.text, row_number() OVER (PARTITION BY s.conv_id ORDER BY nr)
    - max((edit = 'K' AND f.role[1] = 's')::INT) OVER (PARTITION BY s.conv_id) AS nth
  FROM seen s LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE edit <> 'D'),
spoken AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role || ':' || text ELSE CASE WHEN nth % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END END,
    chr(10) ORDER BY nr) AS lines FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(z.gaps, 0)::BIGINT AS gaps, coalesce(z.blank, 0)::BIGINT AS blank, coalesce(z.duplicate, 0)::BIGINT AS duplicate,
  coalesce(z.truncated, 0)::BIGINT AS truncated, coalesce(z.illegal, 0)::BIGINT AS illegal, coalesce(f.b.c, 0)::BIGINT AS cost, coalesce(f.b.e, '') AS audit,
  sha256(coalesce(p.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN finals f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN spoken p ON p.conv_id IS NOT DISTINCT FROM c.conv_id""".replace("%CRC%", _crc32_sql("named"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_chat_repair": op4_chat_repair,
    "op5_ngram_join": op5_ngram_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_fm_dedup": op9_fm_dedup,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE: dict[str, str] = {"op1_suffix_dedup": _OP1_SQL, "op3_decontamination": _OP3_SQL, "op5_ngram_join": _OP5_SQL, "op7_quality_rules": _op7_sql(), "op9_fm_dedup": _OP9_SQL,
                          "op11_prefix_trie": _OP11_SQL, "op13_structure_repair": _OP13_SQL}
