"""The queries of the training-data operators over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chosen_path import near_dup
from .common import read
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .langid import identify
from .line_dedup import line_dedup
from .media import media_digest
from .packing import pack
from .pii import replace_pii
from .pieces import DEFAULT_MODEL, encode_digest, load_model
from .preferences import format_preferences, reply_pairs


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(read(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass Bloom filtering over all documents."""
    return exact_dedup(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY sha) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS kept,
  sha AS text_sha256
FROM d"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a grey raster in binary Netpbm, read back, resized and hashed."""
    return media_digest(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-kernel classification of every document; fitted on the labelled ones outside the held-out fold."""
    return identify(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-line windows repeated anywhere in documents, later occurrences removed."""
    return line_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM d),
t AS (SELECT doc_id, n, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS l FROM p),
w AS (SELECT doc_id, pos, l AS l0, lead(l, 1) OVER o AS l1, lead(l, 2) OVER o AS l2, n FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS r FROM w WHERE pos <= n - 3 AND l0 || l1 || l2 <> ''),
marked AS (SELECT DISTINCT doc_id, pos + k AS pos FROM v, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1)
SELECT t.doc_id, any_value(n)::BIGINT AS n_lines, count(m.pos) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY t.pos) FILTER (WHERE m.pos IS NULL), '') AS text
FROM t LEFT JOIN marked m ON t.doc_id = m.doc_id AND t.pos = m.pos GROUP BY t.doc_id"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of CAPACITY words without two of a source or of a text in a bin."""
    return pack(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = DEFAULT_MODEL) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode_digest(read(spark, sf_dir, "documents"), load_model(model))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each against itself with another last reply, formatted as preferences."""
    return format_preferences(reply_pairs(read(spark, sf_dir, "conversations")))


OP9_SQL = r"""
WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
e AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM c WHERE role = 'assistant' GROUP BY 1),
f AS (SELECT c.conv_id, min(coalesce(c.text, '')) AS reply FROM c JOIN e ON e.conv_id = c.conv_id AND c.turn = e.first WHERE c.role = 'assistant' AND e.first < e.last GROUP BY 1),
s AS (SELECT c.conv_id AS pair_id, true AS chosen, turn, role, text FROM c LEFT JOIN e USING (conv_id) WHERE last IS NULL OR turn <= last
  UNION ALL SELECT c.conv_id, false, turn, role, text FROM c LEFT JOIN e USING (conv_id) WHERE last IS NULL OR turn < last
  UNION ALL SELECT e.conv_id, false, last, 'assistant', reply FROM e JOIN f USING (conv_id)),
d AS (SELECT pair_id, chosen, turn, role, text FROM s WHERE pair_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pair_id, chosen, turn ORDER BY role NULLS LAST, text NULLS LAST) = 1),
t AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, a.pair_id IS NOT NULL AS ina, b.pair_id IS NOT NULL AS inb,
  a.role AS arole, a.text AS atext, b.role AS brole, b.text AS btext,
  a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM d WHERE chosen) a FULL JOIN (SELECT * FROM d WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.turn = b.turn),
p AS (SELECT *, coalesce(turn < min(turn) FILTER (WHERE NOT same) OVER (PARTITION BY pair_id), true) AS prompt FROM t),
u AS (SELECT pair_id, CASE WHEN prompt THEN 'prompt' ELSE 'chosen' END AS section, turn, arole AS role, atext AS text FROM p WHERE ina
  UNION ALL SELECT pair_id, 'rejected', turn, brole, btext FROM p WHERE NOT prompt AND inb),
r AS (SELECT pair_id, section, turn, role, '<|im_start|>' || replace(coalesce(role, ''), '<|', '< ') || chr(10) || replace(coalesce(text, ''), '<|', '< ') || '<|im_end|>' || chr(10) AS rendered FROM u)
SELECT pair_id, section, turn::BIGINT AS turn, role, rendered, CASE WHEN section <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END::INT AS mask, length(rendered)::BIGINT AS n_chars FROM r"""


#: Production keys come from a secret store; this one makes results repeatable.
PII_KEY = "loomfield-documents"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = PII_KEY) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), key, count_col="n_entities")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles, similarity 0.8 or more."""
    return near_dup(read(spark, sf_dir, "documents"), words=2, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_line_dedup": op2_line_dedup,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_media": op6_media,
        "op7_minhash_near_dup": op7_minhash_near_dup,
        "op8_language_id": op8_language_id,
        "op9_preferences": op9_preferences,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op9_preferences": OP9_SQL}
