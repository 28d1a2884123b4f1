"""The queries of this subpackage's operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, chroma, embed_dedup, langid, lattice_lm, licenses, mixing, pii, simhash, tokencount
from .common import table

#: The key of the registered query; who runs the operator on real data brings their own.
DEMO_KEY = b"a key for tests, not for real data"
BPE_FILE, WORD_FILE, PIECE_FILE, LEVEL_FILE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data, and how many values of which kind were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, DEMO_KEY, counts="kinds")
    of = lambda *kinds: sum((F.coalesce(F.element_at("kinds", k), F.lit(0)) for k in kinds), F.lit(0)).cast("long")
    return out.select("doc_id", "text", of("card", "iban", "ssn", "phone", "local_phone", "ip", "ip6").alias("n_numbers"), of("iso_date", "short_date", "long_date").alias("n_dates"), of("email", "secret").alias("n_other"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, epochs=2)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, langid.train(langid.learnable(docs)))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), limit=2048)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with a neighbour's last answer; masks as text, so that they compare as values."""
    out = chat.format_preferences(chat.counterfactuals(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("id").alias("conv_id"), "n_prompt", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_mask"), text("rejected_spans").alias("rejected_mask"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' bytes as sound: they are short, so frames and hops are too."""
    return chroma.align_recordings(table(spark, sf_dir, "documents"), frame=256, hop=8)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.detect(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(LEVEL_FILE), public_tokenizers.path(PIECE_FILE), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_mixing, op3_bpe, op4_language, op5_token_counts, op6_simhash, op7_embeddings, op8_preferences, op9_lattice, op10_chroma, op11_licenses, op12_alignment)}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce('mix:' || CAST(doc_id AS VARCHAR), 'mix::' || coalesce(text, ''))), 1, 13))::BIGINT AS r
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS k
  FROM d GROUP BY source),
f AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
         (sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_,
         (sum(source_size) OVER ())::BIGINT * 150 AS total,
         row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, k) AS turn
  FROM s),
l AS (
  SELECT *, min(CASE WHEN level * weight <= 2 * source_size THEN {'turn': turn, 'level': level} END) OVER () AS first_
  FROM (SELECT *, (total - 100 * full_)::DOUBLE / (100.0::DOUBLE * open_) AS level FROM f)),
b AS (SELECT *, first_.level AS best FROM l),
t AS (
  SELECT source, source_size, CASE WHEN best IS NULL OR best * weight >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE best * weight END AS target FROM b),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.r) AS tied
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN upto - tied / 2.0::DOUBLE <= target - whole * source_size AND whole < 2 AND target > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (whole + CASE WHEN upto - tied / 2.0::DOUBLE <= target - whole * source_size AND whole < 2 AND target > 0 THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM o
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
last AS (SELECT conv_id, text FROM c WHERE k = n),
sides AS (
  SELECT conv_id, k, 'chosen' AS side, role, text, n FROM c
  UNION ALL
  SELECT c.conv_id, c.k, 'rejected', c.role, CASE WHEN c.k = c.n THEN o.text ELSE c.text END, c.n
  FROM c LEFT JOIN last o ON o.conv_id = xor(c.conv_id, 1) WHERE c.k < c.n OR o.conv_id IS NOT NULL),
p AS (
  SELECT a.conv_id, a.n - CASE WHEN bool_and(b.text IS NOT NULL AND a.text = b.text) THEN 0 ELSE 1 END AS n_prompt
  FROM sides a LEFT JOIN sides b ON a.conv_id = b.conv_id AND a.k = b.k AND b.side = 'rejected'
  WHERE a.side = 'chosen' AND a.k = a.n GROUP BY a.conv_id, a.n),
r AS (
  SELECT b.*, p.n_prompt, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM sides b JOIN p USING (conv_id)),
m AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM r WHERE k > n_prompt),
g AS (
  SELECT conv_id, side, string_agg(shown, '' ORDER BY k) AS shown,
         string_agg(CASE WHEN role = 'assistant' THEN (pos + 13 + length(role)) || '-' || (pos + length(shown)) END, ',' ORDER BY k) AS mask
  FROM m GROUP BY conv_id, side)
SELECT p.conv_id, p.n_prompt::BIGINT AS n_prompt,
       coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.conv_id = p.conv_id AND r.side = 'chosen' AND k <= p.n_prompt), '') AS prompt,
       coalesce(x.shown, '') AS chosen, coalesce(y.shown, '') AS rejected, coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask
FROM p LEFT JOIN g x ON x.conv_id = p.conv_id AND x.side = 'chosen' LEFT JOIN g y ON y.conv_id = p.conv_id AND y.side = 'rejected'
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op8_preferences": OP8_SQL, "op11_licenses": licenses.oracle()}
