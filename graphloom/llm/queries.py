"""The corpus operators applied to whole tables, one query each, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from .chat_trees import as_trees, format_trees, read_back
from .common import documents, materialize
from .decontaminate import contained_items
from .fingerprint import fingerprints
from .language_id import identify_language
from .lm_score import cross_entropy_difference
from .near_dedup import near_duplicates
from .sentencepiece_match import encode_decode
from .token_files import token_files
from .toxicity import toxicity
from .warc import archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the documents of good quality (target) and all documents (background)."""
    return cross_entropy_difference(documents(spark, sf_dir), _table(spark, sf_dir, "labels").where("quality = 1"))


def op2_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = [(-1, k, role, "<|im_end|><|im_start|>assistant ok") for k, role in enumerate(("user", "assistant"))]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = materialize(as_trees(rows.union(spark.createDataFrame(probe, rows.schema))), "messages")
    return read_back(materialize(format_trees(messages), "formatted"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(_table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), "same")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score,
        op2_chat_trees,
        op3_warc_bundles,
        op4_fingerprints,
        op5_decontaminate,
        op6_sentencepiece,
        op7_near_dedup,
        op8_language_id,
        op9_token_files,
        op10_toxicity,
    )
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_LETTERS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_RUNS = "CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END"

ORACLES = {
    "op7_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id""",
    "op2_chat_trees": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(role) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op3_warc_bundles": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM r""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_LETTERS} AS ws FROM documents), i AS (SELECT item_id, {_LETTERS} AS ws FROM benchmark),
ds AS (SELECT doc_id, unnest(list_distinct({_RUNS})) AS x FROM d),
it AS (SELECT item_id, list_distinct({_RUNS}) AS sh FROM i),
iu AS (SELECT item_id, len(sh) AS n, unnest(sh) AS x FROM it)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared, count(*) / n::DOUBLE AS containment
FROM ds JOIN iu USING (x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n""",
}
