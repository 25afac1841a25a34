"""The registered queries of this package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import alignment, bpe_codec, chat_format, decontamination, language_id, lm_scoring, ngram_join, quality, substring_dedup, suffix_dedup, token_counts, topk_search, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded by the 50k byte vocabulary."""
    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe_codec.digests(bpe_codec.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, with_bytes=True))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probabilities of every document by a bigram model of nine tenths of them, beside a smoothed unigram base."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    scored = lm_scoring.score(table(spark, folder, "documents"), learn)
    return scored.select("doc_id", (~F.col("learned_from")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that imitates the marks, expanded into one example for each reply."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    imitation = spark.createDataFrame([(-7, number, role, IMITATION) for number, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(imitation)))


#: A text that looks like the template's own marks.
IMITATION = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('### ') + length(role) + length(': ') + length('</turn>') + 1
         + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM t
), summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR place = turns) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    return decontamination.digests(decontamination.mark(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
),
hits AS (SELECT d.doc_id, d.i, d.size, w.item_id FROM doc_windows d JOIN item_windows w ON d.size = w.size AND d.win = w.win),
hit_words AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, size)) AS o FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words hw ON dw.doc_id = hw.doc_id LEFT JOIN hit_items hi ON dw.doc_id = hi.doc_id
"""


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    documents = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.fit(documents, ~held_out)
    predicted = language_id.predict(documents, model)
    return predicted.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors with the largest inner product for every fiftieth vector."""
    return topk_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur more than once."""
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, folder, "documents")))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier document holds."""
    return substring_dedup.digests(substring_dedup.dedup(table(spark, folder, "documents")))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + o) AS g FROM (SELECT doc_id, i, unnest(range(0, 50)) AS o FROM again) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
removed AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(range(0, 50)) AS o FROM again)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.g), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document by the 49k word vocabulary, and which exceed 2,048."""
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary).withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingles are similar by 90 % or more."""
    return ngram_join.link(table(spark, folder, "documents"))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes s ON w.doc_id = s.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON w.doc_id = r.a
"""


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector projected on the eight leading components of all vectors, scaled to variance one."""
    vectors = table(spark, folder, "embeddings")
    return whitening.component_rows(vectors, whitening.fit(vectors))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the byte-level and the piece tokens of every document line up, and how common its linked pairs are."""
    files = alignment.read_tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, folder, "documents"), files)


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of every document, learned from three quarters of the labelled ones."""
    documents = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(documents, table(spark, folder, "labels"), ~held_out)
    return quality.above(quality.score(documents, model)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_chat_format": op3_chat_format,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_topk_search": op6_topk_search,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}

ORACLE: dict[str, str] = {
    "op3_chat_format": CHAT_SQL,
    "op4_decontamination": DECONTAMINATION_SQL,
    "op6_topk_search": TOPK_SQL,
    "op8_substring_dedup": SUBSTRING_SQL,
    "op10_ngram_join": NGRAM_SQL,
}
