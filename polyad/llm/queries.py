"""The queries of this subpackage over the whole intended tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm import bpe, chat, decontam, doubling, exact, quality, sharding, simhash, substrings, token_counts
from polyad.llm.common import read_table, shared_dir


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark)}/token-cache", blank_runs_count=False)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.drop_repeated_substrings(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.format_chats(rows).select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = doubling.drop_repeated_windows(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
}

def _doubled(unit: str, length: int) -> str:
    """CTEs from ``units`` (doc_id, pos, u): keys of every ``length`` units in a row, by digests of 1, 2, 4 ... units, as ``keyed`` (doc_id, pos, u, key), null at the end of a document."""
    ctes, size = [f"h1 AS (SELECT doc_id, pos, u, md5({unit}) AS k1 FROM units)"], 1
    while 2 * size <= length:
        held = ", ".join(f"k{2**i}" for i in range(size.bit_length()))
        ctes.append(f"h{2 * size} AS (SELECT doc_id, pos, u, {held}, md5(k{size} || lead(k{size}, {size}) OVER w) AS k{2 * size} FROM h{size} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))")
        size *= 2
    parts, at = [], 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            parts.append(f"lead(k{2**bit}, {at}) OVER w")
            at += 2**bit
    ctes.append(f"keyed AS (SELECT doc_id, pos, u, {' || '.join(parts)} AS key FROM h{size} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))")
    return ", ".join(ctes)


ORACLES: dict[str, str] = {
    "op3_suffix_dedup": rf"""
WITH units AS (
  SELECT doc_id, unnest(b) AS u, unnest(range(0, len(b))) AS pos FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents)
), {_doubled("u", substrings.LENGTH)}, starts AS (
  SELECT doc_id, pos, u, CASE WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM keyed
), marked AS (
  SELECT doc_id, pos, u, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {substrings.LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM starts
), edged AS (
  SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS first FROM marked
), found AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(first) AS BIGINT) AS n_spans, sha256(unhex(coalesce(string_agg(u, '' ORDER BY pos) FILTER (WHERE gone = 0), ''))) AS kept_sha256 FROM edged GROUP BY doc_id
)
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN found USING (doc_id)""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dg AS (SELECT doc_id, n, unnest(range(0, n)) AS pos, unnest(list_transform(range(1, n + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM (SELECT *, len(w) - 4 AS n FROM d WHERE len(w) >= 5)),
ig AS (SELECT item_id, m, g, count(*) AS c FROM (SELECT item_id, m, unnest(list_transform(range(1, m + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM (SELECT *, len(w) - 4 AS m FROM i WHERE len(w) >= 5)) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, pos, n, m, least(n, m) AS width FROM dg JOIN ig USING (g)),
windows AS (SELECT DISTINCT doc_id, item_id, m, width, least(greatest(p, 0), n - width) AS p FROM (SELECT *, unnest(range(pos - width + 1, pos + 1)) AS p FROM hits)),
common AS (SELECT doc_id, item_id, m, width, p, sum(least(cw, c)) AS met FROM (
  SELECT x.doc_id, x.item_id, x.m, x.width, x.p, y.g, count(*) AS cw FROM windows x JOIN dg y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.p AND x.p + x.width - 1 GROUP BY ALL) JOIN ig USING (item_id, m, g) GROUP BY ALL),
short AS (SELECT doc_id, item_id, min(p) AS p FROM (SELECT d.doc_id, i.item_id, unnest(range(0, len(d.w) - len(i.w) + 1)) AS p, d.w AS dw, i.w AS iw FROM d JOIN i ON len(i.w) BETWEEN 1 AND 4 AND len(d.w) >= len(i.w)) WHERE dw[p + 1:p + len(iw)] = iw GROUP BY ALL)
SELECT doc_id, item_id, similarity, start_word FROM (
  SELECT doc_id, item_id, met / (width + m - met) AS similarity, p AS start_word FROM common
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY met / (width + m - met) DESC, p) = 1) WHERE similarity >= 0.8
UNION ALL SELECT doc_id, item_id, 1.0, p FROM short""",
    "op10_substring_dedup": rf"""
WITH units AS (
  SELECT doc_id, unnest(b) AS u, unnest(range(0, len(b))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS b FROM documents)
), {_doubled("u", doubling.WORDS)}, starts AS (
  SELECT doc_id, pos, u, CASE WHEN key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 THEN 1 ELSE 0 END AS again FROM keyed
), marked AS (
  SELECT doc_id, pos, u, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {doubling.WORDS - 1} PRECEDING AND CURRENT ROW) AS gone FROM starts
), found AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(u, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN found USING (doc_id)""",
    "op4_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same,
         length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS esc_text,
         length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) AS esc_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(esc_text + CASE WHEN same THEN 8 ELSE 8 + 8 + 7 + esc_role END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
}
