"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, context_mixing, decontaminate, edit_counts, line_chunks, ngram_join, pairwise_rank, prefix_trie, quality_rules, quotes, secret_scan, simhash, tiered_index
from .common import table


def tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of the public tokenizer that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.keeps("base")).alias("base_failed"), quality_rules.keeps().alias("kept"), "fail_bits")


def op3_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op5_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(table(spark, sf_dir, "documents"))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.counts(table(spark, sf_dir, "documents"), *tokenizer())


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its id, the characters left, the digest of what is left, and whether anything went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.char_length(F.coalesce("text", F.lit(""))).alias("before"))
    left = line_chunks.deduplicate(docs)
    return left.select("doc_id", F.char_length("text").cast("long").alias("chars_left"), (F.char_length("text") < F.col("before")).alias("changed"), F.sha2("text", 256).alias("left_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_rank.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_index.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.branched_nodes(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_benchmark_decontamination, op2_secret_scan, op3_quality_rules, op3_rule_ablations, op4_byte_bpe, op5_quotation_threads, op6_context_mixing, op7_edit_counts, op8_line_chunks, op9_ngram_jaccard, op10_pairwise_quality, op11_tiered_search, op12_prefix_trie, op13_simhash)}

_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM b WHERE len(w) >= 8),
h AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT b.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::BIGINT AS n_upper,
  (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaim,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN cov USING (doc_id)),
l AS (SELECT *, ((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_words >= 20 AND 10 * n_upper > 6 * word_chars THEN 8 ELSE 0 END)
  + (CASE WHEN n_words >= 20 AND 10 * n_exclaim > 4 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN n_words >= 20 AND n_dup_lines >= 5 AND 10 * n_dup_lines > 8 * n_lines THEN 32 ELSE 0 END) + (CASE WHEN n_words >= 20 AND 10 * n_stutter > 4 * n_words THEN 64 ELSE 0 END))::BIGINT AS fail_bits FROM m)
"""

# CRC-32 of a decimal number, bit by bit: fixed values are its polynomial and start.
_CRC = """xor(list_reduce(list_transform(string_split('_' || {c}::VARCHAR, ''), lambda x: CASE WHEN x = '_' THEN 4294967295::BIGINT ELSE ascii(x)::BIGINT END),
 lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

_TRIE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, n, {_CRC.format(c='c')} % 4 AS h, c - c % 20 AS b FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
re AS (SELECT k.c, t.p, r, x FROM k JOIN t ON t.c = k.b AND t.p <= k.h
 UNION ALL SELECT k.c, t.p - k.h + least(k.h, coalesce(kb.n, 0)), r, x FROM k JOIN t ON t.c = k.c AND t.p > k.h LEFT JOIN k kb ON kb.c = k.b),
pre AS (SELECT c, p::BIGINT AS d, x, sha256(array_to_string(list(sha256(concat(length(r), ':', r, x))) OVER (PARTITION BY c ORDER BY p), ',')) AS s FROM re
 UNION ALL SELECT c, 0, '', '' FROM k),
le AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
no AS (SELECT d, s, min(c) AS c, count(*) AS n, any_value(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS w FROM pre GROUP BY d, s),
pa AS (SELECT no.d, no.s, up.s AS ps FROM no JOIN pre up ON up.c = no.c AND up.d = no.d - 1),
ch AS (SELECT d - 1 AS d, ps AS s, count(*) AS k FROM pa GROUP BY d, ps),
su AS (SELECT a.d, a.s, sum(CASE WHEN ch.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((no.n - 1) * no.w)::BIGINT AS saved FROM no LEFT JOIN ch USING (d, s) JOIN pre a ON a.c = no.c AND a.d <= no.d GROUP BY a.d, a.s),
en AS (SELECT pre.d, pre.s, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM pre JOIN le USING (c, d) GROUP BY pre.d, pre.s)
SELECT no.c AS conv_id, no.d AS depth, up.c AS parent_conv_id, no.n AS n_convs, coalesce(ch.k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM no JOIN su USING (d, s) LEFT JOIN ch USING (d, s) LEFT JOIN pa USING (d, s) LEFT JOIN no up ON up.d = no.d - 1 AND up.s = pa.ps LEFT JOIN en ON en.d = no.d AND en.s = no.s"""

_TERMS = r"unnest(regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
_RANKED = f"""WITH dt AS (SELECT doc_id, {_TERMS.format(x='text')} AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY doc_id, t), dn AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
tot AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM dn), it AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, {_TERMS.format(x='text')} AS t FROM benchmark) GROUP BY item_id, t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN tot GROUP BY t, nn),
m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM dn CROSS JOIN tot),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM it JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

ORACLE_SQL = {
    "op11_tiered_search": _RANKED,
    "op12_prefix_trie": _TRIE,
    "op3_quality_rules": _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM l",
    "op3_rule_ablations": _LEDGER
    + """, r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('shouting', 8), ('exclaiming', 16), ('repeated_lines', 32), ('stuttering', 64)) AS t(rule, bit))
SELECT rule, sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN fail_bits = bit THEN 1 ELSE 0 END)::BIGINT AS "only",
sum(CASE WHEN fail_bits & (127 - bit) = 0 THEN 1 ELSE 0 END)::BIGINT AS kept_without FROM l CROSS JOIN r GROUP BY rule""",
    # The table holds no quoted line, so every message answers the turn before it; nested quotes are tested by brute force.
    "op5_quotation_threads": r"""SELECT conv_id, row_number() OVER w - 1 AS place, turn, lag(turn) OVER w AS reply_to, role, text,
0::BIGINT AS depth, 0::BIGINT AS n_passages, 0::BIGINT AS n_linked, NULL::BIGINT AS parent_conv, NULL::BIGINT AS parent_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
}
