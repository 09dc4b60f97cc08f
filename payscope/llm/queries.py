"""The registered queries of the subpackage and their DuckDB statements."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

from . import (bpe, line_spread, masked_lm, packing, piecewise, preferences, quality, ranked_search, sharding, simhash,
               source_schedule, statements, token_store, turn_repair)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judged(table(spark, folder, "documents")).select(
        "row.doc_id", *[f"quality.{m}" for m in measures], "base_failed", "kept")


def histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; 24 shards of nearly equal bytes."""
    return sharding.shard(table(spark, folder, "documents"), 24).select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited form, and their likeness."""
    return piecewise.compared_with_edit_and_next(table(spark, folder, "documents")).drop("next_fingerprint")


def preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and masked completions of each conversation against itself with its partner's ending."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    pairs = preferences.format_pairs(preferences.with_partner_endings(table(spark, folder, "conversations")))
    return pairs.withColumns({c: spans(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def masked_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them."""
    return masked_lm.score_by_own_corpus(table(spark, folder, "documents"))


def line_spread_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, lines removed and the digest of the cleaned text of every document."""
    return line_spread.remove_boilerplate(table(spark, folder, "documents")).select(
        "row.doc_id", "n_lines", "n_removed", F.length("clean").cast("long").alias("clean_chars"),
        F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as token files and read back."""
    store = shared_dir(spark, "token-store")
    token_store.write(table(spark, folder, "documents"), store, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_store.read(spark, store, digest=True)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded over distinct words, and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.per_document(encoded, spark, ranks)


def nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document in windows of 1024 ids."""
    return pieces(table(spark, folder, "documents"))


def pieces(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, window=1024, digest=True)


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def pipelined_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=20)


def hirschberg_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest audit and repaired digest of every conversation after damage."""
    turns = table(spark, folder, "conversations")
    repair = turn_repair.Repair(turn_repair.damage(turns))
    found = repair.report().withColumnRenamed("conv_id", "of")
    digests = repair.digests().withColumnRenamed("conv", "known")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (turns.select("conv_id").distinct()
            .join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
            .join(digests, F.col("conv_id").eqNullSafe(F.col("known")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return source_schedule.mix(table(spark, folder, "documents")).taken.select(
        "doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_shards": histogram_shards,
    "op2_token_files": token_files,
    "op3_preference_pairs": preference_pairs,
    "op4_bpe_round_trip": bpe_round_trip,
    "op5_nnls_packing": nnls_packing,
    "op6_piecewise_fingerprints": piecewise_fingerprints,
    "op7_masked_lm_scores": masked_lm_scores,
    "op8_line_spread_dedup": line_spread_dedup,
    "op9_quality_rules": quality_rules,
    "op10_simhash_near_dedup": simhash_near_dedup,
    "op11_pipelined_search": pipelined_search,
    "op12_hirschberg_repair": hirschberg_repair,
    "op13_source_schedule": source_mix,
}

_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SHARE = "coalesce({} * 1.0::DOUBLE / nullif({}, 0), {})"

_SPANS = """list_aggregate(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'),
  lambda i: (coalesce(list_sum(list_transform({0}[1:i - 1], lambda t: length(t.s))), 0) + 13 + length({0}[i].role))::BIGINT::VARCHAR
    || '-' || (list_sum(list_transform({0}[1:i], lambda t: length(t.s))))::BIGINT::VARCHAR), 'string_agg', ',')"""

STATEMENTS: dict[str, str] = {
    "op3_preference_pairs": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final FROM t),
e AS (SELECT * FROM z WHERE final),
sides AS (
  SELECT conv_id, true AS chosen, turn, role, text FROM z
  UNION ALL SELECT conv_id, false, turn, role, text FROM z WHERE NOT final
  UNION ALL SELECT a.conv_id, false, a.turn, b.role, b.text FROM e a JOIN e b ON b.conv_id = xor(a.conv_id, 1)),
shown AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM sides),
p AS (SELECT conv_id,
    coalesce(list({{'role': role, 's': s}} ORDER BY turn, role, text) FILTER (WHERE chosen), []) AS c,
    coalesce(list({{'role': role, 's': s}} ORDER BY turn, role, text) FILTER (WHERE NOT chosen), []) AS r
  FROM shown GROUP BY conv_id),
n AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])[1] - 1,
                         least(len(c), len(r))) AS n FROM p),
x AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n)
SELECT conv_id AS pair_id, n AS n_prompt_turns,
  coalesce(list_aggregate(list_transform(p, lambda t: t.s), 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(c, lambda t: t.s), 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate(list_transform(r, lambda t: t.s), 'string_agg', ''), '') AS rejected,
  coalesce({_SPANS.format("c")}, '') AS chosen_spans, coalesce({_SPANS.format("r")}, '') AS rejected_spans
FROM x""",
    "op8_line_spread_dedup": f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, source, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM d),
l AS (SELECT doc_id, source, no, trim(regexp_replace(line, '[\\x09-\\x0D]', ' ', 'g')) AS bare FROM u),
b AS (SELECT bare, min({{'d': doc_id, 'n': no}}) AS first FROM l
      WHERE bare <> '' AND len(string_split_regex(bare, ' +')) >= {line_spread.MIN_WORDS}
      GROUP BY bare HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
g AS (SELECT doc_id, list(no) AS gone FROM l JOIN b USING (bare)
      WHERE doc_id <> first.d OR no <> first.n GROUP BY doc_id),
c AS (SELECT doc_id, ls, text, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN text ELSE coalesce(
        list_aggregate(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), 'string_agg', chr(10)), '') END AS clean
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, n_removed, length(clean) AS clean_chars, md5(clean) AS clean_md5 FROM c""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS ls FROM d),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_aggregate(ws[i:i + 7], 'string_agg', ' ')) AS times
            FROM starts),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
              SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(list_aggregate(ws, 'string_agg', '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_intersect(ws, [{", ".join(f"'{x}'" for w in dict.fromkeys(quality.STOP_WORDS)
                                           for x in (w, w.capitalize()))}])) AS n_stop,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha,
        len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•●]'))) AS n_bullet,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis
      FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 20
  AND {_SHARE.format("word_chars", "n_words", 5)} BETWEEN 2 AND 14 AND {_SHARE.format("n_symbols", "n_words", 0)} <= 0.1
  AND n_stop >= 2 AND {_SHARE.format("n_alpha", "n_words", 1)} >= 0.6
  AND {_SHARE.format("n_dup_lines", "n_lines", 0)} <= 0.3 AND {_SHARE.format("n_bullet", "n_lines", 0)} <= 0.9
  AND {_SHARE.format("n_ellipsis", "n_lines", 0)} <= 0.3 AS kept
FROM b""",
    "op11_pipelined_search": statements.SEARCH,
    "op12_hirschberg_repair": statements.REPAIR,
    "op13_source_schedule": statements.MIX,
}
