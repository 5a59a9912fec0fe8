"""Packing: optimal length buckets, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE, draw_52, text_of, word_count

SEED = "pack-1"
MAX_TOKENS = 2048
BUCKETS = 8
BATCH_TOKENS = 32768
#: The first 12 bits of the order key: the order of a bucket is counted up in so many parts.
SLOT_BITS = 12


def sequences(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per sequence: texts of over ``max_tokens`` words are cut into consecutive pieces, nothing is lost.

    A token is a word with the white space before it (the last one also takes
    what follows), so the pieces of a document joined give its text back.
    """
    pieces = F.regexp_extract_all(text_of("text"), F.lit(rf"[{SPACE}]*[^{SPACE}]+(?:[{SPACE}]+\z)?"), F.lit(0))
    docs = docs.withColumn("_n", word_count("text"))
    docs = docs.withColumn("_words", F.when(F.col("_n") > max_tokens, pieces))
    last = F.greatest(F.floor((F.col("_n") - 1) / F.lit(max_tokens)), F.lit(0))
    docs = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    docs = docs.withColumn("start_token", F.col("chunk") * max_tokens)
    docs = docs.withColumn("n_tokens", F.least(F.col("_n") - F.col("start_token"), F.lit(max_tokens)).cast("long"))
    piece = F.concat_ws("", F.slice("_words", (F.col("start_token") + 1).cast("int"), F.lit(max_tokens)))
    docs = docs.withColumn("sequence_text", F.when(F.col("_words").isNull(), text_of("text")).otherwise(piece))
    return docs.drop("_n", "_words")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that together pad the fewest tokens; ties take smaller lengths."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    far = np.iinfo(np.int64).max // 4
    best, back = np.full(n + 1, far), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, take = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            take[j] = int(np.argmin(cost))
            new[j] = cost[take[j]]
        best = new
        back.append(take)
    ends, j = [], n
    for take in reversed(back):
        ends.append(int(lengths[j - 1]))
        j = int(take[j])
    return ends[::-1]


def pack(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    seed: str = SEED,
) -> DataFrame:
    """Every sequence with its bucket, batch and place in the batch.

    The histogram of lengths over all sequences has at most ``max_tokens`` + 1
    rows, whatever the input; dynamic programming over it finds the bucket
    boundaries of least padding. A batch holds as many rows as fit the token
    budget when each is padded to the bucket's length (one at least). Within a
    bucket the order is hashed from seed, doc_id and chunk; the place of a row is
    the count of rows in lower slots of the hash plus its rank in its slot, so no
    bucket is ever sorted by one task.

    Adds ``chunk``, ``start_token``, ``n_tokens``, ``sequence_text``, ``bucket``
    (from 0), ``bucket_tokens``, ``batch`` and ``batch_row`` (from 0, per
    bucket), ``padding``; columns of these names are replaced, others stay.
    A null, empty or blank text is one sequence of no tokens. Equal rows take
    neighbouring places. An empty table gives none.
    """
    made = ("chunk", "start_token", "n_tokens", "sequence_text", "bucket", "bucket_tokens", "batch", "batch_row", "padding")
    rows = sequences(docs.drop(*made), max_tokens)
    histogram = rows.groupBy("n_tokens").count().collect()  # at most max_tokens + 1 rows
    ends = optimal_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in reversed(range(len(ends))):
        bucket = F.when(F.col("n_tokens") <= ends[k], F.lit(k)).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= ends[k], F.lit(ends[k]).cast("long")).otherwise(size)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", size)
    rows = rows.withColumn("_key", draw_52(seed, "doc_id", "chunk"))
    rows = rows.withColumn("_slot", F.shiftright("_key", 52 - SLOT_BITS))

    per_slot = rows.groupBy("bucket", "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    below = Window.partitionBy("bucket").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = per_slot.withColumn("_before", F.coalesce(F.sum("_rows").over(below), F.lit(0))).drop("_rows")

    rank = F.row_number().over(Window.partitionBy("bucket", "_slot").orderBy("_key", "doc_id", "chunk", "n_tokens"))
    rows = rows.withColumn("_rank", rank).join(per_slot, ["bucket", "_slot"])
    per_batch = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1))
    place = F.col("_before") + F.col("_rank") - 1
    rows = rows.withColumn("batch", F.floor(place / per_batch).cast("long"))
    rows = rows.withColumn("batch_row", (place - F.col("batch") * per_batch).cast("long"))
    rows = rows.withColumn("padding", F.col("bucket_tokens") - F.col("n_tokens"))
    return rows.drop("_key", "_slot", "_rank", "_before")


def op2_query(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "doc_id", "chunk", "start_token", "n_tokens", "bucket", "bucket_tokens", "batch", "batch_row", "padding", "sequence_text"
    )


ORACLE = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS w,
    regexp_extract(coalesce(text, ''), '[\x20\x09-\x0D]*\z') AS tail
  FROM documents
), sequences AS (
  SELECT doc_id, chunk, chunk * {MAX_TOKENS} AS start_token, least(len(w) - chunk * {MAX_TOKENS}, {MAX_TOKENS}) AS n_tokens,
    CASE WHEN len(w) <= {MAX_TOKENS} THEN text ELSE
      array_to_string(w[chunk * {MAX_TOKENS} + 1 : (chunk + 1) * {MAX_TOKENS}], '') ||
      CASE WHEN (chunk + 1) * {MAX_TOKENS} >= len(w) THEN tail ELSE '' END END AS sequence_text
  FROM words, LATERAL (SELECT unnest(range(0, greatest((len(w) + {MAX_TOKENS} - 1) // {MAX_TOKENS}, 1))) AS chunk)
), lengths AS (
  SELECT n_tokens, count(*) AS n FROM sequences GROUP BY n_tokens
), summed AS (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens, sum(n) OVER (ORDER BY n_tokens)::BIGINT AS c,
    sum(n * n_tokens) OVER (ORDER BY n_tokens)::BIGINT AS s FROM lengths
), ends AS (
  SELECT j, n_tokens AS top, c, s FROM summed UNION ALL SELECT 0, NULL, 0, 0
), best AS (
  SELECT 0 AS k, j, CASE WHEN j = 0 THEN 0::BIGINT ELSE 1000000000000000::BIGINT END AS cost, []::BIGINT[] AS tops FROM ends
  UNION ALL
  SELECT k + 1, j, min(cost), arg_min(tops, (cost, i)) FROM (
    SELECT b.k, e.j, b.j AS i, b.cost + e.top * (e.c - p.c) - (e.s - p.s) AS cost, list_append(b.tops, e.top) AS tops
    FROM best b JOIN ends p ON p.j = b.j JOIN ends e ON e.j > b.j
    WHERE b.k < least({BUCKETS}, (SELECT count(*) FROM lengths)))
  GROUP BY k, j
), chosen AS (
  SELECT unnest(tops) AS top, unnest(range(0, len(tops))) AS bucket FROM best
  WHERE k = least({BUCKETS}, (SELECT count(*) FROM lengths)) AND j = (SELECT count(*) FROM lengths)
), placed AS (
  SELECT s.*, (SELECT min(bucket) FROM chosen WHERE top >= s.n_tokens) AS bucket,
    (SELECT min(top) FROM chosen WHERE top >= s.n_tokens) AS bucket_tokens,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || chunk), 1, 13))::BIGINT AS key
  FROM sequences s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id, chunk, n_tokens) - 1 AS place,
    greatest({BATCH_TOKENS} // greatest(bucket_tokens, 1), 1) AS per_batch FROM placed
)
SELECT doc_id, chunk, start_token, n_tokens::BIGINT AS n_tokens, bucket::INT AS bucket, bucket_tokens, place // per_batch AS batch,
  place % per_batch AS batch_row, bucket_tokens - n_tokens AS padding, sequence_text FROM ranked
"""
