"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import draw_52, stored, text_of

SEED = "mix-1"
ALPHA = 0.7
EPOCHS = 1.0


def target_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS
) -> DataFrame:
    """Mean repetitions of a document per source: one row per source (null is one).

    A source shall make up its weight of ``epochs`` times all bytes. Weights
    are given per source (sources not named get 0; they need not sum to 1), or
    else follow bytes ** ``alpha``. Sources without bytes are repeated
    ``epochs`` times on average, so that their (empty) documents stay in the
    mix. ``cdf`` holds the Poisson distribution summed up from 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(text_of("text"))).cast("long").alias("source_bytes"))
    if weights is None:
        weight = F.when(F.col("source_bytes") > 0, F.pow(F.col("source_bytes").cast("double"), F.lit(float(alpha))))
    else:
        weight = F.lit(None).cast("double")
        for name, value in weights.items():
            weight = F.when(F.col("source") == F.lit(name), F.lit(float(value))).otherwise(weight)
        weight = F.when(F.col("source_bytes") > 0, F.coalesce(weight, F.lit(0.0)))
    sizes = stored(sizes.withColumn("weight", F.coalesce(weight, F.lit(0.0))))
    # two sums over one row per source
    whole = sizes.agg(F.sum("source_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    all_bytes, all_weight = whole.first()
    share = F.col("weight") / F.lit(float(all_weight or 1.0))
    rate = F.when(
        F.col("source_bytes") > 0, F.lit(float(epochs)) * F.lit(float(all_bytes or 0)) * share / F.col("source_bytes")
    ).otherwise(F.lit(float(epochs)))
    return stored(sizes.withColumn("rate", rate).withColumn("cdf", poisson_cdf(F.col("rate"))))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until what is left is below 2**-53; summed in logarithms, so any rate will do."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(
        F.lit(0.0).alias("log_factorial"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf")
    )

    def step(acc: Column, k: Column) -> Column:
        logs = acc["log_factorial"] + F.log(k.cast("double"))
        total = acc["sum"] + F.exp(k * F.log(rate) - rate - logs)
        return F.struct(
            logs.alias("log_factorial"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf")
        )

    made = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])
    return F.when(rate > 0, made).otherwise(F.array(F.lit(1.0)))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    epochs: float = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """All columns of ``docs``, each document as often as its Poisson draw says, shuffled over the corpus.

    The draw is a uniform number hashed from seed and ``doc_id``, inverted
    through the Poisson distribution of the source's rate: the same whatever
    the partitions. ``copy`` counts 1 to ``n_copies``. Rows are dealt to
    partitions and ordered within by ``shuffle_key``, a hash of seed, document
    and copy; sorting by it gives the order of the whole corpus. Documents drawn
    zero times do not appear.

    Null source: a source of its own. Null or empty text: no bytes, drawn at
    the rate of its source. Rows with one doc_id (or none) share a draw.
    An empty table gives none. Other columns ride along; columns named like
    those added here are replaced.
    """
    own = ("source_bytes", "weight", "rate", "cdf", "copy", "n_copies", "shuffle_key")
    docs = docs.drop(*own)
    rates = target_rates(docs, weights, alpha, epochs).select(
        F.col("source").alias("_source"), "source_bytes", "rate", "cdf"
    )
    drawn = draw_52(seed, "doc_id") / F.lit(float(2**52))
    copies = docs.join(rates, docs["source"].eqNullSafe(rates["_source"])).drop("_source")
    copies = copies.withColumn("_u", drawn)
    copies = copies.withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("_u")))).drop("cdf", "_u")
    copies = copies.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    copies = copies.withColumn("shuffle_key", draw_52(f"{seed}-order", "doc_id", "copy"))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op1_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "source_bytes", "copy", "n_copies", "shuffle_key", "text")


ORACLE = f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS source_bytes FROM documents GROUP BY source
), weighed AS (
  SELECT *, CASE WHEN source_bytes > 0 THEN pow(source_bytes::DOUBLE, {ALPHA}) ELSE 0 END AS weight FROM sizes
), rated AS (
  SELECT source, source_bytes, CASE WHEN source_bytes > 0
    THEN {EPOCHS} * (SELECT sum(source_bytes) FROM weighed)::DOUBLE * (weight / (SELECT sum(weight) FROM weighed))
      / source_bytes ELSE {EPOCHS} END AS rate FROM weighed
), terms AS (
  SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p
  FROM rated, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM
    (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, r.source_bytes, d.text,
    len(list_filter(c.cdf, lambda x: x <=
      ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52)))::INT AS n_copies
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
    JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
), copies AS (
  SELECT *, unnest(range(1, n_copies + 1))::INT AS copy FROM drawn
)
SELECT doc_id, source, source_bytes, copy, n_copies,
  ('0x' || substr(md5('{SEED}-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 13))::BIGINT AS shuffle_key,
  text
FROM copies
"""
