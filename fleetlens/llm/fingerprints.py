"""Document fingerprints by one-permutation MinHash: one hash a shingle, densified bins, low-order bits, bias correction."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE, text_of

WORDS = 5
#: Bins, and low-order bits kept of each bin's least hash: one hex digit a bin, 1,024 bits a fingerprint.
BINS, BITS = 256, 4
DIGITS = "0123456789abcdef"
#: Documents of one bucket of neighbours in doc_id order, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 4_096, 65_536
#: Stands for a null doc_id where documents are ordered.
NO_ID = -(2**63)


def draws(bin_: int) -> tuple[int, int]:
    """Step and start of a bin's draws: the t-th is bin (start + t * step) mod 256. The step is odd, so all bins are drawn once."""
    drawn = hashlib.md5(f"bin {bin_}".encode()).digest()
    return drawn[0] | 1, drawn[1]


STEPS, STARTS = zip(*(draws(j) for j in range(BINS)), strict=True)
INVERSES = [pow(step, -1, BINS) for step in STEPS]
#: Draws tried one by one before all filled bins are ranked by their draw.
TRIES = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _table(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def shingles(text: Column) -> Column:
    """Windows of five words, A to Z in lower case; fewer words are one shingle, none are none."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_remove(F.split(lowered, f"[{SPACE}]+"), "")

    def windows(w: Column) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.size(w) - WORDS + 1), lambda i: F.concat_ws(" ", F.slice(w, i, WORDS)))
        return F.when(F.size(w) >= WORDS, all_of).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(_table([]).cast("array<string>"))

    return _let(words, windows)


def least_codes(hashes: Column) -> Column:
    """The low-order digit of each bin's least hash, -1 for an empty bin. The first two hex digits of a hash are its bin."""
    ends = _table(f"{j:02x}g" for j in range(BINS))  # sorts behind all hashes of the bin
    first = lambda s: lambda x, i: (i == 0) | (F.substring(x, 1, 2) != F.substring(F.get(s, i - 1), 1, 2))
    dense = _let(F.sort_array(F.concat(hashes, ends)), lambda s: F.filter(s, first(s)))
    digit = lambda x: F.instr(F.lit(DIGITS), F.substring(x, 32, 1)) - 1
    return F.transform(dense, lambda x: F.when(F.length(x) == 3, F.lit(-1)).otherwise(digit(x)))


def densified(codes: Column) -> Column:
    """Optimal densification: an empty bin takes the code of the first filled bin among its own random draws."""

    def filled(c: Column) -> Column:
        some = F.filter(F.transform(c, lambda x, b: F.when(x >= 0, b * 16 + x).otherwise(F.lit(-1))), lambda x: x >= 0)

        def drawn(some: Column) -> Column:
            def code(x: Column, j: Column) -> Column:
                out = F.when(x >= 0, x)
                for t in range(TRIES):
                    at = (F.get(_table(STARTS), j) + t * F.get(_table(STEPS), j)).bitwiseAND(BINS - 1)
                    out = out.when(F.get(c, at) >= 0, F.get(c, at))
                turn = lambda y: ((F.shiftright(y, 4) - F.get(_table(STARTS), j) + BINS) * F.get(_table(INVERSES), j)).bitwiseAND(BINS - 1)
                rest = F.array_min(F.transform(some, lambda y: turn(y) * 16 + y.bitwiseAND(15))).bitwiseAND(15)
                return out.otherwise(rest)

            return F.transform(c, code)

        return _let(some, drawn)

    return _let(codes, filled)


def fingerprint(text: str | Column) -> Column:
    """256 hex digits, the low four bits of the least shingle hash in each bin; a text without words has ''."""

    def packed(found: Column) -> Column:
        hashes = F.transform(found, lambda s: F.md5(s))
        digits = F.transform(densified(least_codes(hashes)), lambda c: F.substring(F.lit(DIGITS), c + 1, F.lit(1)))
        return F.when(F.size(found) == 0, F.lit("")).otherwise(F.array_join(digits, ""))

    return _let(shingles(text_of(text)), packed)


def likeness(left: str | Column, right: str | Column) -> Column:
    """Similarity of two shingle sets from their fingerprints, 0 to 1.

    Bins of sets of similarity J agree with probability J + (1 - J) / 16, as unequal hashes share their low four bits
    by chance; the share that agrees is corrected for that. Two empty fingerprints are alike (1), an empty and
    another are not (0).
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    corrected = (same * 16 - BINS) / F.lit(float(BINS * 15))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(corrected, F.lit(0.0)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next``, a struct of ``columns`` of the next document in order of doc_id.

    After the last comes the first. Rows without doc_id come first; rows that share a doc_id follow each other by the
    MD5 of their texts. Documents are dealt into buckets of neighbours by bounds from a range partitioning of the ids
    alone; each bucket also holds a copy of the first rows of the next one, so texts are shuffled once and no window
    spans more than a bucket.
    """
    key = F.coalesce("doc_id", F.lit(NO_ID))
    ids = docs.select(key.alias("_key"))
    buckets = min(MOST_BUCKETS, max(1, -(-ids.count() // BUCKET_ROWS)))
    firsts = ids.repartitionByRange(buckets, "_key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("_key").alias("first"))
    step = max(1, int(buckets**0.5))
    bounds = firsts.agg(F.sort_array(F.collect_list("first")).alias("all"))
    bounds = bounds.select(F.struct("all", F.filter("all", lambda x, i: i % step == 0).alias("coarse")).alias("b"))

    coarse = F.size(F.filter("_b.coarse", lambda x: x <= F.col("_key"))) - 1
    fine = F.size(F.filter(F.slice("_b.all", F.col("_coarse") * step + 1, step), lambda x: x <= F.col("_key"))) - 1
    dealt = docs.withColumn("_key", key).withColumn("_b", bounds.scalar())
    dealt = dealt.withColumn("_coarse", coarse).withColumn("_bucket", F.col("_coarse") * step + fine)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guard"))
    before = F.pmod(F.col("_bucket") - 1, F.greatest(F.size("_b.all"), F.lit(1)))
    guard = F.struct(before.alias("bucket"), F.lit(True).alias("guard"))
    leads = F.col("_key") == F.get("_b.all", F.col("_bucket"))
    dealt = dealt.withColumn("_at", F.explode(F.when(leads, F.array(own, guard)).otherwise(F.array(own))))
    dealt = dealt.select(*docs.columns, "_key", F.col("_at.bucket").alias("_bucket"), F.col("_at.guard").alias("_guard"))
    dealt = dealt.repartition(-(-buckets // 2), "_bucket")  # tasks follow the number of documents, not the session's partitions
    order = Window.partitionBy("_bucket").orderBy("_guard", "_key", F.md5("text"))
    dealt = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return dealt.where("NOT _guard").drop("_key", "_bucket", "_guard")


def edited_text(text: str, next_text: str, chars: str) -> Column:
    """The text with its last quarter replaced by the beginning of the next one."""
    quarter = F.floor(F.col(chars) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.col(chars).cast("int") - quarter), F.substring(next_text, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``fingerprint`` of every row; a null text counts as empty, extra columns are not read.

    Equal texts have equal fingerprints. Rows that share a doc_id, and rows without one, are documents of their own. An empty table gives none.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return read.withColumn("fingerprint", fingerprint("text"))


def op12_query(docs: DataFrame) -> DataFrame:
    near = with_next(fingerprints(docs), ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long"))
    near = near.withColumn("edited", edited_text("text", "next.text", "n_chars"))
    near = near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint("edited").alias("edited_fingerprint"), F.col("next.fingerprint").alias("_next"),
    )
    return near.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next").alias("near_next"),
    )


def _list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


ORACLE = f"""
WITH numbered AS (
  SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS own,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS pos FROM documents
), pairs AS (
  SELECT *, length(own) AS n_chars, coalesce(lead(own) OVER (ORDER BY pos), first_value(own) OVER (ORDER BY pos)) AS follower,
    coalesce(lead(pos) OVER (ORDER BY pos), first_value(pos) OVER (ORDER BY pos)) AS next_pos FROM numbered
), texts AS (
  SELECT pos, 0 AS which, own AS t FROM pairs
  UNION ALL SELECT pos, 1, left(own, n_chars - n_chars // 4) || left(follower, n_chars // 4) FROM pairs
), split AS (
  SELECT pos, which, list_filter(string_split_regex(translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[{SPACE}]+'), lambda w: w <> '') AS w FROM texts
), hashed AS (
  SELECT pos, which, md5(unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
    ELSE [array_to_string(w, ' ')] END)) AS h FROM split WHERE len(w) > 0
), least AS (
  SELECT pos, which, ('0x' || left(h, 2))::INT AS bin, right(min(h), 1) AS digit FROM hashed GROUP BY ALL
), empty_bins AS (
  SELECT pos, which, bin FROM (SELECT DISTINCT pos, which FROM least) CROSS JOIN range({BINS}) r(bin)
  ANTI JOIN least USING (pos, which, bin)
), taken AS (
  SELECT e.pos, e.which, e.bin, arg_min(f.digit, ((f.bin - ({_list(STARTS)})[e.bin + 1] + {BINS}) * ({_list(INVERSES)})[e.bin + 1]) % {BINS}) AS digit
  FROM empty_bins e JOIN least f ON e.pos = f.pos AND e.which = f.which GROUP BY ALL
), prints AS (
  SELECT pos, which, string_agg(digit, '' ORDER BY bin) AS print
  FROM (SELECT * FROM least UNION ALL SELECT pos, which, bin, digit FROM taken) GROUP BY pos, which
), joined AS (
  SELECT p.doc_id, p.n_chars, x.t AS edited, coalesce(a.print, '') AS fa, coalesce(b.print, '') AS fb, coalesce(c.print, '') AS fc
  FROM pairs p JOIN texts x ON x.pos = p.pos AND x.which = 1 LEFT JOIN prints a ON a.pos = p.pos AND a.which = 0
  LEFT JOIN prints b ON b.pos = p.pos AND b.which = 1 LEFT JOIN prints c ON c.pos = p.next_pos AND c.which = 0
), matched AS (
  SELECT *, len(list_filter(range(1, {BINS + 1}), lambda i: fa[i] = fb[i])) AS ab, len(list_filter(range(1, {BINS + 1}), lambda i: fa[i] = fc[i])) AS ac FROM joined
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN fa = '' OR fb = '' THEN 0.0::DOUBLE ELSE greatest((16 * ab - {BINS}) / {BINS * 15}::DOUBLE, 0.0::DOUBLE) END AS near_edited,
  CASE WHEN fa = fc THEN 1.0::DOUBLE WHEN fa = '' OR fc = '' THEN 0.0::DOUBLE ELSE greatest((16 * ac - {BINS}) / {BINS * 15}::DOUBLE, 0.0::DOUBLE) END AS near_next
FROM matched
"""
