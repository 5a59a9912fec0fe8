"""Near-duplicates: MinHash bands for candidates, odd sketches to verify them, full shingle sets to confirm links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, stored
from fleetlens.llm.components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch of the MinHash samples, and of that of the whole set.
SAMPLE_BITS, SET_BITS = 512, 1024
#: A pair goes on if its similarity, estimated from the samples, is at most this far (over five deviations) below the threshold.
MARGIN = 0.15
#: Larger buckets are compared in tiles of two parts of about this size.
PART = 4096

_M = (1 << 64) - 1
_random = np.random.default_rng(20240131)
_MULTIPLY = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A to Z in lower case (``bytes.lower`` and ``split`` touch ASCII only)."""
    return text.lower().split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct windows of five words; fewer words are one shingle, none are none."""
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS)), strict=False))


def shingle_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    for word in set(words):
        if word not in cache:
            cache[word] = xxhash.xxh3_64_intdigest(word)
    ids = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(words))):
        total = _mixed(total * _PRIME + ids[i : i + n])
    return np.unique(total)


def parity(values: np.ndarray, bits: int) -> bytes:
    """Odd sketch: bit i tells whether an odd number of values falls on i."""
    return np.packbits(np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, _M, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512, None] * _MULTIPLY + _ADD).min(axis=0))
    return least


FEATURES = "doc_id long, md5 string, n long, print binary, bands array<long>, samples binary, bitmap binary"
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)
_SAMPLE = np.arange(1, SAMPLES + 1, dtype=np.uint64)


def features(docs: DataFrame) -> DataFrame:
    """Per document: set size, fingerprint of the set, band keys, odd sketches of the MinHash samples and of the set."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cache: dict[bytes, int] = {}
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                hashes = shingle_hashes(words_of(text), cache)
                if not len(hashes):
                    rows.append((doc_id, "", 0, None, None, None, None))
                    continue
                least = min_hashes(hashes)
                keys = _BAND * _PRIME
                for part in least.reshape(BANDS, ROWS).T:
                    keys = _mixed(keys ^ part) * _PRIME
                rows.append((
                    doc_id, hashlib.md5(text).hexdigest(), len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), keys.astype(np.int64),
                    parity(_mixed(least + _SAMPLE * _PRIME), SAMPLE_BITS), parity(hashes, SET_BITS),
                ))
                if len(cache) > 100_000:
                    cache = {}
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    read = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return read.mapInPandas(made, FEATURES)


def _upper_bounds(rows: slice, bitmaps: np.ndarray, samples: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Greatest similarity that members ``rows`` can have with each member; -1 where the sketches say less than the threshold.

    Sets differ in at least as many shingles as their bitmaps in bits, so the
    bound from the whole sets is never too low. The samples differ in 2 k (1 - J)
    values on average; bits that met twice are made up for by the logarithm.
    """
    apart = np.bitwise_count(bitmaps[rows, None] ^ bitmaps[None]).sum(axis=2, dtype=np.int64)
    both = sizes[rows, None] + sizes[None]
    apart = np.maximum(apart, np.abs(sizes[rows, None] - sizes[None]))
    bound = (both - apart) / (both + apart)
    odd = np.bitwise_count(samples[rows, None] ^ samples[None]).sum(axis=2, dtype=np.int64)
    left = np.maximum(1 - 2 * odd / SAMPLE_BITS, 1e-9)
    estimate = 1 - (-SAMPLE_BITS / 2 * np.log(left)) / (2 * SAMPLES)
    near = (100 * bound >= percent - 1e-9) & (100 * estimate >= percent - 100 * MARGIN)
    return np.where(near, bound, -1.0)


def _tile_pairs(group: pd.DataFrame, all_pairs: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile whose sketches allow a link and whose components differ: all, or each member's best earlier one."""
    ids, part, component = (group[c].to_numpy() for c in ("doc_id", "part", "component"))
    bitmaps, samples = (np.frombuffer(b"".join(group[c]), np.uint64).reshape(len(group), -1) for c in ("bitmap", "samples"))
    sizes = group["n"].to_numpy()
    two = len(np.unique(part)) > 1
    found_a, found_b = [], []
    for at in range(0, len(group), 64):
        rows = slice(at, min(at + 64, len(group)))
        bound = _upper_bounds(rows, bitmaps, samples, sizes, percent)
        allowed = (ids[None] < ids[rows, None]) & (component[None] != component[rows, None])
        if two:  # pairs within a part have a tile of their own
            allowed &= part[None] != part[rows, None]
        bound = np.where(allowed, bound, -1.0)
        if all_pairs:
            i, j = np.nonzero(bound > 0)
        else:
            j = bound.argmax(axis=1)
            i = np.nonzero(bound[np.arange(len(j)), j] > 0)[0]
            j = j[i]
        found_a.append(ids[rows][i])
        found_b.append(ids[j])
    return np.concatenate(found_a), np.concatenate(found_b)


def sketched_pairs(members: DataFrame, all_pairs: bool, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a > b) to confirm, from rows sorted by bucket and tile; a task holds one tile at a time."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(group: list[pd.DataFrame]) -> pd.DataFrame:
            whole = pd.concat(group) if len(group) > 1 else group[0]
            a, b = _tile_pairs(whole, all_pairs, percent) if len(whole) > 1 else ((), ())
            return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64)})

        open_key, group = None, []
        for batch in batches:
            keys = batch["key"].to_numpy(), batch["tile"].to_numpy()
            cuts = np.nonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0))[0] + 1
            out = []
            for at, to in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if at == to:
                    continue
                key = (keys[0][at], keys[1][at])
                if group and key != open_key:
                    out.append(done(group))
                    group = []
                open_key = key
                group.append(batch.iloc[at:to])
            if out:
                yield pd.concat(out)
        if group:
            yield done(group)

    dealt = members.repartition("key", "tile").sortWithinPartitions("key", "tile", "doc_id")
    return dealt.mapInPandas(pairs, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, set()
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch["b"], batch["ta"], batch["tb"], strict=True):
                if b != last:
                    last, kept = b, shingles(words_of(tb))
                own = shingles(words_of(ta))
                common = len(own & kept)
                keep.append(100 * common >= percent * (len(own) + len(kept) - common))
            yield batch[["a", "b"]][np.array(keep, bool)]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``; links from ``percent`` similarity on.

    1. Documents with equal sets form a class, whose smallest doc_id stands for it from here on.
    2. Classes meet in buckets of equal band keys. A pair at 85 % misses all 32 bands of 6 with
       probability 3e-7, one at 80 % with 6e-5.
    3. In every bucket each class is paired with its nearest earlier one by the odd sketches; the pairs are confirmed
       on full sets, and the links give components.
    4. Of the pairs between different components that share a bucket, all that the sketches allow are confirmed
       too: links inside a component change nothing, so no others are needed, and a group of near copies costs about
       one confirmation a member. Comparing sketches grows with the square of a bucket, in tiles dealt over tasks.

    Null, empty or blank text: no shingles, its own component, kept. Rows without doc_id: no component, kept. Of
    rows that share a doc_id but not the text, the text of smallest MD5 stands for the document among others; equal sets
    are found by any. Extra columns are not read. An empty table gives none.
    """
    made = stored(features(docs))
    classes = made.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes)
    one = made.join(classes.withColumnRenamed("rep", "doc_id"), ["print", "doc_id"])
    spread = one.select("doc_id", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    spread = stored(spread.join(shared, "key"))
    suspects = spread.select("doc_id").distinct()
    first = F.min(F.struct("md5", "n", "samples", "bitmap")).alias("first")  # of rows that share a doc_id
    sketches = made.where("n > 0").join(suspects, "doc_id").groupBy("doc_id").agg(first)
    sketches = stored(sketches.select("doc_id", "first.n", "first.samples", "first.bitmap"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    # merged at every size: the suspects are a share of the corpus, so broadcasting them would only ever suit small ones
    read = read.where(F.col("text").cast("string").rlike(WORD)).join(sketches.select("doc_id").hint("merge"), "doc_id")
    read = read.groupBy("doc_id").agg(F.min(F.struct(F.md5("text").alias("md5"), "text")).alias("first"))
    texts = stored(read.select("doc_id", "first.text"))

    parts = F.ceil(F.col("members") / PART).cast("int")
    members = spread.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.withColumn("_other", other)
    low, high = F.least("part", "_other"), F.greatest("part", "_other")
    members = members.withColumn("tile", low * F.col("parts") + high).drop("_other", "parts", "members")
    members = members.join(sketches, "doc_id")

    first = sketched_pairs(members.withColumn("component", F.col("doc_id")), all_pairs=False, percent=percent)
    links = stored(confirmed(first, texts, percent))
    joined = stored(components(links))
    members = members.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = members.withColumn("component", F.coalesce("component", "doc_id"))
    rest = sketched_pairs(members, all_pairs=True, percent=percent)
    more = stored(confirmed(rest, texts, percent))
    final = joined
    if not more.isEmpty():
        final = stored(components(links.union(more)))

    out = made.select("doc_id", "n", "print").join(classes, "print", "left")
    out = out.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    missing = docs.where("doc_id IS NULL").select(F.col("text").cast("string").alias("text"))
    size = F.pandas_udf(lambda texts: texts.map(lambda t: len(shingles(words_of(t.encode() if t else None)))), "long")
    missing = missing.select(F.lit(None).cast("long"), size("text"), F.lit(None).cast("long"), F.lit(True))
    return out.union(missing)


def op10_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
