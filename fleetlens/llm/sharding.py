"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import draw_52, shared_folder, stored, text_of

SEED = "shard-1"
#: 2 ** SLOT_BITS virtual slots, for good: records never change their slot.
SLOT_BITS = 13
SHARDS = 24
#: Bytes of a record besides its text.
OVERHEAD = 8


def with_slots(docs: DataFrame, seed: str = SEED, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Adds ``size`` (UTF-8 bytes of the text, null none, plus 8) and ``virtual_slot``, hashed from ``doc_id``."""
    size = (F.octet_length(text_of("text")) + OVERHEAD).cast("long")
    return docs.withColumn("size", size).withColumn(
        "virtual_slot", F.shiftright(draw_52(seed, "doc_id"), 52 - slot_bits)
    )


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """Bytes and rows per slot: at most 2 ** slot_bits rows, whatever the input."""
    return slotted.groupBy("virtual_slot").agg(
        F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows")
    )


def _dealt(slots: Column, loads: Column) -> Column:
    """Each slot, in the given order, to the shard with the least bytes so far (the lowest of equals)."""
    start = F.struct(loads.alias("loads"), F.lit(None).cast("array<int>").alias("shards"))

    def step(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loaded = F.transform(
            acc["loads"], lambda load, i: load + F.when(i + 1 == to, slot["slot_bytes"]).otherwise(F.lit(0).cast("long"))
        )
        return F.struct(
            loaded.alias("loads"), F.concat(F.coalesce(acc["shards"], F.array().cast("array<int>")), F.array(to - 1)).alias("shards")
        )

    return F.aggregate(slots, start, step, lambda acc: F.coalesce(acc["shards"], F.array().cast("array<int>")))


def _in_one_row(sizes: DataFrame) -> DataFrame:
    """All slots as one array, largest first: the number of slots bounds it."""
    order = F.struct((-F.col("slot_bytes")).alias("o"), "virtual_slot", "slot_bytes")
    return sizes.agg(F.array_sort(F.collect_list(order)).alias("slots"))


def initial_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: slots, largest first, each to the shard with the least bytes so far.

    Columns ``version``, ``virtual_slot``, ``shard``. Slots without records are not
    in ``sizes``; ``shard_records`` never needs them, and ``rebalanced_map`` adds
    slots that gained records since.
    """
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    dealt = _in_one_row(sizes).withColumn("to", _dealt(F.col("slots"), loads))
    return dealt.select(F.explode(F.arrays_zip("slots", "to")).alias("s")).select(
        F.lit(1).alias("version"), F.col("s.slots.virtual_slot").alias("virtual_slot"), F.col("s.to").alias("shard")
    )


def rebalanced_map(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: only as many slots change their shard as must.

    Each shard keeps its slots, smallest first, as long as they fit an equal
    share of the bytes; the others, and slots new to the map, are dealt, largest
    first, to the shards with the least bytes. A shard that no longer exists
    keeps nothing; one that is new starts empty and takes what others give up.
    """
    known = sizes.join(old.select("virtual_slot", "shard", F.col("version").alias("_v")), "virtual_slot", "left")
    share = sizes.agg((F.sum("slot_bytes") / shards).alias("_share"), F.lit(1).alias("_one"))
    upto = Window.partitionBy("shard").orderBy("slot_bytes", "virtual_slot")
    known = known.withColumn("_upto", F.sum("slot_bytes").over(upto)).withColumn("_one", F.lit(1)).join(share, "_one")
    stays = F.coalesce((F.col("shard") < shards) & (F.col("_upto") <= F.col("_share")), F.lit(False))
    known = stored(known.withColumn("_stays", stays).select("virtual_slot", "slot_bytes", "shard", "_stays", "_v"))
    kept = known.where("_stays")
    used = kept.groupBy("shard").agg(F.sum("slot_bytes").alias("b"))
    used = used.agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("used"))
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.coalesce(F.try_element_at("used", i), F.lit(0).cast("long")),
    )
    free = _in_one_row(known.where("NOT _stays")).crossJoin(used)  # one row each
    free = free.withColumn("to", _dealt(F.col("slots"), loads))
    free = free.select(F.explode(F.arrays_zip("slots", "to")).alias("s")).select(
        F.col("s.slots.virtual_slot").alias("virtual_slot"), F.col("s.to").alias("shard")
    )
    version = old.agg(F.max("version") + 1).first()[0]
    return kept.select("virtual_slot", "shard").unionByName(free).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the maps in ``folder``. Versions are never changed; writing one twice fails."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version is not None:
        slot_map.drop("version").write.mode("error").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    maps = spark.read.parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def kept_map(spark: SparkSession, sizes: DataFrame, folder: str, shards: int) -> DataFrame:
    """The map in ``folder`` for these slots and shards: version 1 if there is none yet, else the newest, edited into a new
    version only if slots are new to it or the shards are others. Read back from the folder."""
    try:
        now = load_map(spark, folder)
    except AnalysisException:  # no map yet
        store_map(initial_map(sizes, shards), folder)
        return load_map(spark, folder)
    unknown = sizes.join(now, "virtual_slot", "left_anti").limit(1).count()
    if unknown or now.agg(F.max("shard") + 1).first()[0] != shards:
        store_map(rebalanced_map(now, sizes, shards), folder)
    return load_map(spark, folder)


def moves(old: DataFrame, new: DataFrame, sizes: DataFrame) -> DataFrame:
    """What one version moves against another: ``from_shard``, ``to_shard`` with ``slots``, ``rows`` and ``bytes``."""
    both = old.select("virtual_slot", F.col("shard").alias("from_shard")).join(
        new.select("virtual_slot", F.col("shard").alias("to_shard")), "virtual_slot"
    )
    moved = both.where("from_shard <> to_shard").join(sizes, "virtual_slot").groupBy("from_shard", "to_shard")
    return moved.agg(F.count(F.lit(1)).alias("slots"), F.sum("slot_rows").alias("rows"), F.sum("slot_bytes").alias("bytes"))


def shard_records(slotted: DataFrame, slot_map: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot``, the place in the shard: gapless from 0, by virtual slot, doc_id, then size.

    The place is the count of rows in the shard's lower slots plus the rank in
    the own slot, so no shard is sorted by one task. Further columns of the map
    (but ``version``) are added too.
    """
    sizes = slot_bytes(slotted) if sizes is None else sizes
    own = [c for c in slot_map.columns if c != "version"]
    sizes = stored(sizes.join(slot_map.select(*own), "virtual_slot"))
    below = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("slot_rows").over(below), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    placed = slotted.withColumn("_rank", rank)
    placed = placed.join(starts.select(*own, "_start"), "virtual_slot")
    return placed.withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_rank", "_start")


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    slot_bits: int = SLOT_BITS,
    folder: str | None = None,
    next_shards: int | None = None,
) -> DataFrame:
    """Documents with ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``slot`` and ``next_shard``.

    The map is kept in ``folder`` (a new one below the shared folder if none is given): its first version deals the
    slots, a later call edits it for new slots or another number of shards. With ``next_shards`` the map is then
    rebalanced to that many shards, and ``next_shard`` is where the next version puts the row (else null).

    Law: ``bytes``, shards are of nearly equal size. A record's slot follows from its doc_id alone, so equal texts
    may lie in several shards. Null text counts as empty; a null doc_id hashes like an empty one; equal doc_ids
    share a virtual slot. An empty table gives none, and no map. Columns of the added names are replaced, others stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "text_crc32", "virtual_slot", "shard", "slot", "next_shard")
    slotted = with_slots(docs, seed, slot_bits)
    slotted = slotted.withColumn("text_crc32", F.crc32(text_of("text").cast("binary")).cast("long"))
    sizes = stored(slot_bytes(slotted))
    folder = folder or f"{shared_folder(spark)}/maps/{uuid.uuid4().hex}"
    if sizes.isEmpty():
        slot_map = initial_map(sizes, shards).withColumn("next_shard", F.lit(None).cast("int"))
    else:
        slot_map = kept_map(spark, sizes, folder, shards)
        later = kept_map(spark, sizes, folder, next_shards) if next_shards else slot_map.where("false")
        slot_map = slot_map.join(later.select("virtual_slot", F.col("shard").alias("next_shard")), "virtual_slot", "left")
    return shard_records(slotted, slot_map, sizes)


def op9_query(docs: DataFrame) -> DataFrame:
    """Beside the placing: ``virtual_slot``, and ``next_shard`` under the map's next version, with one shard more."""
    placed = shard(docs.select("doc_id", "text").withColumn("law", F.lit("bytes")), next_shards=SHARDS + 1)
    return placed.select(
        "doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("next_shard").cast("int"),
    )


def _deal_sql(name: str, order: str, start: str) -> str:
    """A recursive table ``name`` (i, virtual_slot, loads, shard): the slots of ``order``, each to the least load so far."""
    least = "list_position(d.loads, list_min(d.loads))"
    return f"""{name}(i, virtual_slot, loads, shard) AS (
  SELECT 0::BIGINT, NULL::BIGINT, {start}, NULL::INT
  UNION ALL
  SELECT o.i, o.virtual_slot, list_transform(d.loads, lambda x, j: x + CASE WHEN j = {least} THEN o.slot_bytes ELSE 0 END), ({least} - 1)::INT
  FROM {name} d JOIN {order} o ON o.i = d.i + 1
)"""


ORACLE = f"""
WITH RECURSIVE crc(byte, value) AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) FROM range(256) t(b)
), crc_table AS (
  SELECT list(value ORDER BY byte) AS of_byte FROM crc
), records AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS digits,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT >> {52 - SLOT_BITS})::BIGINT AS virtual_slot
  FROM documents
), summed AS (
  SELECT doc_id, size, virtual_slot, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(digits, '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(of_byte[xor(c & 255, b) + 1], c >> 8))) AS text_crc32
  FROM records, crc_table
), slots AS (
  SELECT virtual_slot, sum(size)::BIGINT AS slot_bytes, count(*) AS slot_rows FROM records GROUP BY virtual_slot
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY slot_bytes DESC, virtual_slot) AS i FROM slots
), {_deal_sql("dealt", "ordered", f"list_transform(range({SHARDS}), lambda x: 0::BIGINT)")}
, first_map AS (
  SELECT slots.*, shard, sum(slot_bytes) OVER (PARTITION BY shard ORDER BY slot_bytes, virtual_slot) AS upto,
    (SELECT sum(slot_bytes) FROM slots) / {SHARDS + 1} AS share
  FROM slots JOIN dealt USING (virtual_slot)
), given_up AS (
  SELECT *, row_number() OVER (ORDER BY slot_bytes DESC, virtual_slot) AS i FROM first_map WHERE upto > share
), used AS (
  SELECT list(coalesce(b, 0)::BIGINT ORDER BY s.shard) AS loads FROM range({SHARDS + 1}) s(shard)
    LEFT JOIN (SELECT shard, sum(slot_bytes) AS b FROM first_map WHERE upto <= share GROUP BY shard) k USING (shard)
), {_deal_sql("again", "given_up", "(SELECT loads FROM used)")}
, maps AS (
  SELECT f.virtual_slot, f.shard, coalesce(a.shard, f.shard) AS next_shard,
    sum(slot_rows) OVER (PARTITION BY f.shard ORDER BY f.virtual_slot) - slot_rows AS start
  FROM first_map f LEFT JOIN again a USING (virtual_slot)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, start::BIGINT - 1 + row_number() OVER (PARTITION BY virtual_slot
    ORDER BY doc_id NULLS FIRST, size, text_crc32) AS slot, NULL::INT AS grown_shard, virtual_slot, next_shard
FROM summed JOIN maps USING (virtual_slot)
"""
