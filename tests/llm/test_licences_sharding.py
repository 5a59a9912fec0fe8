import zlib

from pyspark.sql import functions as F

from fleetlens.llm import licences, sharding


def files(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def test_own_and_inherited_licences(spark):
    frame = files(
        spark,
        (1, "r/LICENSE", "The MIT License (MIT)\nmore words here"),
        (2, "r/a/x.txt", "nothing"),
        (3, "r/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "r/a/b/c/y.txt", None),
        (5, "r/a/b/z.txt", "text\nReleased under the MIT License."),
        (6, "q/x.txt", "the license of this is that"),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, None, ""),
        (9, "LICENSE", "nothing of the kind"),
    )
    rows = {r.doc_id: (r.own_licence, r.licence, r.licence_dir) for r in licences.scan(frame).collect()}
    assert rows == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "r"), 3: ("Apache-2.0", "Apache-2.0", None),
        4: (None, "Apache-2.0", "r/a/b"), 5: ("MIT", "MIT", None), 6: (None, None, None),
        7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, None, None), 9: (None, None, None),
    }


def test_licence_edges(spark):
    frame = files(spark, (1, "a/LICENSE", "Released under CC0 1.0."), (1, "a/LICENSE", "Released under CC0 1.0."), (None, "a/b", ""))
    rows = [(r.doc_id, r.licence) for r in licences.scan(frame.withColumn("licence", F.lit(1))).collect()]
    assert sorted(rows, key=str) == [(1, "CC0-1.0"), (1, "CC0-1.0"), (None, "CC0-1.0")]
    assert licences.scan(frame.limit(0)).count() == 0
    long = files(spark, (1, "a/x", "word " * 100_000 + "\nReleased under the MIT License."))
    assert licences.scan(long).first().own_licence == "MIT"


def test_templates_hold_a_cue_and_find_themselves(spark):
    texts = [(i, f"d{i}/x", t) for i, t in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    names = [n for n, ts in licences.TEMPLATES.items() for _ in ts]
    got = {r.doc_id: r.own_licence for r in licences.scan(files(spark, *texts)).collect()}
    assert [got[i] for i in range(len(names))] == names


def test_shards_are_even_and_places_gapless(spark, documents):
    docs = documents(*[(i, "é" * (i * 37 % 400)) for i in range(3000)], (7, "again"), (7, "again"), (None, None))
    rows = sharding.shard(docs, shards=5).collect()
    assert len(rows) == 3003 and {r.shard for r in rows} == set(range(5))
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shard(docs.limit(0)).count() == 0
    assert "extra" in sharding.shard(docs.withColumn("shard", F.lit("mine"))).columns


def test_rebalancing_moves_little_and_versions_are_kept(spark, documents, tmp_path):
    docs = documents(*[(i, "x" * (i % 90)) for i in range(4000)])
    slotted = sharding.with_slots(docs).cache()
    sizes = sharding.slot_bytes(slotted)
    first = sharding.initial_map(sizes, 4)
    folder = str(tmp_path / "maps")
    sharding.store_map(first, folder)
    for shards in (5, 3):
        old = sharding.load_map(spark, folder)
        new = sharding.rebalanced_map(old, sizes, shards).cache()
        sharding.store_map(new, folder)
        before = {r.virtual_slot: r.shard for r in old.collect()}
        after = {r.virtual_slot: r.shard for r in new.collect()}
        load = {r.virtual_slot: r.slot_bytes for r in sizes.collect()}
        assert set(before) == set(after)
        moved = sum(load[s] for s in before if before[s] != after[s])
        total = sum(load.values())
        least = total / 5 if shards == 5 else total * 2 / 5
        assert moved < 1.15 * least
        per = [sum(load[s] for s in after if after[s] == k) for k in range(shards)]
        assert max(per) - min(per) < 0.02 * total
    assert sharding.load_map(spark, folder).first().version == 3
    assert {r.shard for r in sharding.load_map(spark, folder, 1).collect()} == set(range(4))


def test_a_kept_map_places_records_and_the_next_version_moves_few(spark, documents, tmp_path):
    docs = documents(*[(i, "x" * (i * 31 % 500)) for i in range(4000)])
    folder = str(tmp_path / "kept")
    rows = sharding.shard(docs, shards=4, folder=folder, next_shards=5).collect()
    total, moved = sum(r["size"] for r in rows), sum(r["size"] for r in rows if r.shard != r.next_shard)
    assert {r.shard for r in rows} == set(range(4)) and {r.next_shard for r in rows} == set(range(5))
    assert moved < 1.15 * total / 5
    per = [sum(r["size"] for r in rows if r.next_shard == s) for s in range(5)]
    assert max(per) - min(per) < 0.02 * total
    sizes = sharding.slot_bytes(sharding.with_slots(docs))
    told = sharding.moves(sharding.load_map(spark, folder, 1), sharding.load_map(spark, folder, 2), sizes).collect()
    assert sum(r.bytes for r in told) == moved and all(r.from_shard != r.to_shard for r in told)
    # the same shards and slots again: version 2 stands; a table that grew: a new version, old slots where they were or given up
    again = {r.doc_id: r.shard for r in sharding.shard(docs, shards=5, folder=folder).collect()}
    assert again == {r.doc_id: r.next_shard for r in rows} and sharding.load_map(spark, folder).first().version == 2
    more = docs.unionByName(documents(*[(i, "y" * 90) for i in range(4000, 9000)]))
    grown = {r.doc_id: (r.shard, r.next_shard) for r in sharding.shard(more, shards=5, folder=folder).collect()}
    assert len(grown) == 9000 and {s for s, _ in grown.values()} == set(range(5)) and {n for _, n in grown.values()} == {None}
    empty = sharding.shard(docs.limit(0), folder=str(tmp_path / "none"), next_shards=9)
    assert empty.count() == 0 and "next_shard" in empty.columns and not (tmp_path / "none").exists()
