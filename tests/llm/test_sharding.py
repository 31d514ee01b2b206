import zlib
from collections import Counter, defaultdict

from matchloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def docs(spark, n):
    return spark.createDataFrame([(i, "x" * (i % 50), "own") for i in range(n)], SCHEMA)


def test_counts_are_one_apart_and_slots_gapless(spark):
    rows = sharding.shard_report(docs(spark, 1000)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and r.size == 8 + r.doc_id % 50
    assert len(rows) == 1000 and set(slots) == set(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equals_pouring_key_by_key():
    """Rows of an arc that find their shard full go on clockwise, one at a time, in rounds."""
    nodes = sharding.ring(5, 4, seed=3)
    arc_rows = [(7 * a) % 11 for a in range(len(nodes))]
    limits = sharding.capacities(sum(arc_rows), 5)
    got = Counter()
    for arc, first, end, shard, _, hops in sharding.fill_ring(nodes, arc_rows, limits):
        for rank in range(first, end):
            got[arc, rank] = (shard, hops)
    room, waiting, expected = list(limits), [(a, r) for a in range(len(nodes)) for r in range(arc_rows[a])], {}
    hops = 0
    while waiting:
        rest = []
        for arc, rank in waiting:
            shard = nodes[(arc + hops) % len(nodes)][1]
            if room[shard]:
                room[shard] -= 1
                expected[arc, rank] = (shard, hops)
            else:
                rest.append((arc, rank))
        waiting, hops = rest, hops + 1
    assert dict(got) == expected


def test_few_rows_move_when_a_shard_is_added(spark):
    before = {r.doc_id: r.shard for r in sharding.assign_shards(docs(spark, 4000), 10).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign_shards(docs(spark, 4000), 11).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.2 * len(before)  # 1 / 11 must move, some more for the exact balance


def test_rows_without_an_id_share_windows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_PARTS", 7)
    rows = [(None, f"text {i}", "own") for i in range(300)] + [(i, "x", "own") for i in range(300)] + [(None, "text 1", "own")] * 20
    out = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 5).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == 620 and all(sorted(s) == list(range(124)) for s in slots.values())
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in rows)


def test_wholly_alike_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_PARTS", 8)
    rows = [(i, "x", "own") for i in range(900)] + [(None, None, "own")] * 1500 + [(7, "same", "own")] * 600
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = sharding.assign_shards(table, 5)
    plan = out._jdf.queryExecution().toString()
    assert "alike-rows" in plan  # hot groups of alike rows are read from a written table, with the part of each row
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(600)) for s in slots.values()) and len(slots) == 5
    places = [{r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(t, 5).where("text = 'x' and doc_id <> 7").collect()} for t in (table, table.repartition(3))]
    assert places[0] == places[1]  # other rows' places do not depend on the deal


def test_a_very_long_text(spark):
    out = sharding.shard_report(spark.createDataFrame([(1, "ab" * 3_000_000, "own"), (2, "", "own")], SCHEMA)).collect()
    assert {(r.doc_id, r.size) for r in out} == {(1, 6_000_008), (2, 8)}


def test_columns_nulls_repeats_and_empty(spark):
    rows = [(None, None, "a"), (None, None, "a"), (5, "é", "b"), (5, "é", "b"), (6, "", None)]
    out = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 3)
    assert out.columns == ["doc_id", "text", "shard", "slot", "home_shard", "hops"] and out.count() == 5
    report = sharding.shard_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in report} == {(None, 8, 0), (5, 10, zlib.crc32("é".encode())), (6, 8, 0)}
    assert sharding.assign_shards(docs(spark, 0)).count() == 0
