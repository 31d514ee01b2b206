"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING_CELLS cells. Every shard owns VIRTUAL_NODES of them; a row belongs to the first
virtual node at or clockwise after the cell its key hashes to. Shards take rows up to a capacity;
the rows of an arc that its shard cannot hold continue clockwise to the next virtual node whose
shard has room. Capacities add up to the row count and differ by one at most, so the balance is
exact, and only overflowing rows leave their home shard.

Only counts by ring cell (RING_CELLS at most, whatever the input; HOT_PARTS more for each of the cells, and
each of the groups of wholly alike rows, with more than a HOT_CELLS-th of all rows) and the resulting segments
(virtual nodes + shards at most) pass through the driver. Rows are ranked in windows of one cell, hot cells
in parts by the hash of the whole row, so that rows of one id, or without one, do not all meet in one task.
A hot group of alike rows comes last in its cell, dealt out to parts by place of reading: its rows can stand in
for each other, and no other row's place depends on the deal. They are written first, so that both readings agree.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, utf8_size

RING_CELLS = 1 << 16
VIRTUAL_NODES = 128
SHARDS = 24
ROW_OVERHEAD = 8
HOT_CELLS, HOT_PARTS = 500, 256


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, seed: int = 0) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in clockwise order; a cell that is taken makes the later node hash again."""
    if shards * virtual_nodes > RING_CELLS // 2:
        raise ValueError("too many virtual nodes for the ring")
    owner: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            attempt = 0
            while True:
                digest = hashlib.blake2b(f"{seed}/{shard}/{node}/{attempt}".encode(), digest_size=4).digest()
                cell = int.from_bytes(digest, "big") % RING_CELLS
                if cell not in owner:
                    owner[cell] = shard
                    break
                attempt += 1
    return sorted(owner.items())


def capacities(rows: int, shards: int) -> list[int]:
    """Row limits that add up to rows and are at most one apart."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def fill_ring(nodes: list[tuple[int, int]], arc_rows: list[int], limits: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Pour the rows of each arc into shards: (arc, first rank, end rank, shard, first slot, hops).

    Round h lets what is left of every arc try the h-th virtual node clockwise of its own.
    """
    used = [0] * len(limits)
    taken = [0] * len(nodes)
    waiting = [arc for arc in range(len(nodes)) if arc_rows[arc]]
    segments = []
    hops = 0
    while waiting:
        still = []
        for arc in waiting:
            shard = nodes[(arc + hops) % len(nodes)][1]
            n = min(arc_rows[arc] - taken[arc], limits[shard] - used[shard])
            if n > 0:
                segments.append((arc, taken[arc], taken[arc] + n, shard, used[shard], hops))
                used[shard] += n
                taken[arc] += n
            if taken[arc] < arc_rows[arc]:
                still.append(arc)
        waiting, hops = still, hops + 1
    return segments


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
    seed: int = 0,
    keep: list[str | Column] | None = None,
) -> DataFrame:
    """Add shard, slot (gapless from 0 in each shard), home_shard (before overflow) and hops to every row.

    keep: the columns to carry (all by default); carried columns of the four names are replaced.
    Null ids hash like any value; null and empty texts count as empty, texts of any length travel with their
    row; repeated rows are placed one by one, in any order among them; an empty table gives no rows.
    """
    spark = docs.sparkSession
    nodes = ring(shards, virtual_nodes, seed)
    position = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 32)
    cell = F.shiftright(position, 16).cast("int")
    counts = {r["cell"]: r["count"] for r in docs.select(cell.alias("cell")).groupBy("cell").count().collect()}
    many = max(sum(counts.values()) // HOT_CELLS, 1)
    hot = [c for c, n in counts.items() if n > many]
    tie = F.struct(F.col(id_col).cast("string"), utf8_size(F.col(text_col)), F.crc32(F.col(text_col).cast("binary")))
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*kept).alias("_row"), position.alias("_position"), cell.alias("_cell"), tie.alias("_tie"))
    in_parts: dict[int, list[tuple[int, int]]] = {}
    if hot:
        row_hash = F.xxhash64("_tie")
        in_hot = rows.where(F.col("_cell").isin(hot))
        alike = sorted(r["h"] for r in in_hot.groupBy(row_hash.alias("h")).count().where(F.col("count") > many).collect())
        part = F.when(F.col("_cell").isin(hot), F.pmod(row_hash, F.lit(HOT_PARTS)).cast("int")).otherwise(0)
        if alike:
            dealt = F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS)).cast("int")
            group = F.array_position(F.array(*[F.lit(h).cast("long") for h in alike]), row_hash).cast("int")
            same = materialize(in_hot.where(row_hash.isin(alike)).withColumn("_part", group * HOT_PARTS + dealt), "alike-rows")
            rows = rows.where(~row_hash.isin(alike)).withColumn("_part", part).unionByName(same)
        else:
            rows = rows.withColumn("_part", part)
        split = rows.where(F.col("_cell").isin(hot)).groupBy("_cell", "_part").count()
        for r in split.orderBy("_part").collect():
            in_parts.setdefault(r["_cell"], []).append((r["_part"], r["count"]))
    else:
        rows = rows.withColumn("_part", F.lit(0))
    starts = [c for c, _ in nodes]
    arc_of = [bisect.bisect_left(starts, c) % len(nodes) for c in range(RING_CELLS)]
    # the first arc crosses zero: its cells after the last node come before those from zero on
    order = sorted(range(RING_CELLS), key=lambda c: (arc_of[c], c <= starts[-1] and arc_of[c] == 0, c))
    arc_rows, cells = [0] * len(nodes), []
    for c in order:
        for p, n in in_parts.get(c) or ([(0, counts[c])] if c in counts else []):
            cells.append((c, p, arc_of[c], arc_rows[arc_of[c]]))
            arc_rows[arc_of[c]] += n
    segments = fill_ring(nodes, arc_rows, capacities(sum(arc_rows), shards))
    cell_table = F.broadcast(spark.createDataFrame(cells, "_cell int, _part int, _arc int, _before long"))
    homes = [(arc, first, end, shard, slot, hops, nodes[arc][1]) for arc, first, end, shard, slot, hops in segments]
    segment_table = F.broadcast(
        spark.createDataFrame(homes, "_arc int, _first long, _end long, _shard int, _slot long, _hops int, _home int")
    )
    in_cell = Window.partitionBy("_cell", "_part").orderBy("_position", "_tie")
    ranked = (
        rows.withColumn("_rank", F.row_number().over(in_cell) - 1)
        .join(cell_table, ["_cell", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    placed = ranked.join(segment_table, "_arc").where("_rank >= _first and _rank < _end")
    fields = [f for f in rows.schema["_row"].dataType.names if f not in ("shard", "slot", "home_shard", "hops")]
    return placed.select(
        *[F.col("_row")[f].alias(f) for f in fields],
        F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"),
        F.col("_home").alias("home_shard"), F.col("_hops").alias("hops"),
    )


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document under the rows law: sizes, checksums and places; nulls, repeats and empty tables as in assign_shards."""
    measured = [
        F.col("doc_id"), (utf8_size(F.col("text")) + ROW_OVERHEAD).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
    ]
    placed = assign_shards(docs, shards, keep=measured)
    return placed.withColumn("grown_shard", F.lit(None).cast("int")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "home_shard", "hops"
    )


