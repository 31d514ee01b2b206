"""Near-duplicate classes by an exact n-gram Jaccard join with T-occurrence search (DivideSkip).

Sets are the distinct WORDS-word shingles of a text as 64-bit fingerprints. Two sets link when their
Jaccard similarity is at least PERCENT / 100; classes are the connected components of the links.

1. Equal sets are one node. Ordered by fingerprint, linked sets share at least l of their first
   n - ceil(0.8 n) + l shingles. These prefixes are dealt out by fingerprint, packed many to a row, and
   a set goes on only if enough of its prefix occurs in other sets.
2. The sets that go on meet in cells (tasks of bounded size) by their two least shared fingerprints.
   A cell indexes its sets and searches each of them with DivideSkip: short lists are merged by a
   heap, long ones probed by binary search, and sets with the overlap T that their sizes ask for are
   linked. What cannot reach T by the parity marks of both sets, which differ in no more bits than the
   sets in fingerprints, does not enter the heap. Sets that are already in one class are not compared again, so a group of copies costs a
   few comparisons for each copy.
3. What could still be missing are links between different classes. Of each whole set the
   fingerprints that sets of other classes have too are counted; a set needs 0.8 n of them. Ordered
   from the rarest, such a set shares one of its first m - 0.8 n + 1 of m with any set it links to.
   The connected components of these keys hold every missing link: a component that fits a cell meets
   there at once, the sets of larger ones meet key by key.

A key with more sets than fit a cell is split into blocks: in step 2 the blocks are searched by
themselves and their class roots together in a second round; in step 3 its blocks meet two by two.
The number of tasks follows from the number of fingerprints. A fingerprint that very many sets hold is
found on a sample and decided by a pre-aggregated count, so that its holders never meet in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import discard, map_batches, materialize
from matchloom.llm.components import connected_components

WORDS = 5
PERCENT = 80
#: Shingles asked of both prefixes beyond the first, as a percentage of the set; weight of list length in DivideSkip.
EXTRA_PERCENT = 10
MU = 0.01
CELL_BYTES = 4 << 20
BLOCK_SETS = 4000
BROADCAST_IDS = 1_000_000
WORD_CACHE = 1 << 17
#: Rows of an Arrow batch that are held as arrays at a time.
SLICE_ROWS = 500
PROBED_ROOTS = 4
#: Entries that the short lists of a set should hold at most: long lists are cut off until they do, as far as the
#: threshold allows. Candidates that are probed together.
HEAP_ENTRIES, PROBED_TOGETHER = 400, 256
#: Bits of a set's mark for each fingerprint of the mean set of a cell; sets that are marked at a time.
MARK_BITS, MARKED_TOGETHER = 8, 256
#: Fingerprints that one task of the exchange holds on average.
BUCKET_ENTRIES = 1 << 18
#: One set in HEAVY_SAMPLE is looked at for fingerprints with HEAVY_HOLDERS holders or more.
HEAVY_SAMPLE, HEAVY_HOLDERS = 1000, 200_000

# Odd multipliers of the shingle fingerprint (fractional parts of the square roots of the first primes).
_MULTIPLIERS = np.array(
    [0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179],
    np.uint64,
)


def need(size: int | np.ndarray, percent: int = PERCENT):
    """The least overlap of a set of this size with any set it links to."""
    return -(-size * percent // 100)


def extra(size: int | np.ndarray):
    return np.maximum(1, size * EXTRA_PERCENT // 100)


class Shingler:
    """Sorted distinct shingle fingerprints of texts; word hashes are remembered."""

    class _Words(dict):
        def __missing__(self, word: bytes) -> int:
            value = self[word] = xxhash.xxh3_64_intdigest(word)
            return value

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, self._Words()

    def set_of(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(h))
        mixed = np.full(len(h) - width + 1, _MULTIPLIERS[7] ^ np.uint64(width))
        for i in range(width):
            mixed += (h[i : len(h) - width + 1 + i] ^ (h[i : len(h) - width + 1 + i] >> np.uint64(29))) * _MULTIPLIERS[i % 7] * np.uint64(2 * (i // 7) + 1)
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MULTIPLIERS[0]
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of rows; empty ones are left out."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (set size), sig (hash of the set, 0 for the empty one), prefix (its first fingerprints)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            sets = [shingler.set_of(t.as_py()) for t in batch.column(1)]
            sizes = [len(s) for s in sets]
            sigs = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0 for s in sets]
            prefixes = [s[: n - need(n, percent) + int(extra(n))].tobytes() if n else b"" for s, n in zip(sets, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(prefixes, pa.binary())], ["doc_id", "n", "sig", "prefix"]
            )

    return docs.transform(map_batches, made, "doc_id long, n long, sig long, prefix binary")


def _packed(buckets: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has entries: the bytes of each column's entries in it."""
    if not len(buckets):
        return
    buckets = buckets.astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    rows, starts = np.unique(buckets[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    arrays = [pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for c in (c[order] for c in columns)]
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *arrays], names)


def _unpacked(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for part, name in zip(parts, names, strict=True):
            part.extend(np.frombuffer(x.as_py(), np.uint64) for x in batch.column(name))
    return [np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts]


def heavy_fingerprints(source: DataFrame) -> dict[int, tuple[bool, int]]:
    """Whether groups share it, and its holders, of each fingerprint that very many rows (group, hashes) hold.

    Candidates are the fingerprints that are frequent in a sample; they are then counted exactly, batch by
    batch before any shuffle. There are at most (fingerprints of all rows) / HEAVY_HOLDERS of them, more or less.
    """
    least = max(2, HEAVY_HOLDERS // HEAVY_SAMPLE)
    sample = source.where(F.pmod(F.xxhash64(F.lit(3), "owner"), F.lit(HEAVY_SAMPLE)) == 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)] or [np.empty(0, np.int64)]))], ["key"])

    likely = sample.select("hashes").transform(map_batches, listed, "key long").groupBy("key").count().where(F.col("count") >= least)
    keys = np.sort(np.array([r["key"] for r in likely.collect()], np.int64).view(np.uint64))
    if not len(keys):
        return {}
    shared = source.sparkSession.sparkContext.broadcast(keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 * SLICE_ROWS):
            lists = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("hashes")]
            flat, groups = np.concatenate(lists), np.repeat(batch.column("group").to_numpy(zero_copy_only=False), [len(x) for x in lists])
            at = np.minimum(np.searchsorted(shared.value, flat), len(shared.value) - 1)
            hit = shared.value[at] == flat
            flat, groups = flat[hit], groups[hit]
            order = np.argsort(flat, kind="stable")
            flat, groups = flat[order], groups[order]
            if len(flat):
                starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                columns = [flat[starts].view(np.int64), np.minimum.reduceat(groups, starts), np.maximum.reduceat(groups, starts), np.diff(np.r_[starts, len(flat)])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "lo", "hi", "n"])

    sums = source.select("group", "hashes").transform(map_batches, counted, "key long, lo long, hi long, n long").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return {r["key"] % (1 << 64): (r["lo"] != r["hi"], r["n"]) for r in sums.collect()}


def shared_fingerprints(rows: DataFrame, owner: str, group: str, hashes: str, least: Column, rare_first: bool = False) -> DataFrame:
    """owner, shared: the fingerprints of each owner that owners of two groups or more have, if there are `least` or more.

    rows has one row per owner, its hashes distinct: copies would all meet in their owner's task.
    rare_first: only the m - least + 1 rarest of the m. Two shuffles of packed rows, first by fingerprint
    and then by owner; owner and group are longs. Neighbouring entries of a packed row have one owner, so
    that what travels is little more than the fingerprints.
    """
    same = group == owner
    names = ["hashes", "owners", "leasts"] + ["groups"] * (not same)
    back = ["hashes", "owners", "leasts", "holders"]
    source = rows.select(F.col(owner).alias("owner"), least.cast("long").alias("least"), F.col(group).alias("group"), F.col(hashes).alias("hashes"))
    count = max(1, -(-(source.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // (8 * BUCKET_ENTRIES)))
    heavy = heavy_fingerprints(source)
    heavy_keys = np.sort(np.array(list(heavy), np.uint64))
    heavy_shared = np.array([heavy[int(k)][0] for k in heavy_keys], bool)
    heavy_holders = np.array([heavy[int(k)][1] for k in heavy_keys], np.uint64)
    told = rows.sparkSession.sparkContext.broadcast((heavy_keys, heavy_shared, heavy_holders))

    def flat_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("hashes")]
        sizes = [len(x) for x in lists]
        columns = ("owner", "least") if same else ("owner", "least", "group")
        return [np.concatenate(lists), *[np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes) for c in columns]]

    def heavy_at(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = told.value[0]
        at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        return at, keys[at] == flat if len(keys) else np.zeros(len(flat), bool)

    def owner_bucket(owners: np.ndarray) -> np.ndarray:
        return (owners ^ (owners >> np.uint64(33))) % np.uint64(count)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 * SLICE_ROWS):
            columns = flat_columns(batch)
            light = ~heavy_at(columns[0])[1]
            columns = [c[light] for c in columns]
            # packed thousands to a row, so that rows stay few however many fingerprints there are
            yield from _packed((columns[0] >> np.uint64(20)) % np.uint64(count), columns, ["bucket", *names])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 * SLICE_ROWS):
            flat, owners, leasts = flat_columns(batch)[:3]
            at, hit = heavy_at(flat)
            hit[hit] = told.value[1][at[hit]]
            yield from _packed(owner_bucket(owners[hit]), [flat[hit], owners[hit], leasts[hit], told.value[2][at[hit]]], ["bucket", *back])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _unpacked(batches, names)
        order = np.argsort(columns[0], kind="stable")
        flat, owners, leasts, groups = columns[0][order], columns[1][order], columns[2][order], columns[1 if same else 3][order]
        if not len(flat):
            return
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        sizes = np.diff(np.r_[starts, len(flat)])
        keep = np.repeat(np.minimum.reduceat(groups, starts) != np.maximum.reduceat(groups, starts), sizes)
        holders = np.repeat(sizes, sizes).astype(np.uint64)
        by_owner = np.argsort(owners[keep], kind="stable")
        flat, owners, leasts, holders = (c[keep][by_owner] for c in (flat, owners, leasts, holders))
        yield from _packed(owner_bucket(owners), [flat, owners, leasts, holders], ["bucket", *back])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, owners, leasts, holders = _unpacked(batches, back)
        if not len(flat):
            return
        order = np.lexsort((flat, owners))
        flat, owners, leasts, holders = (c[order] for c in (flat, owners, leasts, holders))
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        ends = np.r_[starts[1:], len(owners)]
        enough = ends - starts >= leasts[starts].astype(np.int64)
        ids, pieces = [], []
        for a, b in zip(starts[enough], ends[enough], strict=True):
            own = flat[a:b]
            if rare_first:
                own = own[np.argsort(holders[a:b], kind="stable")][: b - a - int(leasts[a]) + 1]
            ids.append(owners[a])
            pieces.append(own.tobytes())
        for i in range(0, len(ids), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[i : i + 2000], np.uint64).view(np.int64)), pa.array(pieces[i : i + 2000], pa.binary())], [owner, "shared"])

    back_schema = "bucket int, " + ", ".join(f"{n} binary" for n in back)
    first = source.transform(map_batches, dealt, "bucket int, " + ", ".join(f"{n} binary" for n in names)).repartitionById(count, F.col("bucket"))
    second = first.transform(map_batches, met, back_schema)
    if len(heavy_keys):
        second = second.unionByName(source.transform(map_batches, known, back_schema))
    return second.repartitionById(count, F.col("bucket")).transform(map_batches, gathered, f"{owner} long, shared binary")


def parity_marks(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: the parities of how many of its fingerprints end in each pattern. Two rows differ in no more bits than the sets in fingerprints."""
    width = 1 << max(6, int(MARK_BITS * sum(map(len, sets)) / len(sets)).bit_length())
    rows = np.empty((len(sets), width // 64), np.uint64)
    for i in range(0, len(sets), MARKED_TOGETHER):
        part = sets[i : i + MARKED_TOGETHER]
        at = (np.concatenate(part) & np.uint64(width - 1)).astype(np.int64) + np.repeat(np.arange(len(part)) * width, [len(x) for x in part])
        parity = (np.bincount(at, minlength=len(part) * width) & 1).astype(bool).reshape(len(part), width)
        rows[i : i + len(part)] = np.packbits(parity, axis=1).view(np.uint64)
    return rows


def search_cell(nodes: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the sets of one cell into their classes (a spanning forest); classes: as known so far."""
    sizes = np.array([len(s) for s in sets], np.int64)
    by_size = np.lexsort((nodes, sizes))
    nodes, classes, sizes, sets = nodes[by_size], classes[by_size], sizes[by_size], [sets[i] for i in by_size]
    count = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(count), sizes)
    order = np.argsort(flat, kind="stable")
    new_list = np.r_[True, flat[order][1:] != flat[order][:-1]]
    list_of, list_start = np.cumsum(new_list) - 1, np.flatnonzero(new_list)
    ids = owner[order]  # the inverted lists end to end, set numbers ascending in each
    keys = list_of * count + ids
    place = np.empty(len(flat), np.int64)
    place[order] = np.arange(len(flat))
    offsets = np.r_[0, np.cumsum(sizes)]
    _, root = np.unique(classes, return_inverse=True)
    first_of = np.full(root.max() + 1, count)
    np.minimum.at(first_of, root, np.arange(count))
    root = first_of[root]
    marks = parity_marks(sets)
    links: list[tuple[int, int]] = []

    def keys_hit(lists: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Binary probes: whether each list (rows) has each of the other sets (columns)."""
        want = lists[:, None] * count + others[None]
        return keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want

    def merge(merged: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets in the short lists, in order, and in how many of these each is: a heap merges the lists."""
        runs = [r.tolist() for r in np.split(merged, np.flatnonzero(which[1:] != which[:-1]) + 1)]
        counted = [(other, sum(1 for _ in hits)) for other, hits in groupby(heapq.merge(*runs))]
        others, seen = zip(*counted, strict=True)
        return np.array(others), np.array(seen)

    def entries(lists: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first entries of lists end to end, and the list that each is from."""
        starts = list_start[lists] - np.r_[0, np.cumsum(lengths)[:-1]] if len(lists) else lengths
        return ids[np.repeat(starts, lengths) + np.arange(int(lengths.sum()))], np.repeat(np.arange(len(lists)), lengths)

    def within_reach(q: int, merged: np.ndarray) -> np.ndarray:
        """Whether each entry is of a set that could still link to q by the marks of both."""
        near = np.zeros(q, bool)
        near[merged] = True
        others = np.flatnonzero(near)
        both = sizes[q] + sizes[others]
        apart = np.bitwise_count(marks[others] ^ marks[q]).sum(1, dtype=np.int64)
        near[others] = apart <= both - 2 * -(-percent * both // (100 + percent))
        return near[merged]

    def similar(q: int, other: int, common: int) -> bool:
        return 100 * common >= percent * (sizes[q] + sizes[other] - common)

    def join(q: int, other: int) -> None:
        nonlocal root
        links.append((int(nodes[q]), int(nodes[other])))
        low, high = sorted((root[q], root[other]))
        root[root == high] = low

    for q in range(count):
        least = need(int(sizes[q]), percent)
        at = place[offsets[q] : offsets[q + 1]]
        lists = list_of[at]
        lengths = at - list_start[lists]  # entries before q in each of its lists
        lists, lengths = lists[lengths > 0], lengths[lengths > 0]
        if len(lists) < least:
            continue
        by_length = np.argsort(lengths, kind="stable")
        lists, lengths = lists[by_length], lengths[by_length]
        lowest = int(np.searchsorted(sizes, least))  # smaller sets cannot reach the overlap
        # the classes in the longest list first: most copies join theirs by one comparison
        longest = ids[list_start[lists[-1]] : list_start[lists[-1]] + lengths[-1]]
        for r in np.unique(root[longest[-64:]])[:PROBED_ROOTS]:
            if r >= lowest and r < q and root[r] != root[q] and within_reach(q, np.array([r]))[0] and similar(q, r, int(keys_hit(lists, np.array([r])).sum())):
                join(q, r)
        # DivideSkip's weight of the longest list, and more long lists where the short ones would still be long
        long_n = min(least - 1, int(least / (MU * np.log2(max(int(lengths[-1]), 2)) + 1)))
        fitting = int(np.searchsorted(np.cumsum(lengths), HEAP_ENTRIES, side="right"))
        long_n = min(least - 1, max(long_n, len(lists) - fitting))
        short = len(lists) - long_n
        merged, which = entries(lists[:short], lengths[:short])
        open_ = (merged >= lowest) & (root[merged] != root[q])
        merged, which = merged[open_], which[open_]
        reached = within_reach(q, merged)
        if not reached.any():
            continue
        others, seen = merge(merged[reached], which[reached])
        likely = seen >= least - long_n
        others, seen = others[likely], seen[likely]
        while len(others):
            part, counted = others[:PROBED_TOGETHER], seen[:PROBED_TOGETHER]
            common = counted + (keys_hit(lists[short:], part).sum(0) if long_n else 0)
            for other in part[100 * common >= percent * (sizes[q] + sizes[part] - common)]:
                if root[other] != root[q]:
                    join(q, other)
            others, seen = others[PROBED_TOGETHER:], seen[PROBED_TOGETHER:]
            apart = root[others] != root[q]
            others, seen = others[apart], seen[apart]
    return links


def search_cells(sets: DataFrame, placed: DataFrame, cells: int, percent: int) -> DataFrame:
    """Links (a, b) found where sets (sig, node, class, full) meet in cells (sig, cell)."""
    rows = placed.join(sets.select("sig", "node", F.col("class").alias("own_class"), "full"), "sig").repartitionById(cells, F.col("cell"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for cell, node, own, full in zip(*[batch.column(c) for c in ("cell", "node", "own_class", "full")], strict=True):
                held.setdefault(cell.as_py(), []).append((node.as_py(), own.as_py(), np.frombuffer(full.as_py(), np.uint64)))
        for members in held.values():
            if len(members) > 1:
                nodes, classes, full = zip(*members, strict=True)
                links = search_cell(np.array(nodes, np.int64), np.array(classes, np.int64), list(full), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return materialize(rows.transform(map_batches, searched, "a long, b long"), "links")


def _cells(meetings: DataFrame) -> int:
    """Cells for meetings (sig, size) so that one holds CELL_BYTES on average at most."""
    return max(1, -(-(meetings.agg(F.sum("size")).first()[0] or 0) * 8 // CELL_BYTES))


def listed_keys(sets: DataFrame, column: str, most: int | None) -> DataFrame:
    """sig, size, key: the fingerprints packed in a column, the first `most` of them or all."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_py(), np.int64)[:most] for x in batch.column(2)]
            repeat = [len(k) for k in keys]
            ids = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), repeat) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], ["sig", "size", "key"])

    return sets.select("sig", F.col("n").alias("size"), column).transform(map_batches, listed, "sig long, size long, key long")


def meet_by_keys(sets: DataFrame) -> tuple[DataFrame, int, bool]:
    """Cells of each set by its two least shared fingerprints; their number; whether a key was split into blocks."""
    keys = listed_keys(sets, "shared", 2)
    crowds = keys.groupBy("key").count().where(F.col("count") > BLOCK_SETS)
    crowds = materialize(crowds.select("key", F.ceil(F.col("count") / BLOCK_SETS).alias("blocks")), "crowds")
    placed = keys.join(crowds, "key", "left").withColumn("block", F.pmod(F.xxhash64("sig"), F.coalesce("blocks", F.lit(1).cast("long"))))
    cells = _cells(keys)
    cell = F.pmod(F.xxhash64("key", "block"), F.lit(cells)).cast("int")
    return placed.select("sig", cell.alias("cell")).distinct(), cells, bool(crowds.head(1))


def meet_by_rare_keys(keys: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, int]:
    """Cells of each set by its rare keys (sig, size, key), and their number.

    The sets of a connected component of keys share one cell if they fit it; else the sets of each key do,
    and those of a key with more sets than fit are split into blocks that meet two by two.
    """
    first = keys.groupBy("key").agg(F.min("sig").alias("b"), F.count("*").alias("holders"), F.sum("size").alias("sizes")).where("holders > 1")
    first = materialize(first, "key-holders")
    edges = keys.join(first, "key").select(F.col("sig").alias("a"), "b").distinct()
    members = connected_components(edges).select(F.col("node").alias("sig"), "component")
    members = materialize(members.join(keys.select("sig", "size").distinct(), "sig"), "members")
    scratch += [first, members]

    def blocks(sets: str, sizes: str) -> Column:
        return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(sizes) * 8 / (CELL_BYTES / 2)))

    grouped = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("size").alias("sizes"))
    sized = members.join(grouped.select("component", (blocks("sets", "sizes") == 1).alias("fits")), "component")
    whole = sized.where("fits").select("sig", "size", F.struct(F.lit(0), F.col("component").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("place"))
    apart = keys.join(sized.where("not fits").select("sig"), "sig", "left_semi").join(first.select("key", blocks("holders", "sizes").alias("blocks")), "key")
    apart = apart.withColumn("i", F.pmod(F.xxhash64("sig"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.struct(F.lit(1), "key", F.least("i", "j").cast("int").alias("i"), F.greatest("i", "j").cast("int").alias("j"))
    placed = materialize(whole.unionByName(apart.select("sig", "size", pair.alias("place"))), "places")
    scratch.append(placed)
    cells = _cells(placed)
    return placed.select("sig", F.pmod(F.xxhash64("place"), F.lit(cells)).cast("int").alias("cell")).distinct(), cells


def enough_shared(n: Column, percent: int) -> Column:
    """Fingerprints that the prefixes of a set of size n and of any set it links to have in common at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) * EXTRA_PERCENT / 100))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, component_id.

    A text of fewer words is one shingle; null, empty and blank texts have none and are alone. Rows with
    one id are one document, whose links add up. A null id has no component; an empty table gives no rows.
    """
    sets = materialize(shingle_sets(docs.select("doc_id", "text"), words, percent), "sets")
    usable = sets.where("n > 0 and doc_id is not null")
    # exact copies are one row before any prefix travels
    nodes = materialize(usable.groupBy("sig").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    named_sets = materialize(sets.drop("prefix"), "named-sets")
    discard(sets)
    shared = shared_fingerprints(nodes, "sig", "sig", "prefix", enough_shared(F.col("n"), percent))
    kept = materialize(shared.join(nodes.drop("prefix"), "sig").select("sig", "node", "n", "shared"), "candidates")
    scratch = [kept]
    classes = connected_components(class_links(docs, kept, words, percent, scratch))
    for table in scratch:
        discard(table)
    named = nodes.join(classes, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    out = named_sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(named, "sig", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"))


def class_links(docs: DataFrame, kept: DataFrame, words: int, percent: int, scratch: list[DataFrame]) -> DataFrame:
    """Links (a, b) between nodes that connect every class. scratch gets the tables that are not needed once the links are read."""
    wanted = kept.select(F.col("node").alias("doc_id")).distinct()
    if kept.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            sets = [shingler.set_of(t.as_py()) for t in batch.column(1)]
            sigs = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "full"])

    full = docs.select("doc_id", "text").join(wanted, "doc_id").transform(map_batches, whole, "sig long, full binary").dropDuplicates(["sig"])
    sets = materialize(kept.join(full, "sig").withColumn("class", F.col("node")), "full-sets")
    placed, cells, split = meet_by_keys(sets)
    links = search_cells(sets, placed, cells, percent)
    classes = materialize(connected_components(links), "classes")
    scratch += [sets, links, classes]
    if split:
        roots = sets.join(classes.where("node <> component"), "node", "left_anti")
        placed, cells, _ = meet_by_keys(roots)
        between = search_cells(roots, placed, cells, percent)
        links = links.unionByName(between)
        classes = materialize(connected_components(links), "classes")
        scratch += [between, classes]
    classed = sets.drop("class").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    rare = shared_fingerprints(classed, "sig", "class", "full", F.ceil(F.col("n") * percent / 100), rare_first=True)
    keys = materialize(listed_keys(rare.join(kept.select("sig", "n"), "sig"), "shared", None), "rare-keys")
    scratch.append(keys)
    if keys.head(1):
        placed, cells = meet_by_rare_keys(keys, scratch)
        missing = search_cells(classed, placed, cells, percent)
        scratch.append(missing)
        links = links.unionByName(missing)
    return links


def one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their class, with their own columns; rows with a null id stay."""
    found = near_duplicates(docs, words=words, percent=percent)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


SQL = f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' '))) end as s from w),
    e as (select doc_id, len(s) as n, unnest(s) as g from s),
    p as (select a.doc_id as a, b.doc_id as b, a.n + b.n - count(*) as u, count(*) as i from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n),
    l as (select a, b from p where 100 * i >= {PERCENT} * u),
    t as (select a, b from l union all select b, a from l),
    r(a, b) as (select a, b from t union select r.a, t.b from r join t on r.b = t.a)
    select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce((select min(b) from r where r.a = s.doc_id), s.doc_id)) as component_id from s"""
