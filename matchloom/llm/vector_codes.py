"""Vector compression: codebooks of vector parts, learned and applied over a trie of the distinct parts.

Components become whole numbers, floor(SCALE * x), and a vector is cut into PARTS equal parts, each coded
by the number of its nearest codebook entry. The distinct parts of one position, in lexicographic order,
are the leaves of a trie with one level a component. A depth-first walk carries, for every node, the
squared distances of its prefix to all entries; children add their own component to their parent's row,
so that a prefix is measured once however many parts share it. A child that holds one part alone is a
leaf: the rest of its components is measured in one product, and it takes the least distance (ties to the
smaller entry) and adds its components, times its number of rows, to that entry's sums.

Learning groups equal parts over the whole table first (one shuffle, combined before it) and sorts them by
ranges, so that a task's parts share long prefixes and a vector that most rows hold is one weighted leaf.
A round is one pass over that table; only the sums by entry, ENTRIES times the number of components, come
to the driver. Coding is a map over the rows, with a trie of the distinct parts of each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import discard, map_batches, materialize

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Nodes whose distances are held at a time on each level of the walk.
NODES = 256
ELEMENTS = (("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where the vector is null or holds null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def exact_type(parts: np.ndarray, entries: np.ndarray) -> type:
    """A number type in which squared distances are exact: doubles below 2**53, then long, then Python's integers."""
    reach = int(max(np.abs(parts.astype(np.float64)).max(initial=0), np.abs(entries.astype(np.float64)).max(initial=0)))
    most = (2 * reach + 2) ** 2 * parts.shape[1] * 2
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry number and squared distance for every row of parts, which are distinct and in lexicographic order."""
    count, width = parts.shape
    kind = exact_type(parts, entries)
    p, c = parts.astype(kind), entries.astype(kind)
    codes, errors = np.zeros(count, np.int64), np.zeros(count, object if kind is object else np.int64)
    # leading components shared with the row before
    apart = p[1:] != p[:-1]
    shared = np.r_[-1, apart.argmax(1)] if count else np.empty(0, np.int64)
    tails = np.zeros((width + 1, len(c)), kind)
    for depth in range(width - 1, -1, -1):
        tails[depth] = tails[depth + 1] + c[:, depth] * c[:, depth]

    def leaves(rows: np.ndarray, so_far: np.ndarray, depth: int) -> None:
        rest = p[rows, depth:]
        distance = so_far + tails[depth] + (rest * rest).sum(1)[:, None] - 2 * (rest @ c[:, depth:].T)
        codes[rows] = distance.argmin(1)
        errors[rows] = distance.min(1)

    # groups of sibling nodes: (depth, rows of the parents, parent of each node, first and end row of each node)
    root = np.zeros((1, len(c)), kind)
    stack = [(0, root, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, count))] if count else []
    while stack:
        depth, above, parent, first, end = stack.pop()
        so_far = above[parent]
        if depth:
            step = p[first, depth - 1][:, None] - c[:, depth - 1]
            so_far = so_far + step * step
        alone = end - first == 1
        if alone.any():
            leaves(first[alone], so_far[alone], depth)
        inner = np.flatnonzero(~alone)
        if not len(inner):
            continue
        sizes = end[inner] - first[inner]
        owner = np.repeat(inner, sizes)
        rows = np.arange(sizes.sum()) + np.repeat(first[inner] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        begins = np.flatnonzero((shared[rows] == depth) | (rows == first[owner]))
        ends = np.r_[begins[1:], len(rows)]
        for i in range(0, len(begins), NODES):
            at = begins[i : i + NODES]
            stack.append((depth + 1, so_far, owner[at], rows[at], rows[ends[i : i + NODES] - 1] + 1))
    return codes, errors


def code_parts(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry number and squared distance for parts in any order, repeated ones measured once."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(1)][: len(parts)]
    codes, errors = nearest_entries(ordered[new], entries)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    return codes[place], errors[place]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distinct_parts(vectors: DataFrame, parts: int, width: int, element: str) -> DataFrame:
    """position, part, rows: how many vectors hold each distinct part, sorted by ranges and written."""
    cut = F.array(*[F.slice("v", i * width + 1, width).cast(f"array<{element}>") for i in range(parts)])
    counted = vectors.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("rows"))
    grouped = materialize(counted, "parts")
    ordered = materialize(grouped.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "ordered-parts")
    discard(grouped)
    return ordered


def entry_sums(parts: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """For every position and entry the sums of its parts' components, and last the number of its rows."""
    shared = parts.sparkSession.sparkContext.broadcast(codebooks)
    positions, entries, width = codebooks.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions, entries, width + 1), np.int64)
        for batch in batches:
            position, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = unpacked(batch.column(1), width).astype(np.int64)
            for at in np.unique(position):
                own = position == at
                codes, _ = code_parts(values[own], shared.value[at])
                np.add.at(total[at], codes, np.c_[values[own] * weight[own, None], weight[own]])
        at, entry = np.nonzero(total[:, :, -1])
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (width + 1)), pa.array(total[at, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(entry.astype(np.int32)), sums], ["position", "entry", "sums"])

    found = parts.transform(map_batches, summed, "position int, entry int, sums array<long>")
    added = found.select("position", "entry", F.posexplode("sums")).groupBy("position", "entry", "pos").agg(F.sum("col").alias("total"))
    out = np.zeros((positions, entries, width + 1), np.int64)
    for row in added.collect():
        out[row["position"], row["entry"], row["pos"]] = row["total"]
    return out


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) of vectors (id, v: array<long>); see compress for the cases."""
    sized = vectors.withColumn("dim", F.size("v")).where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    reach = F.max(F.greatest(F.array_max("v"), -1 - F.array_min("v")))
    commonest = sized.groupBy("dim").agg(F.count("*").alias("rows"), reach.alias("reach")).orderBy(F.desc("rows"), "dim").first()
    if commonest is None:
        return np.zeros((parts, 0, 0), np.int64)
    dim, width = commonest["dim"], commonest["dim"] // parts
    element = next(name for name, limit in ELEMENTS if commonest["reach"] < limit)
    own = sized.where(F.col("dim") == dim)
    seeds = [r["v"] for r in own.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    codebooks = np.array(seeds, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    table = distinct_parts(own, parts, width, element)
    for _ in range(rounds):
        sums = entry_sums(table, codebooks)
        rows = sums[:, :, -1:]
        codebooks = np.where(rows > 0, sums[:, :, :-1] // np.maximum(rows, 1), codebooks)
    discard(table)
    return codebooks


def encode(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Rows with v replaced by code (entry numbers in part order, two hex digits each, more where there are more entries) and error."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    positions, entries, width = codebooks.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    kept = [c for c in vectors.columns if c != "v"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(entries)], object)
        for batch in batches:
            cells = batch.column(len(kept))
            fits = cells.value_lengths().to_numpy(zero_copy_only=False) == positions * width
            fits = fits & (entries > 0)
            code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
            if fits.any():
                values = unpacked(cells.filter(pa.array(fits)), positions * width)
                made = [code_parts(values[:, i * width : (i + 1) * width], shared.value[i]) for i in range(positions)]
                code[fits] = reduce(np.add, (names[c] for c, _ in made))
                error[fits] = sum(e.astype(object) for _, e in made)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*kept, "code", "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "v"]
    return vectors.select(*kept, "v").transform(map_batches, coded, ", ".join([*fields, "code string", "error long"]))


def decode(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Rows with code replaced by v: the components of the coded entries; null codes stay null."""
    digits = max(2, len(f"{max(codebooks.shape[1] - 1, 0):x}"))
    books = F.array(*[F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in entry]) for entry in book]) for book in codebooks])
    number = [F.conv(F.substring("code", i * digits + 1, digits), 16, 10).cast("int") for i in range(len(codebooks))]
    return codes.withColumn("v", F.when(F.col("code").isNotNull(), F.concat(*[books[i][n] for i, n in enumerate(number)]))).drop("code")


def fingerprint(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error for every kept row; the codebooks), learned on all kept rows.

    Rows whose vector is null or holds null or non-finite components are dropped. The codebooks are those of
    the commonest length that parts divide (ties to the shorter); rows of other lengths, empty ones too, stay
    with a null code and error. Codebooks start from the rows with the smallest ids (null ids last, equal ids
    by their vectors), with fewer entries than asked for if there are fewer rows. Null and repeated ids are
    rows like any other; an empty table gives no rows and empty codebooks; other columns are not looked at.
    Floors beyond a long are cut to it, and sums over an entry and errors must fit a long.
    """
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    rows = embeddings.select(F.col(id_col).alias("id"), label.alias("label"), whole_numbers(F.col(vector_col), scale).alias("v")).where("v is not null")
    codebooks = learn(rows, parts, entries, rounds)
    return encode(rows, codebooks), codebooks


def code_report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256; cases as in compress."""
    codes, codebooks = compress(embeddings)
    coded = materialize(codes, "codes")
    # written, so that Spark knows its size and broadcasts it only when it is small
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))


def code_sql(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, for vectors of one length; every round is a pair of materialised tables."""
    distance = "list_sum(list_transform(list_zip(part, entry), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"

    def assigned(r: int) -> str:
        """best: distance * entries + entry number, so that its minimum breaks ties by the number."""
        return f"a{r} as materialized (select j, part, rows, min({distance} * {entries} + e) as best from d join c{r} using (j) group by j, part, rows)"

    steps = []
    for r in range(rounds):
        steps += [
            assigned(r),
            f"""s{r} as (select j, (best % {entries})::bigint as e, i, sum(part[i] * rows) as total, sum(rows) as held
                from (select *, unnest(range(1, len(part) + 1)) as i from a{r}) group by all)""",
            f"""c{r + 1} as materialized (select c.j, c.e, coalesce(m.entry, c.entry) as entry from c{r} c
                left join (select j, e, list((total - ((total % held) + held) % held) // held order by i)::bigint[] as entry from s{r} group by j, e) m on c.j = m.j and c.e = m.e)""",
        ]
    return f"""with k as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as materialized (select rid, j, v[j * (len(v) // {parts}) + 1 : (j + 1) * (len(v) // {parts})] as part from k, range({parts}) t(j)),
    d as materialized (select j, part, count(*) as rows from p group by j, part),
    c0 as materialized (select j, e, part as entry from (select rid, row_number() over (order by vec_id, v) - 1 as e from k qualify e < {entries}) join p using (rid)),
    {", ".join(steps)}, {assigned(rounds)},
    f as (select sha256(string_agg(array_to_string(entry, ','), ',' order by j, e)) as codebooks_sha256 from c{rounds}),
    r as (select rid, string_agg(printf('%02x', (best % {entries})::bigint), '' order by j) as code, sum(best // {entries})::bigint as error from p join a{rounds} using (j, part) group by rid)
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from k join r using (rid), f"""
