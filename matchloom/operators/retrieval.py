"""Top-k profiles for every opening: exact and approximate cosine, text relevance and their sum."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.sparse import sparse_rows, sparse_top_k
from matchloom.sources.tables import written

TOP_K = 50
QUERY_BLOCK, ITEM_BLOCK = 1024, 4096
# Boosts of the clauses, and the constants of the text relevance.
KNN_BOOST, TEXT_BOOST, SKILL_BOOST, TITLE_BOOST = 1.0, 0.5, 0.5, 0.25
K1, B = 1.2, 0.75
# The usual English stop words of a text analyser.
ENGLISH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
DEFAULT_TOP_K, MAX_TOP_K, DEFAULT_POOL, MAX_POOL = 20, 30, 100, 300
DIGITS = 6


def top_k(scored: DataFrame, k: int, score: str, group: str = "job_id", item: str = "resume_id", rank: str = "retrieval_rank") -> DataFrame:
    """The k best items of each group, ties to the smaller item, ranked from 1."""
    order = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two vectors in doubles, rounded; the cosine of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), DIGITS)


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows in blocks of about `size` by the hash of their key: block number `name`, array {name}_rows; the number of blocks."""
    usable = rows.where(F.col(key).isNotNull() & F.col("embedding").isNotNull())
    blocks = max(1, -(-usable.count() // size))
    numbered = usable.select(F.struct(F.col(key).alias("id"), "embedding").alias("row"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name))
    return numbered.groupBy(name).agg(F.collect_list("row").alias(f"{name}_rows")), blocks


def meeting(held: DataFrame, coming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `held` and of `coming` that have the same keys, the one row of held first: a task keeps it while the others come one by one.

    The number of partitions is given, as tasks are long where rows are few: Spark would put small partitions together.
    """
    both = held.withColumn("turn", F.lit(0)).unionByName(coming.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    partitions = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(partitions, *keys).sortWithinPartitions(*keys, "turn").drop("turn")


def sliced(held: DataFrame, blocks: int, others: int) -> tuple[DataFrame, int]:
    """Each of `blocks` rows once a slice, where they are so few that some cores would have none; the number of slices, at most `others`."""
    slices = min(others, max(1, -(-2 * held.sparkSession.sparkContext.defaultParallelism // max(blocks, 1))))
    return held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), slices


def first_of_each(own: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of every owner are, by owner, score and id; NaN comes before all numbers, as in SQL."""
    place = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((place, np.where(np.isnan(scores), -np.inf, -scores), own))
    begins = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0][: len(own)])
    turn = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
    return order[turn < k]


def least_best(scores: np.ndarray, k: int, group: int = 16) -> np.ndarray:
    """A bound that the k-th largest score of every row reaches; less than any where there are no more than k.

    It is the k-th largest score, or of the largest of each of many groups, which is about the same and found sooner.
    """
    n = scores.shape[1]
    if n <= k:
        return np.full(len(scores), -np.inf)
    groups = n // group
    if groups > 4 * k:
        scores, n = scores[:, : groups * group].reshape(len(scores), group, groups).max(axis=1), groups
    return np.partition(scores, n - k, axis=1)[:, n - k]


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Nearest:
    """The k best items so far of every query of a block; scores are rounded, ties go to the smaller id."""

    CHUNK = 256

    def __init__(self, names: np.ndarray, queries: np.ndarray, k: int):
        self.names, self.queries, self.k = names, queries, k
        self.own, self.ids, self.scores = np.empty(0, np.int64), None, np.empty(0)
        self.floor = np.full(len(names), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        found = [(self.own, ids[:0] if self.ids is None else self.ids, self.scores)]
        for first in range(0, len(self.names), self.CHUNK):
            scores, floor = self.queries[first : first + self.CHUNK] @ vectors.T, self.floor[first : first + self.CHUNK]
            # a score that rounds to the k-th best may be less by one unit of the last digit
            open_ = floor == -np.inf
            if open_.any():
                floor = np.where(open_, least_best(scores, self.k), floor)
            row, column = places(~(scores < floor[:, None] - 10.0**-DIGITS))
            found.append((row + first, ids[column], np.round(scores[row, column], DIGITS)))
        own, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        best = first_of_each(own, ids, scores, self.k)
        self.own, self.ids, self.scores = own[best], ids[best], scores[best]
        counts = np.bincount(self.own, minlength=len(self.names))
        last = np.cumsum(counts) - 1
        self.floor = np.where(counts == self.k, self.scores[np.maximum(last, 0)] if len(self.scores) else -np.inf, -np.inf)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if len(self.own):
            yield pa.RecordBatch.from_arrays([pa.array(self.names[self.own]), pa.array(self.ids), pa.array(self.scores)], ["job_id", "resume_id", "embedding_cosine"])


def topk_cosine(jobs: DataFrame, resumes: DataFrame, k: int = TOP_K, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The k nearest profiles of every opening: job_id, resume_id, embedding_cosine, retrieval_rank.

    Openings and profiles are packed into blocks of bounded size; every block of profiles meets every block
    of openings in one matrix product. A task keeps the k best of a block of openings while blocks of profiles come by, so that
    only scores beyond the k-th best so far are looked at, and k rows an opening leave it. Neither
    all pairs nor a whole table are ever in one task or in the driver.
    jobs: job_id, embedding; resumes: resume_id, embedding, all of one length. Rows without a vector are left out.
    """
    asked, blocks = _blocks(jobs, "job_id", query_block, "jobs")
    items, others = _blocks(resumes, "resume_id", item_block, "items")
    held, slices = sliced(asked, blocks, others)
    coming = items.select((F.col("items") % slices).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("jobs"), "items_rows")
    met = meeting(held, coming, ["jobs", "slice"]).select("jobs", "jobs_rows", "items_rows")

    def unpacked(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        rows = cell.values
        ids = rows.field("id").to_numpy(zero_copy_only=False)
        return ids, rows.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, number = None, None
        for batch in batches:
            for block, left, right in zip(*batch.columns, strict=True):
                if left.is_valid:
                    if best:
                        yield from best.rows()
                    best, number = Nearest(*unpacked(left), k), block.as_py()
                elif block.as_py() == number:  # a block without openings has no row
                    best.meet(*unpacked(right))
        if best:
            yield from best.rows()

    kinds = (jobs.schema["job_id"].dataType.simpleString(), resumes.schema["resume_id"].dataType.simpleString())
    found = met.mapInArrow(nearest, f"job_id {kinds[0]}, resume_id {kinds[1]}, embedding_cosine double")
    return top_k(found, k, "embedding_cosine")


def terms(text: Column) -> Column:
    """Terms of a text: lower-case runs of letters and digits, without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: ~t.isin("", *ENGLISH_STOP_WORDS))


def bm25_terms(jobs: DataFrame, resumes: DataFrame, max_df_share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The openings' terms weighted by rarity and the profiles' by saturated frequency, as sparse rows of field 0.

    A term's part of the relevance is the product of both weights. jobs: job_id, text; resumes: resume_id, text.
    Each distinct term of an opening counts once; max_df_share leaves out terms that more of the profiles have.
    """
    words = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9]+")
    hashed = resumes.select("resume_id", F.transform(words, lambda t: F.xxhash64(F.lit(0), t)).alias("tokens"))
    # stop words, and the empty words at the ends, are told by their hashes
    unused = resumes.sparkSession.range(1).select(F.array(*[F.xxhash64(F.lit(0), F.lit(w)) for w in ("", *ENGLISH_STOP_WORDS)])).first()[0]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            owner, flat = np.repeat(np.arange(len(lengths)), lengths), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            used = ~np.isin(flat, unused)
            owner, flat = owner[used], flat[used]
            lengths = np.bincount(owner, minlength=len(lengths))
            order = np.lexsort((flat, owner))
            owner, flat = owner[order], flat[order]
            starts = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])][: len(flat)])
            ends = pa.array(np.searchsorted(owner[starts], np.arange(len(lengths) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat[starts], np.diff(np.r_[starts, len(flat)]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32)), *lists], ["resume_id", "length", "terms", "times"])

    # the texts are split once; counts, rarities and weights read the written terms
    kind = resumes.schema["resume_id"].dataType.simpleString()
    held = written(hashed.mapInArrow(counted, f"resume_id {kind}, length int, terms array<long>, times array<int>"), "terms")
    n, average = held.agg(F.count("*"), F.avg("length")).first()
    norm = K1 * (1 - B) + K1 * B * F.col("length") / F.lit(average or 1.0)
    weights = F.transform("times", lambda x: x * (K1 + 1) / (x + norm))
    items = held.where("resume_id is not null and size(terms) > 0").select("resume_id", F.lit(0).alias("field"), "terms", weights.alias("weights"))
    asked = jobs.where("job_id is not null").select("job_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).select("job_id", F.xxhash64(F.lit(0), "term").alias("term"))
    # documents that hold each asked term: only asked terms are counted
    known = held.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarity = known.where(F.col("df") <= n * max_df_share).select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))
    pairs = asked.join(rarity, "term").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    return pairs.select("job_id", F.lit(0).alias("field"), F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), items


def bm25_scores(jobs: DataFrame, resumes: DataFrame, max_df_share: float = 1.0, k: int | None = None) -> DataFrame:
    """Text relevance of profiles for openings: job_id, resume_id, text_score, over pairs that share a term.

    With k, only the best k of each opening (ties to the smaller id), of which no others leave a task; without,
    all such pairs, whose number grows with the product of the tables. Inputs as in bm25_terms.
    """
    asked, items = bm25_terms(jobs, resumes, max_df_share)
    found = sparse_top_k(asked, items, jobs.count(), 1, lambda sums, _: (sums[0], sums[0] > 0), k, score="text_score", digits=4)
    return found if k is None else top_k(found, k, "text_score").drop("retrieval_rank")


def title_idf(resumes: DataFrame) -> DataFrame:
    """job_title, title_idf: the rarity of every whole title among the profiles (resume_titles). Case counts, as on a keyword field."""
    n = resumes.agg(F.count("*").alias("n"))
    held = resumes.select(F.explode(F.array_distinct("resume_titles")).alias("job_title")).groupBy("job_title").agg(F.count("*").alias("df"))
    return held.crossJoin(F.broadcast(n)).select("job_title", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("title_idf"))


def hybrid_retrieval(nearest: DataFrame, jobs: DataFrame, resumes: DataFrame, pool: int) -> DataFrame:
    """Pools of candidates by the sum of the vector part (only for the nearest) and the text clauses.

    nearest: job_id, resume_id, embedding_cosine; jobs: job_id, text, job_skills, job_title; resumes: resume_id,
    text, resume_skills, resume_titles. jobs has every opening of nearest. The clauses count for pairs that share a term: text relevance, any shared
    skill, and a whole title times its rarity.
    """
    text_asked, text_items = bm25_terms(jobs, resumes)
    titles = jobs.join(title_idf(resumes), "job_title").select("job_id", "job_title", "title_idf")
    own = F.array(F.col("job_id").cast("string"))  # the vector part: each opening is a term that its nearest profiles hold
    asked = [
        text_asked, sparse_rows(jobs, "job_id", 1, F.array_distinct("job_skills")),
        sparse_rows(titles, "job_id", 2, F.array("job_title"), F.array("title_idf")), sparse_rows(jobs, "job_id", 3, own),
        sparse_rows(jobs, "job_id", 4, own),
    ]
    items = [
        text_items, sparse_rows(resumes, "resume_id", 1, F.array_distinct("resume_skills")), sparse_rows(resumes, "resume_id", 2, F.array_distinct("resume_titles")),
        sparse_rows(nearest, "resume_id", 3, own), sparse_rows(nearest, "resume_id", 4, own, F.array(KNN_BOOST * (1 + F.col("embedding_cosine")) / 2)),
    ]

    def combined(sums: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, skill, title, near, vector = sums
        clauses = TEXT_BOOST * np.round(text, 4) + SKILL_BOOST * (skill > 0) + TITLE_BOOST * title
        return np.where(text > 0, clauses, 0.0) + vector, (text > 0) | (near > 0)

    found = sparse_top_k(reduce(DataFrame.unionByName, asked), reduce(DataFrame.unionByName, items), jobs.count(), 5, combined, pool, score="retrieval_score_raw", digits=8)
    return top_k(found, pool, "retrieval_score_raw")


def pool_limits(available: int, top_k: int | None = None, pool: int | None = None) -> tuple[int, int]:
    """(top_k, pool) after defaults, bounds, pool >= top_k, and no more than there are profiles."""
    top_k, pool = DEFAULT_TOP_K if top_k is None else top_k, DEFAULT_POOL if pool is None else pool
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be from 1 to {MAX_TOP_K}")
    if not 1 <= pool <= MAX_POOL:
        raise ValueError(f"the pool must be from 1 to {MAX_POOL}")
    pool = min(max(pool, top_k), available)
    return min(top_k, pool), pool


def missing_profiles(pool: DataFrame, resumes: DataFrame) -> DataFrame:
    """Retrieved ids that no profile has."""
    return pool.select("resume_id").distinct().join(resumes, "resume_id", "left_anti")


def require_profiles(pool: DataFrame, resumes: DataFrame) -> None:
    """Fail with up to ten of the ids that no profile has."""
    ids = [str(r[0]) for r in missing_profiles(pool, resumes).orderBy("resume_id").limit(10).collect()]
    if ids:
        raise ValueError(f"retrieved ids without a profile: {', '.join(ids)}")


def with_cosines(pool: DataFrame, job_vectors: DataFrame, resume_vectors: DataFrame) -> DataFrame:
    """Pool rows with embedding_cosine and embedding_source: of both vectors, or the retrieval score where the profile has none.

    pool: job_id, resume_id, retrieval_score_raw; the vectors: job_id or resume_id, embedding.
    """
    a, b = job_vectors.select("job_id", F.col("embedding").alias("_a")), resume_vectors.select("resume_id", F.col("embedding").alias("_b"))
    local = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), cosine(F.col("_a"), F.col("_b")))
    joined = pool.join(a, "job_id", "left").join(b, "resume_id", "left").withColumn("_cosine", local)
    source = F.when(F.col("_cosine").isNotNull(), "local_embedding").otherwise("elastic_score_fallback")
    return joined.select(*pool.columns, F.coalesce("_cosine", "retrieval_score_raw").alias("embedding_cosine"), source.alias("embedding_source"))


def with_fallback(pool: DataFrame, resumes: DataFrame, fields: list[str]) -> DataFrame:
    """Pool rows with the profile's fields, or the hit's own (hit_ columns) where there is no profile."""
    found = pool.join(resumes.select("resume_id", F.lit(True).alias("_found"), *[F.col(f).alias(f"_{f}") for f in fields]), "resume_id", "left")
    chosen = [F.when(F.col("_found"), F.col(f"_{f}")).otherwise(F.col(f"hit_{f}")).alias(f) for f in fields]
    source = F.when(F.col("_found"), "local_embedding").otherwise("elastic_score_fallback").alias("embedding_source")
    return found.select(*pool.columns, source, *chosen)
