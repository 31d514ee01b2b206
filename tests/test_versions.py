import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.snapshots import parsed_snapshots
from matchloom.operators import feedback as fb
from matchloom.operators import reports
from matchloom.sources import tables
from matchloom.streaming import jobs, versions

KEYS, ORDER, FIRST = ["user_id", "run_id"], ["t", "n"], {"created": "t", "score": "score"}


def board(rows):
    return {(r.user_id, r.run_id, r.t, r.n, r.status, r.created, r.score) for r in rows.collect()}


def made(spark, count, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), rng.randint(0, 8), rng.randint(0, 50), n, rng.choice(["new", "hired", None]), 0, rng.random()) for n in range(count)]
    rows = [(u, r, t, n, s, t, x) for u, r, t, n, s, _, x in rows]
    return spark.createDataFrame(rows, "user_id long, run_id long, t int, n int, status string, created int, score double")


def test_versions_equal_the_batch(spark, tmp_path):
    path, table = f"{tmp_path}/board", made(spark, 900, 1)
    write = versions.versioned_upserts(path, KEYS, ORDER, FIRST, bucket_rows=25)
    write(table.limit(0), 0)
    with pytest.raises(FileNotFoundError):
        versions.read_upserts(spark, path)
    buckets = []
    for epoch, part in enumerate([F.col("n") < 10, F.col("n").between(10, 199), F.col("n") % 2 == 0, F.col("n") >= 200, F.col("n") == 3]):
        write(table.where(part), epoch)
        write(table.where(part), epoch)  # replayed
        buckets.append(versions._head(spark, path)["buckets"])
    got = versions.read_upserts(spark, path)
    assert got.count() == len(board(got)) and board(got) == board(jobs.latest_rows(table, KEYS, ORDER, FIRST).select(*got.columns))
    assert buckets[0] == 1 and buckets == sorted(buckets) and buckets[-1] >= 8
    head = versions._head(spark, path)
    assert sum(head["rows"].values()) == got.count() and max(head["rows"].values()) < 75


def test_a_batch_rewrites_what_it_touches_and_shows_at_once(spark, tmp_path, monkeypatch):
    path, table = f"{tmp_path}/board", made(spark, 900, 2)
    write = versions.versioned_upserts(path, KEYS, ORDER, FIRST, bucket_rows=100)
    write(table, 0)
    write(table.where("n < 5"), 1)
    head, before, reader = versions._head(spark, path), board(versions.read_upserts(spark, path)), versions.read_upserts(spark, path)
    one = table.where("user_id = 3 and run_id = 3").limit(1).selectExpr("user_id", "run_id", "99 as t", "n", "'late' as status", "99 as created", "9.0 as score").selectExpr("*").withColumn("score", F.lit(9.0))

    def ends(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as lost:
        lost.setattr(versions, "_switch", ends)
        with pytest.raises(RuntimeError):
            write(one, 2)
    assert board(versions.read_upserts(spark, path)) == before
    write(one, 2)
    after = versions._head(spark, path)
    assert len(after["replaced"]) == 1 and sum(after["folders"][b] != f for b, f in head["folders"].items()) == 1
    assert board(reader) == before  # a reader that began before the batch
    changed = board(versions.read_upserts(spark, path)) - before
    assert [(c[0], c[1], c[2], c[4]) for c in changed] == [(3, 3, 99, "late")] and next(iter(changed))[6] != 9.0
    used = {f.split("/")[0] for f in [*after["folders"].values(), *after["replaced"]]}
    assert {p.name for p in tmp_path.joinpath("board").iterdir() if p.is_dir()} == used  # nothing of the run that ended


def test_a_stream_into_versions(spark, tmp_path):
    table = made(spark, 300, 3)
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write = versions.versioned_upserts(f"{tmp_path}/board", KEYS, ORDER, FIRST, bucket_rows=50)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = versions.read_upserts(spark, f"{tmp_path}/board")
    assert board(got) == board(jobs.latest_rows(table, KEYS, ORDER, FIRST).select(*got.columns))


SNAPSHOTS = [
    '{"resume_years_experience": 4.5, "skill_overlap_count": 3, "experience_match_flag": 1, "embedding_cosine": 0.25, "skill_overlap_ratio": 0.5, "title_overlap_ratio": 0.0, "years_gap": -1, "job_years_required": 2}',
    '{"resume_years_experience": null, "skill_overlap_count": 12}', "{bad", "[1, 2]", "7", "", None, '{"embedding_cosine": "high", "extra": {"a": [1]}}', "{}",
]


def test_stored_snapshots_read_like_texts(spark, tmp_path):
    rows = [(i, i % 3, i % 4, i, f"r{i}", i % 2 + 1, 0.5 * i, s, "accept", "v", "", "j", "n", i, i) for i, s in enumerate(SNAPSHOTS * 3)]
    schema = "candidate_id int, user_id int, run_id int, feedback_id int, resume_id string, final_rank int, score double, feature_snapshot string, decision string, vacancy_id string, existing_job_id string, job_title string, note string, created_at int, updated_at int"
    text = spark.createDataFrame(rows, schema)
    parsed_snapshots(text).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    assert stored.where("feature_snapshot is null").count() == 9  # '{bad', '' and null

    def same(work):
        one, other = sorted(map(str, work(text).collect())), sorted(map(str, work(stored).collect()))
        assert one == other and one

    same(reports.board)
    same(fb.feedback_pairs)
    same(lambda t: reports.fairness_groupings(t, text, 1))
    for by in ("experience", "skill", "match"):
        same(lambda t, by=by: reports.bucketed(t, by))
        alone = sorted(map(str, reports.fairness(stored, text, 1, by).collect()))
        assert alone == sorted(map(str, reports.fairness_groupings(text, text, 1).where(F.col("grouping") == by).drop("grouping").collect()))
    plan = reports.fairness_groupings(stored, text, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "from_json" not in plan  # fields are read by path, in the scan


def test_runs_are_appended_with_variant_snapshots(spark, tmp_path):
    shown = spark.createDataFrame([("run", 1, "r", 0.5, None)], "run_id string, final_rank int, resume_id string, score double, gap double")
    cards = shown.selectExpr("*", "score as final_fusion_score", "score as model_score", "1 as retrieval_rank", "named_struct('a', 1) as explanation", *[f"{'gap' if k == 'years_gap' else 'score'} as {k}" for k in tables.SNAPSHOT_KEYS])
    for _ in range(2):
        tables.append_run(spark.createDataFrame([("run",)], "id string"), cards, f"{tmp_path}/runs", f"{tmp_path}/shown")
    again = spark.read.parquet(f"{tmp_path}/shown")
    assert dict(again.dtypes)["feature_snapshot"] == "variant" and again.count() == 2
    got = again.select(F.try_variant_get("feature_snapshot", "$.embedding_cosine", "double"), F.try_variant_get("feature_snapshot", "$.years_gap", "double")).first()
    assert tuple(got) == (0.5, None)
