import os
import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from matchloom.streaming import jobs, sketches

START = datetime(2024, 1, 1)
REQUESTS = "event_id long, ts timestamp, user_id long, method string, path string, status_code int, latency_ms double"


def requests(spark, moments, user=1):
    rows = [(i, START + timedelta(seconds=s), user, "GET", "/a", 200 if i % 4 else 500, float(i)) for i, s in enumerate(moments)]
    return spark.createDataFrame(rows, REQUESTS)


def test_percentiles(spark):
    rows = [(i, START, 1, "GET", "/a", 500 if i == 3 else 200, x) for i, x in enumerate((1.0, 2.0, 3.0, 10.0))]
    out = {r.endpoint: r for r in jobs.request_metrics(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert (out["*"].latency_ms_p50, out["*"].latency_ms_p95, out["GET /a"].error_rate, out["GET /a"].requests) == (2.5, 8.95, 0.25, 4)


def test_limiter_batch_and_stream(spark, tmp_path):
    batch = requests(spark, [0, 1, 2, 3, 4, 5, 180, 181, 400]).unionByName(requests(spark, [0, 500, 501], 2))
    decided = {(r.user_id, r.event_id): (r.allowed, r.remaining, r.retry_after) for r in jobs.limiter_log(batch).collect()}
    assert decided[1, 5] == (False, 0, 175.0) and decided[1, 6] == (False, 0, 0.0) and decided[1, 7] == (True, 0, 0.0) and decided[1, 8] == (True, 4, 0.0)


def test_limiter_stream_out_of_order_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    moments = {1: [0, 1, 2, 3, 4, 5, 180, 181, 400], 2: [0, 170, 175], 3: [rng.uniform(0, 600) for _ in range(40)]}
    rows = sorted((s, u) for u, own in moments.items() for s in own)
    batch = spark.createDataFrame([(i, START + timedelta(seconds=s), u, "GET", "/a", 200, 1.0) for i, (s, u) in enumerate(rows)], REQUESTS)
    # rows come up to 50 seconds out of order, in many small batches; the last one moves the watermark past all others
    shuffled = sorted(batch.collect(), key=lambda r: r.ts.timestamp() + rng.uniform(0, 50))
    parts = [shuffled[i : i + 9] for i in range(0, len(shuffled), 9)] + [[(10**6 + i, START + timedelta(seconds=5000 + i), 9, "GET", "/a", 200, 1.0)] for i in range(2)]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        file = next((tmp_path / f"part{i}").glob("*.parquet"))
        target = tmp_path / "in" / f"{i:03}.parquet"
        shutil.copy(file, target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = jobs.streamed_limiter(source)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.user_id, r.event_id): (r.allowed, r.remaining, r.retry_after) for r in spark.table("limited").collect() if r.event_id < 10**6}
    assert got == {(r.user_id, r.event_id): (r.allowed, r.remaining, r.retry_after) for r in jobs.limiter_log(batch).collect()}
    state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "log").load()
    assert {r.key.user_id for r in state.collect()} <= {9}  # idle users have left no log


def test_sketches_merge_upwards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, START + timedelta(seconds=rng.uniform(0, 86_000)), 1, "GET", rng.choice(["/a", "/b", "/ui/x"]), rng.choice([200, 500, None]), rng.lognormvariate(3, 1)) for i in range(20_000)]
    batch = spark.createDataFrame(rows, REQUESTS)
    stored = sketches.latency_sketches(batch, "10 minutes")
    stored.write.parquet(f"{tmp_path}/minutes")
    merged = sketches.sketched_metrics(sketches.rolled_up(spark.read.parquet(f"{tmp_path}/minutes"), "endpoint")).collect()
    assert {r.endpoint for r in merged} == {"GET /a", "GET /b"}
    for r in merged:
        own = [x for x in rows if f"GET {x[4]}" == r.endpoint]
        assert r.requests == len(own) and abs(r.error_rate - sum(x[5] != 200 for x in own) / len(own)) < 1e-12
        for value, point in ((r.latency_ms_p50, 0.5), (r.latency_ms_p95, 0.95)):
            assert abs(sum(x[6] <= value for x in own) / len(own) - point) < 0.03
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = sketches.latency_sketches(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), "10 minutes", "0 seconds")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.agg(F.max("start")).first()[0]
    assert out.agg(F.sum("requests")).first()[0] == stored.where(F.col("start") <= last).agg(F.sum("requests")).first()[0] > 10_000


def test_pages_and_exceptions(spark):
    rows = [(1, START, 1, "GET", "/a", None, 5.0), (2, START, 1, "GET", "/ui/x", 200, 7.0), (3, START, 1, "GET", "/a", 200, 1.0), (4, START, 1, "GET", None, 200, 1.0)]
    out = {r.endpoint: r for r in jobs.request_metrics(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert out.keys() == {"*", "GET /a", "GET"} and out["GET /a"].error_rate == 0.5 and out["*"].requests == 3


def test_streamed_metrics(spark, tmp_path):
    batch = requests(spark, [0, 1, 30, 61, 1000])
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.streamed_request_metrics(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("measured").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.requests for r in spark.table("measured").collect()) == [1, 3]


def test_upserts_equal_the_batch(spark, tmp_path):
    rows = [(u, c, t, f"d{t}") for t, (u, c) in enumerate([(1, 1), (1, 2), (2, 1), (1, 1), (3, 3), (1, 2)])]
    table = spark.createDataFrame(rows, "user_id long, candidate_id long, t int, decision string")
    write = jobs.upsert_batch(f"{tmp_path}/board", ["user_id", "candidate_id"], ["t"], buckets=3)
    for epoch, part in enumerate((table.where("t < 3"), table.where("t >= 3"), table.where("t >= 3"))):
        write(part, epoch)
    got = {(r.user_id, r.candidate_id, r.decision) for r in spark.read.parquet(f"{tmp_path}/board").collect()}
    expected = jobs.latest_rows(table, ["user_id", "candidate_id"], ["t"]).collect()
    assert got == {(r.user_id, r.candidate_id, r.decision) for r in expected} == {(1, 1, "d3"), (1, 2, "d5"), (2, 1, "d2"), (3, 3, "d4")}
    first = jobs.latest_rows(table, ["user_id", "candidate_id"], ["t"], {"created": "t"}).where("user_id = 1 and candidate_id = 1").first()
    assert (first.decision, first.created) == ("d3", 0)
    assert table.select(F.max("t")).first()[0] == 5
    assert not list(tmp_path.glob("*staged*"))


def test_upserts_keep_first_fields_through_a_crash(spark, tmp_path, monkeypatch):
    rows = [(1, 1, 0, "new", 0.5), (1, 1, 1, "interview", 0.1), (2, 1, 1, "new", 0.7), (1, 1, 2, "hired", 0.9)]
    table = spark.createDataFrame(rows, "user_id long, run_id long, t int, status string, score double")
    write = jobs.upsert_batch(f"{tmp_path}/board", ["user_id", "run_id"], ["t"], {"score": "score", "created": "t"}, buckets=2)
    parts = [part.withColumn("created", F.col("t")) for part in (table.where("t = 0"), table.where("t = 1"), table.where("t = 2"))]
    write(parts[0], 0)
    write(parts[1], 1)

    def board():
        return {(r.user_id, r.status, r.score, r.created) for r in spark.read.parquet(f"{tmp_path}/board").collect()}

    assert board() == {(1, "interview", 0.5, 0), (2, "new", 0.7, 1)}
    parts[2].write.parquet(f"{tmp_path}/board-staged-2")  # a run that ended after it had staged its rows, and is replayed
    write(parts[2], 2)
    write(parts[2], 2)
    assert board() == {(1, "hired", 0.5, 0), (2, "new", 0.7, 1)} and not list(tmp_path.glob("*staged*"))


def test_limiter_of_one_busy_user(spark):
    moments = [i * 0.7 for i in range(5000)]
    out = sorted(jobs.limiter_log(requests(spark, moments), 5, 60.0).collect(), key=lambda r: r.event_id)
    log, expected = [], []
    for m in moments:
        log = [t for t in log if t >= m - 60.0]
        expected.append(len(log) < 5)
        log += [m] * expected[-1]
    assert [r.allowed for r in out] == expected
