import numpy as np
import pytest

from matchloom.sources import matrices


def test_vectors_come_to_their_rows(spark, tmp_path):
    values = np.random.default_rng(1).normal(size=(1003, 7)).astype(np.float32)
    np.save(tmp_path / "vectors.npy", values)
    read = matrices.read_matrix(spark, f"{tmp_path}/vectors.npy", 100)
    assert read.rdd.getNumPartitions() == 11
    assert np.array_equal(np.array([r.embedding for r in read.orderBy("position").collect()], np.float32), values)
    # a table of several files of different sizes; its order is that of the files' names and of the rows in them
    table = spark.range(1003).selectExpr("id as job", "concat('t', id) as title")
    table.where("job < 50").coalesce(1).write.parquet(f"{tmp_path}/a")
    table.where("job >= 50").coalesce(1).write.parquet(f"{tmp_path}/b")
    (tmp_path / "jobs").mkdir()
    for name in "ab":
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "jobs" / f"{name}.parquet")
    rows = matrices.read_with_positions(spark, f"{tmp_path}/jobs")
    joined = matrices.attach_by_position(rows, read).collect()
    assert len(joined) == 1003 and all(r.position == r.job and np.array_equal(np.array(r.embedding, np.float32), values[r.job]) for r in joined)
    with pytest.raises(ValueError, match="50 rows, but 1003 vectors"):
        matrices.attach_by_position(matrices.read_with_positions(spark, f"{tmp_path}/jobs/a.parquet"), read)


def test_wrong_files(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.arange(5))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((4, 3))))
    for name in ("flat", "columns"):
        with pytest.raises(ValueError, match="no matrix"):
            matrices.matrix_shape(f"{tmp_path}/{name}.npy")
    np.save(tmp_path / "none.npy", np.ones((0, 3)))
    assert matrices.read_matrix(spark, f"{tmp_path}/none.npy").count() == 0
    np.save(tmp_path / "cut.npy", np.ones((100, 3)))
    data = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(data[:-500])
    with pytest.raises(Exception, match="cut off in row"):
        matrices.read_matrix(spark, f"{tmp_path}/cut.npy").collect()
