import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import pixel_frame
from pixloom.sources import dense
from pixloom.streaming import telemetry


def frame(spark, sizes, rng):
    made = {i: {c: rng.integers(0, 256, s) / 255.0 for c in "rgb"} for i, s in sizes.items()}
    parts = [pixel_frame(spark, planes, i).select("image_id", "row", "col", *"rgb") for i, planes in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return made, out.repartition(4)


def test_written_files_are_column_major_and_read_back(spark, tmp_path):
    sizes = {1: (7, 5), 2: (3, 11), 30: (1, 1)}
    made, px = frame(spark, sizes, np.random.default_rng(5))
    path = str(tmp_path / "dense")
    dense.write_dense(px, path, tuple("rgb"))
    raw = np.fromfile(tmp_path / "dense" / "image_001.bin", np.uint8).reshape((7, 5, 3), order="F")
    assert all((raw[:, :, k] == np.rint(made[1][c] * 255)).all() for k, c in enumerate("rgb"))
    strips = dense.read_dense(spark, path, split_bytes=10)
    parts = dense.DenseReader(path, "uint8", 10).partitions()
    assert len(parts) > 15 and all(sum((s.last - s.first) * s.height for s in p.strips) <= 10 for p in parts)
    back = dense.dense_pixels(strips, tuple("rgb")).collect()
    assert len(back) == sum(h * w for h, w in sizes.values())
    for r in back:
        assert all(abs(r[c] - made[r["image_id"]][c][r["row"] - 1, r["col"] - 1]) < 1e-6 for c in "rgb")


def test_ids_prune_files_and_bad_files_are_named(spark, tmp_path):
    _, px = frame(spark, {1: (2, 2), 2: (2, 3)}, np.random.default_rng(6))
    path = str(tmp_path / "dense")
    dense.write_dense(px, path, tuple("rgb"))
    with open(tmp_path / "dense" / "image_002.bin", "ab") as f:
        f.write(b"more")
    one = dense.read_dense(spark, path).where("image_id = 1")
    reader = dense.DenseReader(path, "uint8", 100)
    with pytest.raises(ValueError, match="image_002"):
        reader.partitions()
    left = list(reader.pushFilters([dense.EqualTo(("image_id",), 1), dense.EqualTo(("col",), 2)]))
    assert len(left) == 1 and {s.image_id for p in reader.partitions() for s in p.strips} == {1}
    assert one.count() == 6
    with pytest.raises(Exception, match="image_002"):
        dense.read_dense(spark, path).count()


def test_floats_and_missing_columns(spark, tmp_path):
    _, px = frame(spark, {4: (3, 3)}, np.random.default_rng(7))
    path = str(tmp_path / "f")
    dense.write_dense(px, path, ("r",), "float32")
    got = {(r["row"], r["col"]): r["r"] for r in dense.dense_pixels(dense.read_dense(spark, path, "float32"), ("r",)).collect()}
    assert all(got[r["row"], r["col"]] == np.float32(r["r"]) for r in px.collect())
    with pytest.raises(Exception, match="missing, double or too short"):
        dense.write_dense(px.where(F.col("col") != 2), str(tmp_path / "g"), ("r",))


def test_a_commit_message_takes_sixteen_bytes_a_file(tmp_path):
    from pyspark.sql import Row

    rows = [Row(image_id=i, channel=1, col=1, height=2, pixels=[0.0, 1.0]) for i in range(1, 501)]
    writer = dense.DenseWriter(str(tmp_path), "uint8")
    message = writer.write(iter(rows))
    assert len(pickle.dumps(message)) < 500 * 16 + 300
    writer.commit([message, None])
    assert len(list(tmp_path.glob("image_*.bin"))) == 500 and not list(tmp_path.glob(".part*"))
    again = writer.write(iter(rows[:3]))
    assert len(list(tmp_path.glob(".part*"))) == 3
    writer.abort([again])
    assert not list(tmp_path.glob(".part*"))


def test_files_of_a_batch_are_looked_up_by_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1, 61):
        (tmp_path / "in" / f"image_{i:03d}.bin").write_bytes(b"x" * i)
    files = telemetry.ingest_stream(spark, str(tmp_path / "in"), "bin", 1000).select("path", "length")
    query = files.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query = query.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(str(query.runId))
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= telemetry.LISTERS
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
