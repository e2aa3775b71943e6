import json

from pyspark.sql import functions as F

from cartulary.streaming import observations as obs

SCHEMA = "id string, lineage string, digest string, at timestamp"


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(dict(zip(("id", "lineage", "digest", "at"), r, strict=True))) + "\n" for r in rows))


def run(df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_intake_and_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.json", [("1", "x", "d1", "2026-01-01T00:01:00Z"), ("1", "x", "d1", "2026-01-01T00:02:00Z"), ("2", "y", "d2", "2026-01-01T00:03:00Z")])
    write(folder, "b.json", [("1", "x", "d1", "2026-01-01T00:04:00Z"), ("1", "x", "d9", "2026-01-01T00:21:00Z"), ("3", "y", "d3", "2026-01-01T01:30:00Z")])
    stream = obs.read_files(spark, str(folder), SCHEMA, 1)
    run(obs.once_each(stream, ["id", "digest"], "at", "1 hour"), "once", "append", str(tmp_path / "c1"))
    assert sorted((r.id, r.digest) for r in spark.table("once").collect()) == [("1", "d1"), ("1", "d9"), ("2", "d2"), ("3", "d3")]
    run(obs.coverage_by_window(stream, "lineage", "at", "10 minutes", "5 minutes"), "windows", "append", str(tmp_path / "c2"))
    closed = {(r.window_start.minute, r.lineage): r.n_observations for r in spark.table("windows").collect()}
    batch = spark.read.schema(SCHEMA).json(str(folder))
    whole = {(r.window_start.hour * 60 + r.window_start.minute, r.lineage): r.n_observations for r in obs.coverage_by_window(batch, "lineage", "at", "10 minutes", "5 minutes").collect()}
    assert closed == {k: v for k, v in whole.items() if k[0] < 80}
    assert obs.freshness(batch, ["lineage"], "at").where("lineage = 'x'").first().n_observations == 4


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "id string, digest string")
    path = str(tmp_path / "t")
    assert obs.append_new(df, path, ["id", "digest"]) == 2 and obs.append_new(df, path, ["id", "digest"]) == 0
    assert obs.append_new(df.withColumn("digest", F.lit("z")), path, ["id", "digest"]) == 2
    assert spark.read.parquet(path).count() == 4
