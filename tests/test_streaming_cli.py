from concordat import cli
from concordat.streaming.incremental import incremental_differences


def test_stream_of_two_systems(spark, tmp_path):
    src, schema = tmp_path / "in", "k string, side int, at timestamp, v string, w string"

    def arrive(n, rows):
        spark.createDataFrame(rows, "k string, side int, at string, v string, w string").selectExpr("k", "side", "cast(at as timestamp) at", "v", "w").coalesce(1).write.mode("append").parquet(str(src))

    arrive(1, [("p", 0, "2026-01-01 10:00:00", "1", None), ("q", 0, "2026-01-01 10:00:00", "1", "1"), ("r", 1, "2026-01-01 10:00:00", "1", "1"), (None, 0, "2026-01-01 10:00:00", "1", "1")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(src))
    q = incremental_differences(stream, "k", "side", "at", ["v", "w"]).writeStream.format("memory").queryName("inc").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        arrive(2, [("p", 1, "2026-01-01 10:01:00", "2", None), ("q", 1, "2026-01-01 10:01:00", "1", "1")])
        q.processAllAvailable()
        arrive(3, [("p", 1, "2026-01-01 10:00:30", "9", "9"), ("z", 0, "2026-01-01 20:00:00", "1", "1")])
        q.processAllAvailable()
        arrive(4, [("z", 0, "2026-01-01 20:00:01", "1", "1")])
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("inc").collect()}
    finally:
        q.stop()
    assert {("p", "differs", "v"), ("q", "equal", None), ("r", "missing_0", None)} <= got and not any(k == "p" and f == "w" for k, _, f in got)


def test_cli(spark, sf, tmp_path, capsys):
    assert cli.main(["rules", "--markdown"]) == 0 and capsys.readouterr().out.startswith("| Field")
    assert cli.main(["--mapping", "/nowhere.yaml", "rules"]) == 2
    assert cli.main(["run", "--tables", sf, "--out", "x", "--choose", "dates=never"]) == 2
    counts = cli.run(spark, cli.config.load(), sf, str(tmp_path / "out"))
    findings = spark.read.parquet(str(tmp_path / "out" / "findings"))
    alone = findings.where("target_field = 'affectation'").count()
    assert sum(counts.values()) == findings.count() == 25 * spark.read.parquet(str(tmp_path / "out" / "pairs")).where("l is not null and r is not null").count() + alone and counts["CONFORME"] > 0
    assert spark.read.parquet(str(tmp_path / "out" / "pairs")).where("l is null or r is null").count() == alone
    assert (tmp_path / "out" / "to_investigate.csv").read_bytes().startswith(b"\xef\xbb\xbf")
