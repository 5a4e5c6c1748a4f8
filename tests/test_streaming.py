"""The stream gives what one batch gives."""


def test_stream_equals_batch(spark, tmp_path):
    from namewright.streaming.arrivals import assign, start

    schema = "pid bigint, block string, year int, authors array<string>"
    rows = [(1, "x", 2000, ["a", "b"]), (2, "x", 2001, ["c"]), (3, "y", 1999, ["a"]), (4, "z", 1999, ["a"])]
    profiles = spark.createDataFrame([("x", 10, 2000, ["a"]), ("x", 11, 2000, ["c", "d"]), ("y", 12, 1990, ["q"])], "block string, aid bigint, last_year int, authors array<string>")
    papers = spark.createDataFrame(rows, schema)
    for i in range(2):
        papers.where(f"pid % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(stream, profiles, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r["pid"], r["aid"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["pid"], r["aid"], r["score"]) for r in assign(papers, profiles).collect()) and [g[:2] for g in got] == [(1, 10), (2, 11)]
