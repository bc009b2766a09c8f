from treeline.schema import INVENTORY
from treeline.streaming import arrivals


def drop(spark, folder, rows):
    df = spark.createDataFrame(rows, "drive_id string, row_seq long, path string, md5_hash string, size_bytes long")
    wide = df.selectExpr(*[
        c.name if c.name in df.columns else f"cast(null as {c.dataType.simpleString()}) as {c.name}"
        for c in INVENTORY])
    wide.coalesce(1).write.mode("append").parquet(folder)


def test_arrivals_keep_first_rows_and_find_copies(spark, tmp_path):
    drops, state = str(tmp_path / "drops"), str(tmp_path / "state")
    drop(spark, drops, [("D:", 1, "a", "h1", 1), ("D:", 2, "b", "h2", 1), ("D:", 3, "a", "h9", 1)])
    first = {r.path: r for r in arrivals.run_available(spark, drops, state).collect()}
    assert set(first) == {"a", "b"} and first["a"].md5_hash == "h1"
    drop(spark, drops, [("D:", 4, "c", "h1", 1), ("D:", 5, "b", "h5", 1)])
    drop(spark, drops, [("D:", 6, "d", "h2", 1), ("E:", 7, "e", "h1", 1)])
    out = {r.path: r for r in arrivals.run_available(spark, drops, state, files_per_batch=1).collect()}
    assert set(out) == {"a", "b", "c", "d", "e"} and out["b"].md5_hash == "h2"
    assert out["c"].duplicate_source_path == "a" and out["d"].duplicate_source_path == "b"
    assert out["e"].duplicate_kind == ""
    # A batch that is repeated after a failure replaces its own rows only.
    stored = arrivals.read_state(spark, state)
    last = stored.agg({"batch_id": "max"}).first()[0]
    arrivals.arrival_writer(state)(
        spark.read.schema(INVENTORY).parquet(drops).where("path = 'd'"), last)
    assert {r.path for r in arrivals.read_state(spark, state).collect()} >= {"a", "b", "c", "d"}


def test_only_touched_prefixes_are_opened(spark, tmp_path):
    drops, state = str(tmp_path / "drops"), str(tmp_path / "state")
    drop(spark, drops, [("D:", i, f"p{i}", f"h{i % 40}", 1) for i in range(200)])
    arrivals.run_available(spark, drops, state)
    shape = "drive_id string, row_seq long, path string, md5_hash string, size_bytes long"
    small = spark.createDataFrame([("D:", 900, "p7", "h3", 1), ("D:", 901, "new", "h5", 1)], shape)
    touched = arrivals.touched_prefixes(small)
    assert all(1 <= len(p) <= 2 for p in touched.values())
    for name, _, _ in arrivals.INDEXES:
        read = arrivals.read_index(spark, state, name, touched[name], 9)
        opened = {f.split("prefix=")[1].split("/")[0] for f in read.inputFiles()}
        assert opened <= {str(p) for p in touched[name]} and read.count() < 30
    by_hash = arrivals.read_index(spark, state, "by_hash", touched["by_hash"], 9).where("md5_hash = 'h5'")
    assert by_hash.count() == 5
    # The same answer as with everything at hand.
    everything = [arrivals.read_index(spark, state, n, list(range(arrivals.PREFIXES)), 9) for n, _, _ in arrivals.INDEXES]
    none = [spark.createDataFrame([], s) for s in ("md5_hash string, baseline_path string",
                                                  "md5_hash string, kept_path string, kept_target string")]
    few = [arrivals.read_index(spark, state, n, touched[n], 9) for n, _, _ in arrivals.INDEXES]
    want, got = ([tuple(r) for r in arrivals.add_arrivals(small, *x, *none).collect()] for x in (everything, few))
    assert want == got and [r[1] for r in got] == ["new"]
    assert arrivals.read_index(spark, state, "by_path", [0], 0).count() == 0
