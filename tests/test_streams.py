import datetime as dt


from tesserae.streaming import jobs

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROW = "user string, ts timestamp, what string"


def rows_at(spark, rows):
    return spark.createDataFrame([(u, BASE + dt.timedelta(minutes=m), w) for u, m, w in rows], ROW)


def streamed(spark, job, batches, folder):
    """What ``job`` emits when each of ``batches`` is a micro-batch of its own, whatever its times are."""
    for i, batch in enumerate(batches):
        rows_at(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(rows_at(spark, []).schema).parquet(f"{folder}/source")
        writer = job(stream).writeStream.format("parquet").option("path", f"{folder}/sink").option("checkpointLocation", f"{folder}/marks").outputMode("append")
        writer.trigger(availableNow=True).queryName(f"b{i}").start().awaitTermination()
    return spark.read.parquet(f"{folder}/sink")


def minutes(t):
    return round((t.replace(tzinfo=dt.timezone.utc) - BASE).total_seconds() / 60)


def test_late_rows_merge_sessions(spark, tmp_path):
    batches = [[("a", 0, "x"), ("a", 50, "x"), ("b", 10, "y")], [("a", 25, "late"), ("b", 100, "y")], [("a", -500, "too late"), ("b", 2000, "end")]]
    got = streamed(spark, lambda s: jobs.sessions(s, "user", "ts", "30 minutes", "2 hours"), batches, str(tmp_path))
    assert sorted((r.user, minutes(r.start), minutes(r.end), r.n) for r in got.collect()) == [("a", 0, 50, 3), ("b", 10, 10, 1), ("b", 100, 100, 1)]


def test_sessions_of_a_batch_and_a_stream_agree(spark, tmp_path):
    rows = [(u, m, "x") for u, times in (("a", [0, 5, 29, 60, 61, 200]), ("b", [3, 90, 118, 119])) for m in times]
    df = rows_at(spark, rows)
    job = lambda s: jobs.sessions(s, "user", "ts", "30 minutes")
    stream = jobs.replayed(spark, df, "ts", 3, job, str(tmp_path), {"user": "~"}).filter("user <> '~'")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, job(df).collect()))


def expected(rows, ttl):
    out, held = [], {}
    for u, m, w in sorted(rows, key=lambda r: r[1]):
        if u in held and m > held[u][0] + ttl:
            out.append((u, *held.pop(u)))
        held[u] = (m, w, held[u][2] + 1 if u in held else 1)
    return sorted([*out, *((u, *h) for u, h in held.items())])


def test_state_expires_and_is_forgotten(spark, tmp_path):
    rows = [(f"u{k % 7}", 13 * k + (k % 5) * 90 + (2000 if k > 60 else 0), f"w{k}") for k in range(100)]
    with jobs.rocksdb_state(spark):
        got = jobs.replayed(spark, rows_at(spark, rows), "ts", 4, lambda s: jobs.expiries(s, "user", "ts", "what", "6 hours"), str(tmp_path), {"user": "~"})
        assert sorted((r.key, round(r.last_ms / 60000 - BASE.timestamp() / 60), r.value, r.n) for r in got.filter("key <> '~'").collect()) == expected(rows, 360)
        left = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/marks")
        assert left.count() <= 1
    assert all(r.expired_ms == r.last_ms + 6 * 3_600_000 for r in got.collect())


def test_no_rows(spark, tmp_path):
    job = lambda s: jobs.sessions(s, "user", "ts", "30 minutes")
    assert jobs.replayed(spark, rows_at(spark, []), "ts", 2, job, str(tmp_path), {"user": "~"}).count() == 0


def test_runs_of_a_key_that_have_ended_are_told_in_one_frame():
    """However many of a key's runs end with a batch, its task makes one frame of them and asks for its state once."""
    import pandas as pd

    class Value:
        held, asked = (0, "a", 1), 0

        def get(self):
            self.asked += 1
            return self.held

        def exists(self):
            self.asked += 1
            return self.held is not None

        def update(self, held):
            self.held = held

    class Handle:
        timers = {10}

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    job = jobs.Expiry("ts", "what", 10)
    job.held, job.handle = Value(), Handle()
    part = pd.DataFrame({"ts": [400, 100, 200, 205], "at_ms": [400, 100, 200, 205], "what": ["e", "b", "c", "d"]})
    frames = list(job.handleInputRows(("k",), iter([part]), None))
    assert len(frames) == 1 and job.held.asked == 1
    assert frames[0].to_dict("list") == {"key": ["k"] * 3, "last_ms": [0, 100, 205], "value": ["a", "b", "d"], "n": [1, 1, 2], "expired_ms": [10, 110, 215]}
    assert job.held.held == (400, "e", 1) and job.handle.timers == {410}
