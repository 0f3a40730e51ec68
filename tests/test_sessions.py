import random

from findings_engine.streaming import sessions as S

SCHEMA = "session string, ts timestamp, event_id bigint, kind string, continuing boolean"


def _events(seed=3, n=400):
    import datetime

    r = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    kinds = [S.EDIT, S.GROW, S.STOP, S.START, "other"]
    return [(f"s{r.randrange(5)}", at + datetime.timedelta(seconds=i), i, r.choice(kinds), r.random() < 0.1) for i in range(n)]


def _plain(rows):
    state, out = {}, set()
    for s, _, i, kind, continuing in rows:
        m = state.setdefault(s, set())
        if kind == S.START:
            m.clear()
        elif kind == S.EDIT:
            m.add("edited")
        elif kind == S.GROW and "edited" in m:
            m.add("grown")
        elif kind == S.STOP:
            block = not continuing and "edited" in m and "grown" not in m and "prompted" not in m
            if not continuing and "edited" in m and "grown" in m:
                m.clear()
            elif block:
                m.add("prompted")
            out.add((s, i, "block" if block else "pass"))
    return out


def test_batch_equals_a_plain_loop(spark):
    from findings_engine.plans.tables import stored

    # Few sessions and as many tasks: parts begin within a session, and some hold nothing but one.
    for seed, sessions in ((3, 5), (4, 1), (5, 2)):
        rows = [(f"s{hash(r[0]) % sessions}", *r[1:]) for r in _events(seed)]
        got = {tuple(r) for r in S.capture(spark.createDataFrame(rows, SCHEMA), stored).collect()}
        assert got == _plain(rows) and any(x[2] == "block" for x in got)
    assert S.capture(spark.createDataFrame([], SCHEMA), stored).count() == 0


def test_growth_needs_proof(spark):
    stops = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, None), ("e", 1, "x")], "session string, ts int, register_sha string")
    base = spark.createDataFrame([("a", True, "x"), ("b", True, "y"), ("c", False, None), ("d", False, None)], "session string, exists boolean, sha256 string")
    assert {r.session for r in S.growth(stops, base).collect()} == {"b", "c"}


def test_stream_equals_batch(spark, tmp_path):
    rows = _events(5, 200)
    for k in range(2):  # two micro-batches in the order of time
        spark.createDataFrame(rows[100 * k : 100 * (k + 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = S.capture_stream(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
    q.trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == _plain(rows)


def test_many_edits_one_refresh(spark, tmp_path):
    spark.createDataFrame(_events(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    S.refresh_on(src, lambda edits, n: seen.append(edits.count()), str(tmp_path / "c")).awaitTermination(120)
    assert len(seen) == 1 and seen[0] > 1
