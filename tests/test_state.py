import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import known, live, metrics, scale
from tidemark.sources import tables, versions
from tidemark.streaming import ingest, state

PLAYS = ("game_id string, event_num double, period int, scoreHome double, scoreAway double, at timestamp, _seq long")


def play(game, n, h, a, seq, minute=0, period=1):
    return (game, n, period, h, a, f"2024-11-01 10:{minute:02d}:00", seq)


FILES = [
    [play("1", 1.0, 2.0, 0.0, 0), play("1", 300.0, 9.0, 4.0, 1), play("2", 1.0, None, 3.0, 2)],
    [play("1", 301.0, 2.0, 0.0, 3, 1), play("1", 2.0, 5.0, 6.0, 4, 1), play("3", None, 7.0, 7.0, 5, 1)],
    [play("2", 1.0, 4.0, 3.0, 6, 2), play("3", 1.0, -1.0, None, 7, 2), play("1", 300.0, 9.0, 4.0, 8, 2)],
]


def land(spark, rows, path):
    df = spark.createDataFrame(rows, PLAYS.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def landed(spark, tmp_path):
    for rows in FILES:
        land(spark, rows, str(tmp_path / "in"))
    return str(tmp_path)


def files(spark, root, schema=PLAYS):
    return ingest.read_stream(spark, f"{root}/in", schema, files_per_batch=1)


def test_state_between_batches_gives_the_batch_result(spark, tmp_path):
    root, sizes = str(tmp_path), []
    for rows in FILES:
        land(spark, rows, f"{root}/in")
        query = state.start_live_state(files(spark, root), f"{root}/blocks", f"{root}/cp", "at", "1 hour")
        query.awaitTermination()
        sizes.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert sizes == [3, 3, 3]  # a batch reads its own rows and the state, no stored events
    got = {r.game_id: r for r in state.current_scores(tables.read_table(spark, f"{root}/blocks", state.BLOCKS)).collect()}
    assert (got["1"].home_score, got["1"].away_score, got["1"].last_event, got["1"].event_rows) == (9.0, 6.0, 301.0, 5)
    assert (got["2"].home_score, got["2"].away_score) == (4.0, 3.0)
    assert (got["3"].home_score, got["3"].away_score, got["3"].event_rows) == (0.0, 0.0, 1)
    plays = spark.read.parquet(f"{root}/in").dropna(subset=["event_num"])
    batch = live.running_scores(live.dedupe_events(plays).withColumnsRenamed({}))
    top = {r.game_id: (r.h, r.a) for r in batch.groupBy("game_id").agg(
        F.max("home_score").alias("h"), F.max("away_score").alias("a")).collect()}
    assert {k: (r.home_score, r.away_score) for k, r in got.items()} == top


def test_a_replayed_state_batch_changes_nothing(spark, tmp_path):
    changed = spark.createDataFrame([("1", None, 0, 5.0, 4.0, 9.0, 3)], "game_id string, day timestamp, block long, "
                                    "home double, away double, last_event double, event_rows long")
    step = state.keep_blocks(f"{tmp_path}/blocks")
    step(changed, 4)
    step(changed, 4)
    assert tables.read_table(spark, f"{tmp_path}/blocks", state.BLOCKS).count() == 1


def test_last_arrivals_equal_the_batch_keep_last(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(400):
        rows.append((str(rng.randint(1, 4)), float(rng.randint(1, 9)), 1, float(i), None, f"2024-11-{rng.randint(1, 9):02d} 00:00:00", i))
    closing = [("9", 1.0, 1, 0.0, None, "2024-12-30 00:00:00", 999)]
    rng.shuffle(rows)
    for part in (rows[:150], rows[150:], closing):
        land(spark, part, f"{tmp_path}/in")
    out = state.last_arrivals(files(spark, str(tmp_path)), "at", "20 days")
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(
        availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    everything = spark.read.parquet(f"{tmp_path}/in").where("game_id <> '9'")
    want = scale.keep_last(everything, ["at", *live.EVENT_KEY], "_seq")
    assert got.columns == everything.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100


def run_coverage(spark, root, games):
    events, counts, deltas, totals = (f"{root}/{n}" for n in ("table", "counts", "deltas", "totals"))
    ingest.start_ingest(
        files(spark, root), events, f"{root}/bad", f"{root}/cp", bucket_games=1,
        first=state.note_deltas(events, counts, deltas), then=state.apply_deltas(deltas, games, counts, totals),
    ).awaitTermination()
    return events, totals


def test_deltas_equal_a_full_count(spark, landed):
    games = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "c")], "game_id string, season string")
    events, totals = run_coverage(spark, landed, games)
    full = tables.read_table(spark, events).join(games, "game_id").groupBy("season").agg(
        F.countDistinct("game_id").alias("g"), F.count(F.lit(1)).alias("n"))
    got = tables.read_table(spark, totals, state.TOTALS)
    assert {(r.season, r.collected_games, r.total_event_rows, r._seq) for r in got.collect()} == {("a", 1, 4, 2), ("b", 2, 2, 2)}
    assert {(r.season, r.g, r.n) for r in full.collect()} == {("a", 1, 4), ("b", 2, 2)}


def test_a_coverage_batch_that_runs_twice_counts_once(spark, tmp_path):
    games = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "game_id string, season string")
    paths = [f"{tmp_path}/{n}" for n in ("table", "counts", "deltas", "totals")]
    note, apply = state.note_deltas(*paths[:3]), state.apply_deltas(paths[2], games, paths[1], paths[3])
    step = ingest.ingest_batch(paths[0], f"{tmp_path}/bad", 1, then=apply, first=note)
    stamped = [spark.createDataFrame(f, PLAYS.replace("timestamp", "string")) for f in FILES]
    step(stamped[0], 0)
    step(stamped[0], 0)

    def seasons():
        return {r.season: (r.collected_games, r.total_event_rows, r._seq) for r in tables.read_table(spark, paths[3], state.TOTALS).collect()}

    assert seasons() == {"a": (1, 2, 0), "b": (1, 1, 0)}
    step(stamped[1], 1)  # touches season a only
    assert seasons() == {"a": (1, 4, 1), "b": (1, 1, 0)}
    step(stamped[2], 2)
    step(stamped[2], 2)
    assert seasons() == {"a": (1, 4, 2), "b": (2, 2, 2)}


def test_a_batch_lost_before_its_pointers_leaves_the_old_table(spark, tmp_path):
    schema = "k int, v string, p string, _seq long"
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), schema)
    versions.upsert(path, rows((1, "old", "x", 0), (2, "old", "y", 1), (3, "old", None, 2)), ["k"], ["p"])

    def lost(*_):
        raise RuntimeError("lost")

    def now():
        return sorted((r.k, r.v) for r in versions.read(spark, path, rows().schema, ["p"]).collect())

    with pytest.raises(RuntimeError):
        versions.upsert(path, rows((1, "new", "x", 3), (4, "new", "y", 4)), ["k"], ["p"], point=lost)
    assert now() == [(1, "old"), (2, "old"), (3, "old")]
    versions.upsert(path, rows((1, "new", "x", 3), (4, "new", "y", 4), (3, "new", None, 5)), ["k"], ["p"])
    versions.upsert(path, rows((1, "newer", "x", 6)), ["k"], ["p"])
    assert now() == [(1, "newer"), (2, "old"), (3, "new"), (4, "new")]
    assert versions.read(spark, str(tmp_path / "none"), rows().schema, ["p"]) is None


def test_a_version_has_as_many_files_as_its_size_asks_for(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.range(0, 900).select("id", (F.col("id") % 300).alias("p"), F.lit(0).cast("long").alias("_seq"))
    versions.upsert(str(path), rows, ["id"], ["p"])
    assert 1 <= len(list(path.glob("data/**/*.parquet"))) <= 8  # not one for each of the 300 partitions
    versions.upsert(str(path), rows.where("p IN (7, 9)").withColumn("_seq", F.lit(1).cast("long")), ["id"], ["p"])
    got = versions.read(spark, str(path), rows.schema, ["p"])
    assert sorted((r.id, r.p, r._seq) for r in got.collect()) == [(i, i % 300, int(i % 300 in (7, 9))) for i in range(900)]
    some = spark.createDataFrame([(8,), (9,), (None,)], "p long")
    got = versions.read(spark, str(path), rows.schema, ["p"], some)
    assert sorted((r.id, r._seq) for r in got.collect()) == [(8, 0), (9, 1), (308, 0), (309, 1), (608, 0), (609, 1)]


def folders(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("*=*"))


def test_an_upsert_writes_a_partition_once_without_adaptive_plans(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select("id", (F.col("id") % 5).alias("p"), F.lit(0).cast("long").alias("_seq"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in streams with state
    try:
        tables.upsert(f"{tmp_path}/t", rows, ["id"], ["p"])
        tables.upsert(f"{tmp_path}/t", rows.where("p < 2"), ["id"], ["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4000
    assert len(list((tmp_path / "t").glob("*/*.parquet"))) == 5


def test_states_of_many_games_share_a_file(spark, tmp_path):
    changed = spark.createDataFrame([(str(g), None, 0, 5.0, 4.0, 9.0, 3) for g in range(1, 20000, 1000)],
                                    "game_id string, day timestamp, block long, home double, away double, last_event double, event_rows long")
    state.keep_blocks(f"{tmp_path}/blocks")(changed, 0)
    assert folders(tmp_path / "blocks") == ["bucket=0"]


def test_counts_of_many_games_share_a_file(spark, tmp_path):
    ids = [str(g) for g in range(1, 20000, 1000)]
    games = spark.createDataFrame([(i, "a") for i in ids], "game_id string, season string")
    paths = [f"{tmp_path}/{n}" for n in ("table", "counts", "deltas", "totals")]
    note, apply = state.note_deltas(*paths[:3]), state.apply_deltas(paths[2], games, paths[1], paths[3])
    step = ingest.ingest_batch(paths[0], f"{tmp_path}/bad", 1, then=apply, first=note)
    schema = PLAYS.replace("timestamp", "string")
    step(spark.createDataFrame([play(i, 1.0, 2.0, 0.0, 0) for i in ids], schema), 0)
    step(spark.createDataFrame([play(i, n, 2.0, 0.0, 1) for i in ids[:5] for n in (1.0, 2.0)], schema), 1)
    assert folders(tmp_path / "counts") == ["bucket=0"] and len(folders(tmp_path / "table")) == len(ids)
    totals = tables.read_table(spark, paths[3], state.TOTALS).first()
    assert (totals.collected_games, totals.total_event_rows) == (20, 25)
    counts = tables.read_table(spark, paths[1], state.COUNTS)
    assert sorted(r.event_rows for r in counts.collect()) == [1] * 15 + [2] * 5


def test_known_games_without_the_event_table(spark, tmp_path):
    path = f"{tmp_path}/known"
    rows = lambda *ids: spark.createDataFrame([(i, "2024-25" if i and i < "0022500000" else None) for i in ids], "game_id string, season string")
    games = rows("0022400001", "0022400002", "0022432768", "0022432769", "0000000000", "22400001", "x1", "x2", None, "0022600001")
    assert known.left_to_collect(games, path).count() == 10
    known.add(path, rows("0022400001", "0022400001", "x1", None))
    known.add(path, rows("0022432768", "0022600001", "0000000000", "0022400001"))
    left = known.left_to_collect(games, path)
    assert {r.game_id for r in left.collect()} == {"0022400002", "0022432769", "22400001", "x2", None}
    assert left.columns == games.columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_auc_needs_no_range_sort_and_no_checkpoint(spark):
    rng = random.Random(3)
    rows = [("m", rng.randint(0, 1), rng.choice([rng.random(), 0.25, 1e-300 * rng.random(), None, float("nan")])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    out = metrics.roc_auc(df, ["g"])
    text = plan(out)
    assert "rangepartitioning" not in text and "Scan ExistingRDD" not in text.replace("Scan ExistingRDD[g", "")
    key = lambda p: (0, 0.0) if p is None else (2, 0.0) if p != p else (1, p)
    pos, neg = ([key(p) for _, y, p in rows if y == k] for k in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert out.first().roc_auc == pytest.approx(want, abs=1e-12)


def test_a_split_runs_its_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, counted(F.col("id").cast("int"))).alias("x"))
    good, bad = tables.write_split(df, str(tmp_path / "t"), ["x"])
    assert (good.count(), bad.count(), good.columns) == (30, 10, ["id", "x"])
    assert seen.value <= 40
    empty, none = tables.write_split(df.limit(0), str(tmp_path / "e"), ["x"])
    assert (empty.count(), none.count()) == (0, 0)


def test_sorted_files_let_a_filter_read_one(spark, tmp_path):
    df = spark.range(0, 4000).select(
        (F.col("id") % 4).alias("season"), F.lpad(F.col("id").cast("string"), 10, "0").alias("game_id")).repartition(7)
    tables.write_sorted(df, str(tmp_path / "t"), ["season", "game_id"], files=5)
    rows = spark.read.parquet(str(tmp_path / "t"))
    ranges = sorted((r.lo, r.hi) for r in rows.groupBy(F.input_file_name()).agg(
        F.min(F.struct("season", "game_id")).alias("lo"), F.max(F.struct("season", "game_id")).alias("hi")).collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum(lo <= (1, "0000000041") <= hi for lo, hi in ranges) == 1
