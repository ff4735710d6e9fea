import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import live
from tidemark.sources import tables
from tidemark.streaming import ingest

PLAYS = ("game_id string, event_num double, event_msg_type string, event_msg_action_type string, "
         "period int, pctimestring string, scoreHome double, scoreAway double, home_team string, "
         "away_team string, season string, game_date string, _seq long")


def play(game, n, h, a, seq, period=1):
    return (game, n, "Foul", None, period, "10:00", h, a, "H", "A", "2024-25", "2024-11-01", seq)


FILES = [
    [play("1", 1.0, 2.0, 0.0, 0), play("1", 5.0, 9.0, 4.0, 1), play("2", 1.0, 0.0, 3.0, 2)],
    [play("1", 6.0, 2.0, 0.0, 3), play("1", 3.0, 5.0, 4.0, 4), play("1", None, 1.0, 1.0, 5)],
    [play("2", 1.0, 4.0, 3.0, 6), play("3", 1.0, 1.0, 1.0, 7), play("3", 2.0, 1.0, 1.0, 8, None)],
]


@pytest.fixture
def landed(spark, tmp_path):
    for i, rows in enumerate(FILES):
        df = spark.createDataFrame(rows, PLAYS).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path)


def run(spark, root, then=None):
    stream = ingest.read_stream(spark, f"{root}/in", PLAYS, files_per_batch=1)
    ingest.start_ingest(stream, f"{root}/table", f"{root}/bad", f"{root}/cp", bucket_games=1,
                        then=then).awaitTermination()


def test_late_scores_and_repeats_end_up_as_in_the_batch_job(spark, landed):
    games = spark.createDataFrame([(str(i), "2024-25", "d", "H", "A", "1", "2", 0) for i in (1, 2, 3)],
                                  "game_id string, season string, game_date string, "
                                  "home_team string, away_team string, home_team_id string, "
                                  "away_team_id string, _seq long")
    run(spark, landed, ingest.refresh_live_state(f"{landed}/table", games, f"{landed}/features"))
    everything = spark.createDataFrame([r for f in FILES for r in f], PLAYS)
    valid = everything.dropna(subset=["game_id", "event_num", "period"])
    want, _, _ = live.build_live(valid, games)
    columns = want.columns
    got = tables.read_table(spark, f"{landed}/features").select(*columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want)
    late = got.filter("game_id = '1' AND event_num = 6").first()
    assert (late.home_score, late.away_score) == (9.0, 4.0)
    assert spark.read.parquet(f"{landed}/bad").count() == 2
    fixed = got.filter("game_id = '2'").first()
    assert fixed.home_score == 4.0


def test_a_batch_that_runs_twice_changes_nothing(spark, landed):
    rows = spark.createDataFrame(FILES[0], PLAYS)
    step = ingest.ingest_batch(f"{landed}/t", f"{landed}/q", bucket_games=1)
    step(rows, 0)
    step(rows, 0)
    assert spark.read.parquet(f"{landed}/t").count() == 3


def test_coverage_follows_the_stream(spark, landed):
    games = spark.createDataFrame([(str(i), "2024-25") for i in range(1, 6)],
                                  "game_id string, season string")
    run(spark, landed, ingest.refresh_coverage(
        f"{landed}/table", games, f"{landed}/counts", f"{landed}/report", "2026-01-01"))
    r = tables.read_table(spark, f"{landed}/report").first()
    assert (r.eligible_games, r.collected_games, r.remaining_games, r.total_event_rows) == (5, 3, 2, 6)


def test_coverage_counts_of_many_games_share_a_file(spark, tmp_path):
    ids = [str(g) for g in range(1, 20000, 1000)]
    games = spark.createDataFrame([(i, "2024-25") for i in ids], "game_id string, season string")
    refresh = ingest.refresh_coverage(f"{tmp_path}/t", games, f"{tmp_path}/counts", f"{tmp_path}/report", "2026-01-01")
    step = ingest.ingest_batch(f"{tmp_path}/t", f"{tmp_path}/q", bucket_games=1, then=refresh)
    step(spark.createDataFrame([play(i, 1.0, 2.0, 0.0, 0) for i in ids], PLAYS), 0)
    step(spark.createDataFrame([play(i, 2.0, 2.0, 0.0, 1) for i in ids[:5]], PLAYS), 1)
    assert [p.name for p in (tmp_path / "counts").glob("bucket=*")] == ["bucket=0"]
    r = tables.read_table(spark, f"{tmp_path}/report").first()
    assert (r.eligible_games, r.collected_games, r.total_event_rows) == (20, 20, 25)


def test_known_games_are_skipped(spark, landed):
    stream = ingest.read_stream(spark, f"{landed}/in", PLAYS)
    known = spark.createDataFrame([("1",)], "game_id string")
    query = ingest.new_games_only(stream, known).writeStream.format("memory").queryName(
        "new_games").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.game_id for r in spark.table("new_games").collect()} == {"2", "3"}


def test_first_arrival_is_kept_inside_the_watermark(spark, landed):
    stream = ingest.read_stream(spark, f"{landed}/in", PLAYS).withColumn(
        "at", F.timestamp_seconds(F.col("_seq")))
    query = ingest.drop_late_duplicates(stream, "at", "1 hour").writeStream.format(
        "memory").queryName("first_arrivals").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("first_arrivals").filter("game_id = '2'").collect()
    assert len(rows) == 1


def test_a_batch_leaves_the_buckets_of_other_games_alone(spark, landed):
    step = ingest.ingest_batch(f"{landed}/t", f"{landed}/q", bucket_games=1)
    step(spark.createDataFrame(FILES[0], PLAYS), 0)

    def files(game):
        return sorted(p.name for p in pathlib.Path(f"{landed}/t/bucket={game}").glob("*.parquet"))

    before = files(1), files(2)
    step(spark.createDataFrame(FILES[2], PLAYS), 1)
    assert files(1) == before[0] and files(2) != before[1]
