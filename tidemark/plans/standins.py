"""Domain tables derived from the bundled star-schema tables, row for row.

Each stand-in is a list of SQL expressions over one source, which Spark evaluates here and the
oracle reuses as a common table expression, so both sides start from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class StandIn:
    source: str
    columns: tuple[str, ...]
    joined: tuple[str, str, str] | None = None  # table, left key, right key

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.source)
        if self.joined:
            other, left, right = self.joined
            dim = table(spark, sf_dir, other)
            df = df.join(dim, df[left] == dim[right])
        return df.selectExpr(*self.columns)

    def sql(self) -> str:
        join = ""
        if self.joined:
            other, left, right = self.joined
            join = f" JOIN {other} ON {left} = {right}"
        return f"SELECT {', '.join(self.columns)} FROM {self.source}{join}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SEASON = (
    "CAST(year(o_orderdate) AS STRING) || '-' || "
    "lpad(CAST((year(o_orderdate) + 1) % 100 AS STRING), 2, '0')"
)
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_AWAY = "(o_orderkey % 24 + c_nationkey + 1) % 25"
_BASE = "CAST(floor(o_totalprice) AS BIGINT) % 60 + 70"
_HOME_WON = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END"
_PICK = "CAST(o_custkey * 7919 % 101 AS DOUBLE) / 100"
_IDENTITY = (
    "lpad(CAST(o_orderkey AS STRING), 10, '0') AS game_id",
    f"{_SEASON} AS season",
    f"{_DAY} AS game_date",
    "'TEAM_' || CAST(c_nationkey AS STRING) AS home_team",
    f"'TEAM_' || CAST({_AWAY} AS STRING) AS away_team",
)

STAND_INS = {
    # orders as games: two scores unless unknown, some ties, some foreign statuses, some no date
    "games": StandIn("orders", (
        *_IDENTITY[:2],
        f"CASE WHEN o_orderkey % 97 <> 0 THEN {_DAY} END AS game_date",
        *_IDENTITY[3:],
        "CAST(c_nationkey AS STRING) AS home_team_id",
        f"CAST({_AWAY} AS STRING) AS away_team_id",
        "CASE WHEN o_orderkey % 101 = 0 THEN 'Final' ELSE 'final' END AS status",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'playoffs' ELSE 'regular_season' END AS game_type",
        f"CAST(CASE o_orderstatus WHEN 'F' THEN {_BASE} + CASE WHEN o_orderkey % 50 = 0 THEN 0 "
        f"ELSE 10 END WHEN 'O' THEN {_BASE} END AS DOUBLE) AS home_score",
        f"CAST(CASE o_orderstatus WHEN 'F' THEN {_BASE} WHEN 'O' THEN {_BASE} + 10 END "
        "AS DOUBLE) AS away_score",
        "o_orderkey AS _seq",
    ), ("customer", "o_custkey", "c_custkey")),
    # events as play-by-play: scores climb with noise, a third and a quarter of them missing
    "plays": StandIn("events", (
        "lpad(CAST(user_id AS STRING), 10, '0') AS game_id",
        "event_id AS event_num",
        "CASE WHEN event_id % 11 = 0 THEN CAST(event_id % 15 AS STRING) ELSE CASE event_type "
        "WHEN 'signup' THEN 'Made Shot' WHEN 'purchase' THEN ' free throw' WHEN 'click' THEN 'Foul' "
        "WHEN 'view' THEN 'period' ELSE 'Coach Call' END END AS event_msg_type",
        "CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'End' END AS event_msg_action_type",
        "CAST(1 + event_id % 6 AS INT) AS period",
        "CASE event_id % 7 WHEN 0 THEN lpad(CAST(hour(ts) % 12 AS STRING), 2, '0') || ':' || "
        "lpad(CAST(minute(ts) AS STRING), 2, '0') WHEN 1 THEN 'PT' || CAST(minute(ts) AS STRING) "
        "|| '.5S' WHEN 2 THEN 'garbage' WHEN 3 THEN NULL ELSE 'PT' || "
        "lpad(CAST(hour(ts) % 12 AS STRING), 2, '0') || 'M' || "
        "lpad(CAST(minute(ts) AS STRING), 2, '0') || '.00S' END AS pctimestring",
        "CASE WHEN event_id % 3 <> 0 THEN floor(CAST(event_id AS DOUBLE) / 100 + value / 10) "
        "END AS scoreHome",
        "CASE WHEN event_id % 4 <> 0 AND user_id % 29 <> 0 THEN "
        "floor(CAST(event_id AS DOUBLE) / 100 + value / 12) END AS scoreAway",
        "'H' || CAST(user_id % 25 AS STRING) AS home_team",
        "'A' || CAST(user_id % 24 AS STRING) AS away_team",
        "'2024-25' AS season",
        "'2024-01-01' AS game_date",
        "CASE event_id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'v' WHEN 2 THEN '' WHEN 3 THEN 'x' "
        "END AS location",
        "event_type AS description",
        "event_id AS _seq",
    )),
    # customers as a schedule of the event games; every seventh game is missing from it
    "schedule": StandIn("customer", (
        "lpad(CAST(c_custkey AS STRING), 10, '0') AS game_id",
        "CASE WHEN c_custkey % 2 = 0 THEN '2023-24' ELSE '2024-25' END AS season",
        "CASE WHEN c_custkey % 5 <> 0 THEN '2024-03-0' || CAST(1 + c_custkey % 9 AS STRING) "
        "END AS game_date",
        "'HOME_' || CAST(c_nationkey AS STRING) AS home_team",
        "'AWAY_' || CAST(c_nationkey AS STRING) AS away_team",
        "CAST(c_nationkey AS STRING) AS home_team_id",
        "CAST(c_nationkey + 25 AS STRING) AS away_team_id",
        "c_custkey AS _seq",
        "c_custkey % 7 AS _gap",
    )),
    # orders as scored games
    "picks": StandIn("orders", (
        *_IDENTITY,
        f"{_PICK} AS home_win_probability",
        f"1.0 - {_PICK} AS away_win_probability",
        f"CASE WHEN {_PICK} >= 0.5 THEN 1 ELSE 0 END AS predicted_label",
        f"CASE WHEN {_PICK} >= 0.5 THEN 'TEAM_' || CAST(c_nationkey AS STRING) ELSE 'TEAM_' || "
        f"CAST({_AWAY} AS STRING) END AS predicted_winner",
        f"{_HOME_WON} AS actual_home_team_won",
        f"CASE WHEN {_PICK} >= 0.5 THEN 1 ELSE 0 END = {_HOME_WON} AS prediction_correct",
        "o_orderkey AS _seq",
    ), ("customer", "o_custkey", "c_custkey")),
    # events as scored events
    "live_picks": StandIn("events", (
        "lpad(CAST(user_id AS STRING), 10, '0') AS game_id",
        "event_id AS event_num",
        "CASE WHEN user_id % 2 = 0 THEN '2023-24' ELSE '2024-25' END AS season",
        "'2024-03-0' || CAST(1 + user_id % 9 AS STRING) AS game_date",
        "'H' || CAST(user_id % 25 AS STRING) AS home_team",
        "'A' || CAST(user_id % 24 AS STRING) AS away_team",
        "CAST(1 + event_id % 6 AS INT) AS period",
        "event_type AS event_type_label",
        "CAST(CASE WHEN event_id % 13 <> 0 THEN 2880 - event_id % 3100 END AS DOUBLE) "
        "AS seconds_remaining_game",
        "CAST(CAST(floor(value * 100) AS BIGINT) % 101 AS DOUBLE) / 100 AS home_win_probability",
        "1.0 - CAST(CAST(floor(value * 100) AS BIGINT) % 101 AS DOUBLE) / 100 "
        "AS away_win_probability",
        "CASE WHEN CAST(floor(value * 100) AS BIGINT) % 101 >= 50 THEN 1 ELSE 0 END "
        "AS predicted_label",
        "CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS actual_home_team_won",
        "CASE WHEN CAST(floor(value * 100) AS BIGINT) % 101 >= 50 THEN 1 ELSE 0 END = "
        "CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS prediction_correct",
    )),
    # line items as judged rows: ten probabilities that sit on the bucket edges
    "judged": StandIn("lineitem", (
        "l_linestatus AS model_version",
        "l_discount * 10 AS p",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
        "CASE WHEN l_discount * 10 > 0.5 THEN 1 ELSE 0 END AS yhat",
        "CASE WHEN l_partkey % 17 <> 0 THEN l_quantity * 70 - 300 END AS seconds_remaining_game",
    )),
    # line items as judged rows with nearly unique probabilities
    "fine_judged": StandIn("lineitem", (
        "l_linestatus AS model_version",
        "l_extendedprice / 200000 AS p",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
    )),
    # line items as a feed that repeats its keys
    "feed": StandIn("lineitem", (
        "lpad(CAST(l_orderkey AS STRING), 10, '0') AS game_id",
        "l_linenumber AS event_num",
        "l_quantity AS quantity",
        "l_extendedprice AS price",
        "l_returnflag AS flag",
        "l_partkey * 1000000 + l_suppkey AS _seq",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS shipped",
    )),
    # line items as team rows of the schedule feed
    "team_rows": StandIn("lineitem", (
        "CASE WHEN l_partkey % 19 = 0 THEN '2023-24' ELSE '2024-25' END AS season",
        "'Regular Season' AS season_type",
        "lpad(CAST(l_orderkey AS STRING), 10, '0') AS GAME_ID",
        "CAST(l_suppkey AS STRING) AS TEAM_ID",
        "CASE WHEN l_suppkey % 23 <> 0 THEN 'T' || CAST(l_suppkey AS STRING) END AS TEAM_NAME",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS GAME_DATE",
        "CASE l_returnflag WHEN 'R' THEN 'BOS vs. MIA' WHEN 'A' THEN 'MIA @ BOS' "
        "ELSE CASE WHEN l_tax > 0.04 THEN 'BOS MIA' ELSE 'PHI vs. NYK' END END AS MATCHUP",
        "l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS _seq",
    )),
    # orders as playoff games: ids of even years hold the order key and so a round, others are unreadable
    "playoffs": StandIn("orders", (
        "CASE WHEN year(o_orderdate) % 2 = 0 THEN '004' || "
        "lpad(CAST(o_orderkey % 10000000 AS STRING), 7, '0') "
        "ELSE 'G' || CAST(o_orderkey AS STRING) END AS game_id",
        *_IDENTITY[1:],
        "'playoffs' AS game_type",
        "o_orderkey AS _seq",
        "CAST(c_nationkey AS STRING) AS home_team_id",
        "'final' AS status",
    ), ("customer", "o_custkey", "c_custkey")),
}

_NUMBER = "CAST(floor(o_orderkey / 7) AS BIGINT)"
_SERIES = f"'S' || CAST({_NUMBER} AS STRING)"
_SLOT = "o_orderkey % 7 + 1"
_TEAM_A = f"'A' || CAST({_NUMBER} AS STRING)"
_TEAM_B = f"'B' || CAST({_NUMBER} AS STRING)"
_WON_BY_A = "CAST(floor(o_totalprice) AS BIGINT) % 2 = 0"

# orders as the games of series of seven, by order key
STAND_INS["series_slots"] = StandIn("orders", (
    f"{_SERIES} AS season",
    f"CAST({_SLOT} AS INT) AS finals_game_number",
    _IDENTITY[0],
    _IDENTITY[2],
    f"CASE WHEN o_orderkey % 2 = 0 THEN {_TEAM_A} ELSE {_TEAM_B} END AS home_team",
    f"CASE WHEN o_orderkey % 2 = 0 THEN {_TEAM_B} ELSE {_TEAM_A} END AS away_team",
    "CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE CASE o_orderkey % 5 "
    "WHEN 0 THEN 'scheduled' WHEN 1 THEN 'if_necessary' WHEN 2 THEN 'if_necessary_scheduled' "
    "WHEN 3 THEN 'not_available_yet' ELSE 'completed' END END AS game_status",
    "o_custkey % 4 <> 0 AS pregame_prediction_available",
    f"CASE o_custkey % 3 WHEN 0 THEN {_TEAM_A} WHEN 1 THEN {_TEAM_B} END "
    "AS predicted_winner_pregame",
    "o_orderstatus = 'F' AS final_result_available",
    f"CASE WHEN o_orderstatus = 'F' THEN CASE WHEN {_WON_BY_A} THEN {_TEAM_A} ELSE {_TEAM_B} END "
    "END AS final_winner",
    f"CASE WHEN o_orderkey % 17 = 0 THEN CASE WHEN {_WON_BY_A} THEN {_TEAM_B} ELSE {_TEAM_A} END "
    "END AS manual_winner",
    "o_custkey % 5 < 3 AS start_prediction_correct_if_final",
    "o_custkey % 5 > 1 AS final_prediction_correct_if_final",
), ("customer", "o_custkey", "c_custkey"))

# orders as schedule overrides: some fill gaps of known seasons, some bring seasons of their own
STAND_INS["overrides"] = StandIn("orders", (
    "CAST(year(o_orderdate) + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END AS STRING) || "
    "CASE WHEN o_orderkey % 2 = 0 THEN '-x' ELSE '-' || "
    "lpad(CAST((year(o_orderdate) + 1) % 100 AS STRING), 2, '0') END AS season",
    "CAST(1 + o_custkey % 9 AS INT) AS finals_game_number",
    "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'P' || CAST(o_orderkey AS STRING) END AS game_id",
    "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS game_date",
    "'Home ' || CAST(o_custkey % 5 AS STRING) AS home_team",
    "'Away ' || CAST(o_custkey % 5 AS STRING) AS away_team",
    "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE '1' END AS home_team_id",
    "'2' AS away_team_id",
    "CASE o_orderkey % 5 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'if_necessary' "
    "WHEN 2 THEN ' If_Necessary_Scheduled' WHEN 3 THEN 'not_available_yet' ELSE 'postponed' END "
    "AS status",
    "'Playoffs' AS season_type",
    "CASE o_orderkey % 4 WHEN 0 THEN 'manual_schedule' WHEN 1 THEN 'api_schedule' "
    "WHEN 2 THEN 'placeholder' ELSE 'rumour' END AS source",
    "CASE WHEN o_orderkey % 6 = 0 THEN 'noted' ELSE '' END AS notes",
))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return STAND_INS[name].load(spark, sf_dir)


def cte(*names: str) -> str:
    return ", ".join(f"{n} AS ({STAND_INS[n].sql()})" for n in names)
