"""SQL counterparts of the registered queries, written against the same source tables.

They share the stand-in columns with the Spark side but none of its operator logic: windows are
spelled out directly, recent form is a self join, splits rank the whole table, and so on.
"""

from __future__ import annotations

from tidemark import schemas
from tidemark.operators import live, metrics, pregame, replay, series
from tidemark.plans.queries import SEASONS
from tidemark.plans.standins import cte

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(f"({text(i)})" for i in items)


# ---- pre-game features ------------------------------------------------------------------------
FIN = f"{cte('games')}, fin AS (SELECT * FROM games WHERE status = 'final' AND game_date IS NOT NULL)"
HIST = """hist AS (
  SELECT home_team_id AS team_id, season, game_id, game_date, 0 AS away,
         CAST(game_date AS DATE) - DATE '1970-01-01' AS d,
         CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN 0 END AS won,
         home_score AS pf, away_score AS pa FROM fin
  UNION ALL
  SELECT away_team_id, season, game_id, game_date, 1, CAST(game_date AS DATE) - DATE '1970-01-01',
         CASE WHEN home_score > away_score THEN 0 WHEN home_score < away_score THEN 1 END,
         away_score, home_score FROM fin)"""
STATS = """form AS (
  SELECT DISTINCT team_id, season, game_date, d, count(*) OVER w AS n, count(won) OVER w AS decided,
         sum(won) OVER w AS wins, sum(pf) OVER w AS s_pf, count(pf) OVER w AS n_pf,
         sum(pa) OVER w AS s_pa, count(pa) OVER w AS n_pa, max(d) OVER w AS last_d
  FROM hist
  WINDOW w AS (PARTITION BY team_id, season ORDER BY d
               RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stats AS (
  SELECT team_id, season, game_date, d, n AS games_played_before,
         CASE WHEN n = 0 THEN 0 WHEN decided > 0 THEN CAST(wins AS BIGINT) END AS wins_before,
         CASE WHEN n = 0 THEN 0 WHEN decided > 0 THEN CAST(decided - wins AS BIGINT) END
           AS losses_before,
         CASE WHEN decided > 0 THEN CAST(wins AS DOUBLE) / decided ELSE 0.5 END AS win_pct_before,
         CASE WHEN n_pf > 0 THEN s_pf / n_pf END AS points_for_avg_before,
         CASE WHEN n_pa > 0 THEN s_pa / n_pa END AS points_allowed_avg_before,
         CAST(d - last_d AS DOUBLE) AS rest_days
  FROM form)"""
RECENT = """ranked AS (
  SELECT k.team_id, k.season, k.d, h.won,
         row_number() OVER (PARTITION BY k.team_id, k.season, k.d
                            ORDER BY h.d DESC, h.game_id DESC, h.away DESC) AS rn
  FROM (SELECT DISTINCT team_id, season, d FROM hist) k
  JOIN hist h ON h.team_id = k.team_id AND h.season = k.season AND h.d < k.d),
recent AS (
  SELECT s.team_id, s.season, s.d, s.game_date,
         COALESCE(avg(r.won) FILTER (WHERE r.rn <= 5), 0.5) AS recent_win_pct_before
  FROM stats s LEFT JOIN ranked r USING (team_id, season, d)
  GROUP BY s.team_id, s.season, s.d, s.game_date)"""
FORM = f"{FIN}, {HIST}, {STATS}"
BOTH_SIDES = """sides AS (
  SELECT s.*, r.recent_win_pct_before FROM stats s JOIN recent r USING (team_id, season, d)),
full_rows AS (
  SELECT g.game_id, g.season, g.game_date, g.home_team, g.away_team, g.home_team_id,
         g.away_team_id, g.game_type,
         h.games_played_before AS home_games_played_before,
         a.games_played_before AS away_games_played_before,
         h.wins_before AS home_wins_before, a.wins_before AS away_wins_before,
         h.losses_before AS home_losses_before, a.losses_before AS away_losses_before,
         h.win_pct_before AS home_win_pct_before, a.win_pct_before AS away_win_pct_before,
         h.win_pct_before - a.win_pct_before AS win_pct_diff_before,
         h.points_for_avg_before AS home_points_for_avg_before,
         a.points_for_avg_before AS away_points_for_avg_before,
         h.points_allowed_avg_before AS home_points_allowed_avg_before,
         a.points_allowed_avg_before AS away_points_allowed_avg_before,
         h.points_for_avg_before - a.points_for_avg_before AS points_for_avg_diff_before,
         h.points_allowed_avg_before - a.points_allowed_avg_before
           AS points_allowed_avg_diff_before,
         h.recent_win_pct_before AS home_recent_win_pct_before,
         a.recent_win_pct_before AS away_recent_win_pct_before,
         h.recent_win_pct_before - a.recent_win_pct_before AS recent_win_pct_diff_before,
         COALESCE(h.rest_days, 3.0) AS home_rest_days, COALESCE(a.rest_days, 3.0) AS away_rest_days,
         COALESCE(h.rest_days, 3.0) - COALESCE(a.rest_days, 3.0) AS rest_days_diff,
         CASE WHEN g.home_score > g.away_score THEN 1 WHEN g.home_score < g.away_score THEN 0 END
           AS home_team_won
  FROM fin g
  JOIN sides h ON h.team_id = g.home_team_id AND h.season = g.season AND h.game_date = g.game_date
  JOIN sides a ON a.team_id = g.away_team_id AND a.season = g.season AND a.game_date = g.game_date)"""
FULL = f"{FORM}, {RECENT}, {BOTH_SIDES}"

ORACLES["strict_prior_team_stats"] = f"""WITH {FORM}
SELECT team_id, season, game_date, games_played_before, wins_before, losses_before, win_pct_before,
       points_for_avg_before, points_allowed_avg_before FROM stats"""
ORACLES["recent_form_last5"] = f"""WITH {FORM}, {RECENT}
SELECT team_id, season, game_date, recent_win_pct_before FROM recent"""
ORACLES["rest_days"] = f"WITH {FORM} SELECT team_id, season, game_date, rest_days FROM stats"
ORACLES["pregame_features_full"] = f"WITH {FULL} SELECT * FROM full_rows"
ORACLES["pregame_missing_targets"] = f"""WITH {FIN}
SELECT game_id, 'missing_target' AS issue_type, {text(pregame.MISSING_TARGET)} AS message
FROM fin WHERE home_score IS NULL OR home_score = away_score"""
ORACLES["merged_game_results"] = f"""WITH {cte('games')}
SELECT game_id, status, home_score, away_score,
       CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away'
            WHEN home_score = away_score THEN 'tie' END AS winner_side FROM games"""
ORACLES["history_with_targets"] = f"""WITH {cte('games')}
SELECT game_id, season, game_type,
       CASE WHEN game_type = 'playoffs' AND status = 'final' THEN 'scheduled' ELSE status END
         AS status FROM games"""
ORACLES["series_target_features"] = f"""WITH {FULL}
SELECT game_id, home_games_played_before, away_games_played_before, home_wins_before,
       home_win_pct_before, away_points_for_avg_before, rest_days_diff, home_team_won
FROM full_rows WHERE game_type = 'playoffs'"""

# ---- live state -----------------------------------------------------------------------------------
STATE = """running AS (
  SELECT *, COALESCE(max(scoreHome) OVER w, 0) AS hs, COALESCE(max(scoreAway) OVER w, 0) AS vs
  FROM plays
  WINDOW w AS (PARTITION BY game_id ORDER BY event_num
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
state AS (
  SELECT *, COALESCE(hs + vs > lag(hs + vs) OVER (PARTITION BY game_id ORDER BY event_num), FALSE)
    AS scoring FROM running)"""
TRIMMED = r"regexp_replace(pctimestring, '^\s+|\s+$', '', 'g')"


def _part(pattern: str, group: int) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({TRIMMED}, '{pattern}', {group}), '') AS DOUBLE)"


ISO = r"^PT(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
COLON = r"^(\d+):(\d{1,2}(?:\.\d+)?)$"
HOURS = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
SECONDS = f"""CASE WHEN regexp_matches({TRIMMED}, '{ISO}')
  THEN COALESCE({_part(ISO, 1)}, 0) * 60 + COALESCE({_part(ISO, 2)}, 0)
  WHEN regexp_matches({TRIMMED}, '{COLON}') THEN {_part(COLON, 1)} * 60 + {_part(COLON, 2)} END"""


def _left(period: str, seconds: str) -> str:
    return (f"CASE WHEN {period} <= 4 THEN (4 - {period}) * 720 + ({seconds}) "
            f"ELSE -(({period} - 5) * 300 + (300 - ({seconds}))) END")


def _phase(seconds: str) -> str:
    return (f"CASE WHEN ({seconds}) IS NULL THEN 'unknown' WHEN ({seconds}) > 2160 THEN 'early_game' "
            f"WHEN ({seconds}) <= 720 THEN 'late_game' ELSE 'mid_game' END")


LABEL = """CASE WHEN regexp_matches(trim(event_msg_type), '^[0-9]+$')
  THEN CASE CAST(trim(event_msg_type) AS INT) WHEN 1 THEN 'made_shot' WHEN 2 THEN 'missed_shot'
    WHEN 3 THEN 'free_throw' WHEN 4 THEN 'rebound' WHEN 5 THEN 'turnover' WHEN 6 THEN 'foul'
    WHEN 7 THEN 'violation' WHEN 8 THEN 'substitution' WHEN 9 THEN 'timeout' WHEN 10 THEN 'jump_ball'
    WHEN 11 THEN 'ejection' WHEN 12 THEN 'start_period' WHEN 13 THEN 'end_period' ELSE 'unknown' END
  ELSE CASE lower(trim(event_msg_type)) WHEN 'made shot' THEN 'made_shot'
    WHEN 'free throw' THEN 'free_throw' WHEN 'foul' THEN 'foul'
    WHEN 'period' THEN CASE WHEN lower(event_msg_action_type) = 'end' THEN 'end_period'
      ELSE 'start_period' END
    ELSE 'unknown' END END"""
FLAGS = """label = 'turnover' AS is_turnover, label = 'foul' AS is_foul,
  label = 'timeout' AS is_timeout, label = 'rebound' AS is_rebound,
  label = 'free_throw' AS is_free_throw, label IN ('made_shot', 'missed_shot')
  AS is_field_goal_attempt"""
KNOWN = "known AS (SELECT * FROM schedule WHERE _gap <> 3)"
TOTALS = """totals AS (
  SELECT p.game_id, max(scoreHome) AS h, max(scoreAway) AS a, count(*) AS n,
         arg_min(p.home_team, event_num) AS first_home, arg_min(p.away_team, event_num) AS first_away,
         any_value(p.season) AS first_season, any_value(p.game_date) AS first_date
  FROM plays p GROUP BY p.game_id),
per_game AS (
  SELECT t.game_id, t.n, k.game_id IS NOT NULL AS in_schedule,
         CASE WHEN k.game_id IS NOT NULL THEN k.season ELSE first_season END AS season,
         CASE WHEN k.game_id IS NOT NULL THEN k.game_date ELSE first_date END AS game_date,
         CASE WHEN k.game_id IS NOT NULL THEN k.home_team ELSE first_home END AS home_team,
         CASE WHEN k.game_id IS NOT NULL THEN k.away_team ELSE first_away END AS away_team,
         k.home_team_id, k.away_team_id,
         CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN h END AS home_score,
         CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN a END AS away_score,
         CASE WHEN h > a THEN 1 WHEN h <= a THEN 0 END AS home_team_won
  FROM totals t LEFT JOIN known k USING (game_id))"""
PLAYED = f"{cte('plays', 'schedule')}, {KNOWN}, {TOTALS}"

ORACLES["running_score_state"] = f"""WITH {cte('plays')}, {STATE}
SELECT game_id, event_num, hs AS home_score, vs AS away_score, hs - vs AS score_margin_home,
       abs(hs - vs) AS abs_score_margin, scoring AS is_scoring_event FROM state"""
ORACLES["stream_equals_batch"] = f"""WITH {cte('plays')}, {STATE}
SELECT game_id, event_num, hs AS home_score, vs AS away_score, scoring AS is_scoring_event
FROM state"""
ORACLES["live_features_full"] = f"""WITH {PLAYED}, {STATE}, labelled AS (
  SELECT *, {SECONDS} AS secs, {LABEL} AS label FROM state)
SELECT l.game_id, event_num, g.season, g.game_date, g.home_team, g.away_team, g.home_team_id,
       g.away_team_id, period, pctimestring, secs AS seconds_remaining_period,
       {_left('period', 'secs')} AS seconds_remaining_game, hs AS home_score, vs AS away_score,
       hs - vs AS score_margin_home, abs(hs - vs) AS abs_score_margin, event_msg_type,
       event_msg_action_type, label AS event_type_label, scoring AS is_scoring_event, {FLAGS},
       g.home_team_won
FROM labelled l JOIN per_game g USING (game_id)"""
ORACLES["stream_live_state"] = ORACLES["live_features_full"]
ORACLES["stream_first_arrivals"] = """SELECT DISTINCT user_id AS game_id,
event_id % 300 AS event_num FROM events"""
ORACLES["stream_coverage"] = f"""WITH {cte('plays', 'schedule')}, {KNOWN}, n AS (
  SELECT game_id, count(*) AS c FROM plays GROUP BY game_id)
SELECT season, count(*) AS eligible_games, count(c) AS collected_games,
       round(100.0 * count(c) / count(*), 2) AS coverage_pct,
       CAST(COALESCE(sum(c), 0) AS BIGINT) AS total_event_rows
FROM known LEFT JOIN n USING (game_id) GROUP BY season"""
ORACLES["game_result_from_events"] = f"""WITH {PLAYED}
SELECT game_id, season, game_date, home_team, away_team, home_team_id, away_team_id, home_score,
       away_score, CASE WHEN home_team_won = 1 THEN home_team ELSE away_team END AS winner,
       home_team_won, 'play_by_play' AS source
FROM per_game WHERE home_team_won IS NOT NULL"""
ORACLES["event_issues"] = f"""WITH {PLAYED}, clocks AS (
  SELECT game_id, count(*) AS n FROM plays
  WHERE pctimestring IS NOT NULL AND {TRIMMED} <> '' AND ({SECONDS}) IS NULL GROUP BY game_id),
found AS (
  SELECT '' AS game_id, 'duplicate_events' AS issue_type, count(*) AS row_count FROM plays
  UNION ALL SELECT game_id, 'missing_from_games', n FROM per_game WHERE NOT in_schedule
  UNION ALL SELECT game_id, 'missing_scores', n FROM per_game WHERE home_team_won IS NULL
  UNION ALL SELECT game_id, 'invalid_pctimestring', n FROM clocks)
SELECT game_id, issue_type, row_count, CASE issue_type
  {' '.join(f"WHEN {text(k)} THEN {text(v)}" for k, v in live.ISSUE_TEXT.items())} END AS message
FROM found"""
ORACLES["clock_parse"] = f"""WITH {cte('plays')}, parsed AS (SELECT *, {SECONDS} AS s FROM plays),
timed AS (SELECT *, {_left('period', 's')} AS g FROM parsed)
SELECT event_num, s AS seconds, g AS game_seconds, {_phase('g')} AS phase,
  CASE WHEN COALESCE({TRIMMED}, '') = '' THEN '—'
       WHEN regexp_matches({TRIMMED}, '^\\d+:\\d{{2}}$') THEN {TRIMMED}
       WHEN regexp_matches({TRIMMED}, '{HOURS}') THEN
         CAST(COALESCE({_part(HOURS, 1)}, 0) * 60 + COALESCE({_part(HOURS, 2)}, 0) AS INT) || ':' ||
         lpad(CAST(CAST(trunc(COALESCE({_part(HOURS, 3)}, 0)) AS INT) AS VARCHAR), 2, '0')
       ELSE {TRIMMED} END AS shown FROM timed"""
ORACLES["event_label_map"] = f"""WITH {cte('plays')}, named AS (SELECT *, {LABEL} AS label FROM plays)
SELECT event_num, label, {FLAGS} FROM named"""

# ---- ingest ---------------------------------------------------------------------------------------
LATEST = "row_number() OVER (PARTITION BY game_id, event_num ORDER BY {order}) = 1"
ORACLES["dedupe_keep_last"] = f"""WITH {cte('feed')} SELECT * FROM feed QUALIFY
{LATEST.format(order='_seq DESC, price DESC, quantity DESC, flag DESC, shipped DESC')}"""
ORACLES["duplicate_event_count"] = f"""WITH {cte('feed')}
SELECT count(*) - count(DISTINCT (game_id, event_num)) AS removed FROM feed"""
ORACLES["upsert_merge"] = f"""WITH {cte('feed')} SELECT game_id, event_num, _seq, flag FROM feed
QUALIFY {LATEST.format(order="flag = 'R' DESC, _seq DESC")}"""
ORACLES["upsert_stored_table"] = f"""WITH {cte('feed')}
SELECT game_id, event_num, _seq, flag FROM feed QUALIFY {LATEST.format(order="flag DESC, _seq DESC")}"""
GROUPS = """rows AS (
  SELECT season, GAME_ID AS game_id, TEAM_ID AS team_id, TEAM_NAME AS team_name,
         GAME_DATE AS game_date, MATCHUP AS matchup, _seq,
         CASE WHEN MATCHUP LIKE '%vs.%' THEN 'home' WHEN MATCHUP LIKE '%@%' THEN 'away' END AS side
  FROM team_rows),
groups AS (
  SELECT season, game_id, count(*) AS n, count(*) FILTER (WHERE side = 'home') AS h,
         count(*) FILTER (WHERE side = 'away') AS a, count(*) FILTER (WHERE side IS NULL) AS u,
         bool_or(side IS NOT NULL AND team_name IS NULL) AS unnamed FROM rows
  GROUP BY season, game_id),
judged_groups AS (
  SELECT *, concat_ws(';', CASE WHEN u > 0 THEN 'invalid_matchup_format' END,
    CASE WHEN h = 0 THEN 'missing_home_row' END, CASE WHEN a = 0 THEN 'missing_away_row' END,
    CASE WHEN h > 1 THEN 'multiple_home_rows' END, CASE WHEN a > 1 THEN 'multiple_away_rows' END,
    CASE WHEN u = 0 AND h = 1 AND a = 1 AND unnamed THEN 'missing_required_fields' END) AS reasons
  FROM groups)"""
ORACLES["pair_home_away_rows"] = f"""WITH {cte('team_rows')}, {GROUPS}
SELECT g.game_id, g.season, h.game_date, h.team_name AS home_team, a.team_name AS away_team,
       h.team_id AS home_team_id, a.team_id AS away_team_id, 'final' AS status,
       'regular_season' AS game_type
FROM judged_groups g
JOIN rows h ON h.game_id = g.game_id AND h.season = g.season AND h.side = 'home'
JOIN rows a ON a.game_id = g.game_id AND a.season = g.season AND a.side = 'away'
WHERE g.reasons = ''"""
ORACLES["skipped_feed_games"] = f"""WITH {cte('team_rows')}, {GROUPS}
SELECT g.game_id, g.season, 'regular_season' AS game_type, g.n AS raw_row_count,
       g.h AS home_row_count, g.a AS away_row_count,
       string_agg(COALESCE(team_name, 'nan'), ' | ' ORDER BY _seq) AS team_names,
       string_agg(team_id, ' | ' ORDER BY _seq) AS team_ids,
       string_agg(matchup, ' | ' ORDER BY _seq) AS matchup_values,
       string_agg(game_date, ' | ' ORDER BY _seq) AS game_dates, g.reasons AS reason_skipped,
       CAST(0 AS INT) AS part
FROM judged_groups g JOIN rows r USING (season, game_id) WHERE g.reasons <> ''
GROUP BY g.game_id, g.season, g.n, g.h, g.a, g.reasons"""
ORACLES["skipped_feed_rows"] = f"""WITH {cte('team_rows')}, {GROUPS}
SELECT season, game_id, _seq, matchup, team_id, reasons AS reason_skipped
FROM rows JOIN judged_groups USING (season, game_id) WHERE reasons <> ''"""
ORACLES["raw_feed_counts"] = """SELECT count(*) AS raw_row_count,
count(DISTINCT l_orderkey) AS unique_game_id_count,
CAST(count(*) // 2 AS BIGINT) AS expected_game_count_from_raw_pairs FROM lineitem"""
ORACLES["normalized_plays"] = f"""WITH {cte('plays', 'schedule')}, {KNOWN}, texts AS (
  SELECT *, CAST(CAST(scoreHome AS BIGINT) AS VARCHAR) AS h,
         CAST(CAST(scoreAway AS BIGINT) AS VARCHAR) AS a FROM plays)
SELECT t.game_id, CAST(event_num AS DOUBLE) AS event_num, event_msg_type, event_msg_action_type,
       period, pctimestring,
       CASE WHEN location = 'h' THEN description ELSE '' END AS home_description,
       CASE WHEN COALESCE(location, '') = '' THEN description ELSE '' END AS neutral_description,
       CASE WHEN location = 'v' THEN description ELSE '' END AS visitor_description,
       COALESCE(h || ' - ' || a, '') AS score,
       COALESCE(CAST(CAST(scoreHome - scoreAway AS INT) AS VARCHAR), '') AS score_margin,
       k.home_team, k.away_team, k.season, k.game_date, location
FROM texts t LEFT JOIN known k USING (game_id)"""
ORACLES["anti_join_uncollected"] = f"""WITH {cte('games')}
SELECT game_id, season, game_date FROM games g
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE lpad(CAST(l_orderkey AS VARCHAR), 10, '0') = g.game_id)
ORDER BY season, game_date NULLS FIRST, game_id LIMIT 100"""
ORACLES["uncollected_games"] = f"""WITH {cte('games')}
SELECT game_id, season, game_date FROM games
WHERE game_id NOT IN (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') FROM lineitem)"""
ORACLES["eligible_games"] = f"""WITH {cte('games')} SELECT game_id, season FROM games
WHERE status = 'final' AND game_id IS NOT NULL AND _seq % 9 <> 0 AND away_team IS NOT NULL"""
ORACLES["completed_playoffs"] = f"""WITH {cte('games')} SELECT game_id, game_type FROM games
WHERE status = 'final' AND game_date IS NOT NULL AND _seq % 9 <> 0"""
ORACLES["failure_merge"] = f"""WITH {cte('feed')},
latest AS (SELECT game_id, _seq, flag FROM feed WHERE flag = 'R'
  QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY _seq DESC) = 1),
kept AS (SELECT game_id, _seq, flag FROM feed WHERE flag = 'A'
  AND game_id NOT IN (SELECT game_id FROM feed WHERE flag = 'R')
  AND game_id NOT IN (SELECT game_id FROM feed WHERE flag = 'N' AND quantity > 25)
  QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY _seq DESC) = 1)
SELECT * FROM latest UNION ALL SELECT * FROM kept"""
ORACLES["team_stats_normalized"] = """SELECT '2024-25' AS season,
CASE p_size % 4 WHEN 0 THEN 'Regular Season' WHEN 1 THEN 'Playoffs' WHEN 3 THEN 'Regular Season' END
  AS season_type, CAST(p_partkey AS VARCHAR) AS team_id, p_name AS team_name,
p_size AS games_played, p_retailprice AS points, p_size % 9 AS off_rating FROM part"""
ORACLES["season_type_rules"] = """SELECT p_partkey AS id,
CASE p_size % 5 WHEN 0 THEN 'Regular Season' WHEN 1 THEN 'Playoffs' END AS strict,
CASE WHEN p_size % 5 IN (1, 2, 3) THEN 'Playoffs' ELSE 'Regular Season' END AS lenient,
'regular_season' AS game_type FROM part"""
ORACLES["season_labels"] = f"""WITH {cte('games')}
SELECT season, count(*) AS row_count, count(DISTINCT game_id) AS game_count, TRUE AS valid_label
FROM games GROUP BY season"""

# ---- quality ---------------------------------------------------------------------------------------
ORACLES["valid_invalid_split"] = f"""WITH {cte('plays')}
SELECT game_id, count(*) AS row_count,
       CASE WHEN pctimestring IS NULL OR scoreHome IS NULL THEN 'invalid' ELSE 'valid' END AS side
FROM plays GROUP BY game_id, side"""
ORACLES["prob_contract"] = f"""WITH {cte('judged')}
SELECT 'stretched' AS column_name, count(*) AS offending_rows FROM judged
WHERE p * 1.25 - 0.1 < 0 OR p * 1.25 - 0.1 > 1 HAVING count(*) > 0
UNION ALL SELECT 'holed', count(*) FROM judged WHERE y <> 1 HAVING count(*) > 0
UNION ALL SELECT 'p', count(*) FROM judged WHERE p < 0 OR p > 1 HAVING count(*) > 0"""
CLEAN = """clean AS (
  SELECT *, lower(trim(status)) AS s, game_date IS NULL AS no_date, trim(home_team_id) = '' AS no_id
  FROM overrides)"""
ORACLES["override_rules"] = f"""WITH {cte('overrides')}, {CLEAN}, keyed AS (
  SELECT *, season || ' ' || CAST(finals_game_number AS VARCHAR) AS key FROM clean)
SELECT 'duplicate_key' AS rule, key, CAST(count(*) AS VARCHAR) AS detail FROM keyed
GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'invalid_status', key, s FROM keyed WHERE s = 'postponed'
UNION ALL SELECT 'invalid_source', key, source FROM keyed WHERE source = 'rumour'
UNION ALL SELECT 'missing_required', key, 'game_date' FROM keyed
WHERE s IN ('scheduled', 'if_necessary_scheduled') AND no_date
UNION ALL SELECT 'missing_required', key, 'home_team_id' FROM keyed
WHERE s IN ('scheduled', 'if_necessary_scheduled') AND no_id"""
COMPLETE = "(s IN ('scheduled', 'if_necessary_scheduled') AND NOT no_date AND NOT no_id)"
RESOLVED = f"""CASE WHEN game_id <> '' THEN game_id WHEN {COMPLETE} THEN 'finals_schedule_' ||
  replace(season, '-', '') || '_g' || CAST(finals_game_number AS VARCHAR) ELSE '' END"""
ORACLES["normalized_overrides"] = f"""WITH {cte('overrides')}, {CLEAN}
SELECT season, finals_game_number, game_id, trim(home_team_id) AS home_team_id, s AS status, source,
       season_type, {COMPLETE} AS complete, {RESOLVED} AS resolved_id FROM clean"""

ORACLES["dataset_contracts"] = """SELECT * FROM (VALUES
  ('orders', 'exists', 'pass', ''), ('orders', 'columns', 'fail', 'o_winner'),
  ('events', 'exists', 'pass', ''), ('events', 'columns', 'pass', ''),
  ('lineitem', 'exists', 'pass', ''), ('lineitem', 'columns', 'pass', ''),
  ('region', 'exists', 'pass', ''), ('region', 'columns', 'pass', ''),
  ('ratings', 'exists', 'fail', 'table missing'),
  ('notes', 'exists', 'not_applicable', 'table missing')) t(dataset, "check", status, details)
UNION ALL SELECT 'orders', 'has_rows', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'warning' END, ''
FROM orders
UNION ALL SELECT 'events', 'has_rows', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'warning' END, ''
FROM events
UNION ALL SELECT 'lineitem', 'has_rows', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'warning' END, ''
FROM lineitem
UNION ALL SELECT 'region', 'has_rows', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'warning' END, ''
FROM region"""

# ---- reconciliation ----------------------------------------------------------------------------------
CORRECTIONS = """fixes AS (
  SELECT game_id, CAST(quantity AS INT) AS home_score,
         CAST(CAST(floor(price) AS BIGINT) % 55 - 2 AS INT) AS away_score, flag, shipped, _seq
  FROM feed),
checked AS (
  SELECT f.*, g.home_team, g.away_team, CASE WHEN g.game_id IS NULL THEN 'unknown_game'
    WHEN f.home_score < 0 OR f.away_score < 0 THEN 'negative_score'
    WHEN f.home_score = f.away_score THEN 'tie_not_allowed'
    WHEN flag NOT IN ('R', 'A') THEN 'invalid_source'
    WHEN g.home_score IS NULL THEN 'already_exists' END AS reason
  FROM fixes f LEFT JOIN games g USING (game_id)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY game_id, reason IS NULL ORDER BY _seq) AS rn FROM checked)"""
ORACLES["corrections_accepted"] = f"""WITH {cte('feed', 'games')}, {CORRECTIONS}
SELECT game_id, home_score, away_score,
       CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS winner,
       CASE flag WHEN 'R' THEN 'manual' ELSE 'api' END AS source, shipped AS confirmed_at,
       'late fix' AS notes FROM ordered WHERE reason IS NULL AND rn = 1"""
ORACLES["corrections_rejected"] = f"""WITH {cte('feed', 'games')}, {CORRECTIONS}
SELECT game_id, _seq, COALESCE(reason, 'duplicate_in_batch') AS reject_reason FROM ordered
WHERE reason IS NOT NULL OR rn > 1"""
ORACLES["corrections_applied"] = f"""WITH {cte('feed', 'games')}, {CORRECTIONS}, usable AS (
  SELECT * FROM checked WHERE COALESCE(reason, 'already_exists') = 'already_exists'
), last AS (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY _seq DESC) AS rn FROM usable
), stored AS (SELECT game_id, home_team FROM games WHERE home_score IS NULL AND _seq % 2 = 0)
SELECT COALESCE(l.game_id, s.game_id) AS game_id, COALESCE(l.home_score, 1) AS home_score,
       CASE WHEN l.game_id IS NULL THEN 0 ELSE l.away_score END AS away_score,
       CASE WHEN l.game_id IS NULL THEN s.home_team WHEN l.home_score > l.away_score THEN l.home_team ELSE l.away_team END AS winner,
       CASE WHEN l.flag = 'A' THEN 'api' ELSE 'manual' END AS source
FROM (SELECT * FROM last WHERE rn = 1) l FULL JOIN stored s ON l.game_id = s.game_id"""
ORACLES["corrections_accounted"] = f"""WITH {cte('feed', 'games')}, {CORRECTIONS}
SELECT game_id, count(*) AS row_count, CAST(bool_or(reason IS NULL) AS BIGINT) AS accepted FROM checked GROUP BY game_id"""
BOTH_RESULTS = """scored AS (
  SELECT *, CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS w
  FROM games WHERE home_score IS NOT NULL),
official AS (SELECT game_id, home_score, away_score, w FROM scored WHERE _seq % 5 <> 0),
manual AS (SELECT game_id, home_score + CASE WHEN _seq % 7 = 0 THEN 1 ELSE 0 END AS home_score,
  away_score, CASE WHEN _seq % 11 = 0 THEN 'nobody' WHEN _seq % 13 = 0 THEN '' ELSE w END AS w,
  CASE WHEN _seq % 2 = 0 THEN 'manual' ELSE 'api' END AS source FROM scored WHERE _seq % 3 <> 0),
compared AS (
  SELECT COALESCE(m.game_id, o.game_id) AS game_id,
    CASE WHEN m.game_id IS NULL THEN 'no_manual_result_available'
         WHEN o.game_id IS NULL THEN 'no_official_result_available'
         WHEN m.home_score <> o.home_score OR m.away_score <> o.away_score THEN 'mismatch'
         WHEN m.w <> '' AND o.w <> '' AND m.w <> o.w THEN 'mismatch' ELSE 'match' END
      AS comparison_status
  FROM manual m FULL JOIN official o ON m.game_id = o.game_id)"""
MANUAL_SUMMARY = """SELECT 'manual_override_count' AS metric, count(*) AS value FROM manual
UNION ALL SELECT 'source_' || source, count(*) FROM manual GROUP BY source
UNION ALL SELECT comparison_status || '_vs_game_results', count(*) FROM compared
WHERE comparison_status IN ('match', 'mismatch') GROUP BY comparison_status"""
ORACLES["full_outer_reconcile"] = f"WITH {cte('games')}, {BOTH_RESULTS} SELECT * FROM compared"
ORACLES["manual_override_summary"] = f"WITH {cte('games')}, {BOTH_RESULTS} {MANUAL_SUMMARY}"
ORACLES["result_overlay"] = f"""WITH {cte('series_slots')}
SELECT game_id, COALESCE(manual_winner, final_winner) AS winner,
       CASE WHEN manual_winner IS NOT NULL THEN 'manual_override' ELSE 'official/local' END AS source
FROM series_slots WHERE manual_winner IS NOT NULL OR final_winner IS NOT NULL"""
ORACLES["prediction_lock"] = f"""WITH {cte('picks')}
SELECT game_id,
  CASE WHEN actual_home_team_won IS NOT NULL AND home_win_probability > 0.2
       THEN home_win_probability / 2 ELSE home_win_probability END AS home_win_probability,
  CASE WHEN actual_home_team_won IS NOT NULL AND home_win_probability > 0.5
       THEN 'old ' || predicted_winner ELSE predicted_winner END AS predicted_winner,
  CASE WHEN actual_home_team_won IS NOT NULL THEN 'Final' ELSE 'scheduled' END AS game_status
FROM picks"""

# ---- splits --------------------------------------------------------------------------------------------
CUT = "n - CASE WHEN n >= 2 THEN greatest(1, least(round_even(n * 0.2, 0), n - 1)) ELSE 0 END"
ORACLES["chronological_split"] = f"""WITH {cte('games')}, placed AS (
  SELECT game_id, game_date, count(*) OVER () AS n,
         row_number() OVER (ORDER BY game_date NULLS LAST, game_id) AS rn FROM games)
SELECT game_id, game_date, CASE WHEN rn > {CUT} THEN 'test' ELSE 'train' END AS side FROM placed"""
ORACLES["game_level_split"] = f"""WITH {cte('live_picks')}, per_game AS (
  SELECT game_id, arg_min(game_date, event_num) AS game_date, count(*) AS row_count
  FROM live_picks GROUP BY game_id),
placed AS (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY game_date NULLS LAST, game_id) AS rn FROM per_game)
SELECT game_id, rn > {CUT} AS is_test, row_count FROM placed"""
ORACLES["season_split_overlap"] = f"""WITH {cte('games')}
SELECT 'train' AS side, count(*) AS row_count FROM games WHERE season IN ('1995-96', '1996-97')
UNION ALL SELECT 'test', count(*) FROM games WHERE season = '1997-98'
UNION ALL SELECT 'shared', 0"""

# ---- metrics -------------------------------------------------------------------------------------------
CLIPPED = f"least(greatest(p, {metrics.EPSILON!r}), 1 - {metrics.EPSILON!r})"
LOSS = f"avg(-ln(CASE WHEN y = 1 THEN {CLIPPED} ELSE 1 - {CLIPPED} END))"
QUALITY = f"""count(*) AS row_count, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS accuracy,
  {LOSS} AS log_loss, avg((p - y) * (p - y)) AS brier_score,
  count(*) FILTER (WHERE y = 1 AND yhat = 1) AS true_positive,
  count(*) FILTER (WHERE y = 0 AND yhat = 0) AS true_negative,
  count(*) FILTER (WHERE y = 0 AND yhat = 1) AS false_positive,
  count(*) FILTER (WHERE y = 1 AND yhat = 0) AS false_negative"""


def _auc(source: str, by: str) -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""scores AS (
  SELECT {group}p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
  FROM {source} GROUP BY {group}p),
below AS (SELECT *, COALESCE(sum(neg) OVER ({part}ORDER BY p
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM scores),
auc AS (SELECT {group}CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) /
  NULLIF(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS roc_auc FROM below {tail})"""


BY_VERSION = f"""{cte('judged')}, {_auc('judged', 'model_version')},
quality AS (SELECT model_version, {QUALITY} FROM judged GROUP BY model_version),
reports AS (SELECT * FROM quality JOIN auc USING (model_version))"""
ORACLES["classifier_metrics"] = f"""WITH {BY_VERSION}
SELECT * REPLACE (round(accuracy, 9) AS accuracy, round(log_loss, 9) AS log_loss,
  round(brier_score, 9) AS brier_score, round(roc_auc, 9) AS roc_auc) FROM reports"""
ORACLES["roc_auc_rank"] = f"""WITH {cte('fine_judged')}, {_auc('fine_judged', 'model_version')}
SELECT model_version, round(roc_auc, 9) AS roc_auc FROM auc"""
LINSPACE = [i * 0.1 for i in range(10)] + [1.0]
RIGHT = "CASE " + " ".join(
    f"WHEN p <= {hi!r} AND p >= 0 THEN '{lo:.1f}-{hi:.1f}'" for lo, hi in zip(LINSPACE, LINSPACE[1:])
) + " END"
LEFT = "CASE " + " ".join(
    f"WHEN p >= CAST({lo!r} AS DOUBLE) AND p < CAST({hi!r} AS DOUBLE) THEN '{lo:.1f}-{hi:.1f}'"
    for lo, hi in zip(metrics.BUCKET_EDGES[:-2], metrics.BUCKET_EDGES[1:-1])
) + " WHEN p >= CAST(0.9 AS DOUBLE) AND p <= 1 THEN '0.9-1.0' END"
CALIBRATION = f"""bins AS (
  SELECT model_version, {RIGHT} AS bin, count(*) AS n, avg(p) AS predicted,
         avg(CAST(y AS DOUBLE)) AS observed FROM judged GROUP BY model_version, bin)"""
ORACLES["calibration_right_closed"] = f"""WITH {cte('judged')}, {CALIBRATION}
SELECT model_version, bin AS probability_bucket, n AS row_count,
       round(predicted, 9) AS avg_predicted_probability, round(observed, 9) AS actual_home_win_rate
FROM bins"""
ORACLES["probability_buckets_left_closed"] = f"""WITH {cte('picks')}, labelled AS (
  SELECT home_win_probability AS p, actual_home_team_won AS y FROM picks
  WHERE actual_home_team_won IS NOT NULL)
SELECT {LEFT} AS probability_bucket, count(*) AS row_count,
       round(avg(p), 9) AS avg_predicted_home_probability,
       round(avg(CAST(y AS DOUBLE)), 9) AS actual_home_win_rate
FROM labelled GROUP BY probability_bucket"""
PHASES = """SELECT {group}phase, count(*) AS row_count,
  avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS accuracy,
  CASE WHEN min(y) <> max(y) THEN {loss} END AS log_loss,
  avg((p - y) * (p - y)) AS brier_score
FROM (SELECT *, {phase} AS phase FROM judged) GROUP BY {group}phase"""
ALL_PHASES = PHASES.format(group="", loss=LOSS, phase=_phase("seconds_remaining_game"))
VERSION_PHASES = PHASES.format(
    group="model_version, ", loss=LOSS, phase=_phase("seconds_remaining_game"))
ORACLES["phase_metrics"] = f"""WITH {cte('judged')}, phases AS ({ALL_PHASES})
SELECT * REPLACE (round(accuracy, 9) AS accuracy, round(log_loss, 9) AS log_loss,
  round(brier_score, 9) AS brier_score) FROM phases"""


def _long(section: str, source: str, numbers: dict[str, str], words: dict[str, str] | None = None,
          where: str = "") -> str:
    parts = [
        f"SELECT {text(section)} AS section, {text(n)} AS metric, CAST(({e}) AS DOUBLE) AS value, "
        f"CAST(NULL AS VARCHAR) AS text FROM {source}" for n, e in numbers.items()
    ] + [
        f"SELECT {text(section)}, {text(n)}, CAST(NULL AS DOUBLE), {e} FROM {source}"
        for n, e in (words or {}).items()
    ]
    return " UNION ALL ".join(parts)


P, Q = "home_win_probability", "away_win_probability"
CORRECT = "CASE WHEN actual_home_team_won IS NOT NULL THEN CAST(prediction_correct AS INT) END"
AVERAGES = {
    "avg_home_win_probability": f"avg({P})", "avg_away_win_probability": f"avg({Q})",
    "avg_confidence": f"avg(greatest({P}, {Q}))",
    "home_pick_rate": "avg(CASE WHEN predicted_label = 1 THEN 1.0 ELSE 0.0 END)",
    "away_pick_rate": "avg(CASE WHEN predicted_label = 0 THEN 1.0 ELSE 0.0 END)",
}
NAME = "game_date || ' | ' || home_team || ' vs ' || away_team"


def _best(value: str, order: str) -> str:
    return f"first({value} ORDER BY {order}, game_date, game_id)"


PREGAME_LONG = _long("summary", "picks", {
    "total_predictions": "count(*)", "labeled_predictions": "count(actual_home_team_won)",
    **AVERAGES, "prediction_accuracy": f"avg({CORRECT})",
    "correct_predictions": f"sum({CORRECT})", "incorrect_predictions": f"sum(1 - {CORRECT})",
    "most_confident_home_probability": _best(P, f"greatest({P}, {Q}) DESC"),
    "closest_home_probability": _best(P, f"abs({P} - 0.5)"),
}, {
    "most_confident_prediction": _best(NAME, f"greatest({P}, {Q}) DESC"),
    "closest_prediction_to_50_50": _best(NAME, f"abs({P} - 0.5)"),
})
FILTERED_LONG = _long("filtered", "picks", {
    "game_count": "count(*)", "avg_home_win_probability": f"avg({P})",
    "prediction_accuracy": f"avg({CORRECT})",
    "most_confident_home_prob": _best(P, f"abs({P} - 0.5) DESC"),
    "closest_home_prob": _best(P, f"abs({P} - 0.5)"),
}, {
    "most_confident_game": _best(NAME, f"abs({P} - 0.5) DESC"),
    "closest_game": _best(NAME, f"abs({P} - 0.5)"),
})
LIVE_LONG = _long("event_level", "live_picks", {
    "total_event_predictions": "count(*)", "unique_games": "count(DISTINCT game_id)",
    **AVERAGES, "prediction_accuracy": f"avg({CORRECT})",
})
LAST_EVENTS = """last_events AS (SELECT * FROM live_picks
  QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY event_num DESC) = 1)"""
FINAL_LONG = _long("final_event", "last_events", {
    "total_games": "count(*)", "avg_final_confidence": f"avg(greatest({P}, {Q}))",
    "number_home_final_predictions": "count(*) FILTER (WHERE predicted_label = 1)",
    "number_away_final_predictions": "count(*) FILTER (WHERE predicted_label = 0)",
    "final_event_accuracy": f"avg({CORRECT})",
})


def _rounded_long(ctes: str, body: str) -> str:
    return (f"WITH {ctes} SELECT section, metric, round(value, 9) AS value, text FROM ({body}) "
            "WHERE value IS NOT NULL OR text IS NOT NULL")


ORACLES["prediction_summary_long"] = _rounded_long(cte("picks"), PREGAME_LONG)
ORACLES["filtered_summary_long"] = _rounded_long(cte("picks"), FILTERED_LONG)
ORACLES["live_summary_long"] = _rounded_long(cte("live_picks"), LIVE_LONG)
ORACLES["final_event_summary_long"] = _rounded_long(f"{cte('live_picks')}, {LAST_EVENTS}", FINAL_LONG)
ORACLES["team_accuracy"] = f"""WITH {cte('picks')}, labelled AS (
  SELECT * FROM picks WHERE actual_home_team_won IS NOT NULL),
sides AS (SELECT game_id, home_team AS team, 1 AS h, 0 AS a, prediction_correct AS ok FROM labelled
  UNION ALL SELECT game_id, away_team, 0, 1, prediction_correct FROM labelled)
SELECT team, CAST(sum(h) AS BIGINT) AS games_as_home, CAST(sum(a) AS BIGINT) AS games_as_away,
       count(DISTINCT game_id) AS total_games,
       round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM sides GROUP BY team"""
ORACLES["labelled_accuracy"] = f"""WITH {cte('picks')}
SELECT round(avg({CORRECT}), 9) AS accuracy FROM picks"""
METRIC_NAMES = ["accuracy", "roc_auc", "log_loss", "brier_score"]
CONFUSION = ["true_positive", "true_negative", "false_positive", "false_negative"]
PHASE_LONG = " UNION ALL ".join(
    f"SELECT 'live_model_training', phase || '_{m}', CAST({m} AS DOUBLE), CAST(NULL AS VARCHAR), "
    f"{text(metrics.TEST_NOTE)} FROM phases WHERE {m} IS NOT NULL"
    for m in ["accuracy", "log_loss", "brier_score", "row_count"]
)
TRAINING_LONG = " UNION ALL ".join(
    f"SELECT '{s}' AS section, '{m}' AS metric, {m} AS value, CAST(NULL AS VARCHAR) AS text, "
    f"{text(metrics.TEST_NOTE)} AS notes FROM overall"
    for s in ("pregame_model_training", "live_model_training") for m in METRIC_NAMES
)
ORACLES["evaluation_summary"] = f"""WITH {cte('judged', 'picks', 'live_picks', 'games')},
{LAST_EVENTS}, {_auc('judged', '')}, overall AS (
  SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS accuracy, {LOSS} AS log_loss,
         avg((p - y) * (p - y)) AS brier_score, (SELECT roc_auc FROM auc) AS roc_auc FROM judged),
phases AS ({ALL_PHASES}), {BOTH_RESULTS}, everything AS (
  {TRAINING_LONG} UNION ALL {PHASE_LONG}
  UNION ALL SELECT 'pregame_predictions_full_dataset', metric, value, text,
    {text(metrics.REFERENCE_NOTE)} FROM ({PREGAME_LONG})
  UNION ALL SELECT 'live_predictions_event_level', metric, value, text,
    {text(metrics.EVENT_NOTE)} FROM ({LIVE_LONG})
  UNION ALL SELECT 'live_predictions_final_event', metric, value, text,
    {text(metrics.REFERENCE_NOTE)} FROM ({FINAL_LONG})
  UNION ALL SELECT 'data_coverage', 'pregame_predictions_count', count(*), NULL, '' FROM picks
  UNION ALL SELECT 'manual_overrides', metric, value, NULL, '' FROM ({MANUAL_SUMMARY}))
SELECT section, metric, round(value, 9) AS value, text, notes FROM everything
WHERE value IS NOT NULL OR text IS NOT NULL"""
MEANING = f"""trim(CASE WHEN difference IS NULL THEN ''
  WHEN metric IN ('accuracy', 'roc_auc', 'log_loss', 'brier_score') AND difference = 0
    THEN 'Values are equal on this metric.'
  WHEN metric IN ('accuracy', 'roc_auc') THEN 'Multi-season value is ' ||
    CASE WHEN difference > 0 THEN 'higher' ELSE 'lower' END || ' (higher is better for this metric).'
  WHEN metric IN ('log_loss', 'brier_score') THEN 'Multi-season value is ' ||
    CASE WHEN difference > 0 THEN 'higher' ELSE 'lower' END || ' (lower is better for this metric).'
  ELSE 'Confusion counts reflect different test-set sizes — compare rates, not raw counts.' END ||
  ' ' || {text(metrics.SETUP_NOTE)}) AS interpretation"""
REPORT_LONG = " UNION ALL ".join(
    f"SELECT model_version, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM reports "
    f"WHERE {m} IS NOT NULL" for m in METRIC_NAMES + CONFUSION
)
COMPARE = """pairs AS (
  SELECT {keys}metric, max(value) FILTER (WHERE model_version = 'F') AS old,
         max(value) FILTER (WHERE model_version = 'O') AS new FROM long GROUP BY {keys}metric),
gaps AS (SELECT *, new - old AS difference FROM pairs)
SELECT {keys}metric, round(old, 9) AS single_season_value, round(new, 9) AS multiseason_value,
       round(difference, 9) AS difference, {meaning} FROM gaps"""
ORACLES["metric_report_long"] = f"""WITH {BY_VERSION}
SELECT model_version, metric, round(value, 9) AS value FROM ({REPORT_LONG})"""
ORACLES["version_metric_compare"] = (
    f"WITH {BY_VERSION}, long AS ({REPORT_LONG}), " + COMPARE.format(keys="", meaning=MEANING))
VERSION_LONG = " UNION ALL ".join(
    f"SELECT model_version, phase, '{m}' AS metric, {m} AS value FROM phases WHERE {m} IS NOT NULL"
    for m in ["accuracy", "log_loss", "brier_score"]
)
ORACLES["version_phase_compare"] = (
    f"WITH {cte('judged')}, phases AS ({VERSION_PHASES}), long AS ({VERSION_LONG}), "
    + COMPARE.format(keys="phase, ", meaning=MEANING))
ORACLES["version_calibration_compare"] = f"""WITH {cte('judged')}, {CALIBRATION}
SELECT model_version, bin, round(predicted, 9) AS mean_predicted_probability,
       round(observed, 9) AS observed_rate, n AS count,
       round(abs(predicted - observed), 9) AS calibration_error FROM bins"""

# ---- replay --------------------------------------------------------------------------------------------
CHANGES = f"""changes AS (
  SELECT *, lag({P}) OVER (PARTITION BY game_id ORDER BY event_num) AS prev,
         max(seconds_remaining_game) OVER (PARTITION BY game_id) AS start_seconds FROM live_picks)"""
ORACLES["momentum_swings_top50"] = f"""WITH {cte('live_picks')}, {CHANGES}
SELECT game_id, event_num, period, event_type_label, {P}, prev AS previous_home_win_probability,
       round({P} - prev, 9) AS probability_change,
       round(abs({P} - prev), 9) AS absolute_probability_change
FROM changes WHERE prev IS NOT NULL ORDER BY abs({P} - prev) DESC, game_id, event_num LIMIT 50"""
ORACLES["momentum_top_n_per_game"] = f"""WITH {cte('live_picks')}, {CHANGES}
SELECT game_id, event_num, round(abs(COALESCE({P} - prev, 0)), 9) AS absolute_probability_change
FROM changes QUALIFY row_number() OVER (
  PARTITION BY game_id ORDER BY abs(COALESCE({P} - prev, 0)) DESC, event_num) <= 3"""
ORACLES["replay_columns"] = f"""WITH {cte('live_picks')}, {CHANGES}
SELECT game_id, event_num, start_seconds - seconds_remaining_game AS game_elapsed_seconds,
       round(COALESCE({P} - prev, 0), 9) AS probability_change,
       round(abs(COALESCE({P} - prev, 0)), 9) AS absolute_probability_change FROM changes"""
ORACLES["final_and_first_event"] = """SELECT conv_id, arg_min(role, turn) AS role_start,
min(turn) AS turn_start, arg_max(role, turn) AS role_final, max(turn) AS turn_final
FROM conversations GROUP BY conv_id"""
ORACLES["final_event_per_game"] = f"""WITH {cte('live_picks')}, {LAST_EVENTS}
SELECT game_id, event_num, period, {P}, predicted_label FROM last_events"""
CATALOG = f"""catalog AS (
  SELECT DISTINCT game_id, season, game_date, home_team, away_team, {NAME} AS label FROM live_picks)"""
ORACLES["games_catalog"] = f"WITH {cte('live_picks')}, {CATALOG} SELECT * FROM catalog"
ORACLES["catalog_filter"] = f"""WITH {cte('live_picks')}, {CATALOG}, n AS (
  SELECT game_id, count(*) AS event_rows FROM live_picks GROUP BY game_id)
SELECT * FROM catalog JOIN n USING (game_id)
WHERE season = '2024-25' AND (home_team = 'H3' OR away_team = 'H3')"""
ORACLES["team_names"] = f"""WITH {cte('picks')}
SELECT home_team AS team FROM picks UNION SELECT away_team FROM picks"""
ORACLES["team_comparison_long"] = f"WITH {FULL} " + " UNION ALL ".join(
    f"SELECT game_id, {text(label)} AS metric, {side}_team AS team, {side}_{c} AS value "
    f"FROM full_rows WHERE {side}_{c} IS NOT NULL"
    for label, c in replay.COMPARED.items() for side in ("home", "away")
)
ORACLES["feature_sections_long"] = f"WITH {FULL} " + " UNION ALL ".join(
    f"SELECT game_id, {text(section)} AS section, {text(label)} AS label, "
    f"CAST({c} AS DOUBLE) AS value FROM full_rows WHERE {c} IS NOT NULL"
    for section, fields in replay.FEATURE_SECTIONS.items() for label, c in fields.items()
)
ORACLES["first_match_enrich"] = f"""WITH {cte('picks', 'feed')}, firsts AS (
  SELECT game_id, arg_min(flag, _seq) AS flag, arg_min(price, _seq) AS price
  FROM feed GROUP BY game_id)
SELECT game_id, predicted_winner, flag, price FROM picks LEFT JOIN firsts USING (game_id)"""

# ---- series ----------------------------------------------------------------------------------------------


def _finals(source: str) -> str:
    return f"""pool AS (
  SELECT *, CASE WHEN regexp_matches(game_id, '^004[0-9]{{7}}$') THEN substr(game_id, 6, 3) END AS rnd,
         least(home_team, away_team) AS t1, greatest(home_team, away_team) AS t2 FROM {source}),
season_rounds AS (
  SELECT season, count(rnd) AS readable, count(*) FILTER (WHERE rnd = '004') AS finals
  FROM pool GROUP BY season),
pairs AS (
  SELECT season, t1, t2, count(*) AS n, min(game_date) AS first_date,
    count(*) * 1000000 + COALESCE(epoch(CAST(max(game_date) AS TIMESTAMP)), 0) AS score
  FROM pool GROUP BY season, t1, t2 HAVING count(*) >= 2),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (
  PARTITION BY season ORDER BY n >= 4 DESC, score DESC, first_date) = 1),
chosen AS (
  SELECT p.season, p.game_id, row_number() OVER (
    PARTITION BY p.season ORDER BY p.game_date NULLS LAST, p.game_id) AS k
  FROM pool p JOIN season_rounds r USING (season) LEFT JOIN best b ON b.season = p.season
  WHERE (r.finals > 0 AND p.rnd = '004') OR (r.readable = 0 AND p.t1 = b.t1 AND p.t2 = b.t2)),
finals AS (SELECT season, game_id, CAST(k AS INT) AS finals_game_number FROM chosen WHERE k <= 7)"""


FINALS = f"{cte('playoffs')}, {_finals('playoffs')}"
ORACLES["series_game_numbers"] = f"WITH {FINALS} SELECT * FROM finals"
ORACLES["series_live_labels"] = f"""WITH {cte('live_picks')}, first_rows AS (
  SELECT DISTINCT game_id, season, game_date, home_team, away_team FROM live_picks),
{_finals('first_rows')}
SELECT l.game_id, CASE WHEN f.game_id IS NULL THEN '' ELSE {text(series.FINAL_ROUND_LABEL)} END
  AS playoff_round, f.finals_game_number, count(*) AS event_rows
FROM live_picks l LEFT JOIN finals f USING (game_id)
GROUP BY l.game_id, f.game_id, f.finals_game_number"""
UPCOMING = "upcoming AS (SELECT * FROM series_slots)"
OPEN = "game_status IN ('scheduled', 'if_necessary', 'if_necessary_scheduled', 'not_available_yet')"
PATH = f"""teams AS (
  SELECT season, CASE WHEN min(t) <> max(t) THEN min(t) ELSE 'Team A' END AS team_a,
         CASE WHEN min(t) <> max(t) THEN max(t) ELSE 'Team B' END AS team_b
  FROM (SELECT season, home_team AS t FROM upcoming UNION ALL SELECT season, away_team FROM upcoming)
  GROUP BY season),
inputs AS (
  SELECT u.*, team_a, team_b, COALESCE(manual_winner, final_winner) AS actual,
         CASE WHEN manual_winner IS NOT NULL THEN 'manual_override'
              WHEN final_winner IS NOT NULL THEN 'official/local' ELSE 'none' END AS src,
         CASE WHEN {OPEN} AND pregame_prediction_available THEN predicted_winner_pregame END AS pick
  FROM upcoming u JOIN teams USING (season)),
path AS (
  WITH RECURSIVE step AS (
    SELECT i.*, 0 AS a0, 0 AS b0, FALSE AS over0, COALESCE(actual, pick) AS used
    FROM inputs i WHERE finals_game_number = 1
    UNION ALL
    SELECT i.*, s.a1, s.b1, s.a1 >= 4 OR s.b1 >= 4,
      CASE WHEN s.a1 >= 4 OR s.b1 >= 4 THEN NULL WHEN i.actual IS NOT NULL THEN i.actual
           WHEN i.finals_game_number = 7 AND NOT (s.a1 = 3 AND s.b1 = 3) THEN NULL ELSE i.pick END
    FROM (SELECT *, a0 + CASE WHEN used = team_a THEN 1 ELSE 0 END AS a1,
                 b0 + CASE WHEN used = team_b THEN 1 ELSE 0 END AS b1 FROM step) s
    JOIN inputs i ON i.season = s.season AND i.finals_game_number = s.finals_game_number + 1)
  SELECT *, a0 + CASE WHEN used = team_a THEN 1 ELSE 0 END AS a1,
         b0 + CASE WHEN used = team_b THEN 1 ELSE 0 END AS b1,
         finals_game_number = 7 AND NOT (a0 = 3 AND b0 = 3) AS shut FROM step),
told AS (
  SELECT season, finals_game_number, game_id, game_date, home_team, away_team, game_status,
    actual AS actual_winner, src AS actual_result_source, predicted_winner_pregame,
    used AS projected_winner_used,
    CASE WHEN over0 THEN 'not_needed_under_projection'
      WHEN actual IS NOT NULL THEN CASE WHEN src = 'manual_override' THEN 'actual_manual_override'
        ELSE 'actual_official' END
      WHEN shut THEN 'if_necessary_pending'
      WHEN {OPEN} AND pick IS NOT NULL THEN CASE WHEN game_status = 'if_necessary_scheduled'
        THEN 'conditional_model_projected' ELSE 'model_projected' END
      WHEN {OPEN} THEN 'needed_but_prediction_unavailable' ELSE 'not_available' END
      AS projection_type,
    team_a AS series_team_a, team_b AS series_team_b, CAST(a0 AS INT) AS team_a_wins_before,
    CAST(b0 AS INT) AS team_b_wins_before, CAST(a1 AS INT) AS team_a_wins_after,
    CAST(b1 AS INT) AS team_b_wins_after, NOT over0 AND NOT shut AS game_needed_under_projection,
    a1 >= 4 OR b1 >= 4 AS series_over_after_game,
    CASE WHEN over0 THEN {text(series.NOTE_DECIDED)} WHEN actual IS NOT NULL THEN ''
      WHEN shut THEN {text(series.NOTE_GAME_7)}
      WHEN {OPEN} AND pick IS NOT NULL THEN CASE WHEN game_status = 'if_necessary_scheduled'
        THEN {text(series.NOTE_CONDITIONAL_MODEL)} ELSE '' END
      WHEN game_status = 'if_necessary' THEN 'Game ' || CAST(finals_game_number AS VARCHAR) ||
        ' would be necessary under this path, but a pre-game prediction requires schedule metadata.'
      WHEN {OPEN} THEN {text(series.NOTE_PREDICTION_MISSING)}
      WHEN game_status = 'completed' THEN {text(series.NOTE_RESULT_MISSING)} ELSE '' END AS notes
  FROM path)"""
SERIES = f"{cte('series_slots')}, {UPCOMING}, {PATH}"
ORACLES["series_running_state"] = f"WITH {SERIES} SELECT * FROM told"
ORACLES["series_state_summary"] = f"""WITH {SERIES}, folded AS (
  SELECT season, series_team_a AS team_a, series_team_b AS team_b,
    count(*) FILTER (WHERE projection_type LIKE 'actual_%' AND actual_winner = series_team_a) AS aa,
    count(*) FILTER (WHERE projection_type LIKE 'actual_%' AND actual_winner = series_team_b) AS ab,
    arg_max(team_a_wins_after, finals_game_number) AS pa,
    arg_max(team_b_wins_after, finals_game_number) AS pb,
    max(finals_game_number) FILTER (WHERE projection_type LIKE 'actual_%') AS last_actual_game,
    min(finals_game_number) FILTER (WHERE projection_type IN
      ('model_projected', 'conditional_model_projected') AND NOT series_over_after_game)
      AS next_projected_game
  FROM told GROUP BY season, series_team_a, series_team_b)
SELECT season, team_a, team_b,
  team_a || ' ' || aa || ' – ' || ab || ' ' || team_b AS actual_score_text,
  CASE WHEN aa > ab THEN team_a WHEN ab > aa THEN team_b ELSE '' END AS actual_leader,
  team_a || ' ' || pa || ' – ' || pb || ' ' || team_b AS projected_score_text,
  CASE WHEN pa > pb THEN team_a WHEN pb > pa THEN team_b ELSE '' END AS projected_leader,
  last_actual_game, next_projected_game FROM folded"""
ORACLES["series_path_display"] = f"""WITH {SERIES}
SELECT season, finals_game_number, away_team || ' @ ' || home_team AS matchup,
  CASE projection_type WHEN 'actual_official' THEN 'Actual result'
    WHEN 'actual_manual_override' THEN 'Actual (manual correction)'
    WHEN 'model_projected' THEN 'Model projection'
    WHEN 'conditional_model_projected' THEN 'Conditional model projection'
    WHEN 'needed_but_prediction_unavailable' THEN 'Needed — prediction unavailable'
    WHEN 'if_necessary_pending' THEN 'If necessary — pending metadata'
    WHEN 'not_needed_under_projection' THEN 'Not needed under projection'
    WHEN 'not_available' THEN 'Not available' END AS path_type,
  actual_winner, predicted_winner_pregame, projected_winner_used,
  team_a_wins_before || '–' || team_b_wins_before AS score_before,
  team_a_wins_after || '–' || team_b_wins_after AS score_after,
  game_needed_under_projection, notes FROM told"""
ORACLES["series_outcome"] = f"""WITH {cte('series_slots')}, {UPCOMING}, done AS (
  SELECT * FROM upcoming WHERE final_result_available),
wins AS (SELECT season, final_winner, count(*) AS n, max(finals_game_number) AS last
  FROM done GROUP BY season, final_winner),
top AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY n DESC, last DESC) AS k FROM wins),
leans AS (SELECT season, count(*) AS games_played, max(game_date) AS last_game_date,
  count(*) FILTER (WHERE start_prediction_correct_if_final) AS opening_leans_correct,
  count(*) FILTER (WHERE final_prediction_correct_if_final) AS final_leans_correct,
  count(*) FILTER (WHERE predicted_winner_pregame = final_winner) AS pregame_picks_correct
  FROM done GROUP BY season)
SELECT l.season, a.final_winner AS champion, a.n AS champion_wins,
  COALESCE(b.final_winner, '—') AS runner_up, COALESCE(b.n, 0) AS runner_up_wins, games_played,
  last_game_date, opening_leans_correct, final_leans_correct, pregame_picks_correct
FROM leans l JOIN top a ON a.season = l.season AND a.k = 1
LEFT JOIN top b ON b.season = l.season AND b.k = 2"""
ORACLES["series_next_game"] = f"""WITH {cte('series_slots')}, {UPCOMING}
SELECT season, min(finals_game_number) AS finals_game_number,
       arg_min(game_id, finals_game_number) AS game_id
FROM upcoming WHERE NOT final_result_available AND pregame_prediction_available GROUP BY season"""
ORACLES["series_dense_scaffold"] = f"""WITH {cte('series_slots')}, {UPCOMING}, kept AS (
  SELECT * FROM upcoming WHERE game_status <> 'if_necessary')
SELECT s.season, CAST(n AS INT) AS finals_game_number, k.game_id,
       CASE WHEN k.game_id IS NOT NULL THEN TRUE END AS _present
FROM (SELECT DISTINCT season FROM kept) s, range(1, 8) t(n)
LEFT JOIN kept k ON k.season = s.season AND k.finals_game_number = n"""
MERGED = f"""{CLEAN}, planned AS (
  SELECT * FROM clean QUALIFY row_number() OVER (
    PARTITION BY season, finals_game_number ORDER BY game_id DESC) = 1),
collected AS (SELECT f.finals_game_number, p.* FROM finals f JOIN playoffs p USING (season, game_id)),
merged AS (
  SELECT season, finals_game_number, game_id, game_date, home_team, away_team, status,
         NULL AS schedule_source, NULL AS schedule_notes FROM collected
  UNION ALL
  SELECT season, finals_game_number, {RESOLVED}, game_date, home_team, away_team, s, source, notes
  FROM planned p WHERE finals_game_number <= 7 AND NOT EXISTS (
    SELECT 1 FROM collected c
    WHERE c.season = p.season AND c.finals_game_number = p.finals_game_number))"""
ORACLES["override_fill_gaps"] = f"""WITH {FINALS}, {cte('overrides')}, {MERGED}
SELECT season, finals_game_number, game_id, game_date, home_team, status, schedule_source FROM merged"""


def _n(flag: str, default: str) -> str:
    return f"WHEN {flag} THEN CASE WHEN note <> '' THEN note ELSE {text(default)} END"


REPORT = f"""slots AS (
  SELECT season, CAST(n AS INT) AS finals_game_number
  FROM (SELECT DISTINCT season FROM merged), range(1, 8) t(n)),
edges AS (
  SELECT game_id, arg_min(_seq % 100 / 100.0, _seq) AS p_start, arg_max(_seq % 100 / 100.0, _seq) AS p_final,
    arg_min(CASE WHEN _seq % 2 = 0 THEN home_team ELSE away_team END, _seq) AS w_start,
    arg_max(CASE WHEN _seq % 2 = 0 THEN home_team ELSE away_team END, _seq) AS w_final
  FROM playoffs WHERE _seq % 3 <> 0 GROUP BY game_id),
joined AS (
  SELECT t.season, t.finals_game_number, m.game_id IS NOT NULL AS there, COALESCE(m.game_id, '') AS gid,
    m.game_date, m.home_team, m.away_team, COALESCE(m.schedule_source, '') AS src,
    COALESCE(m.schedule_notes, '') AS note,
    CASE WHEN m.game_id IS NULL THEN 'not_available_yet' WHEN m.status = 'final' THEN 'completed'
         WHEN m.status IN ('scheduled', 'if_necessary', 'if_necessary_scheduled', 'not_available_yet')
         THEN m.status WHEN m.game_date IS NULL THEN 'not_available_yet' ELSE m.status END AS st,
    e.*, e.game_id IS NOT NULL AS predicted, EXISTS (
      SELECT 1 FROM playoffs x WHERE x.game_id = m.game_id AND x._seq % 5 <> 0) AS played,
    CASE WHEN m.status = 'final' THEN (SELECT max(x.home_team) FROM playoffs x
      WHERE x.game_id = m.game_id AND x._seq % 4 <> 0) END AS won
  FROM slots t LEFT JOIN merged m
    ON m.season = t.season AND m.finals_game_number = t.finals_game_number
  LEFT JOIN edges e ON e.game_id = m.game_id),
report AS (
  SELECT season, gid AS game_id, finals_game_number, COALESCE(game_date, '') AS game_date,
    COALESCE(home_team, '') AS home_team, COALESCE(away_team, '') AS away_team, st AS game_status,
    '' AS series_status_if_available, predicted AS prediction_available,
    played AS replay_available, won IS NOT NULL AS final_result_available,
    CAST(p_start AS DOUBLE) AS home_win_probability_start,
    CAST(p_final AS DOUBLE) AS home_win_probability_final,
    w_start AS predicted_winner_start, w_final AS predicted_winner_final, won AS final_winner,
    CASE WHEN won IS NOT NULL THEN w_start = won END AS start_prediction_correct_if_final,
    CASE WHEN won IS NOT NULL THEN w_final = won END AS final_prediction_correct_if_final,
    CASE WHEN NOT there THEN CASE WHEN finals_game_number >= 6 THEN {text(series.NOTE_IF_NECESSARY)}
        WHEN finals_game_number >= 4 THEN {text(series.NOTE_NOT_COLLECTED)}
        ELSE {text(series.NOTE_NOT_SCHEDULED)} END
      WHEN src = 'manual_schedule' AND st = 'scheduled'
        THEN trim({text(series.NOTE_MANUAL_SCHEDULE)} || ' ' || note)
      WHEN src = 'manual_schedule' AND st = 'if_necessary_scheduled'
        THEN trim({text(series.NOTE_CONDITIONAL)} || ' ' || note)
      {_n("st = 'scheduled'", series.NOTE_SCHEDULED)}
      {_n("st = 'if_necessary_scheduled'", series.NOTE_CONDITIONAL)}
      {_n("st = 'if_necessary'", series.NOTE_IF_NECESSARY)}
      {_n("NOT played AND predicted", series.NOTE_NO_REPLAY)}
      {_n("played AND NOT predicted", series.NOTE_NO_PREDICTION)} ELSE note END AS notes
  FROM joined),
pre AS (
  SELECT game_id, _seq % 100 / 100.0 AS p, 1 - _seq % 100 / 100.0 AS q, away_team AS pick,
         _seq % 2 = 0 AS ok FROM playoffs WHERE _seq % 7 <> 0),
coming AS (
  SELECT r.season, r.game_id, r.finals_game_number, r.game_date, r.home_team, r.away_team,
    r.game_status, pre.game_id IS NOT NULL AS pregame_prediction_available,
    CAST(p AS DOUBLE) AS home_win_probability_pregame,
    round(CAST(q AS DOUBLE), 9) AS away_win_probability_pregame, pick AS predicted_winner_pregame,
    round(CAST(greatest(p, 1 - p) AS DOUBLE), 4) AS prediction_confidence,
    r.final_result_available, r.final_winner,
    CASE WHEN r.final_result_available THEN ok END AS pregame_prediction_correct_if_final,
    r.replay_available,
    CASE WHEN game_status = 'if_necessary_scheduled' AND pre.game_id IS NOT NULL
        THEN trim({text(series.NOTE_CONDITIONAL_PREGAME)} || ' ' || notes)
      WHEN game_status = 'if_necessary_scheduled' THEN CASE WHEN notes <> '' THEN notes
        ELSE {text(series.NOTE_CONDITIONAL)} END
      WHEN notes <> '' THEN notes
      WHEN r.game_id = '' AND finals_game_number IN (4, 5) THEN {text(series.NOTE_NOT_COLLECTED)}
      WHEN r.game_id = '' AND finals_game_number >= 6 THEN {text(series.NOTE_IF_NECESSARY)}
      WHEN r.game_id <> '' AND pre.game_id IS NULL THEN {text(series.NOTE_PREGAME_FAILED)}
      WHEN r.game_id <> '' AND NOT r.replay_available AND game_status = 'scheduled'
        THEN {text(series.NOTE_PREGAME_WAITING)} ELSE notes END AS notes
  FROM report r LEFT JOIN pre ON pre.game_id = r.game_id)"""
REPORTED = f"{FINALS}, {cte('overrides')}, {MERGED}, {REPORT}"
ORACLES["series_game_report"] = f"WITH {REPORTED} SELECT * FROM report"
ORACLES["series_upcoming_report"] = f"WITH {REPORTED} SELECT * FROM coming"
ORACLES["series_overview"] = f"""WITH {REPORTED}
SELECT r.season, r.finals_game_number, r.game_date,
  CASE WHEN r.home_team = '' AND r.away_team = '' THEN 'TBD'
       ELSE COALESCE(NULLIF(r.away_team, ''), 'TBD') || ' @ ' ||
            COALESCE(NULLIF(r.home_team, ''), 'TBD') END AS matchup,
  CASE r.game_status WHEN 'completed' THEN 'Completed' WHEN 'scheduled' THEN 'Scheduled'
    WHEN 'if_necessary' THEN 'If necessary' WHEN 'if_necessary_scheduled'
    THEN 'If necessary, scheduled' WHEN 'not_available_yet' THEN 'Not available yet'
    ELSE 'Postponed' END AS status,
  CASE WHEN c.pregame_prediction_available THEN 'Yes' ELSE 'No' END AS pregame,
  COALESCE(c.predicted_winner_pregame, '—') AS pregame_winner,
  CASE WHEN r.replay_available THEN 'Yes' ELSE 'No' END AS replay,
  COALESCE(r.final_winner, '—') AS winner,
  COALESCE(r.predicted_winner_start, '—') AS start_prediction,
  COALESCE(r.predicted_winner_final, '—') AS final_prediction
FROM report r JOIN coming c USING (season, finals_game_number)"""
ORACLES["series_export_gaps"] = f"""WITH {cte('series_slots')}, {UPCOMING}
SELECT DISTINCT game_id FROM upcoming WHERE final_result_available
AND CAST(game_id AS BIGINT) NOT IN (SELECT l_orderkey FROM lineitem)"""

ORACLES["series_live_export"] = f"""WITH {FINALS}
SELECT f.season, f.game_id, f.finals_game_number, _seq AS event_num, home_team
FROM finals f JOIN playoffs p USING (game_id)"""
ORACLES["series_replayable"] = f"""WITH {cte('series_slots')}, {UPCOMING}
SELECT season, finals_game_number FROM upcoming
WHERE final_result_available AND pregame_prediction_available"""
ORACLES["labelled_version_metrics"] = f"""WITH {cte('judged')}
SELECT model_version, 'live' AS model, 'setup ' || model_version AS setup, count(*) AS row_count,
       count(*) FILTER (WHERE y = 1 AND yhat = 1) AS true_positive
FROM judged GROUP BY model_version"""

# ---- coverage ---------------------------------------------------------------------------------------------
SEASON_PLAYS = """season_plays AS (SELECT g.game_id, g.season FROM feed f JOIN games g USING (game_id))"""
COVERED = f"""wanted(season) AS (VALUES {values(SEASONS)}),
counts AS (
  SELECT 'games' AS section, season, count(*) AS n, count(DISTINCT game_id) AS g FROM games
  GROUP BY season UNION ALL
  SELECT 'play_by_play', season, count(*), count(DISTINCT game_id) FROM season_plays GROUP BY season
  UNION ALL SELECT 'game_results', season, count(*), count(DISTINCT game_id) FROM games
  WHERE home_score IS NOT NULL GROUP BY season
  UNION ALL SELECT 'pregame_features', season, count(*), count(DISTINCT game_id) FROM games
  WHERE _seq % 7 <> 0 GROUP BY season
  UNION ALL SELECT 'live_features', season, count(*), count(DISTINCT game_id) FROM season_plays
  WHERE CAST(game_id AS BIGINT) % 5 <> 0 GROUP BY season),
sections(section) AS (VALUES ('games'), ('play_by_play'), ('game_results'), ('pregame_features'), ('live_features')),
filled AS (
  SELECT s.section, w.season, COALESCE(e.g, 0) AS expected, COALESCE(c.g, 0) AS have,
         COALESCE(c.n, 0) AS n
  FROM wanted w CROSS JOIN sections s
  LEFT JOIN counts c ON c.section = s.section AND c.season = w.season
  LEFT JOIN counts e ON e.section = 'games' AND e.season = w.season),
judged_sections AS (
  SELECT section, season, expected AS expected_games, have AS available_games, n AS available_rows,
    CASE WHEN expected > 0 THEN round(100.0 * have / expected, 2) WHEN have > 0 THEN 100.0
         ELSE 0.0 END AS coverage_pct,
    CASE WHEN section = 'games' THEN CASE WHEN have >= 1000 THEN 'pass' WHEN have > 0 THEN 'warning'
           ELSE 'fail' END
         WHEN expected <= 0 THEN 'fail' WHEN have >= 0.95 * expected THEN 'pass'
         WHEN have > 0 THEN 'warning' ELSE 'fail' END AS status,
    CASE WHEN section = 'games' THEN have || ' unique games in games.csv'
         WHEN expected <= 0 THEN 'No expected games — games.csv lacks this season'
         ELSE have || '/' || expected || ' games (' || n ||
           CASE WHEN section = 'play_by_play' THEN ' event rows)' ELSE ' rows)' END END AS notes
  FROM filled),
coverage AS (
  SELECT *, CASE WHEN section = 'games' THEN CASE status WHEN 'fail' THEN 'Collect game schedule for this season'
      WHEN 'warning' THEN 'Expected at least 1000 games; verify schedule collection' ELSE '' END
    WHEN expected_games <= 0 THEN 'Collect game schedule before this dataset'
    WHEN status <> 'pass' THEN 'Collect play-by-play for this season, then rebuild the feature tables'
    ELSE '' END AS recommended_action FROM judged_sections)"""
COVERAGE = f"{cte('games', 'feed')}, {SEASON_PLAYS}, {COVERED}"
ORACLES["season_coverage_status"] = f"WITH {COVERAGE} SELECT * FROM coverage"
ORACLES["coverage_readiness"] = f"""WITH {COVERAGE}
SELECT count(*) = 0 AS allowed FROM coverage
WHERE section IN ('play_by_play', 'live_features', 'pregame_features') AND status = 'fail' AND season IN ({', '.join(map(text, SEASONS[:4]))})"""
ORACLES["coverage_missing_seasons"] = f"""WITH {COVERAGE}
SELECT DISTINCT season FROM coverage WHERE status = 'fail'"""
ORACLES["collection_coverage"] = f"""WITH {cte('games', 'feed')}, n AS (
  SELECT game_id, count(*) AS c FROM feed GROUP BY game_id)
SELECT season, count(*) AS eligible_games, count(c) AS collected_games,
       count(*) - count(c) AS remaining_games, round(100.0 * count(c) / count(*), 2) AS coverage_pct,
       CAST(COALESCE(sum(c), 0) AS BIGINT) AS total_event_rows
FROM games LEFT JOIN n USING (game_id) GROUP BY season"""
ORACLES["availability_coverage"] = f"""WITH {cte('games')}, {_finals('games')}, tagged AS (
  SELECT g.season, g.game_id, EXISTS (SELECT 1 FROM lineitem
    WHERE lpad(CAST(l_orderkey AS VARCHAR), 10, '0') = g.game_id) AS has FROM games g),
missing AS (SELECT season, game_id, row_number() OVER (PARTITION BY season ORDER BY game_id) AS k
  FROM tagged WHERE NOT has),
few AS (SELECT season, string_agg(game_id, ', ' ORDER BY game_id) FILTER (WHERE k <= 5) AS ids
  FROM missing GROUP BY season),
found AS (SELECT season, count(*) AS f FROM finals GROUP BY season),
per_season AS (SELECT season, count(*) AS n, count(*) FILTER (WHERE has) AS h FROM tagged GROUP BY season)
SELECT season, n AS playoff_games, h AS games_with_pbp,
       round(100.0 * h / n, 1) AS pbp_coverage_pct, COALESCE(f, 0) AS finals_games_detected,
       n - h AS missing_pbp_games,
       'missing: ' || COALESCE(ids, '') || CASE WHEN n - h > 5 THEN '...' ELSE '' END AS notes
FROM per_season LEFT JOIN few USING (season) LEFT JOIN found USING (season)"""


def _checks(name: str, section: str, source: str, rows: bool) -> str:
    wanted = [(s, "train") for s in SEASONS[:2]] + [(SEASONS[7], "test")]
    out = [f"SELECT '{section}' AS section, '{name}_exists' AS check, 'pass' AS status, '' AS details"]
    out += [
        f"SELECT '{section}', '{name}_column_{c}', 'pass', '{c} present in {name}'"
        for c in ("season", "game_id", "home_team_won")
    ]
    for season, side in wanted:
        of = f"FROM {source} WHERE season = '{season}'"
        n, g, m = "count(*)", "count(DISTINCT game_id)", "count(*) - count(home_team_won)"
        out.append(
            f"SELECT '{section}', '{name}_season_{season}', CASE WHEN {n} > 0 THEN 'pass' ELSE 'fail' "
            f"END, CASE WHEN {n} > 0 THEN '{season} present in {name}' "
            f"ELSE '{season} missing from {name}' END {of}")
        out.append(
            f"SELECT '{section}', '{name}_min_games_{season}', CASE WHEN {g} >= 100 THEN 'pass' "
            f"ELSE 'fail' END, '{season}: ' || {g} || CASE WHEN {g} >= 100 THEN ' games (min 100)' "
            f"ELSE ' games, need at least 100' END {of}")
        if rows:
            out.append(
                f"SELECT '{section}', '{name}_min_rows_{season}', CASE WHEN {n} >= 10000 THEN 'pass' "
                f"ELSE 'fail' END, '{season}: ' || {n} || CASE WHEN {n} >= 10000 "
                f"THEN ' rows (min 10000)' ELSE ' rows, need at least 10000' END {of}")
        out.append(
            f"SELECT '{section}', '{name}_target_{side}_{season}', CASE WHEN {m} = 0 THEN 'pass' "
            f"ELSE 'fail' END, CASE WHEN {m} = 0 THEN '{season}: all {side} rows have home_team_won' "
            f"ELSE '{season}: ' || ({m}) || ' {side} rows missing home_team_won' END {of} "
            f"HAVING {n} > 0")
    return " UNION ALL ".join(out)


READINESS = f"""{cte('games', 'feed')}, {SEASON_PLAYS}, pre AS (
  SELECT season, game_id, CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score
    THEN 0 END AS home_team_won FROM games),
events_by_season AS (SELECT *, 1 AS home_team_won FROM season_plays),
checks AS (
  SELECT 'split' AS section, 'train_test_no_overlap' AS check, 'pass' AS status,
    {text(f"Train {SEASONS[:2]}, test {SEASONS[7]}")} AS details
  UNION ALL {_checks('pregame_features', 'pregame', 'pre', False)}
  UNION ALL {_checks('live_features', 'live', 'events_by_season', True)})"""
ORACLES["training_readiness"] = f"WITH {READINESS} SELECT * FROM checks"
ORACLES["training_gate"] = f"""WITH {READINESS}
SELECT count(*) > 0 AND count(*) FILTER (WHERE status = 'fail') = 0 AS allowed
FROM checks WHERE section = 'live'"""
PROFILE = """profile AS (
  SELECT 'ratings' AS asset, 'missing' AS status, CAST(NULL AS BIGINT) AS row_count,
    CAST(NULL AS BIGINT) AS unique_games, CAST(NULL AS TIMESTAMP) AS last_changed
  UNION ALL SELECT 'orders', CASE WHEN (SELECT max(l_shipdate) FROM lineitem) > max(o_orderdate)
    THEN 'stale' ELSE 'ok' END, count(*), count(DISTINCT o_custkey), max(o_orderdate) FROM orders
  UNION ALL SELECT 'lineitem', 'ok', count(*), count(DISTINCT l_orderkey), max(l_shipdate) FROM lineitem
  UNION ALL SELECT 'events', CASE WHEN (SELECT max(o_orderdate) FROM orders) > max(ts)
    THEN 'stale' ELSE 'ok' END, count(*), count(DISTINCT user_id), max(ts) FROM events
  UNION ALL SELECT 'documents', 'ok', count(*), count(DISTINCT source), NULL FROM documents)"""
ORACLES["dataset_profile"] = f"""WITH {PROFILE}
SELECT asset, status, row_count, unique_games, strftime(last_changed, '%Y-%m-%d') AS last_changed
FROM profile"""
ORACLES["profile_status_counts"] = f"""WITH {PROFILE}, known(status) AS (VALUES
  ('missing'), ('stale'), ('warning'), ('unknown'), ('ok'), ('not_required'))
SELECT status, count(asset) AS n FROM known LEFT JOIN profile USING (status) GROUP BY status"""
ORACLES["profile_rollup"] = f"""WITH {PROFILE}
SELECT asset AS item, status FROM profile WHERE status IN ('missing', 'stale', 'warning')
UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'missing') THEN 'missing'
  WHEN bool_or(status = 'stale') THEN 'stale' ELSE 'ok' END FROM profile
UNION ALL SELECT 'fold', CASE WHEN bool_or(status = 'missing') THEN 'fail'
  WHEN bool_or(status = 'stale') THEN 'warning' ELSE 'pass' END FROM profile"""
ORACLES["latest_attempts"] = """SELECT event_type AS endpoint,
arg_max(event_id, (ts, event_id)) AS attempt, arg_max(value, (ts, event_id)) AS rows_received
FROM events GROUP BY event_type"""
ORACLES["prediction_columns"] = f"""WITH {cte('picks')}
SELECT game_id, home_team, away_team, {P}, 1.0 - {P} AS away_win_probability, predicted_label,
       predicted_winner, actual_home_team_won, prediction_correct FROM picks"""


# ---- what must hold of models ----------------------------------------------------------------------
PREGAME_SIDES = f"""{FULL}, placed_rows AS (
  SELECT f.*, count(*) OVER () AS n, row_number() OVER (ORDER BY game_date NULLS LAST, game_id) AS rn
  FROM full_rows f),
parted AS (SELECT *, rn > {CUT} AS is_test FROM placed_rows)"""
ORACLES["pregame_scores_checked"] = f"""WITH {PREGAME_SIDES}
SELECT game_id, true AS probability_ok, true AS label_ok, true AS winner_ok, true AS correct_ok,
       CAST(home_team_won AS INT) AS actual_home_team_won FROM parted WHERE is_test"""
ORACLES["pregame_fit_balanced"] = f"""WITH {PREGAME_SIDES}
SELECT count(*) AS training_rows, CAST(sum(home_team_won) AS BIGINT) AS home_wins, true AS balanced
FROM parted WHERE NOT is_test AND home_team_won IS NOT NULL"""
LIVE_SIDES = f"""rows AS ({ORACLES["live_features_full"]}), per_game AS (
  SELECT game_id, arg_min(game_date, event_num) AS game_date FROM rows GROUP BY game_id),
placed AS (SELECT game_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY game_date NULLS LAST, game_id) AS rn FROM per_game),
sided AS (SELECT r.*, rn > {CUT} AS is_test FROM rows r JOIN placed USING (game_id))"""
ORACLES["live_scores_checked"] = f"""WITH {LIVE_SIDES}
SELECT game_id, count(*) AS row_count, true AS probability_ok, true AS label_ok, true AS winner_ok,
       true AS correct_ok FROM sided WHERE is_test GROUP BY game_id"""
ORACLES["live_report_counts"] = f"""WITH {LIVE_SIDES}
SELECT count(*) AS n_total_rows, count(home_team_won) AS n_used_rows,
       count(*) - count(home_team_won) AS n_dropped_missing_target,
       count(DISTINCT game_id) FILTER (WHERE home_team_won IS NOT NULL) AS n_unique_games,
       count(*) FILTER (WHERE home_team_won IS NOT NULL AND NOT is_test) AS n_train,
       count(*) FILTER (WHERE home_team_won IS NOT NULL AND is_test) AS n_test,
       count(DISTINCT game_id) FILTER (WHERE home_team_won IS NOT NULL AND NOT is_test) AS train_games,
       count(DISTINCT game_id) FILTER (WHERE home_team_won IS NOT NULL AND is_test) AS test_games
FROM sided"""
ORACLES["running_score_small_blocks"] = f"""SELECT game_id, event_num, home_score, away_score, is_scoring_event
FROM ({ORACLES["running_score_state"]})"""
ORACLES["replay_small_blocks"] = f"""SELECT game_id, event_num, probability_change FROM ({ORACLES["replay_columns"]})"""


# ---- storage -------------------------------------------------------------------------------------------
READABLE = "team_rows AS (SELECT * FROM every_row WHERE _seq % 10 <> 7)"
ORACLES["landed_csv_schedule"] = f"""WITH {cte('team_rows').replace('team_rows AS', 'every_row AS', 1)}, {READABLE}, {GROUPS}
SELECT g.game_id, h.team_name AS home_team, a.team_name AS away_team, 'final' AS status
FROM judged_groups g
JOIN rows h ON h.game_id = g.game_id AND h.season = g.season AND h.side = 'home'
JOIN rows a ON a.game_id = g.game_id AND a.season = g.season AND a.side = 'away'
WHERE g.reasons = '' QUALIFY row_number() OVER (PARTITION BY g.game_id ORDER BY g.season) = 1"""
ORACLES["landed_csv_unreadable"] = f"""WITH {cte('team_rows')}
SELECT season || ',' || GAME_ID || ',bad' || CAST(_seq AS VARCHAR) AS line FROM team_rows WHERE _seq % 10 = 7"""
ORACLES["storage_steps"] = f"""WITH {cte('plays')}, n AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE event_num % 2 = 0) AS a,
         count(scoreHome) AS s FROM plays)
SELECT unnest(['overwritten', 'season_scan', 'log', 'valid', 'quarantine', 'fallback', 'empty']) AS step,
       unnest([n, a, n + a, s, n - s, n - a, 0]) AS row_count FROM n"""
ORACLES["stream_raw_plays"] = f"""SELECT * FROM ({ORACLES["normalized_plays"]})
WHERE game_id IS NOT NULL AND event_num IS NOT NULL AND period IS NOT NULL"""
ORACLES["stream_game_state"] = f"""WITH {cte('plays')}
SELECT game_id, greatest(COALESCE(max(scoreHome), 0), 0) AS home_score, greatest(COALESCE(max(scoreAway), 0), 0) AS away_score,
       CAST(max(event_num) AS DOUBLE) AS last_event, count(*) AS event_rows,
       greatest(COALESCE(max(scoreHome), 0), 0) - greatest(COALESCE(max(scoreAway), 0), 0) AS score_margin_home
FROM plays WHERE game_id IS NOT NULL AND event_num IS NOT NULL GROUP BY game_id"""
ORACLES["stream_last_arrivals"] = """WITH rows AS (
  SELECT user_id AS game_id, event_id % 40 AS event_num, date_trunc('day', ts) AS day, value, event_type AS kind,
         event_id AS _seq FROM events)
SELECT game_id, event_num, strftime(day, '%Y-%m-%d') AS day, value, kind, _seq FROM rows
WHERE day <= (SELECT max(day) FROM rows) - INTERVAL 1 DAY
QUALIFY row_number() OVER (PARTITION BY day, game_id, event_num ORDER BY _seq DESC) = 1"""
ORACLES["stream_coverage_deltas"] = ORACLES["stream_coverage"]
ORACLES["uncollected_by_index"] = ORACLES["uncollected_games"]
ORACLES["upsert_versions"] = ORACLES["upsert_merge"]
ORACLES["valid_invalid_written_once"] = f"""WITH {cte('plays')}
SELECT game_id, event_num, scoreHome IS NOT NULL AND event_msg_action_type IS NOT NULL AS valid FROM plays"""
ORACLES["games_sorted_sink"] = f"""WITH {cte('games')} SELECT count(*) AS games, 0 AS overlapping_files FROM games"""

# ---- no results, manifests, old files, series scores -------------------------------------------------
ORACLES["pregame_without_results"] = f"""WITH {FULL}
SELECT game_id, home_games_played_before, away_games_played_before,
       CAST(CASE WHEN home_games_played_before = 0 THEN 0 END AS BIGINT) AS home_wins_before,
       CAST(0.5 AS DOUBLE) AS home_win_pct_before, CAST(NULL AS DOUBLE) AS home_points_for_avg_before,
       home_rest_days, away_rest_days, rest_days_diff, CAST(NULL AS INT) AS home_team_won FROM full_rows"""
_KINDS = {c: "numeric" for c in schemas.PREGAME_NUMERIC} | {c: "categorical" for c in schemas.PREGAME_CATEGORICAL}
ORACLES["feature_manifest"] = f"""WITH {FULL}, counts AS (
  SELECT {", ".join(f"count({c}) AS {c}" for c in _KINDS)} FROM full_rows)
SELECT unnest([{", ".join(text(c) for c in _KINDS)}]) AS feature, unnest([{", ".join(_KINDS)}]) AS present,
       unnest([{", ".join(text(k) for k in _KINDS.values())}]) AS kind FROM counts"""
ORACLES["manual_results_old_files"] = f"""WITH {cte('games')}, {BOTH_RESULTS}
SELECT game_id, home_score, away_score, source, '' AS notes FROM manual"""
ORACLES["series_scores_checked"] = f"""WITH {FULL}
SELECT game_id, true AS probability_ok, true AS label_ok, true AS winner_ok, true AS correct_ok,
       CAST(home_team_won AS INT) AS actual_home_team_won FROM full_rows WHERE game_type = 'playoffs'"""
ORACLES["live_report_checked"] = f"""WITH {LIVE_SIDES}
SELECT count(*) AS n_test, true AS accuracy_ok, true AS brier_score_ok, true AS log_loss_ok, true AS true_positive_ok
FROM sided WHERE is_test AND home_team_won IS NOT NULL"""
ORACLES["stream_scores_checked"] = ORACLES["live_scores_checked"]
