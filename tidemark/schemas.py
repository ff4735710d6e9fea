"""Explicit schemas and fixed column lists; nothing is inferred from data.

Tables are declared as DDL strings, which readers and ``createDataFrame`` both accept."""

from __future__ import annotations

# ---- fixed values: column lists ----------------------------------------------
GAME_COLUMNS = [
    "game_id", "season", "game_date", "home_team", "away_team",
    "home_team_id", "away_team_id", "status", "game_type",
]
GAME_NON_NULL = ["game_id", "game_date", "home_team", "away_team", "home_team_id", "away_team_id"]
SKIPPED_COLUMNS = [
    "game_id", "season", "game_type", "raw_row_count", "home_row_count", "away_row_count",
    "team_names", "team_ids", "matchup_values", "game_dates", "reason_skipped",
]
PLAY_COLUMNS = [
    "game_id", "event_num", "event_msg_type", "event_msg_action_type", "period", "pctimestring",
    "home_description", "neutral_description", "visitor_description", "score", "score_margin",
    "home_team", "away_team", "season", "game_date",
]
PLAY_EXTRA_COLUMNS = [
    "teamId", "teamTricode", "personId", "playerName", "location", "scoreHome", "scoreAway",
]
PLAY_NON_NULL = ["game_id", "event_num", "period"]
FAILURE_COLUMNS = [
    "game_id", "season", "game_date", "home_team", "away_team",
    "endpoint", "reason_failed", "error_message",
]
LIVE_COLUMNS = [
    "game_id", "event_num", "season", "game_date", "home_team", "away_team",
    "home_team_id", "away_team_id", "period", "pctimestring",
    "seconds_remaining_period", "seconds_remaining_game", "home_score", "away_score",
    "score_margin_home", "abs_score_margin", "event_msg_type", "event_msg_action_type",
    "event_type_label", "is_scoring_event", "is_turnover", "is_foul", "is_timeout",
    "is_rebound", "is_free_throw", "is_field_goal_attempt", "home_team_won",
]
LIVE_NON_NULL = ["game_id", "event_num", "period", "home_score", "away_score", "home_team_won"]
RESULT_COLUMNS = [
    "game_id", "season", "game_date", "home_team", "away_team", "home_team_id",
    "away_team_id", "home_score", "away_score", "winner", "home_team_won", "source",
]
RESULT_NON_NULL = ["game_id", "home_score", "away_score", "winner", "home_team_won"]
PREGAME_NUMERIC = [
    "home_games_played_before", "away_games_played_before",
    "home_wins_before", "away_wins_before", "home_losses_before", "away_losses_before",
    "home_win_pct_before", "away_win_pct_before", "win_pct_diff_before",
    "home_points_for_avg_before", "away_points_for_avg_before",
    "home_points_allowed_avg_before", "away_points_allowed_avg_before",
    "points_for_avg_diff_before", "points_allowed_avg_diff_before",
    "home_recent_win_pct_before", "away_recent_win_pct_before", "recent_win_pct_diff_before",
    "home_rest_days", "away_rest_days", "rest_days_diff",
]
PREGAME_CATEGORICAL = ["game_type"]
PREGAME_COLUMNS = [
    "game_id", "season", "game_date", "home_team", "away_team",
    "home_team_id", "away_team_id", "game_type", *PREGAME_NUMERIC, "home_team_won",
]
PREGAME_NON_NULL = ["game_id", "game_date", "home_team", "away_team"]
PREGAME_FORBIDDEN = [
    "game_id", "season", "game_date", "home_team", "away_team", "home_team_id",
    "away_team_id", "home_team_won", "home_score", "away_score", "winner",
]
LIVE_NUMERIC = [
    "period", "seconds_remaining_period", "seconds_remaining_game", "home_score", "away_score",
    "score_margin_home", "abs_score_margin", "event_msg_type", "event_msg_action_type",
    "is_scoring_event", "is_turnover", "is_foul", "is_timeout", "is_rebound",
    "is_free_throw", "is_field_goal_attempt",
]
LIVE_EITHER_TYPE = ["event_msg_type", "event_msg_action_type"]
LIVE_CATEGORICAL = ["event_type_label", "game_type"]
LIVE_FORBIDDEN = [
    "game_id", "event_num", "season", "game_date", "home_team", "away_team", "home_team_id",
    "away_team_id", "home_team_won", "final_home_score", "final_away_score", "winner",
]
SCORE_COLUMN_PAIRS = [
    ("home_score", "away_score"), ("home_points", "away_points"), ("home_pts", "away_pts"),
    ("pts_home", "pts_away"), ("HOME_PTS", "AWAY_PTS"),
]
TEAM_STATS_BASE = {
    "TEAM_ID": "team_id", "TEAM_NAME": "team_name", "GP": "games_played", "W": "wins",
    "L": "losses", "W_PCT": "win_pct", "MIN": "minutes", "PTS": "points",
    "FGM": "field_goals_made", "FGA": "field_goals_attempted", "FG_PCT": "field_goal_pct",
    "FG3M": "three_pointers_made", "FG3A": "three_pointers_attempted",
    "FG3_PCT": "three_point_pct", "FTM": "free_throws_made", "FTA": "free_throws_attempted",
    "FT_PCT": "free_throw_pct", "OREB": "offensive_rebounds", "DREB": "defensive_rebounds",
    "REB": "rebounds", "AST": "assists", "TOV": "turnovers", "STL": "steals", "BLK": "blocks",
    "PF": "personal_fouls", "PLUS_MINUS": "plus_minus",
}
TEAM_STATS_ADVANCED = {
    "OFF_RATING": "off_rating", "DEF_RATING": "def_rating", "NET_RATING": "net_rating",
    "PACE": "pace", "TS_PCT": "ts_pct", "EFG_PCT": "efg_pct", "AST_PCT": "ast_pct",
    "REB_PCT": "reb_pct", "TM_TOV_PCT": "tm_tov_pct",
}
TEAM_STATS_REQUIRED_SOURCE = ["TEAM_ID", "TEAM_NAME", "GP"]
TEAM_STATS_COLUMNS = ["season", "season_type", *TEAM_STATS_BASE.values()]
TEAM_STATS_NON_NULL = ["season", "season_type", "team_id", "team_name", "games_played"]
TEAM_STATS_KEY = ["season", "season_type", "team_id"]
MANUAL_COLUMNS = [
    "game_id", "home_score", "away_score", "winner", "source", "confirmed_at", "notes",
]
SWING_COLUMNS = [
    "game_id", "season", "game_date", "home_team", "away_team", "event_num", "period",
    "pctimestring", "home_score", "away_score", "event_type_label", "home_win_probability",
    "previous_home_win_probability", "probability_change", "absolute_probability_change",
]
OVERRIDE_COLUMNS = [
    "season", "finals_game_number", "game_id", "game_date", "home_team", "away_team",
    "home_team_id", "away_team_id", "status", "season_type", "source", "notes",
]
OVERRIDE_FORBIDDEN = [
    "home_score", "away_score", "winner", "final_winner", "home_team_won",
    "actual_home_team_won", "prediction_correct",
]
OVERRIDE_STATUSES = ["scheduled", "if_necessary", "if_necessary_scheduled", "not_available_yet"]
OVERRIDE_SOURCES = ["manual_schedule", "api_schedule", "placeholder"]
SCHEDULED_REQUIRED = [
    "season", "finals_game_number", "game_date", "home_team", "away_team",
    "home_team_id", "away_team_id", "status", "season_type",
]
SERIES_REPORT_COLUMNS = [
    "season", "game_id", "finals_game_number", "game_date", "home_team", "away_team",
    "game_status", "series_status_if_available", "prediction_available", "replay_available",
    "final_result_available", "home_win_probability_start", "home_win_probability_final",
    "predicted_winner_start", "predicted_winner_final", "final_winner",
    "start_prediction_correct_if_final", "final_prediction_correct_if_final", "notes",
]
UPCOMING_COLUMNS = [
    "season", "game_id", "finals_game_number", "game_date", "home_team", "away_team",
    "game_status", "pregame_prediction_available", "home_win_probability_pregame",
    "away_win_probability_pregame", "predicted_winner_pregame", "prediction_confidence",
    "final_result_available", "final_winner", "pregame_prediction_correct_if_final",
    "replay_available", "notes",
]
PATH_COLUMNS = [
    "season", "finals_game_number", "game_id", "game_date", "home_team", "away_team",
    "game_status", "actual_winner", "actual_result_source", "predicted_winner_pregame",
    "projected_winner_used", "projection_type", "series_team_a", "series_team_b",
    "team_a_wins_before", "team_b_wins_before", "team_a_wins_after", "team_b_wins_after",
    "game_needed_under_projection", "series_over_after_game", "notes",
]
SERIES_EXPORT_COLUMNS = [
    "season", "game_id", "finals_game_number", "game_date", "home_team", "away_team",
    "event_num", "period", "pctimestring", "seconds_remaining_period", "seconds_remaining_game",
    "home_score", "away_score", "score_margin_home", "abs_score_margin", "event_type_label",
    "home_win_probability", "away_win_probability", "predicted_winner", "predicted_label",
    "actual_home_team_won", "prediction_correct",
]
PREGAME_PREDICTION_COLUMNS = [
    "game_id", "season", "game_date", "home_team", "away_team", "home_team_id", "away_team_id",
    "game_type", "home_win_probability", "away_win_probability", "predicted_winner",
    "predicted_label", "actual_home_team_won", "prediction_correct",
]
LIVE_PREDICTION_COLUMNS = [
    "game_id", "event_num", "season", "game_date", "home_team", "away_team", "period",
    "pctimestring", "seconds_remaining_period", "seconds_remaining_game", "home_score",
    "away_score", "score_margin_home", "abs_score_margin", "event_type_label",
    "home_win_probability", "away_win_probability", "predicted_winner", "predicted_label",
    "actual_home_team_won", "prediction_correct",
]
LOCKED_COLUMNS = [
    "pregame_prediction_available", "home_win_probability_pregame", "away_win_probability_pregame",
    "predicted_winner_pregame", "prediction_confidence",
    "home_win_probability", "away_win_probability", "predicted_winner", "predicted_label",
    "prediction_correct",
]
OVER_COLUMNS = {
    "winner": ["actual_winner", "winner_actual", "actual_result"],
    "status": ["game_status", "status"],
    "score": ["actual_home_score", "actual_away_score", "home_score_actual", "away_score_actual"],
}
OVER_STATUS = ["final", "completed"]
# --------------------------------------------------------------------------------

GAMES = (
    "game_id string, season string, game_date string, home_team string, away_team string, "
    "home_team_id string, away_team_id string, status string, game_type string"
)
GAME_RESULTS = (
    "game_id string, season string, game_date string, home_team string, away_team string, "
    "home_team_id string, away_team_id string, home_score double, away_score double, "
    "winner string, home_team_won int, source string"
)
TEAM_ROWS = (
    "GAME_ID string, TEAM_ID string, TEAM_NAME string, GAME_DATE string, MATCHUP string, "
    "season string, season_type string"
)
RAW_PLAYS = (
    "gameId string, actionNumber double, clock string, period int, teamId string, "
    "teamTricode string, personId string, playerName string, location string, "
    "description string, actionType string, subType string, scoreHome string, scoreAway string"
)
PLAYS = (
    "game_id string, event_num double, event_msg_type string, event_msg_action_type string, "
    "period int, pctimestring string, home_description string, neutral_description string, "
    "visitor_description string, score string, score_margin string, home_team string, "
    "away_team string, season string, game_date string, teamId string, teamTricode string, "
    "personId string, playerName string, location string, scoreHome string, scoreAway string"
)
OVERRIDES = (
    "season string, finals_game_number int, game_id string, game_date string, home_team string, "
    "away_team string, home_team_id string, away_team_id string, status string, "
    "season_type string, source string, notes string"
)
MANUAL_RESULTS = (
    "game_id string, home_score int, away_score int, winner string, source string, "
    "confirmed_at timestamp, notes string"
)


def _typed(columns: list[str], kinds: dict[str, list[str]]) -> str:
    """DDL of a fixed column list; columns that ``kinds`` does not name are text."""
    kind = {c: k for k, cs in kinds.items() for c in cs}
    return ", ".join(f"{c} {kind.get(c, 'string')}" for c in columns)


_COUNTS = [c for c in PREGAME_NUMERIC if c.endswith(("games_played_before", "wins_before", "losses_before"))]
PREGAME_FEATURES = _typed(PREGAME_COLUMNS, {
    "double": [c for c in PREGAME_NUMERIC if c not in _COUNTS], "bigint": _COUNTS, "int": ["home_team_won"],
})
_FLAGS = [c for c in LIVE_COLUMNS if c.startswith("is_")]
# Event kinds are numbers in some feeds and words in others; they keep the type they are stored with.
LIVE_FEATURES = _typed([c for c in LIVE_COLUMNS if c not in LIVE_EITHER_TYPE], {
    "double": ["event_num", "seconds_remaining_period", "seconds_remaining_game", "home_score", "away_score",
               "score_margin_home", "abs_score_margin"],
    "int": ["period", "home_team_won", *_FLAGS],
})
