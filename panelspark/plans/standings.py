"""Team-side plans: perspective rows, form, as-of league table and team features.

Partitioning plan (each is one shuffle):
  (season, team, segment) by time  -> next fixture + rolling means (halo rows)
  (season, team, venue, segment)   -> venue form (halo rows)
  (season, team, segment) by time  -> running totals + game number (segment prefixes)
  (season, week)                   -> as-of fill of the standings grid, rank, neighbour gaps, thresholds
A team's rows of a season are split by ``TableSpec.segment`` where they are too many for one task.
The grid is seasons' teams x that season's kickoff times; it is laid out inside the tasks
(``operators.ladder``), so only the games are shuffled, not the 25 times larger grid.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import expr as X
from panelspark.operators.ladder import standings
from panelspark.operators.segmented import MAX_ROWS_PER_TASK, UNITS, halo_window, resolve_segment, running_totals, time_segment

# Table positions whose points are reported per time, with the
# names the reference gives them, and its season length.
THRESHOLDS = {"win": 1, "cl": 4, "euro": 7, "regulation": 18}
SEASON_LENGTH = 38
# Names of the rolled, form and table columns.
TEAM_ROLLING = ["team_scored", "team_conceded", "home", "win", "draw", "loss"]
FORM_COLS = {"win": "win_rate_home_away_2", "draw": "draw_rate_home_away_2",
             "loss": "loss_rate_home_away_2", "team_scored": "avg_team_scored_home_away_2",
             "team_conceded": "avg_team_conceded_home_away_2"}


@dataclass
class GameSpec:
    season: str = "season"
    time: str = "kickoff"
    home: str = "home"
    away: str = "away"
    home_score: str = "team_h_score"
    away_score: str = "team_a_score"


@dataclass
class TableSpec:
    season_length: int = SEASON_LENGTH
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    form_rows: int = 2
    rolling_window: int = 4
    # (season, team) windows run per date_trunc(segment, kickoff); None = per key;
    # 'auto' segments only when a team-season holds more than max_rows_per_task rows
    segment: str | None = "auto"
    max_rows_per_task: int = MAX_ROWS_PER_TASK
    # of the team windows, when 'auto' measured it apart from the grid's
    window_segment: str | None = "segment"

    def window_unit(self) -> str | None:
        return self.segment if self.window_segment == "segment" else self.window_segment


def team_perspective(games: DataFrame, g: GameSpec | None = None) -> DataFrame:
    """Each game as two rows, one per team (home row first), from ONE scan.

    ``inline(array(struct home, struct away))`` replaces a UNION ALL of two scans.
    """
    g = g or GameSpec()
    home = F.struct(F.col(g.home).alias("team"), F.col(g.away).alias("opponent"),
                    F.col(g.home_score).alias("team_scored"), F.col(g.away_score).alias("team_conceded"),
                    F.lit(1).alias("home"))
    away = F.struct(F.col(g.away).alias("team"), F.col(g.home).alias("opponent"),
                    F.col(g.away_score).alias("team_scored"), F.col(g.home_score).alias("team_conceded"),
                    F.lit(0).alias("home"))
    rows = games.select(F.col(g.time).alias("kickoff_time"), F.col(g.season).alias("season"),
                        F.inline(F.array(home, away)))
    return rows.select("team", "opponent", "team_scored", "team_conceded", "kickoff_time", "season", "home")


def team_setup(games: DataFrame, g: GameSpec | None = None, segment: str | None = "month",
               rolling_window: int | None = None) -> DataFrame:
    """Perspective rows + outcome flags (P7) + next fixture (W5), and optionally
    the rolling means (W4) in the same (season, team, segment) pass."""
    t = team_perspective(games, g)
    flags = X.outcome_flags("team_scored", "team_conceded")
    t = t.select("*", *[v.alias(k) for k, v in flags.items()])
    nxt = {"next_opponent": "opponent", "next_game_home": "home", "next_kickoff_time": "kickoff_time"}

    def stage(w):
        cols = [F.lead(src, 1).over(w).alias(dst) for dst, src in nxt.items()]
        if rolling_window:
            fw = w.rowsBetween(-(rolling_window - 1), 0)
            cols += [F.avg(c).over(fw).alias(f"{c}_rolling_avg") for c in TEAM_ROLLING]
        return cols

    back = (rolling_window - 1) if rolling_window else 0
    return halo_window(t, ["season", "team"], ["kickoff_time"], time_segment("kickoff_time", segment),
                       back, 1, stage)


def with_form(setup: DataFrame, rows: int = 2, segment: str | None = "month") -> DataFrame:
    """Venue form, mean of the last ``rows`` games per (team, next venue, season).

    Computed in place: the reference joins it back on (team, kickoff), which is
    unique per perspective row, so the join is an identity.
    """
    def stage(w):
        fw = w.rowsBetween(-(rows - 1), 0)
        return [F.avg(src).over(fw).alias(dst) for src, dst in FORM_COLS.items()]
    return halo_window(setup, ["season", "team", "next_game_home"], ["kickoff_time"],
                       time_segment("kickoff_time", segment), rows - 1, 0, stage)


def team_game_totals(setup: DataFrame, season_length: int = SEASON_LENGTH,
                     segment: str | None = "month") -> DataFrame:
    """Per team-game running totals (W7, P8, P9, W8) used by the table.

    Exact integer running sums per (season, team, segment) plus the totals of
    the earlier segments of the season.
    """
    pts = X.outcome_points("win", "draw")
    t = setup.select("season", "kickoff_time", "team", pts.alias("points_from_game"))
    t = running_totals(t, ["season", "team"], ["kickoff_time"], time_segment("kickoff_time", segment),
                       {"total_games": F.lit(1), "team_points": F.col("points_from_game")}, row_number="row_num")
    t = t.select("season", "kickoff_time", "team", "points_from_game", "row_num", "total_games", "team_points")
    return t.withColumn("games_remaining", F.lit(season_length) - F.col("total_games"))


def standings_grid(totals: DataFrame, segment: str | None = "month") -> DataFrame:
    """Each team's latest game strictly before every kickoff of its season.

    Grid = (season, team) x distinct kickoff times of the season, laid out inside the tasks
    that hold a stretch of the season's games (``ladder.standings``); the grid is not shuffled.
    """
    return _ladder(totals, segment, {}, []).drop("position")


def ranked_grid(totals: DataFrame, segment: str | None = "month") -> DataFrame:
    """``standings_grid`` with the place of each team at each kickoff."""
    return _ladder(totals, segment, {}, [])


def _ladder(totals: DataFrame, segment: str | None, thresholds: dict, gaps: list[str], own_times: bool = False) -> DataFrame:
    facts = totals.select("season", "team", "kickoff_time", "total_games", "points_from_game", "team_points", "games_remaining")
    return standings(facts, "season", "team", "kickoff_time", "team_points", gaps, thresholds, "next_kickoff_time", segment, own_times)


def league_table(games: DataFrame, g: GameSpec | None = None, t: TableSpec | None = None) -> DataFrame:
    """League table from a game list (see ``league_table_from_setup``)."""
    t = resolve_table_segment(games, g, t)
    return league_table_from_setup(team_setup(games, g, t.window_unit()), t)


def resolve_table_segment(games: DataFrame, g: GameSpec | None, t: TableSpec | None) -> TableSpec:
    """Fix ``t.segment`` ('auto' -> measured).

    The team windows hold the games of a (season, team); the grid has a cell for each kickoff of
    the season, so its stretches are measured on the games of a season and may be shorter.
    """
    t = t or TableSpec()
    if t.segment != "auto":
        return t
    g = g or GameSpec()
    half = max(1, t.max_rows_per_task // 2)
    window = resolve_segment("auto", team_perspective(games, g), ["season", "team"], "kickoff_time", half)
    kickoffs = games.select(F.col(g.season).alias("season"), F.col(g.time).alias("kickoff_time"))
    picked = [u for u in (window, resolve_segment("auto", kickoffs, ["season"], "kickoff_time", half)) if u is not None]
    return replace(t, segment=max(picked, key=UNITS.index) if picked else None, window_segment=window)


def league_table_from_setup(setup: DataFrame, t: TableSpec | None = None, own_times: bool = False) -> DataFrame:
    """League table at every kickoff time: position (W10), neighbour gaps (W11),
    points at threshold positions (A1) and distance to them (J6).

    ``points_above`` = points - points of the next team in the order (the team
    just BELOW in the table); ``points_below`` uses the previous one. The order
    (points desc, team asc) is the one used for ``position``, which makes the
    neighbours deterministic under ties. ``own_times`` keeps the rows of the teams
    that play at the time.
    """
    t = t or TableSpec()
    totals = team_game_totals(setup, t.season_length, t.window_unit())
    ranked = _ladder(totals, t.segment, t.thresholds, ["team_points", "games_remaining"], own_times)
    out = ranked.withColumnsRenamed({"team_points_above": "points_above", "team_points_below": "points_below",
                                     "games_remaining_above": "games_diff_above", "games_remaining_below": "games_diff_below"})
    return out.select("*", *[(F.col("team_points") - F.col(f"{name}_points")).alias(f"points_to_{name}")
                             for name in t.thresholds])


TABLE_FEATURES = {  # league-table column -> team-feature name
    "position": "position", "team_points": "team_points",
    "points_above": "points_to_team_above", "points_below": "points_to_team_below",
    "games_remaining": "games_remaining", "games_diff_above": "games_left_diff_above",
    "games_diff_below": "games_left_diff_below",
}


def team_features(games: DataFrame, g: GameSpec | None = None, t: TableSpec | None = None) -> DataFrame:
    """Team features per perspective row: setup + form + own and opponent standings
    before the game (J4) + rolling means (W4).

    J4 joins the table once, on (season, kickoff = table time): the standings of the teams that
    play at a time (only they are taken from the table) come as one short list, in which a row finds
    its own team and its opponent, whichever game they belong to.
    """
    t = resolve_table_segment(games, g, t)
    # rolling means (W4) only read the perspective rows: computed in the setup
    # pass they share its (season, team, segment) shuffle; the join below
    # neither adds nor drops rows, so the values equal rolling after it.
    base = team_setup(games, g, t.window_unit(), rolling_window=t.rolling_window)
    setup = with_form(base, t.form_rows, t.window_unit())
    table = league_table_from_setup(base, t, own_times=True)
    cols = dict(TABLE_FEATURES)
    cols.update({f"points_to_{n}": f"points_to_{n}" for n in t.thresholds})
    at_time = (table.groupBy("season", F.col("next_kickoff_time").alias("kickoff_time"))
               .agg(F.collect_list(F.struct("team", *[F.col(src).alias(dst) for src, dst in cols.items()])).alias("__at")))
    own = setup.join(at_time, ["season", "kickoff_time"], "left")

    def standing(team: str) -> Column:
        return F.get(F.filter("__at", lambda x: x["team"] == F.col(team)), F.lit(0))

    own = own.select("*", standing("team").alias("__own"), standing("opponent").alias("__opp"))
    rolled = [f"{c}_rolling_avg" for c in TEAM_ROLLING]
    kept = ["season", "kickoff_time", "team", *[c for c in setup.columns if c not in ("season", "kickoff_time", "team", *rolled)]]
    return own.select(*kept, *[F.col(f"__own.{c}").alias(c) for c in cols.values()],
                      *[F.col(f"__opp.{c}").alias(f"opponent_{c}") for c in cols.values()], *rolled)
