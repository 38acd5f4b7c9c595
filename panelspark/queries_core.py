"""Registered queries for the panel plans (windows, joins, as-of table, flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import oracle_sql as O
from panelspark.operators import windows as W
from panelspark.operators.joins import asof_join, sized_hash_side
from panelspark.operators.segmented import halo_window, resolve_segment, time_segment
from panelspark.plans import entity, panel, standings
from panelspark.registry import query
from panelspark.sources import fixtures

LOG_KEYS = ["season", "element", "fixture", "kickoff_time"]
ENT_PART, ENT_ORDER = ["season", "element"], ["kickoff_time", "fixture"]


def entity_windows(log, back: int, fwd: int, *stages):
    """Windows per (season, entity) of the log, segmented by kickoff when an entity is too big
    for one task (measured), with halo rows so the results equal the per-key windows."""
    unit = resolve_segment("auto", log, ENT_PART, "kickoff_time")
    return halo_window(log, ENT_PART, ENT_ORDER, time_segment("kickoff_time", unit), back, fwd, *stages)


@query("rolling_avg", O.with_(*O.FIX) + """
select season, element, fixture, kickoff_time, minutes, total_points, influence,
       avg(minutes) over r as minutes_rolling_avg,
       avg(total_points) over r as total_points_rolling_avg,
       avg(influence) over r as influence_rolling_avg
from appearance_log
window r as (partition by season, element order by kickoff_time, fixture rows between 3 preceding and current row)""")
def q_rolling_avg(spark, root):
    log = fixtures.appearance_log(spark, root).select(*LOG_KEYS, "minutes", "total_points", "influence")
    return entity_windows(log, 3, 0, lambda w: [F.avg(c).over(w.rowsBetween(-3, 0)).alias(f"{c}_rolling_avg")
                                                for c in ("minutes", "total_points", "influence")])


@query("next_value_target", O.with_(*O.FIX) + """
select season, element, fixture, kickoff_time, total_points,
       lead(coalesce(total_points, 0)) over (partition by season, element order by kickoff_time, fixture) as target
from appearance_log""")
def q_next_value_target(spark, root):
    log = fixtures.appearance_log(spark, root).select(*LOG_KEYS, "total_points")
    return entity_windows(log, 0, 1, lambda w: [W.next_value("total_points", default=0, w=w).alias("target")])


@query("lag_fallback_ratio", O.with_(*O.FIX) + """
select season, element, fixture, kickoff_time, selected,
       coalesce(selected / nullif(lag(selected, 3) over w, 0), selected / nullif(lag(selected, 2) over w, 0),
                selected / nullif(lag(selected, 1) over w, 0), 1.0) as selected_index_change4
from appearance_log window w as (partition by season, element order by kickoff_time, fixture)""")
def q_lag_fallback(spark, root):
    log = fixtures.appearance_log(spark, root).select(*LOG_KEYS, "selected")
    return entity_windows(log, 3, 0, lambda w: [W.lag_fallback_ratio("selected", w=w).alias("selected_index_change4")])


@query("role_label", O.with_(*O.FIX) + """
select season, element, fixture, round, target,
       case when season = (select max(season) from appearance_log) and target is null and round > 1 then 'score'
            when target is null then 'delete' else 'train' end as data
from (select *, lead(coalesce(total_points, 0)) over (partition by season, element order by kickoff_time, fixture) as target
      from appearance_log) x""")
def q_role_label(spark, root):
    from panelspark.functions.expr import role_label
    log = fixtures.appearance_log(spark, root)
    t = entity_windows(log.select(*LOG_KEYS, "round", "total_points"), 0, 1,
                       lambda w: [W.next_value("total_points", default=0, w=w).alias("target")])
    t = t.select("season", "element", "fixture", "round", "target")
    last = W.global_max(log, "season")
    return t.withColumn("data", role_label(F.col("season") == last, "target", "round", 1))


@query("relevance_filter", O.with_(*O.FIX) + """
select * from (
  select season, element, fixture, value, selected,
         avg(coalesce(minutes, 0)) over r as minutes_rolling_avg,
         avg(total_points) over r as total_points_rolling_avg
  from appearance_log
  window r as (partition by season, element order by kickoff_time, fixture rows between 3 preceding and current row)) x
where minutes_rolling_avg > 0 or (value >= 45 and selected >= 10000) or total_points_rolling_avg <> 0""")
def q_relevance(spark, root):
    from panelspark.functions.expr import relevance
    log = fixtures.appearance_log(spark, root).select(
        "season", "element", "fixture", "kickoff_time", "value", "selected", "total_points",
        F.coalesce("minutes", F.lit(0)).alias("minutes"))
    r = entity_windows(log, 3, 0, lambda w: [F.avg(c).over(w.rowsBetween(-3, 0)).alias(f"{c}_rolling_avg")
                                              for c in ("minutes", "total_points")])
    r = r.filter(relevance([F.col("minutes_rolling_avg") > 0,
                            (F.col("value") >= 45) & (F.col("selected") >= 10000),
                            F.col("total_points_rolling_avg") != 0]))
    return r.select("season", "element", "fixture", "value", "selected", "minutes_rolling_avg",
                    "total_points_rolling_avg")


@query("entity_features", O.with_(*O.FIX, O.ENTITY) + "select * from entity_features")
def q_entity_features(spark, root):
    return entity.entity_features(fixtures.appearance_log(spark, root), fixtures.games(spark, root),
                                  fixtures.entity_info(spark, root))


@query("entity_features_segmented", O.with_(*O.FIX, O.ENTITY) + "select * from entity_features")
def q_entity_features_segmented(spark, root):
    """The entity plan with its windows forced onto (season, entity, kickoff month) segments."""
    return entity.entity_features(fixtures.appearance_log(spark, root), fixtures.games(spark, root),
                                  fixtures.entity_info(spark, root), entity.EntitySpec(segment="month"))


@query("team_perspective", O.with_(O.GAMES, O.TEAM_SETUP) + "select * from tp")
def q_team_perspective(spark, root):
    return standings.team_perspective(fixtures.games(spark, root))


@query("outcome_flags", O.with_(O.GAMES, O.TEAM_SETUP) + """
select team, kickoff_time, win, draw, loss,
       3 * win + draw as points_from_game
from setup""")
def q_outcome_flags(spark, root):
    from panelspark.functions.expr import outcome_points
    s = standings.team_setup(fixtures.games(spark, root))
    return s.select("team", "kickoff_time", "win", "draw", "loss",
                    outcome_points("win", "draw").alias("points_from_game"))


@query("next_fixture", O.with_(O.GAMES, O.TEAM_SETUP) + """
select team, season, kickoff_time, next_opponent, next_game_home, next_kickoff_time from setup""")
def q_next_fixture(spark, root):
    s = standings.team_setup(fixtures.games(spark, root))
    return s.select("team", "season", "kickoff_time", "next_opponent", "next_game_home", "next_kickoff_time")


@query("home_away_form", O.with_(O.GAMES, O.TEAM_SETUP, O.FORM) + """
select team, season, kickoff_time, next_game_home, win_rate_home_away_2, draw_rate_home_away_2,
       loss_rate_home_away_2, avg_team_scored_home_away_2, avg_team_conceded_home_away_2
from form""")
def q_home_away_form(spark, root):
    s = standings.with_form(standings.team_setup(fixtures.games(spark, root)))
    return s.select("team", "season", "kickoff_time", "next_game_home", *standings.FORM_COLS.values())


@query("game_number", O.with_(O.GAMES, O.TEAM_SETUP, O.TOTALS) + """
select season, team, kickoff_time, row_num from totals""")
def q_game_number(spark, root):
    t = standings.team_game_totals(standings.team_setup(fixtures.games(spark, root)))
    return t.select("season", "team", "kickoff_time", "row_num")


@query("running_totals", O.with_(O.GAMES, O.TEAM_SETUP, O.TOTALS) + """
select season, team, kickoff_time, points_from_game, total_games, team_points, games_remaining from totals""")
def q_running_totals(spark, root):
    t = standings.team_game_totals(standings.team_setup(fixtures.games(spark, root)))
    return t.select("season", "team", "kickoff_time", "points_from_game", "total_games", "team_points",
                    "games_remaining")


@query("asof_strict", O.with_(O.GAMES, O.TEAM_SETUP, O.TOTALS, O.ASOF) + """
select season, team, next_kickoff_time, kickoff_time, total_games, points_from_game, team_points, games_remaining
from st""")
def q_asof_strict(spark, root):
    t = standings.team_game_totals(standings.team_setup(fixtures.games(spark, root)))
    return standings.standings_grid(t)


@query("league_table", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE) + """
select season, team, next_kickoff_time, kickoff_time, total_games, points_from_game, team_points,
       games_remaining, position, points_above, points_below, games_diff_above, games_diff_below,
       win_points, cl_points, euro_points, regulation_points,
       points_to_win, points_to_cl, points_to_euro, points_to_regulation
from league""")
def q_league_table(spark, root):
    return standings.league_table(fixtures.games(spark, root))


@query("league_table_segmented", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE) + """
select season, team, next_kickoff_time, kickoff_time, total_games, points_from_game, team_points,
       games_remaining, position, points_above, points_below, games_diff_above, games_diff_below,
       win_points, cl_points, euro_points, regulation_points,
       points_to_win, points_to_cl, points_to_euro, points_to_regulation
from league""")
def q_league_table_segmented(spark, root):
    """The league table with every (season, team) window split by kickoff week."""
    return standings.league_table(fixtures.games(spark, root), t=standings.TableSpec(segment="week"))


@query("team_features_segmented", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE, O.TEAM_FEATURES)
       + "select * from team_features")
def q_team_features_segmented(spark, root):
    return standings.team_features(fixtures.games(spark, root), t=standings.TableSpec(segment="day"))


@query("neighbour_gaps", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE) + """
select season, next_kickoff_time, team, team_points, points_above, points_below, games_diff_above, games_diff_below
from league""")
def q_neighbour_gaps(spark, root):
    return standings.league_table(fixtures.games(spark, root)).select(
        "season", "next_kickoff_time", "team", "team_points", "points_above", "points_below",
        "games_diff_above", "games_diff_below")


@query("threshold_pivot", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE) + "select * from cuts")
def q_threshold_pivot(spark, root):
    from panelspark.operators.profile import threshold_pivot
    t = standings.team_game_totals(standings.team_setup(fixtures.games(spark, root)))
    return threshold_pivot(standings.ranked_grid(t), ["season", "next_kickoff_time"], "position", "team_points",
                           standings.THRESHOLDS)


@query("standings_both_sides", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE, O.TEAM_FEATURES) + "select * from tf0")
def q_standings_both_sides(spark, root):
    tf = standings.team_features(fixtures.games(spark, root))
    return tf.select(*[c for c in tf.columns if not c.endswith("_rolling_avg")])


@query("team_features", O.with_(O.GAMES, O.TEAM_SETUP, O.LEAGUE, O.TEAM_FEATURES) + "select * from team_features")
def q_team_features(spark, root):
    return standings.team_features(fixtures.games(spark, root))


FEATURE_TABLE_SQL = O.with_(*O.FIX, O.ENTITY, O.TEAM_SETUP, O.LEAGUE, O.TEAM_FEATURES) + """
select distinct * from entity_features e join team_features t using (team, opponent, kickoff_time, season)
where (data = 'train' and next_game_home is not null) or data = 'score'"""


@query("feature_table", FEATURE_TABLE_SQL)
def q_feature_table(spark, root):
    return panel.feature_table_from(spark, root)


@query("panel_join", O.with_(*O.FIX, O.ENTITY, O.TEAM_SETUP, O.LEAGUE, O.TEAM_FEATURES) + """
select count(*) as n_rows, count(distinct element) as n_entities, cast(sum(target) as bigint) as sum_target,
       cast(sum(position) as bigint) as sum_position
from entity_features e join team_features t using (team, opponent, kickoff_time, season)""")
def q_panel_join(spark, root):
    log, games, info = fixtures.panel_inputs(spark, root)
    n = games.count()
    ent = entity.entity_features(log, sized_hash_side(games, n), info)
    # two rows per game, of which the position is read
    tf = sized_hash_side(standings.team_features(games).select(*panel.PANEL_KEYS, "position"), 2 * n)
    j = ent.join(tf, on=panel.PANEL_KEYS, how="inner")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("element").alias("n_entities"),
                 F.sum("target").alias("sum_target"), F.sum("position").alias("sum_position"))


@query("sorted_panel", O.with_(*O.FIX) + """
select element, kickoff_time, season, fixture, total_points from appearance_log
order by element, kickoff_time desc""")
def q_sorted_panel(spark, root):
    log = fixtures.appearance_log(spark, root)
    # One global sort at the sink (range-partitioned, no single partition)
    return (log.select("element", "kickoff_time", "season", "fixture", "total_points")
               .orderBy(F.col("element"), F.col("kickoff_time").desc()))


@query("left_join_case_key", O.with_(*O.FIX) + """
select pd.season, pd.element, pd.fixture, pd.was_home, gl.home, gl.away, gl.team_h_score, gl.team_a_score
from appearance_log pd left join games gl on pd.season = gl.season and pd.fixture = gl.game_id
 and pd.opponent_team = (case when pd.was_home then gl.away else gl.home end)""")
def q_left_join_case_key(spark, root):
    from panelspark.functions.expr import orient
    pd, gl = fixtures.appearance_log(spark, root).alias("pd"), fixtures.games(spark, root).alias("gl")
    cond = ((F.col("pd.season") == F.col("gl.season")) & (F.col("pd.fixture") == F.col("gl.game_id")) &
            (F.col("pd.opponent_team") == orient(F.col("pd.was_home"), F.col("gl.away"), F.col("gl.home"))))
    return pd.join(gl, cond, "left").select("pd.season", "pd.element", "pd.fixture", "pd.was_home",
                                            "gl.home", "gl.away", "gl.team_h_score", "gl.team_a_score")


@query("left_join_dim", O.with_(*O.FIX) + """
select pd.season, pd.element, pd.fixture, pi.code, pi.element_type
from appearance_log pd left join entity_info pi on pd.element = pi.id and pd.season = pi.season""")
def q_left_join_dim(spark, root):
    pd, pi = fixtures.appearance_log(spark, root).alias("pd"), fixtures.entity_info(spark, root).alias("pi")
    cond = (F.col("pd.element") == F.col("pi.id")) & (F.col("pd.season") == F.col("pi.season"))
    return pd.join(pi, cond, "left").select("pd.season", "pd.element", "pd.fixture", "pi.code", "pi.element_type")


@query("orient_case", O.with_(*O.FIX) + """
select pd.season, pd.element, pd.fixture,
       case when pd.was_home then gl.home else gl.away end as team,
       case when pd.was_home then gl.away else gl.home end as opponent
from appearance_log pd join games gl on pd.season = gl.season and pd.fixture = gl.game_id""")
def q_orient_case(spark, root):
    from panelspark.functions.expr import orient
    pd, gl = fixtures.appearance_log(spark, root).alias("pd"), fixtures.games(spark, root).alias("gl")
    j = pd.join(gl, (F.col("pd.season") == F.col("gl.season")) & (F.col("pd.fixture") == F.col("gl.game_id")))
    return j.select("pd.season", "pd.element", "pd.fixture",
                    orient("pd.was_home", "gl.home", "gl.away").alias("team"),
                    orient("pd.was_home", "gl.away", "gl.home").alias("opponent"))


@query("code_decode", O.with_(*O.FIX) + """
select pd.season, pd.element, pd.fixture, pi.element_type,
       coalesce(['Goalkeeper', 'Defender', 'Midfielder'][pi.element_type], 'Striker') as player_position
from appearance_log pd left join entity_info pi on pd.element = pi.id and pd.season = pi.season""")
def q_code_decode(spark, root):
    from panelspark.functions.expr import decode
    pd, pi = fixtures.appearance_log(spark, root).alias("pd"), fixtures.entity_info(spark, root).alias("pi")
    j = pd.join(pi, (F.col("pd.element") == F.col("pi.id")) & (F.col("pd.season") == F.col("pi.season")), "left")
    return j.select("pd.season", "pd.element", "pd.fixture", "pi.element_type",
                    decode("pi.element_type", entity.POSITION_LABELS, entity.POSITION_DEFAULT).alias("player_position"))


@query("per_minute_ratios", O.with_(*O.FIX) + """
select season, element, fixture, coalesce(minutes, 0) as minutes,
       total_points / nullif(coalesce(minutes, 0), 0) as total_points_per_minute,
       influence / nullif(coalesce(minutes, 0), 0) as influence_per_minute,
       transfers_balance / nullif(selected, 0) as pct_transfer_balance
from appearance_log""")
def q_per_minute(spark, root):
    from panelspark.functions.expr import per_unit, safe_ratio
    log = fixtures.appearance_log(spark, root)
    return log.select("season", "element", "fixture", F.coalesce("minutes", F.lit(0)).alias("minutes"),
                      per_unit("total_points", "minutes").alias("total_points_per_minute"),
                      per_unit("influence", "minutes").alias("influence_per_minute"),
                      safe_ratio("transfers_balance", "selected").alias("pct_transfer_balance"))


@query("gated_value", O.with_(*O.FIX) + """
select season, element, fixture,
       case when minutes > 0 then influence else 0 end as influence,
       (case when minutes > 0 then influence else 0 end) / nullif(coalesce(minutes, 0), 0) as influence_per_minute
from appearance_log""")
def q_gated(spark, root):
    from panelspark.functions.expr import gated, per_unit
    log = fixtures.appearance_log(spark, root)
    g = gated("influence", "minutes")
    return log.select("season", "element", "fixture", g.alias("influence"),
                      per_unit(g, "minutes").alias("influence_per_minute"))


@query("distinct_keys", O.with_(O.GAMES, O.TEAM_SETUP) + """
select distinct season, kickoff_time as next_kickoff_time from tp""")
def q_distinct_keys(spark, root):
    tp = standings.team_perspective(fixtures.games(spark, root))
    return tp.select("season", F.col("kickoff_time").alias("next_kickoff_time")).distinct()


@query("latest_per_group", """
select o_custkey, o_orderkey, o_orderdate, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
  from orders) x where rn = 1""")
def q_latest_per_group(spark, root):
    from panelspark.sources.tables import read_table
    o = read_table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return W.latest_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("asof_events", """
select e.event_id, e.user_id, e.ts, p.event_id as prev_event_id, p.event_type as prev_event_type, p.value as prev_value
from events e asof join events p on e.user_id = p.user_id and e.ts > p.ts""")
def q_asof_events(spark, root):
    """J5 on a second shape: each event with the same user's previous event (strict)."""
    from panelspark.sources.tables import read_table
    e = read_table(spark, root, "events")
    left = e.select("user_id", "event_id", "ts")
    right = e.select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("prev_event_id"),
                     F.col("event_type").alias("prev_event_type"), F.col("value").alias("prev_value"))
    j = asof_join(left, right, by=["user_id"], left_on="ts", right_on="p_ts", strict=True, how="inner",
                  segment="auto")
    return j.select("event_id", "user_id", "ts", "prev_event_id", "prev_event_type", "prev_value")
