"""Panel-shaped views derived from the driver's tables.

The reference reads three landed tables: a game list, an appearance log and an
entity info table. These builders derive the same shapes (keys, flags, nulls,
zero denominators) from ``orders``/``customer``/``events`` so every query's work
grows with the input tables. All are lazy DataFrames; no literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import cut_lineage
from panelspark.sources.tables import read_table

# Fixed values of the derived shapes (they must equal the oracle SQL text).
N_TEAMS = 25           # teams are nation keys 0..24
SLOTS_PER_SIDE = 5     # entities per team per game
ENTITY_INFO_GAP = 31   # entities with element % 31 == 0 have no info row
# Measures of the appearance log beside the ones built below: name -> (a, b, m): (game * a + slot * b) % m.
COUNTS = {"goals_scored": (3, 7, 4), "assists": (5, 11, 3), "clean_sheets": (7, 0, 2), "goals_conceded": (11, 0, 6),
          "own_goals": (13, 17, 23), "penalties_saved": (17, 19, 29), "saves": (19, 5, 9), "penalties_missed": (23, 29, 31),
          "yellow_cards": (29, 3, 7), "red_cards": (31, 7, 37), "bonus": (37, 13, 4), "bps": (41, 23, 60), "starts": (43, 3, 2),
          "transfers_in": (47, 31, 5000), "transfers_out": (53, 37, 4000)}
# The same divided by ten.
SCORES = {"creativity": (59, 3, 120), "threat": (61, 5, 150), "ict_index": (67, 7, 90)}
# The same divided by one hundred, null in every 13th game.
EXPECTED = {"expected_goals": (71, 11, 200), "expected_assists": (73, 13, 150), "expected_goal_involvements": (79, 17, 300),
            "expected_goals_conceded": (83, 0, 350)}
EXPECTED_GAP = 13


def games(spark: SparkSession, root: str) -> DataFrame:
    """Game list: one row per order; kickoff is unique (orderdate + orderkey microseconds)."""
    o = read_table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, root, "customer").select("c_custkey", "c_nationkey")
    # customer is a dimension whose size grows with the data: no forced broadcast,
    # AQE broadcasts it only when its measured size is under the threshold.
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.year("o_orderdate").alias("season"),
        F.col("o_orderkey").alias("game_id"),
        F.timestamp_add("MICROSECOND", F.col("o_orderkey"), F.col("o_orderdate")).alias("kickoff"),
        F.col("c_nationkey").alias("home"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % N_TEAMS).cast("int").alias("away"),
        (F.floor("o_totalprice").cast("bigint") % 5).alias("team_h_score"),
        (F.col("o_custkey") % 4).alias("team_a_score"),
    )


def panel_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(appearance log, game list, entity info) over one stored game list.

    A panel reads the games a dozen times, each time with other columns, so no exchange of the join behind
    them is used again: once the customers are too many to broadcast, that join would run every time.
    """
    g = cut_lineage(games(spark, root))
    log = appearance_log(spark, root, g)
    return log, g, entity_info(spark, root, log)


def appearance_log(spark: SparkSession, root: str, g: DataFrame | None = None) -> DataFrame:
    """Appearance log: 10 rows per game (5 slots per side), keyed (season, element, fixture)."""
    g = games(spark, root) if g is None else g
    # one generator instead of a cross join with literal tables: rows never leave their partition
    sides = F.array(*[F.struct(F.lit(h).alias("was_home"), F.lit(s).alias("slot"))
                      for h in (True, False) for s in range(SLOTS_PER_SIDE)])
    x = g.select("*", F.inline(sides))
    gid, slot = F.col("game_id"), F.col("slot")
    own = F.when(F.col("was_home"), F.col("home")).otherwise(F.col("away"))
    other = F.when(F.col("was_home"), F.col("away")).otherwise(F.col("home"))
    return x.select(
        F.col("season"),
        gid.alias("fixture"),
        F.col("was_home"),
        (own * SLOTS_PER_SIDE + slot).alias("element"),
        other.alias("opponent_team"),
        F.col("kickoff").alias("kickoff_time"),
        F.month("kickoff").alias("round"),
        F.when((gid + slot) % 4 == 0, F.lit(0))
         .when((gid + slot) % 17 == 0, F.lit(None))
         .otherwise((gid * 7 + slot * 13) % 90 + 1).alias("minutes"),
        ((gid * 3 + slot * 5) % 15 - 2).alias("total_points"),
        (((gid * 11 + slot) % 100) / 10.0).cast("double").alias("influence"),
        (40 + (gid + slot) % 20).alias("value"),
        ((gid * 37 + slot * 101) % 20000).alias("selected"),
        ((gid * 5 + slot) % 2001 - 1000).alias("transfers_balance"),
        F.concat(F.lit("player "), own * SLOTS_PER_SIDE + slot).alias("playername"),
        *[((gid * a + slot * b) % m).alias(c) for c, (a, b, m) in COUNTS.items()],
        *[(((gid * a + slot * b) % m) / 10.0).cast("double").alias(c) for c, (a, b, m) in SCORES.items()],
        *[F.when(gid % EXPECTED_GAP != 0, (((gid * a + slot * b) % m) / 100.0).cast("double")).alias(c) for c, (a, b, m) in EXPECTED.items()],
    )


def entity_info(spark: SparkSession, root: str, log: DataFrame | None = None) -> DataFrame:
    """Entity info keyed (season, id); some entities have no row (left-join misses)."""
    a = appearance_log(spark, root) if log is None else log
    return (a.filter(F.col("element") % ENTITY_INFO_GAP != 0)
             .select("season", F.col("element").alias("id"),
                     (1000 + F.col("element")).alias("code"),
                     (F.col("element") % 4 + 1).alias("element_type"))
             .distinct())


def appearances(spark: SparkSession, root: str) -> DataFrame:
    """Event-log panel: entity = user, season = ISO week, zero and null measures present."""
    e = read_table(spark, root, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.weekofyear("ts").alias("season"),
        F.col("user_id").alias("entity_id"),
        "event_id",
        F.col("ts").alias("event_time"),
        "event_type",
        k.alias("minutes"),
        F.col("value").alias("points"),
        F.when(k % 2 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("maybe"),
    )
