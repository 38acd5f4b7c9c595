"""Standings laid out inside the tasks, against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from panelspark.operators import ladder
from panelspark.plans import standings
from panelspark.sources import fixtures

ROOT = "/root/testdata/sf0.001"
SCHEMA = "season int, team string, t timestamp_ntz, points long, games long"


def _facts():
    pick = random.Random(3)
    rows = [(s, m, datetime(2024, 1, 1) + timedelta(hours=37 * pick.randrange(40)), pick.randrange(9), k)
            for s in (1, 2, None) for k, m in enumerate(["b", "a", None, "c"] * 9)]
    return rows + [(1, "a", None, 50, 50), (2, "only", None, 4, 60), rows[0]]


def _expected(rows, own_times):
    low = datetime.min
    out = set()
    for s in (1, 2):
        mine = [r for r in rows if r[0] == s]
        for now in {r[2] for r in mine if r[2] is not None}:
            held = {}
            for r in mine:
                if (r[2] or low) < now and ((r[2] or low), *r[3:]) > (held.get(r[1]) or (low, -1, -1)):
                    held[r[1]] = ((r[2] or low), *r[3:])
            order = sorted(held, key=lambda m: (-held[m][1], m is not None, m or ""))
            for i, m in enumerate(order):
                gap = [held[m][2] - held[order[j]][2] if 0 <= j < len(order) else 0 for j in (i + 1, i - 1)]
                third = held[order[2]][1] if len(order) > 2 else 0
                if not own_times or any(r[1] == m and r[2] == now for r in mine):
                    out.add((s, m, now, None if held[m][0] == low else held[m][0], *held[m][1:], i + 1, *gap, third))
    return out


@pytest.mark.parametrize("own_times", [False, True])
@pytest.mark.parametrize("unit", [None, "week", "hour"])
def test_standings_equal_a_loop(spark, monkeypatch, unit, own_times):
    monkeypatch.setattr(ladder, "CELLS", 12)
    rows = _facts()
    got = ladder.standings(spark.createDataFrame(rows, SCHEMA), "season", "team", "t", "points", ["games"], {"third": 3}, "at", unit, own_times)
    assert got.columns == ["season", "team", "at", "t", "points", "games", "position", "games_above", "games_below", "third_points"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _expected(rows, own_times)


def test_the_grid_is_not_shuffled(spark):
    table = standings.league_table(fixtures.games(spark, ROOT), t=standings.TableSpec(segment=None))
    plan = table._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Window" not in above
