"""Queries read every row that they are defined over."""

import math

import pytest
from tidepool.plans import adapters as A
from tidepool.queries import QUERIES


def located(spark, sf_dir):
    return A.typed(spark, sf_dir).where("lat is not null and day is not null")


def brute_places(rows):
    """(days, night_days, months, files, lat, lon) of each place, cell by cell."""
    cell = lambda x: math.floor(round(x / 0.01, 6))
    cells = {}
    for r in rows:
        cells.setdefault((cell(r.lat), cell(r.lon)), []).append(r)
    left, found = set(cells), []
    while left:
        open_, own = [left.pop()], []
        while open_:
            y, x = open_.pop()
            own += cells[y, x]
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            open_ += near
        mean = lambda k: sum(r[k] for r in own) / len(own)
        found.append((len({r.day for r in own}), len({r.day for r in own if r.night}), len({r.month for r in own}), len(own), mean("lat"), mean("lon")))
    return sorted(found)


def test_places_hold_every_located_file(spark, sf_dir):
    want = brute_places(located(spark, sf_dir).select("lat", "lon", "day", "month", "night").collect())
    got = sorted(tuple(r) for r in QUERIES["place_components"](spark, sf_dir).select("days", "night_days", "months", "files", "lat", "lon").collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-6)
    near = sorted((r for r in want if (r[0] < 5 or r[1] < 3) and (r[0] >= 2 or r[1] >= 1)), key=lambda r: (-r[0], -r[1], -r[3], r[4], r[5]))[:5]
    shown = QUERIES["home_near_misses"](spark, sf_dir).select("days", "night_days", "files").collect()
    assert [tuple(r) for r in shown] == [(r[0], r[1], r[3]) for r in near]


def test_areas_hold_every_located_file(spark, sf_dir):
    assert sum(r.files for r in QUERIES["areas"](spark, sf_dir).collect()) == located(spark, sf_dir).count()


def test_split_runs_hold_every_dated_day(spark, sf_dir):
    want = A.typed(spark, sf_dir).where("day is not null").select("folder", "day").distinct().count()
    assert QUERIES["split_runs"](spark, sf_dir).select("folder", "day").distinct().count() == want
