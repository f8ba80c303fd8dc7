"""Windows and composites against a literal walk through the times."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rasterdrill.operators import temporal as T

ORIGIN = datetime(2000, 1, 1)


def frame(spark, series):
    rows = [(k, ORIGIN + timedelta(seconds=s)) for k, ss in series.items() for s in ss]
    return spark.createDataFrame(rows, "poly_id int, ts timestamp_ntz")


def walk(seconds, days):
    """Windows of a series; the last one goes if it holds only the last time."""
    times, out, i = sorted(set(seconds)), [], 0
    while i < len(times):
        j = i
        while j < len(times) and times[j] - times[i] < days * 86400:
            j += 1
        out.append(times[i:j])
        i = j
    if out and len(out[-1]) == 1:
        out.pop()
    return out


@pytest.mark.parametrize("days", [1, 2, 7, 16, 365])
def test_windows_match_a_walk(spark, days):
    rng = random.Random(days)
    series = {
        k: [rng.randint(0, 86400 * rng.choice([3, 40, 900])) for _ in range(rng.randint(1, 60))]
        for k in range(30)
    }
    series[90] = [i * 80_000 for i in range(200)]  # never a gap of a day
    got = {}
    for r in T.anchored_windows(frame(spark, series), days).collect():
        anchor = int((r["anchor"] - ORIGIN).total_seconds())
        got.setdefault((r["poly_id"], anchor, r["n_times"]), []).append(int((r["ts"] - ORIGIN).total_seconds()))
    want = {(k, w[0], len(w)): w for k, ss in series.items() for w in walk(ss, days)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_lone_last_time_is_dropped_unless_kept(spark):
    df = frame(spark, {1: [0, 25, 10 * 86400], 2: [0]})
    assert T.anchored_windows(df, 1).count() == 2
    assert T.anchored_windows(df, 1, keep_trailing=True).count() == 4


def test_window_bound_is_strict(spark):
    """A time exactly N days later starts the next window."""
    df = frame(spark, {1: [0, 86400, 86401]})
    got = sorted((r["ts"], r["anchor"]) for r in T.anchored_windows(df, 1).collect())
    assert [a for _, a in got] == [ORIGIN, ORIGIN + timedelta(days=1), ORIGIN + timedelta(days=1)]


ND = {"bs": -1, "pv": -1, "npv": -1, "TCW": -9999}
PIXEL = "poly_id int, ts timestamp_ntz, anchor timestamp_ntz, n_times int, x int, bs int, pv int, npv int, TCW float, water int"


def sequences():
    rng = random.Random(3)
    out = []
    for x in range(400):
        seq = []
        for t in range(rng.randint(1, 6)):
            if rng.random() < 0.3:  # water: the other bands are masked out
                seq.append((t, -1, -1, -1, -9999.0, 1))
            else:
                cover = [rng.choice([-1, rng.randint(0, 100)]) for _ in range(3)]
                seq.append((t, *cover, rng.choice([-9999.0, -350.0, 12.5, -800.25]), 0))
        out.append((x, [s for s in seq if rng.random() < 0.9]))  # some times are absent
    return out


def pixel_frame(spark, data, n_times):
    rows = [
        (1, ORIGIN + timedelta(days=t), ORIGIN, n_times, x, *rest)
        for x, seq in data
        for t, *rest in seq
    ]
    return spark.createDataFrame(rows, PIXEL)


def test_composite_matches_a_fold(spark):
    data = sequences()
    got = {
        r["x"]: (r["bs"], r["pv"], r["npv"], r["TCW"], r["water"])
        for r in T.composite_first_valid(pixel_frame(spark, data, 6), ["poly_id", "x"], ND).collect()
    }
    want = {}
    for x, seq in data:
        if not seq:
            continue
        state = [-1, -1, -1, -9999.0, 0]
        for _, *now in seq:
            wet_before = state[4] > 0
            for b in range(3):
                if state[b] == -1 and not wet_before:
                    state[b] = now[b]
            settled = state[3] != -9999.0 or wet_before
            if not settled:
                state[3], state[4] = now[3], now[4]
        want[x] = tuple(state)
    assert got == want


def test_day_mean_needs_every_time(spark):
    data = [
        (1, [(0, 10, 20, 70, 4.0, 0), (1, 20, 30, 50, 8.0, 0)]),
        (2, [(0, 10, 20, 70, 4.0, 0), (1, -1, 30, 50, -9999.0, 0)]),
        (3, [(0, 10, 20, 70, 4.0, 0)]),
        (4, [(0, -1, -1, -1, -9999.0, 1), (1, -1, -1, -1, -9999.0, 1)]),
    ]
    got = {
        r["x"]: (r["bs"], r["pv"], r["TCW"], r["water"])
        for r in T.average_over_day(pixel_frame(spark, data, 2), ["poly_id", "x"], ND).collect()
    }
    assert got == {
        1: (15.0, 25.0, 6.0, 0),
        2: (-1.0, 25.0, -9999.0, 0),
        3: (-1.0, -1.0, -9999.0, 0),
        4: (-1.0, -1.0, -9999.0, 2),
    }


def test_one_long_series(spark):
    """200,000 times of one polygon, walked in one pass."""
    df = spark.range(200_000).selectExpr("1 AS poly_id", "timestampadd(HOUR, CAST(id * 5 AS INT), TIMESTAMP_NTZ '1990-01-01 00:00:00') AS ts")
    windows = T.anchored_windows(df, 16)
    assert windows.count() == 200_000 - (200_000 % 77 == 1)
    size = windows.groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert size == 77  # 16 days of 24 hours hold 76.8 steps of 5 hours
    assert "collect_list" not in windows._jdf.queryExecution().toString()


def test_days_per_key(spark):
    rows = [(k, f"2020-01-0{d} 00:00:00", n) for k, n in ((1, 0), (2, 1), (3, 2)) for d in (1, 2, 4, 5)]
    df = spark.createDataFrame(rows, "poly_id int, ts string, days int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r.poly_id, r.ts.day, r.anchor.day, r.n_times, r.days) for r in T.anchored_windows(df, "days").collect()}
    assert {g[1:4] for g in got if g[0] == 1} == {(d, d, 1) for d in (1, 2, 4, 5)}
    assert {g[1:4] for g in got if g[0] == 2} == {(d, d, 1) for d in (1, 2, 4)}
    assert {g[1:4] for g in got if g[0] == 3} == {(1, 1, 2), (2, 1, 2), (4, 4, 2), (5, 4, 2)}


def test_either_rule_is_the_rule_of_the_window(spark):
    """Negative values and the ends of whole numbers too; one row packs a value with its turn."""
    rng, data = random.Random(3), []
    for x in range(120):
        days = rng.choice([0, 1, 2, 400])
        n = 1 if days == 0 else rng.randint(1, 5)
        for turn in rng.sample(range(n), rng.randint(1, n)):
            water = rng.choice([0, 0, 1])
            bands = [rng.choice([-1, 0, 7, -(1 << 31), (1 << 31) - 2]) for _ in range(3)]
            lead = rng.choice([-9999.0, -3.5, 12.25])
            data.append((x, ORIGIN + timedelta(days=turn), turn, n, days, *([-1, -1, -1, -9999.0] if water else [*bands, lead]), water))
    df = spark.createDataFrame(data, "x int, ts timestamp_ntz, turn long, n_times long, days int, bs int, pv int, npv int, TCW float, water int")
    got = sorted(map(tuple, T.composite_either(df, ["x"], ND).collect()))
    parts = T.average_over_day(df.filter("days < 2"), ["x"], ND), T.composite_first_valid(df.filter("days > 1"), ["x"], ND)
    assert got == sorted(tuple(float(v) if v is not None else v for v in r) for p in parts for r in p.select("x", *ND, "water").collect())
    wide = df.withColumns({b: F.col(b).cast("double") for b in ("bs", "pv", "npv")})
    assert len(got) == 120 and got == sorted(map(tuple, T.composite_either(wide, ["x"], ND).collect()))


def test_turns_count_from_the_anchor(spark):
    df = frame(spark, {1: [0, 25, 50, 10 * 86400, 10 * 86400 + 5], 2: [0, 86400 * 3]})
    got = sorted((r["poly_id"], r["ts"], r["turn"]) for r in T.anchored_windows(df, 7, turns=True).collect())
    assert [t for _, _, t in got] == [0, 1, 2, 0, 1, 0, 1]
