"""Drift with state: equal to a plain loop over closed days, across files, restarts and repeated batches."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.streaming import drift as W
from credence.streaming import feedback as S

START = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
BAD = lambda: F.col("event_type") == "error"


def made(seed=3):
    """Events of six users: steady, worsening, with gaps, and one without an id; some with no time."""
    rng = np.random.default_rng(seed)
    rows = []
    for user, days, share in [(1, range(20), 0.2), (2, range(20), 0.7), (3, [0, 1, 2, 9, 10, 19], 0.3), (4, [0, 3, 7, 8, 12], 0.0), (5, [19], 1.0), (None, range(0, 20, 2), 0.5)]:
        for day in days:
            for _ in range(int(rng.integers(1, 6))):
                ts = START + dt.timedelta(days=int(day), seconds=int(rng.integers(0, 86400)))
                rows.append((len(rows), ts, user, "error" if rng.random() < share else "view", 1.0, "{}"))
    return sorted(rows, key=lambda r: r[1])


def expected(rows, usual, odds=2.0, limit=3.0, quiet=3):
    """The same by a loop over the days that the watermark has passed."""
    up, down = round(1e6 * (math.log(odds) - math.log(1 + (odds - 1) * usual))), round(-1e6 * math.log(1 + (odds - 1) * usual))
    mark, out = max(r[1] for r in rows) - dt.timedelta(days=1), []
    for user in {r[2] for r in rows}:
        days = {}
        for r in rows:
            if r[2] == user:
                n, bad = days.get(r[1].date(), (0, 0))
                days[r[1].date()] = (n + 1, bad + (r[3] == "error"))
        at = lambda d: dt.datetime.combine(d, dt.time())
        closed = sorted(d for d in days if at(d) + dt.timedelta(days=1) <= mark)
        score = 0
        for i, d in enumerate(closed):
            n, bad = days[d]
            score = max(0, score + bad * up + (n - bad) * down)
            out.append((user, at(d), n, bad, score, "alarm" if score > limit * 1e6 else "steady"))
            score = 0 if score > limit * 1e6 else score
            end, after = at(d) + dt.timedelta(days=1), at(closed[i + 1]) if i + 1 < len(closed) else mark
            if after - end >= dt.timedelta(days=quiet):
                out.append((user, end, 0, 0, score, "silent"))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["user_id"], r["day"], r["n"], r["bad"], round(r["score"] * 1e6), r["state"]) for r in df.collect()), key=str)


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, events, folder):
    return W.resumed(W.cusum(S.event_stream(spark, events), "user_id", BAD(), 0.2), folder)


@pytest.fixture(scope="module")
def rows():
    return made()


def test_restarts_and_repeated_batches(spark, rows, tmp_path):
    events, folder = str(tmp_path / "events"), str(tmp_path / "run")
    for k in range(3):  # three stretches of time, each taken up from the checkpoint
        put(spark, rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], events)
        table = run(spark, events, folder)
        assert got(table) == expected(rows[: (k + 1) * len(rows) // 3], 0.2)
    want = got(table)
    assert {"steady", "alarm", "silent"} == {r[-1] for r in want}
    number = max(int(f) for f in os.listdir(f"{folder}/state/commits") if f.isdigit())
    for f in (str(number), f".{number}.crc"):  # as if the run had ended before the last batch was noted as done
        if os.path.exists(f"{folder}/state/commits/{f}"):
            os.remove(f"{folder}/state/commits/{f}")
    assert got(run(spark, events, folder)) == want


def test_one_batch_equals_many(spark, rows, tmp_path):
    events = str(tmp_path / "events")
    put(spark, rows + [(10**6, None, 1, "error", 1.0, "{}")], events)  # an event without a time is left out
    assert got(run(spark, events, str(tmp_path / "run"))) == expected(rows, 0.2)


def test_no_events(spark, tmp_path):
    put(spark, [], str(tmp_path / "events"))
    assert run(spark, str(tmp_path / "events"), str(tmp_path / "run")).count() == 0


def test_usual_share_and_steps(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    early = [r for r in rows if r[1] < START + dt.timedelta(days=7)]
    assert W.usual_share(df, BAD()) == pytest.approx(sum(r[3] == "error" for r in early) / len(early))
    assert W.usual_share(df.limit(0), BAD()) == 0.0
    up, down = W.steps(0.2, 2.0)
    assert (up, down) == (round(1e6 * math.log(2 / 1.2)), round(-1e6 * math.log(1.2)))
    assert 0.2 * up + 0.8 * down < 0 < (1 / 3) * up + (2 / 3) * down  # falls at the usual share, climbs at the raised one
