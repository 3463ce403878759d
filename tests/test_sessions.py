from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from waymark.operators.sessions import sessions

SCHEMA = "_id string, uid string, at timestamp_ntz, start_us string"
T0 = datetime(2014, 3, 9, 1, 30)  # the night of a clock change in some zones


def run(spark, rows, gap=7200, record="_id"):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = sessions(df, ["uid"], "at", gap, record=record).collect()
    return sorted((r["uid"], r["session_no"], r["start_us"] // 10**6, r["end_us"] // 10**6, r["records"]) for r in out)


def seconds(t):
    return int((t - datetime(1970, 1, 1)).total_seconds())


def brute(rows, gap=7200):
    out, users = [], {}
    for i, u, t in {(i, u, t) for i, u, t in rows if i is not None and u is not None and t is not None}:
        users.setdefault(u, []).append(t)
    for u, ts in users.items():
        ts.sort()
        runs = [[ts[0]]]
        for a, b in zip(ts, ts[1:]):
            if (b - a).total_seconds() > gap:
                runs.append([])
            runs[-1].append(b)
        out += [(u, k + 1, seconds(r[0]), seconds(r[-1]), len(r)) for k, r in enumerate(runs)]
    return sorted(out)


def test_limits_ties_nulls_and_repeats(spark):
    rows = [
        ("a", "u", T0), ("a", "u", T0), ("b", "u", T0), ("c", "u", T0 + timedelta(seconds=7200)),
        ("d", "u", T0 + timedelta(seconds=14401)), ("e", None, T0), ("f", "u", None), (None, "u", T0),
        ("g", "", T0), ("h", "v", datetime(1969, 12, 31, 23, 0)),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert ("u", 1, seconds(T0), seconds(T0) + 7200, 3) in got
    assert ("u", 2, seconds(T0) + 14401, seconds(T0) + 14401, 1) in got


def test_without_record_each_row_counts(spark):
    rows = [("a", "u", T0), ("a", "u", T0)]
    assert run(spark, rows, record=None)[0][-1] == 2


def test_empty(spark):
    assert run(spark, []) == []


def test_zero_gap(spark):
    rows = [("a", "u", T0), ("b", "u", T0), ("c", "u", T0 + timedelta(microseconds=1))]
    assert [r[-1] for r in run(spark, rows, gap=0)] == [2, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["u", "v", None]), st.integers(0, 60_000)), max_size=60))
def test_as_brute_force(spark, rows):
    rows = [(str(i), u, T0 + timedelta(seconds=s)) for i, u, s in rows]
    assert run(spark, rows) == brute(rows)
