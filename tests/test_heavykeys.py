import math
import random
from collections import Counter

from waymark.operators import heavykeys as hk


def test_profile_percentiles_and_share_as_brute_force(spark):
    rng = random.Random(6)
    rows = [("hot", rng.choice([None, *range(50)])) for _ in range(600)] + [("cold", 7), ("cold", 7), ("tie", 2), ("tie", 1), ("empty", None), (None, 3)]
    df = spark.createDataFrame([(k, v, "c", 1) for k, v in rows], "k string, v int, n string, value int")
    freq = hk.compress(df, ["k"], "v")
    prof = {r["k"]: r for r in hk.profile(freq, ["k"]).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        have = Counter(v for v in vs if v is not None)
        r = prof[k]
        assert r["records"] == len(vs) and r["distinct_values"] == len(have)
        mode = min(have.items(), key=lambda x: (-x[1], x[0]), default=(None, None))
        assert (r["mode"], r["mode_n"]) == mode
    got = {(r["k"], r["fraction"]): r["value"] for r in hk.percentiles(freq, ["k"], [0.0, 0.25, 0.5, 1.0], buckets=8).collect()}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        for f in (0.0, 0.25, 0.5, 1.0):
            if vs and k is not None:
                assert got[(k, f)] == vs[max(1, math.ceil(f * len(vs))) - 1]
    assert ("empty", 0.5) not in got


def test_heavy_exactly_on_the_limit(spark):
    rows = [("f", "a", 1)] * 2 + [("f", "b", 1)] + [("f", f"x{i}", 1) for i in range(97)]
    df = spark.createDataFrame(rows, "field string, key string, v int")
    prof = hk.profile(hk.compress(df, ["field", "key"], "v"), ["field", "key"])
    assert {r["key"] for r in hk.heavy(prof, "field", {"f": 2}).collect()} == {"a"}
    assert hk.heavy(prof, "field", {"g": 2}).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v int")
    freq = hk.compress(df, ["k"], "v")
    assert hk.profile(freq, ["k"]).count() == 0 and hk.percentiles(freq, ["k"], [0.5]).count() == 0


def test_percentiles_of_many_keys_and_long_tails(spark, monkeypatch):
    import math
    import random

    monkeypatch.setattr(hk, "BROADCAST_KEYS", 1)
    rng = random.Random(3)
    rows = [(k, math.exp(rng.gauss(0, 6))) for k in "abc" for _ in range(200)] + [("hot", 1.0)] * 300 + [("hot", 5.0)]
    freq = hk.compress(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    got = {(r["k"], r["fraction"]): r["value"] for r in hk.percentiles(freq, ["k"], [0.0, 0.1, 0.5, 0.9, 1.0], buckets=8).collect()}
    for k in ("a", "b", "c", "hot"):
        own = sorted(v for x, v in rows if x == k)
        assert {f: got[k, f] for f in (0.0, 0.1, 0.5, 0.9, 1.0)} == {f: own[max(1, math.ceil(round(f * len(own), 9))) - 1] for f in (0.0, 0.1, 0.5, 0.9, 1.0)}
