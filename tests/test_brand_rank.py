import numpy as np

from waymark.operators import knn


def test_first_same_beyond_any_cap(spark):
    rng = np.random.default_rng(3)
    side = lambda n, p: [(p + str(i), int(i % 2), ["a", "b", "c", None][int(rng.integers(4)) if i % 9 else 2], rng.integers(0, 3, 4).astype(float).tolist()) for i in range(n)]
    q = [*side(40, "q"), ("qz", 0, "rare", [0.0] * 4)]
    t = [*side(150, "t"), ("tz", 0, "rare", [9.0] * 4)]
    dfs = [spark.createDataFrame(x, "id string, g int, brand string, v array<double>") for x in (q, t)]
    got = {r["q"]: (r["first"], r["size"]) for r in knn.first_same(*dfs, ["g"], "brand", 7, 30).collect()}
    want = {}
    for i, g, brand, v in q:
        near = sorted((round(float(np.linalg.norm(np.array(v) - w)), 9), j, other) for j, h, other, w in t if h == g)
        hits = [k for k, (_, _, other) in enumerate(near, 1) if other == brand and brand]
        if hits:
            want[i] = (hits[0], len(near))
    assert got == want and got["qz"][0] == got["qz"][1] > 20
