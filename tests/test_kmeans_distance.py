import numpy as np

from waymark.plans import matching


def test_all_vectors_count_with_their_weights(spark):
    middles = np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0]])
    rows = [(c, f"{c}{j}{i}", (m + [i, 0]).tolist(), [1.0, 3.0][i % 2]) for c in "ab" for j, m in enumerate(middles) for i in range(2)]
    df = spark.createDataFrame([*rows, ("few", "x", [0.0, 0.0], 1.0)], "city string, id string, v array<double>, w double")
    got = matching.kmeans_centroids(df, tries=40)
    assert set(got) <= {"a", "b"} and got
    spread = [c for c in got.values() if np.allclose(sorted(map(tuple, c)), sorted(map(tuple, middles + [0.75, 0])))]
    one = matching.kmeans_centroids(df.where("city = 'a'"), k=1)["a"]
    assert np.allclose(one, [[50 / 3 + 0.75, 50 / 3]]) and (spread or len(got["a"]) == 3)
