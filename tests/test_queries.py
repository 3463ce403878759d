"""Queries that SQL does not check, run whole over the smallest tables, with what must hold of their rows."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CHECKS = {
    "time_patterns": lambda rows: {r["pattern"] for r in rows} <= set(range(5)),
    "feature_components": lambda rows: all(len(r["p"]) == 2 for r in rows),
    "venue_features_built": lambda rows: all(len(r["f"]) == 31 for r in rows),
    "venue_cluster_numbers": lambda rows: [r["k"] for r in rows] == list(range(3, 16)),
    "tag_topics": lambda rows: all(r["weight"] >= 0 for r in rows),
    "learned_weights": lambda rows: all(abs(sum(x * x for x in r["theta"]) - 1) < 1e-3 for r in rows),
    "cluster_kmeans_distance": lambda rows: all(r["distance"] >= 0 for r in rows),
    "gold_region_emd": lambda rows: all(0 <= r["partial"] <= r["distance"] + 1e-6 for r in rows),
    "gold_region_metrics": lambda rows: all(r["distance"] >= 0 for r in rows),
    "region_circle_search": lambda rows: all(1 <= r["rank"] <= 5 and r["distance"] >= 0 for r in rows),
    "region_search": lambda rows: all(len(set(r["venues"])) == len(r["venues"]) >= 5 for r in rows),
    "greedy_venues": lambda rows: len({(r["district"], r["venue"]) for r in rows}) == len(rows),
    "spatial_scan_merged": lambda rows: all(1 <= r["parts"] <= 3 for r in rows),
    "tags_of_centre": lambda rows: True,
    "tags_by_area": lambda rows: all(0 <= r["area_x"] < 10 and 0 <= r["area_y"] < 10 for r in rows),
    "discrepancy_seeds": lambda rows: all(r["size"] > 0 for r in rows),
    "density_seeds": lambda rows: all(0 < r["core"] <= r["spots"] for r in rows),
}


def test_every_query_without_sql_has_a_check():
    without = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("p")}
    assert without == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, name):
    assert CHECKS[name](entry.queries()[name](spark, DATA).collect())
