"""Queries that SQL does not check, run whole over small tables, with what must hold of their rows."""

from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("waymark.llm")

from waymark.llm import langid, queries  # noqa: E402

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def test_every_query_without_sql_is_here():
    assert set(queries.QUERIES) - set(queries.SQL) == {"p2_typical", "p8_containers", "p8_fill", "p9_documents", "p9_shares", "p10_found", "p10_segments", "p10_lettered"}


def test_clusters_describe_their_members(spark):
    members = {}
    for r in rows(spark, "p2_found"):
        members.setdefault(r["venue_a"], {r["venue_a"]}).add(r["venue_b"])
    found = rows(spark, "p2_typical")
    assert {r["cluster"]: r["items"] for r in found} == {k: len(v) for k, v in members.items()}
    for r in found:
        assert 1 <= len(r["typical"]) <= 3 and set(r["typical"]) <= members[r["cluster"]] and 1 <= r["densest"] <= r["rows"]


def test_containers_are_filled_without_overlap(spark):
    fill = {}
    for r in rows(spark, "p8_containers"):
        fill.setdefault(r["container"], []).append((r["start"], r["tokens"]))
        assert r["certificate"] in {"full", "bound", "kept", "single", "no gain"}
    for parts in fill.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at <= queries.CAPACITY
    total = rows(spark, "p8_fill")[0]
    assert total["containers"] == len(fill) and total["least_containers"] <= len(fill) and total["fullest"] <= queries.CAPACITY


def test_mixture_matches_its_shares(spark):
    taken, copies = Counter(), Counter()
    for r in rows(spark, "p9_documents"):
        taken[r["source"]] += r["tokens"] * r["copies"]
        copies[r["source"]] = max(copies[r["source"]], r["copies"])
    shares = rows(spark, "p9_shares")
    assert {r["source"]: r["taken"] for r in shares if r["taken"]} == dict(taken)
    assert all(r["most_copies"] == copies[r["source"]] for r in shares)
    assert sum(r["share"] for r in shares) == pytest.approx(1, abs=1e-4)


def test_languages_fit_together(spark):
    known = {code for code, *_ in langid.LANGUAGES}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    per = {}
    for r in rows(spark, "p10_segments"):
        assert r["lang"] in known and 0 < r["confidence"] <= 1 and 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])
        per.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["lang"]))
    for spans in per.values():
        spans.sort()
        assert all(a[1] <= b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))
    # whatever has letters outside links, tags and markup has a language
    assert {k for k, t in texts.items() if t and langid.pieces(t)} == set(per) == {r["doc_id"] for r in rows(spark, "p10_lettered")}
    assert {(r["doc_id"], r["lang"]) for r in rows(spark, "p10_found")} <= {(k, lang) for k, spans in per.items() for *_, lang in spans}
