"""Queries on venue features, nearest neighbours and regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import local_xy
from waymark.functions.stats import jensen_shannon
from waymark.functions.text import letters
from waymark.lineage import cut
from waymark.operators import features as ft
from waymark.operators import grids, knn, learning, proximity, regions, scan, transport
from waymark.operators.profiles import score_table
from waymark.plans.common import L, places, with_
from waymark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
FROM, TO = "vellmare", "santorvo"
# The gain of a neighbour of the same top category but another category.
HALF_GAIN = 0.3195079


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _features(spark: SparkSession, d: str) -> DataFrame:
    return ft.cleaned(table(spark, d, "venue_feature"), letters(F.col("city")), "venue_id", "f")


def _z(spark: SparkSession, d: str) -> DataFrame:
    return ft.standardised(_features(spark, d))


_F = """f0 as (select nullif(regexp_replace(lower(city), '[^a-z]', '', 'g'), '') as city, venue_id as venue, list_transform(f, lambda x: case when x is null or isnan(x) or isinf(x) then 0.0 else x end) as f
  from venue_feature where len(f) = 31 and venue_id is not null),
ff as (select city, venue, min(f) as f from f0 where city is not null group by city, venue)"""
_Z = _F + """,
u as (select city, venue, cast(f[6] as bigint) as sub, cast(floor(f[6] / 100000) as bigint) as top, i - 1 as dim, case when i <= 3 then case when f[i] > 0 then ln(f[i]) else 0 end else f[i] end as x from ff, range(1, 32) r(i) where i <> 6),
s as (select city, dim, avg(x) as m, stddev_pop(x) as s from u group by city, dim),
z as (select u.city, venue, sub, top, u.dim, case when u.dim = 17 then x when s > 1e-12 then (x - m) / s else 0 end as z from u join s on s.city = u.city and s.dim = u.dim),
w as materialized (select city, venue, sub, top, list(z order by dim) as v from z group by city, venue, sub, top)"""


@query(with_(_Z) + "select city, venue, cast(dim as int) as dim, round(z, 4) as z from z")
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    dims = F.array(*[F.lit(i) for i in ft.MEASURES])
    rows = _z(spark, d).select("city", "venue", F.posexplode("z").alias("k", "z"))
    return rows.select("city", "venue", F.get(dims, F.col("k")).alias("dim"), F.round("z", 4).alias("z"))


@query(with_(_F) + """, u as (select city, i - 1 as dim, f[i] as x from ff, range(1, 32) r(i) where i <> 6), s as (select dim, min(x) as lo, max(x) as hi from u group by dim),
b as (select city, dim, case when hi > lo then least(floor((x - lo) / (hi - lo) * 10), 9) else 9 end as bin, count(*) as n from u join s using (dim) group by all),
p as (select city, dim, bin, n / sum(n) over (partition by city, dim) as p from b), c as (select distinct city from p),
k as (select a.city as city_a, e.city as city_b, dim, bin from c a join c e on a.city < e.city, (select distinct dim, bin from p)),
j as (select city_a, city_b, k.dim, coalesce(a.p, 0) as p, coalesce(e.p, 0) as q from k left join p a on a.city = city_a and a.dim = k.dim and a.bin = k.bin left join p e on e.city = city_b and e.dim = k.dim and e.bin = k.bin),
r as (select city_a, city_b, sum(case when p + q > 0 then -(p + q) / 2 * ln((p + q) / 2) else 0 end) - (sum(case when p > 0 then -p * ln(p) else 0 end) + sum(case when q > 0 then -q * ln(q) else 0 end)) / 2 as d from j group by city_a, city_b)
select city_a, city_b, round(d, 6) as jsd from r""")
def feature_histogram_jsd(spark: SparkSession, d: str) -> DataFrame:
    """Sum over the features of the divergence of two cities' histograms (20 cities)."""
    rows = _features(spark, d).select("city", F.filter("f", lambda x, i: i != ft.CATEGORY).alias("v"))
    p = ft.histogram(rows, ["city"], "v")
    side = lambda n: p.select(F.col("city").alias(f"city_{n}"), F.col("p").alias(f"p{n}"), "dim", "bin")
    cities = p.select("city").distinct()
    a = cities.select(F.col("city").alias("city_a"))
    pairs = a.join(cities.select(F.col("city").alias("city_b")), F.col("city_a") < F.col("city_b"))
    every = pairs.join(F.broadcast(p.select("dim", "bin").distinct()))
    both = every.join(side("a"), ["city_a", "dim", "bin"], "left").join(side("b"), ["city_b", "dim", "bin"], "left").fillna(0.0, ["pa", "pb"])
    return both.groupBy("city_a", "city_b").agg(F.round(jensen_shannon(F.col("pa"), F.col("pb")), 6).alias("jsd"))


@query(with_(_F) + """, u as (select venue || city as k, i - 1 as dim, f[i] as x from ff, range(1, 32) r(i) where i <> 6),
c as (select a.dim as a, b.dim as b, corr(a.x, b.x) as r from u a join u b on a.k = b.k and a.dim < b.dim group by a.dim, b.dim)
select cast(a as int) as a, cast(b as int) as b, round(r, 6) as r from c where abs(r) > 0.3""")
def correlation_screen(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of features whose correlation exceeds 0.3, from one pass of sums."""
    rows = _features(spark, d).select(F.filter("f", lambda x, i: i != ft.CATEGORY).alias("v"))
    n, s, cross = ft.moments(rows, "v", len(ft.MEASURES))
    cov = cross / max(n, 1) - np.outer(s, s) / max(n, 1) ** 2
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    out = []
    for i in range(len(dev)):
        for j in range(i + 1, len(dev)):
            if dev[i] > 0 and dev[j] > 0 and abs(r := cov[i, j] / dev[i] / dev[j]) > 0.3:
                out.append((ft.MEASURES[i], ft.MEASURES[j], float(r)))
    return spark.createDataFrame(out, "a int, b int, r double").withColumn("r", F.round("r", 6))


@query(with_(_F) + """, u as (select venue || city as k, i - 1 as dim, f[i] as x from ff, range(1, 6) r(i)), s as (select dim, min(x) as lo, max(x) as hi from u group by dim),
b as (select k, dim, case when hi > lo then least(floor((x - lo) / (hi - lo) * 10), 9) else 9 end as bin from u join s using (dim)),
j as (select a.dim as da, b.dim as db, a.bin as a, b.bin as b, count(*) as n from b a join b b on a.k = b.k and a.dim < b.dim group by all),
t as (select *, sum(n) over (partition by da, db) as t, sum(n) over (partition by da, db, a) as na, sum(n) over (partition by da, db, b) as nb from j),
h as (select da, db, sum(n / t * ln(n * t / (na * nb))) as i from t group by da, db),
ha as (select da, db, sum(-na / t * ln(na / t)) as h from (select distinct da, db, a, na, t from t) group by da, db), hb as (select da, db, sum(-nb / t * ln(nb / t)) as h from (select distinct da, db, b, nb, t from t) group by da, db)
select cast(da as int) as dim_a, cast(db as int) as dim_b, round(coalesce(i / nullif(sqrt(ha.h * hb.h), 0), 0), 6) as mi from h join ha using (da, db) join hb using (da, db)""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """Normalised mutual information of the five leading features."""
    rows = _features(spark, d).select(F.slice("f", 1, 5).alias("v"))
    lo_hi = rows.agg(*[F.min(F.get("v", i)).alias(f"lo{i}") for i in range(5)], *[F.max(F.get("v", i)).alias(f"hi{i}") for i in range(5)])
    x = rows.join(F.broadcast(lo_hi))
    bins = []
    for i in range(5):
        span = F.col(f"hi{i}") - F.col(f"lo{i}")
        bins.append(F.when(span > 0, F.least(F.floor((F.get("v", i) - F.col(f"lo{i}")) / span * 10), F.lit(9))).otherwise(9))
    pairs = F.array(*[F.struct(F.lit(i).alias("dim_a"), F.lit(j).alias("dim_b"), bins[i].alias("a"), bins[j].alias("b")) for i in range(5) for j in range(i + 1, 5)])
    out = ft.mutual_information(x.select(F.inline(pairs)), ["dim_a", "dim_b"])
    return out.withColumn("mi", F.round("mi", 6))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    z = _z(spark, d).withColumnsRenamed({"venue": "id", "z": "v"})
    return z.where(F.col("city") == FROM), z.where(F.col("city") == TO)


_K = with_(_Z) + f""", q as (select * from w where city = '{FROM}'), t as (select * from w where city = '{TO}'),
k as (select q.venue as q, t.venue as t, q.top, q.v as qv, t.v as tv, round(list_distance(q.v, t.v), 9) as distance, row_number() over (partition by q.venue order by round(list_distance(q.v, t.v), 9), t.venue) as rank from q join t on t.top = q.top)
"""


@query(_K + "select q, t, cast(rank as int) as rank, round(distance, 4) as distance from k where rank <= 5")
def knn_within_category(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest venues of the other city in the same top category."""
    a, b = _sides(spark, d)
    return knn.nearest(a.select("top", "id", "v"), b.select("top", "id", "v"), ["top"], 5).select("q", "t", "rank", F.round("distance", 4).alias("distance"))


@query(_K + """, sq as (select q, t, i as dim, (qv[i] - tv[i]) * (qv[i] - tv[i]) as d from k, range(1, 31) r(i) where rank = 1)
select q, t, cast(dim - 1 as int) as dim, round(coalesce(100 * d / nullif(sum(d) over (partition by q, t), 0), 0), 3) as percent from sq""")
def knn_explain(spark: SparkSession, d: str) -> DataFrame:
    """What each feature contributes to the distance from the nearest venue."""
    a, b = _sides(spark, d)
    near = knn.nearest(a.select("top", "id", "v"), b.select("top", "id", "v"), ["top"], 1)
    return knn.explained(near, a, b).withColumn("percent", F.round("percent", 3))


@query(_K + "select t, round(min(distance), 4) as distance from k where rank <= 2 group by t order by min(distance), t limit 300")
def knn_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 300 nearest of all neighbours found, each at its smallest distance."""
    a, b = _sides(spark, d)
    near = knn.nearest(a.select("top", "id", "v"), b.select("top", "id", "v"), ["top"], 2)
    return knn.candidates(near, 1, 300, 300).withColumn("distance", F.round("distance", 4))


@query("with recursive " + with_(_Z)[5:] + f""", o as materialized (select * from w where city = '{FROM}'), e as materialized (select * from w where city = '{TO}'),
f as materialized (select q.venue as q, t.venue as t, q.sub = t.sub as same, round(list_distance(q.v, t.v), 9) as d, row_number() over (partition by q.venue order by round(list_distance(q.v, t.v), 9), t.venue) as k, count(*) over (partition by q.venue) as size from o q join e t on t.top = q.top),
b as materialized (select q.venue as q, t.venue as t, q.sub = t.sub as same, round(list_distance(q.v, t.v), 9) as d, row_number() over (partition by q.venue order by round(list_distance(q.v, t.v), 9), t.venue) as k, count(*) over (partition by q.venue) as size from e q join o t on t.top = q.top),
h as materialized (select 1 as odd, * from f where k = 1 union all select 0, * from b where k = 1),
x as (select venue as start, venue as at, [venue] as path, 0 as step, cast(0 as double) as s, cast(1000000000 as bigint) as size, 0 as matched, false as closed from o
 union all select start, h.t, list_append(path, h.t), step + 1, s + h.d, least(x.size, h.size), matched + cast(h.same as int), list_contains(path, h.t) from x join h on h.q = x.at and h.odd = (step + 1) % 2 where not closed)
select start, step as steps, round(s / step, 4) as length, size, matched from x where closed""")
def nn_loops(spark: SparkSession, d: str) -> DataFrame:
    """Walks along nearest neighbours of one category between two cities until a venue comes again."""
    sides = _sides(spark, d)

    def hop(q: DataFrame, t: DataFrame) -> DataFrame:
        near = knn.nearest(q.select("top", "id", "v"), t.select("top", "id", "v"), ["top"], 1)
        size = t.groupBy("top").agg(F.count(F.lit(1)).alias("size"))
        both = near.join(size, "top").join(q.select(F.col("id").alias("q"), F.col("sub").alias("a")), "q").join(t.select(F.col("id").alias("t"), F.col("sub").alias("b")), "t")
        return both.select("q", "t", "distance", "size", (F.col("a") == F.col("b")).alias("same"))

    return knn.loops(hop(*sides), hop(*sides[::-1])).withColumn("length", F.round("length", 4))


@query(with_(_Z) + f""", q as (select * from w where city = '{FROM}'), t as (select * from w where city = '{TO}'),
k as (select q.venue as q, q.sub, q.top, t.sub as tsub, t.top as ttop, row_number() over (partition by q.venue order by round(list_distance(q.v, t.v), 9), t.venue) as rank from q, t),
g as (select q, sub, top, sum(case when sub = tsub then 1.0 when top = ttop then {HALF_GAIN} else 0 end / log2(rank + 1)) as dcg from k where rank <= 5 group by q, sub, top),
c as (select g.*, (select count(*) from t where t.sub = g.sub) as ns, (select count(*) from t where t.top = g.top and t.sub <> g.sub) as nt from g),
i as (select c.*, (select sum(case when r <= ns then 1.0 when r <= ns + nt then {HALF_GAIN} else 0 end / log2(r + 1)) from range(1, 6) x(r)) as ideal from c)
select q, round(coalesce(dcg / nullif(ideal, 0), 0), 6) as ndcg from i""")
def ndcg_labels(spark: SparkSession, d: str) -> DataFrame:
    """How well the five nearest venues keep the category: full gain for the same one, a part for the same top category."""
    a, b = _sides(spark, d)
    one = lambda x: x.select(F.lit(1).alias("g"), "id", "v")
    near = knn.nearest(one(a), one(b), ["g"], 5)
    x = near.join(a.select(F.col("id").alias("q"), "sub", "top"), "q").join(b.select(F.col("id").alias("t"), F.col("sub").alias("tsub"), F.col("top").alias("ttop")), "t")
    rel = F.when(F.col("sub") == F.col("tsub"), 1.0).when(F.col("top") == F.col("ttop"), HALF_GAIN).otherwise(0.0)
    got = x.groupBy("q", "sub", "top").agg(F.sum(knn.gain(rel, F.col("rank"))).alias("dcg"))
    subs = b.groupBy("sub").agg(F.count(F.lit(1)).alias("ns"))
    tops = b.groupBy("top").agg(F.count(F.lit(1)).alias("nt"))
    got = got.join(subs, "sub", "left").join(tops, "top", "left").fillna(0, ["ns", "nt"])
    ideal = sum((knn.gain(F.when(F.col("ns") >= r, 1.0).when(F.col("nt") >= r, HALF_GAIN).otherwise(0.0), F.lit(r)) for r in range(1, 6)), F.lit(0.0))
    return got.select("q", F.round(F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0)), 6).alias("ndcg"))


@query(_K + """, r as (select k.q, k.rank, case when a.sub = b.sub then 1.0 else 0.5 end as rel from k join w a on a.venue = k.q and a.city = '""" + FROM + """' join w b on b.venue = k.t and b.city = '""" + TO + """' where rank <= 5)
select q, round(sum((pow(2, rel) - 1) / log2(rank + 1)), 6) as dcg, round(sum((rel * rel - 1) / log2(rank + 1)), 6) as square_dcg from r group by q""")
def gains_of_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Both discounted gains of the five nearest venues, relevant by 1 with the same category and by half with the same top category."""
    a, b = _sides(spark, d)
    near = knn.nearest(a.select("top", "id", "v"), b.select("top", "id", "v"), ["top"], 5)
    x = near.join(a.select(F.col("id").alias("q"), F.col("sub").alias("sq")), "q").join(b.select(F.col("id").alias("t"), F.col("sub").alias("st")), "t")
    rel = F.when(F.col("sq") == F.col("st"), 1.0).otherwise(0.5)
    return x.groupBy("q").agg(F.round(regions.dcg(rel, F.col("rank")), 6).alias("dcg"), F.round(regions.square_dcg(rel, F.col("rank")), 6).alias("square_dcg"))


@query(with_(_Z) + f""", c as (select city, top, dim, avg(z) as m from z where top in (1, 2, 3) group by city, top, dim), n as (select city from c group by city having count(distinct top) = 3),
d as (select b.city, a.top as i, b.top as j, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from c a join c b on a.city = '{FROM}' and b.dim = a.dim and b.city in (select city from n) group by b.city, a.top, b.top),
p as (select city, sum(case when i = 1 and j = 1 then d end) as a, sum(case when i = 1 and j = 2 then d end) as b, sum(case when i = 1 and j = 3 then d end) as c, sum(case when i = 2 and j = 1 then d end) as e, sum(case when i = 2 and j = 2 then d end) as f, sum(case when i = 2 and j = 3 then d end) as g,
 sum(case when i = 3 and j = 1 then d end) as h, sum(case when i = 3 and j = 2 then d end) as k, sum(case when i = 3 and j = 3 then d end) as l from d group by city)
select city, round(least(a + f + l, a + g + k, b + e + l, b + g + h, c + e + k, c + f + h) / 3, 6) as distance from p where '{FROM}' in (select city from n)""")
def cluster_centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest assignment of three category centroids of one city to those of every city; see ``cluster_kmeans_distance`` for all venues."""
    z = _z(spark, d).where("top in (1, 2, 3)").select("city", "top", F.posexplode("z").alias("dim", "x"))
    c = z.groupBy("city", "top", "dim").agg(F.avg("x").alias("m"))
    full = c.select("city", "top").distinct().groupBy("city").count().where("count = 3").select("city")
    a = c.join(full, "city", "left_semi").where(F.col("city") == FROM).select(F.col("top").alias("i"), "dim", F.col("m").alias("ma"))
    b = c.join(full, "city", "left_semi").select("city", F.col("top").alias("j"), "dim", F.col("m").alias("mb"))
    cost = b.join(F.broadcast(a), "dim").groupBy("city", "i", "j").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")))).alias("d"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values(["i", "j"])["d"].to_numpy().reshape(3, 3)
        return pd.DataFrame({"city": pdf["city"].iloc[:1], "distance": [transport.best_assignment(m)]})

    return cost.groupBy("city").applyInPandas(assign, "city string, distance double").withColumn("distance", F.round("distance", 6))


def _nearest_centroid(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((v[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)


def kmeans_centroids(rows: DataFrame, k: int = 3, steps: int = 5, tries: int = 5, seed: int = 1) -> dict[str, np.ndarray]:
    """City to (k, dimensions): weighted means of the k clusters of all its vectors; ``rows``: city, id, v, w.

    Clusters are found without weights, in ``steps`` rounds from k vectors with the smallest
    seeded hash; a city with an empty cluster, or one of no weight, is tried again with other seeds and is left out
    after ``tries``. Only sums per city and cluster leave a task.
    """
    rows, done = cut(rows.select("city", "id", "v", F.col("w").cast("double"))), {}

    def sums(centres: dict[str, np.ndarray], weighted: bool) -> dict[str, np.ndarray]:
        def part(batches):
            for b in batches:
                out = []
                for city, own in b[b["city"].isin(list(centres))].groupby("city"):
                    v, w = np.stack(own["v"].to_numpy()), own["w"].to_numpy() if weighted else np.ones(len(own))
                    label = _nearest_centroid(v, centres[city])
                    for c in np.unique(label):
                        mine = label == c
                        out += [(city, int(c), i, float(x)) for i, x in enumerate([w[mine].sum(), *(w[mine, None] * v[mine]).sum(0)])]
                yield pd.DataFrame(out, columns=["city", "c", "i", "x"])

        got = rows.mapInPandas(part, "city string, c int, i int, x double").groupBy("city", "c", "i").agg(F.sum("x").alias("x")).collect()
        every = {city: np.zeros((k, centres[city].shape[1] + 1)) for city in centres}
        for r in got:
            every[r["city"]][r["c"], r["i"]] = r["x"]
        return every

    for n in range(tries):
        order = Window.partitionBy("city").orderBy(F.xxhash64(F.lit(seed + n), F.col("id")), "id")
        first = rows.where(~F.col("city").isin(list(done))).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).collect()
        by: dict[str, list] = {}
        for r in sorted(first, key=lambda r: (r["city"], r["_k"])):
            by.setdefault(r["city"], []).append(r["v"])
        centres = {c: np.array(v) for c, v in by.items() if len(v) == k}
        if not centres:
            break
        for _ in range(steps):
            s = sums(centres, False)
            centres = {c: np.where(s[c][:, :1] > 0, s[c][:, 1:] / np.maximum(s[c][:, :1], 1), m) for c, m in centres.items()}
        s, plain = sums(centres, True), sums(centres, False)
        done |= {c: s[c][:, 1:] / s[c][:, :1] for c in centres if (plain[c][:, 0] > 0).all() and (s[c][:, 0] > 0).all()}
    return done


@query()
def cluster_kmeans_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest assignment of the weighted centroids of three k-means clusters of all venues of one city to those of every city; weights are shares of the scaled fifth root of the venues' users."""
    z = _z(spark, d).select("city", F.col("venue").alias("id"), F.col("z").alias("v"))
    users = _features(spark, d).select("city", F.col("venue").alias("id"), F.get("f", 1).alias("users"))
    weights = transport.venue_weights(users, ["city"], "users").select("city", "id", "w")
    c = kmeans_centroids(z.join(weights, ["city", "id"]))
    if FROM not in c:
        return spark.createDataFrame([], "city string, distance double")
    cost = lambda b: transport.best_assignment(transport.euclidean(c[FROM], b))
    return spark.createDataFrame([(n, round(float(cost(b)), 6)) for n, b in sorted(c.items())], "city string, distance double")


@query(with_(_F) + """, u as (select city, venue, pow(greatest(f[2], 0), 0.2) as u from ff), b as (select city, min(u) as lo, sum(u) as s, count(*) as n from u group by city)
select city, venue, round(greatest(coalesce((u - lo) / nullif(s - n * lo, 0), 0), 1e-6), 9) as w from u join b using (city)""")
def venue_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of each venue in its city by the fifth root of its users."""
    users = _features(spark, d).select("city", "venue", F.get("f", 1).alias("users"))
    return transport.venue_weights(users, ["city"], "users").select("city", "venue", F.round("w", 9).alias("w"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(region, district, venue, z) of the venues in each gold region that have features."""
    gold = table(spark, d, "gold_region").select(F.concat_ws("/", "district", "city", "region_no").alias("region"), "ring")
    points = places(spark, d, "lng", "lat").select("id", "lng", "lat")
    found = proximity.points_in_regions(points, gold).select("region", F.col("id").alias("venue"))
    return found.distinct().join(_z(spark, d).select("venue", F.col("z").alias("v")), "venue").withColumn("district", F.split_part("region", F.lit("/"), F.lit(1)))


@query(with_(_F) + """, g as (select concat_ws('/', district, city, region_no) as region, ring from gold_region), e as (select region, unnest(ring) as p, unnest(list_concat([ring[len(ring)]], ring[1:len(ring)-1])) as q from g),
l as (select distinct _id as id, loc.lng as x, loc.lat as y from venue where loc.lng is not null),
h as (select region, id, x, y, sum(case when ((q.lat > y) <> (p.lat > y)) and x < (p.lng - q.lng) * (y - q.lat) / (p.lat - q.lat) + q.lng then 1 else 0 end) as k from l, e group by region, id, x, y)
select region, count(distinct id) as venues, count(distinct venue) as described from h left join ff on ff.venue = h.id where k % 2 = 1 group by region""")
def gold_region_venues(spark: SparkSession, d: str) -> DataFrame:
    """Venues of each gold region, and how many of them have features."""
    gold = table(spark, d, "gold_region").select(F.concat_ws("/", "district", "city", "region_no").alias("region"), "ring")
    found = proximity.points_in_regions(places(spark, d, "lng", "lat"), gold).select("region", "id").distinct()
    known = _features(spark, d).select(F.col("venue").alias("id"), F.lit(1).alias("k")).distinct()
    return found.join(known, "id", "left").groupBy("region").agg(F.count(F.lit(1)).alias("venues"), F.count("k").alias("described"))


@query("with recursive " + """g as (select concat_ws('/', district, city, region_no) as region, ring from gold_region), e as (select region, unnest(ring) as p, unnest(list_concat([ring[len(ring)]], ring[1:len(ring)-1])) as q from g),
l as (select distinct _id as id, loc.lng as x, loc.lat as y from venue where _id is not null and loc.lng between -180 and 180 and loc.lat between -90 and 90),
h as (select region, id, sum(case when ((q.lat > y) <> (p.lat > y)) and x < (p.lng - q.lng) * (y - q.lat) / (p.lat - q.lat) + q.lng then 1 else 0 end) as k from l, e group by region, id, x, y),
i as materialized (select distinct region, id from h where k % 2 = 1), t as materialized (select distinct a.region as a, b.region as b from i a join i b using (id)),
w as (select a as region, b as other from t union select w.region, t.b from w join t on t.a = w.other),
m as materialized (select region, min(other) as part from w group by region)
select part, count(distinct region) as shapes, count(distinct id) as points from i join m using (region) group by part""")
def joined_regions(spark: SparkSession, d: str) -> DataFrame:
    """Gold regions that share venues, of whatever district, made one, with their venues."""
    gold = table(spark, d, "gold_region").select(F.concat_ws("/", "district", "city", "region_no").alias("region"), "ring")
    return regions.joined_shapes(gold, places(spark, d, "lng", "lat").withColumnRenamed("id", "key"))


def _region_pairs(members: DataFrame) -> DataFrame:
    r = members.select("district", "region").distinct()
    a = r.select("district", F.col("region").alias("a"))
    return a.join(r.select("district", F.col("region").alias("b")), "district").where("a < b").select("a", "b")


@query()
def gold_region_emd(spark: SparkSession, d: str) -> DataFrame:
    """Earth mover's distance between the gold regions of each district, and for 0.8 of the mass (about 50 regions)."""
    m = cut(_members(spark, d))
    sets = m.select(F.col("region").alias("set"), "v", F.lit(1.0).alias("w"))
    pairs = _region_pairs(m)
    full = transport.pair_distances(pairs, sets)
    part = transport.pair_distances(pairs, sets, 0.8).withColumnRenamed("distance", "partial")
    return full.join(part, ["a", "b"]).select("a", "b", F.round("distance", 6).alias("distance"), F.round("partial", 6).alias("partial"))


_NEAR_M = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


@query("with recursive " + with_(L)[5:] + f""", q as materialized (select id, lng, lat from l where lng between -180 and 180 and lat between -90 and 90), s as materialized (select lng, lat, count(*) as n from q group by all),
n as materialized (select a.lng as ax, a.lat as ay, b.lng as tx, b.lat as ty, b.n from s a join s b on b.lat between a.lat - 0.002 and a.lat + 0.002 where {_NEAR_M} <= 150),
c as materialized (select ax as x, ay as y from n group by ax, ay having sum(n) >= 8),
e as materialized (select ax, ay, tx, ty from n join c p on p.x = ax and p.y = ay join c r on r.x = tx and r.y = ty),
w as (select x, y, x as cx, y as cy from c union select tx, ty, cx, cy from w join e on ax = x and ay = y),
m as materialized (select x, y, min(struct_pack(x := cx, y := cy)) as label from w group by x, y),
g as (select ax as x, ay as y, min(label) as border from n join m on m.x = tx and m.y = ty group by ax, ay)
select s.lng, s.lat, m.label is not null as core, struct_extract(coalesce(m.label, border), 'x') as cluster_lng, struct_extract(coalesce(m.label, border), 'y') as cluster_lat from s left join m on m.x = s.lng and m.y = s.lat left join g on g.x = s.lng and g.y = s.lat""")
def venue_dbscan(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of venue positions: eight venues within 150 m; a cluster is named by its first core position."""
    found = regions.density_clusters(places(spark, d, "lng", "lat"), 150.0, 8)
    name = F.split("cluster", ",")
    return found.select("lng", "lat", "core", F.get(name, 0).cast("double").alias("cluster_lng"), F.get(name, 1).cast("double").alias("cluster_lat"))


#: The radii of the survey's searches in metres, and the least venues of a circle.
RADII, LEAST_VENUES = (200.0, 275.0, 350.0, 425.0, 500.0), 5
BINS = 10


def _binned(spark: SparkSession, d: str) -> DataFrame:
    """(city, venue, bins): the number of the bin of each feature, dimension times BINS plus bin, between the extremes over all venues."""
    flat = _z(spark, d).select("city", "venue", F.posexplode("z").alias("dim", "x"))
    support = F.broadcast(flat.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    span = F.col("hi") - F.col("lo")
    code = F.col("dim") * BINS + F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo")) / span * BINS), F.lit(BINS - 1))).otherwise(BINS - 1).cast("int")
    return flat.join(support, "dim").select("city", "venue", code.cast("int").alias("bin"))


def _asked(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    """(district, region): the region of each district with at least 20 described venues whose number is nearest to 150, ties by name; without such, the nearest to 150 of all."""
    n = members.groupBy("district", "region").agg(F.count_distinct("venue").alias("n"))
    best = n.groupBy("district").agg(F.min(F.struct((F.col("n") < 20).alias("few"), F.abs(F.col("n") - 150).alias("off"), "region")).alias("b"))
    return best.select("district", F.col("b.region").alias("region"))


def _circle_distances(spark: SparkSession, d: str, theta: list[float] | None = None) -> DataFrame:
    """(district, city, radius, key, lng, lat, venues, distance) of every circle against the asked region of every district.

    The distance is the sum over the features, weighted by ``theta`` (all 1 by default), of the divergence of the circle's and the
    region's histograms. Circles are counted once for all districts; only sums per circle and bin leave a task.
    """
    binned = cut(_binned(spark, d))
    members = cut(_members(spark, d).select("district", "region", "venue").distinct())
    asked = members.join(_asked(spark, d, members), ["district", "region"])
    weight = lambda c: F.lit(1.0) if theta is None else F.get(F.array(*[F.lit(float(t)) for t in theta]), F.floor(F.col(c) / BINS).cast("int"))
    want = asked.join(binned.select("venue", "bin"), "venue").groupBy("district", "bin").agg(F.count(F.lit(1)).alias("w"))
    total = asked.groupBy("district").agg(F.count(F.lit(1)).alias("tw"))
    want = cut(want.join(total, "district").withColumn("q", F.col("w") / F.col("tw")).withColumn("t", weight("bin")))
    mass = want.groupBy("district").agg(F.sum(F.col("q") * F.col("t")).alias("mass"))
    points = cut(binned.join(places(spark, d, "lng", "lat").withColumnRenamed("id", "venue"), "venue").select("lng", "lat", "bin", F.lit(1).alias("n")))
    h = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    out = None
    for radius in RADII:
        centres = cut(proximity.on_shared_tiles(regions.circle_centres(table(spark, d, "city_box"), radius), points, radius))
        sums = cut(proximity.ball_sums(centres, points, radius).select("key", "bin", F.col("near").alias("n")))
        size = sums.where(F.col("bin") < BINS).groupBy("key").agg(F.sum("n").alias("venues")).where(F.col("venues") >= LEAST_VENUES)
        both = sums.join(size, "key").join(F.broadcast(mass)).join(F.broadcast(want.select("district", "bin", "q")), ["district", "bin"], "left")
        p, q = F.col("n") / F.col("venues"), F.coalesce("q", F.lit(0.0))
        # bins of the region that a circle lacks add q ln 2 / 2 each: all its mass less the shared one
        per = both.groupBy("district", "key", "venues", "mass").agg(
            F.sum(weight("bin") * (h((p + q) / 2) - (h(p) + h(q)) / 2)).alias("s"), F.sum(q * weight("bin")).alias("met")
        )
        found = per.withColumn("distance", F.round(F.col("s") + (F.col("mass") - F.col("met")) * (np.log(2) / 2), 6)).join(centres, "key")
        found = found.select("district", "city", F.lit(radius).alias("radius"), "key", "lng", "lat", "venues", "distance")
        out = found if out is None else out.unionByName(found)
    return out


_CIRCLES = with_(_F) + f""", u as (select city, venue, dim, x from (select city, venue, dim, case when dim = 17 then x when s > 1e-12 then (x - m) / s else 0 end as x from (select u.*, avg(x) over (partition by city, dim) as m, stddev_pop(x) over (partition by city, dim) as s
 from (select city, venue, i - 1 as dim, case when i <= 3 then case when f[i] > 0 then ln(f[i]) else 0 end else f[i] end as x from ff, range(1, 32) r(i) where i <> 6) u))),
k as (select distinct dim, dense_rank() over (order by dim) - 1 as k from (select distinct dim from u)), lim as (select dim, min(x) as lo, max(x) as hi from u group by dim),
bn as materialized (select city, venue, k * 10 + case when hi > lo then least(floor((x - lo) / (hi - lo) * 10), 9) else 9 end as bin from u join lim using (dim) join k using (dim)),
loc as (select distinct _id as venue, loc.lng as lng, loc.lat as lat from venue where _id is not null and loc.lng between -180 and 180 and loc.lat between -90 and 90),
g as (select district, concat_ws('/', district, city, region_no) as region, ring from gold_region), e as (select region, unnest(ring) as p, unnest(list_concat([ring[len(ring)]], ring[1:len(ring)-1])) as q from g),
inr as (select region, venue from (select region, venue, sum(case when ((q.lat > lat) <> (p.lat > lat)) and lng < (p.lng - q.lng) * (lat - q.lat) / (p.lat - q.lat) + q.lng then 1 else 0 end) as n from loc, e group by region, venue, lng, lat) where n % 2 = 1),
mem as (select distinct split_part(region, '/', 1) as district, region, venue from inr where venue in (select venue from bn)),
ask as (select district, region from (select district, region, row_number() over (partition by district order by count(*) < 20, abs(count(*) - 150), region) as r from mem group by district, region) where r = 1),
wn as (select district, bin, count(*) as w from mem join ask using (district, region) join bn using (venue) group by district, bin), tw as (select district, count(*) as tw from mem join ask using (district, region) group by district),
rad as (select unnest([200.0, 275.0, 350.0, 425.0, 500.0])::double as radius),
ax as (select city, radius, lng_bl, lat_bl, lng_ur, lat_ur, radius / 3 / 111195.0 as st from city_box, rad),
cen as (select city, radius, lat_bl + i * st as lat, lng_bl + j * (st / cos(radians((lat_bl + lat_ur) / 2))) as lng, concat_ws('/', city, i, j) as key from ax, range(0, 700) a(i), range(0, 1400) b(j)
 where i <= floor((lat_ur - lat_bl) / st) and j <= floor((lng_ur - lng_bl) / (st / cos(radians((lat_bl + lat_ur) / 2))))),
pts as materialized (select venue, lng, lat from loc where venue in (select venue from bn)),
inn as materialized (select a.city, radius, key, a.lng, a.lat, b.venue from cen a join pts b on floor(a.lat * 100) - floor(b.lat * 100) between -1 and 1 and abs(a.lat - b.lat) < 0.005 and {_NEAR_M} <= radius),
sz as (select city, radius, key, count(distinct venue) as venues from inn group by all having count(distinct venue) >= 5),
hs as materialized (select inn.city, radius, key, bn.bin, count(*) as n, any_value(venues) as venues from inn join sz using (city, radius, key) join bn using (venue) group by inn.city, radius, key, bn.bin),
jj as (select district, city, radius, key, bin, n / venues as p, coalesce(w / tw, 0) as q from (select hs.*, tw.district, tw.tw, wn.w from hs cross join tw left join wn on wn.district = tw.district and wn.bin = hs.bin)),
dd as (select district, city, radius, key, sum(-(p + q) / 2 * ln((p + q) / 2) - (-p * ln(p) + case when q > 0 then -q * ln(q) else 0 end) / 2) as s, sum(q) as met from jj group by all),
ds as (select *, round(s + ((select count(*) from k) - met) * ln(2) / 2, 6) as distance from dd)
"""


@query(_CIRCLES + "select district, city, radius, min(distance) as distance, count(*) as circles from ds group by district, city, radius")
def circle_search_best(spark: SparkSession, d: str) -> DataFrame:
    """The best circle of each radius in each city for the region asked of each district, among how many with five venues."""
    found = _circle_distances(spark, d)
    return found.groupBy("district", "city", "radius").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("circles"))


@query()
def region_circle_search(spark: SparkSession, d: str) -> DataFrame:
    """The five best disjoint circles of any radius in each city for the region asked of each district."""
    found = _circle_distances(spark, d)
    x, y = F.col("lng") * 111_195 * F.cos(F.radians("lat")), F.col("lat") * 111_195
    rows = found.select("district", "city", F.concat_ws("/", "key", F.col("radius").cast("int")).alias("key"), x.alias("x"), y.alias("y"), "radius", "distance")
    return regions.disjoint_circles(rows, ["district", "city"]).select("district", "city", "key", "rank", "radius", "distance")


@query()
def gold_region_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The distance of each two gold regions of a district (about 50 regions) by every named metric; all that weigh venues weigh them alike."""
    m = cut(_members(spark, d))
    sets = m.select(F.col("region").alias("set"), "v", F.lit(1.0).alias("w"))
    out = None
    for metric in transport.METRICS:
        found = transport.pair_distances(_region_pairs(m), sets, metric=metric).withColumn("metric", F.lit(metric))
        out = found if out is None else out.unionByName(found)
    return out.select("a", "b", "metric", F.round("distance", 6).alias("distance"))


@query(_CIRCLES.split("rad as (select")[0] + """al as (select mem.*, count(*) over (partition by region) as rn from mem), rb as (select district, region, rn, bin, count(*) as n from al join bn using (venue) group by all),
rp as (select distinct a.district, a.region as a, b.region as b from mem a join mem b on a.district = b.district and a.region < b.region), bb as (select distinct bin, cast(floor(bin / 10) as int) as k from bn),
jv as (select rp.a, rp.b, bb.k, coalesce(x.n / x.rn, 0) as p, coalesce(y.n / y.rn, 0) as q from rp cross join bb left join rb x on x.region = rp.a and x.bin = bb.bin left join rb y on y.region = rp.b and y.bin = bb.bin)
select a, b, cast(k as int) as dim, round(sum(case when p + q > 0 then -(p + q) / 2 * ln((p + q) / 2) else 0 end - (case when p > 0 then -p * ln(p) else 0 end + case when q > 0 then -q * ln(q) else 0 end) / 2), 6) as jsd from jv group by a, b, k""")
def region_divergences(spark: SparkSession, d: str) -> DataFrame:
    """The divergence of each feature between every two gold regions of a district (about 50 regions): the vectors that weights are learned from."""
    binned = cut(_binned(spark, d).select("venue", "bin"))
    members = cut(_members(spark, d).select("district", "region", "venue").distinct())
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("rn"))
    per = members.join(binned, "venue").groupBy("region", "bin").agg(F.count(F.lit(1)).alias("n")).join(size, "region").select("region", "bin", (F.col("n") / F.col("rn")).alias("p"))
    pairs = _region_pairs(members).join(F.broadcast(binned.select("bin").distinct()))
    side = lambda c, n: per.select(F.col("region").alias(c), "bin", F.col("p").alias(n))
    both = pairs.join(side("a", "p"), ["a", "bin"], "left").join(side("b", "q"), ["b", "bin"], "left").fillna(0.0, ["p", "q"])
    return both.groupBy("a", "b", F.floor(F.col("bin") / BINS).cast("int").alias("dim")).agg(F.round(jensen_shannon(F.col("p"), F.col("q")), 6).alias("jsd"))


@query()
def learned_weights(spark: SparkSession, d: str) -> DataFrame:
    """Feature weights learned from the regions of each district, once without each region: by bounded least squares, with the lengths of the region's vectors under them and under equal weights."""
    v = region_divergences(spark, d).groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "jsd"))), lambda x: x["jsd"]).alias("v"))
    pairs = v.orderBy("a", "b").collect()
    names = sorted({r[c] for r in pairs for c in "ab"})
    schema = "region string, theta array<double>, learned double, equal double"
    if not pairs:
        return spark.createDataFrame([], schema)
    rows = np.array([r["v"] for r in pairs])
    own = {n: np.array([n in (r["a"], r["b"]) for r in pairs]) for n in names}
    found = learning.leave_one_out(lambda keep: learning.bounded_weights(rows[keep] if keep.any() else rows), len(names), lambda k: own[names[k]], rows)
    return spark.createDataFrame([(n, [round(float(x), 6) for x in w], round(a, 6), round(b, 6)) for n, (w, a, b) in zip(names, found)], schema)


@query()
def greedy_venues(spark: SparkSession, d: str) -> DataFrame:
    """For the region asked of each district the eight venues of another city whose joint histogram comes nearest to it, chosen one by one."""
    binned = cut(_binned(spark, d))
    members = cut(_members(spark, d).select("district", "region", "venue").distinct())
    asked = members.join(_asked(spark, d, members), ["district", "region"])
    cand = cut(binned.where(F.col("city") == TO).groupBy("venue").agg(F.array_sort(F.collect_list("bin")).alias("bins")))
    out = None
    for district in [r[0] for r in asked.select("district").distinct().orderBy("district").collect()]:
        want = asked.where(F.col("district") == district).join(binned.select("venue", "bin"), "venue").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        chosen = regions.greedy_choice(cand, {r["bin"]: r["n"] for r in want.collect()}, 8, BINS).withColumn("district", F.lit(district))
        out = chosen if out is None else out.unionByName(chosen)
    return out if out is not None else spark.createDataFrame([], "venue string, step int, distance double, district string")


@query()
def region_search(spark: SparkSession, d: str) -> DataFrame:
    """The five best disjoint venue sets of each city for the region asked of each district: neighbours in feature space, density clusters of them, grown hulls, earth mover's distance."""
    z = _z(spark, d)
    members = cut(_members(spark, d))
    wanted = cut(members.join(_asked(spark, d, members), ["district", "region"]).select("district", F.col("venue").alias("id"), "v").distinct())
    # what is asked of a district is one outlined region, the query itself
    asked: dict[str, list] = {}
    for r in wanted.orderBy("district", "id").collect():
        asked.setdefault(r["district"], []).append(r["v"])
    cand = _neighbours(z, wanted).withColumnRenamed("t", "venue")
    box = table(spark, d, "city_box").select("city", "lat_bl", "lng_bl", "lat_ur", "lng_ur")
    here = places(spark, d, "lng", "lat").withColumnRenamed("id", "venue").join(z, "venue").join(F.broadcast(box), "city")
    east, north = local_xy(F.col("lat"), F.col("lng"), (F.col("lat_bl") + F.col("lat_ur")) / 2, (F.col("lng_bl") + F.col("lng_ur")) / 2)
    here = cut(here.select("city", "venue", east.alias("x"), north.alias("y"), "z"))
    spots = cand.join(here.select("city", "venue", "x", "y"), ["city", "venue"])

    def areas(pdf: pd.DataFrame) -> pd.DataFrame:
        # a border venue joins the first cluster that reaches it, so their order counts
        xy = pdf.sort_values(["venue", "x", "y"])[["x", "y"]].to_numpy()
        out = []
        for k, part in enumerate(regions.good_clusters(xy, 250.0, 10, 1_500.0, 250)):
            radius = float(np.sqrt(((xy[part] - xy[part].mean(0)) ** 2).sum(1).max()))
            out.append((pdf["district"].iloc[0], pdf["city"].iloc[0], k, regions.hull(xy[part]).ravel().tolist(), radius))
        return pd.DataFrame(out, columns=["district", "city", "area", "ring", "radius"])

    shapes = cut(spots.groupBy("district", "city").applyInPandas(areas, "district string, city string, area int, ring array<double>, radius double"))

    # one task for each area and its venues; a venue lies near few areas
    edge = lambda keep, best: best(F.filter("ring", lambda v, i: i % 2 == keep))
    boxed = shapes.select(
        "*", (edge(0, F.array_min) - F.col("radius")).alias("x0"), (edge(0, F.array_max) + F.col("radius")).alias("x1"),
        (edge(1, F.array_min) - F.col("radius")).alias("y0"), (edge(1, F.array_max) + F.col("radius")).alias("y1"),
    )
    near = here.join(boxed, "city").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("venue", ignore_index=True)
        xy, v, names = pdf[["x", "y"]].to_numpy(), np.stack(pdf["z"].to_numpy()), pdf["venue"].to_numpy()
        district, city, query = pdf["district"].iloc[0], pdf["city"].iloc[0], np.array(asked[pdf["district"].iloc[0]])
        off = regions.hull_distance(np.array(pdf["ring"].iloc[0]).reshape(-1, 2), xy)
        out, seen = [], 0
        for step in range(5):
            rows = np.flatnonzero(off <= pdf["radius"].iloc[0] * step / 4)
            if len(rows) >= 5 and len(rows) != seen:
                seen = len(rows)
                out.append((district, city, names[rows].tolist(), round(transport.region_distance("emd", query, v[rows]), 6)))
        return pd.DataFrame(out, columns=["district", "city", "venues", "distance"])

    columns = ["district", "city", "area", "ring", "radius", "venue", "x", "y", "z"]
    scored = near.select(columns).groupBy("district", "city", "area").applyInPandas(score, "district string, city string, venues array<string>, distance double")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in sorted(pdf.itertuples(index=False), key=lambda r: (r.distance, list(r.venues))):
            if len(kept) < 5 and not any(set(row.venues) & set(o.venues) for o in kept):
                kept.append(row)
        return pd.DataFrame([(*r, i + 1) for i, r in enumerate(kept)], columns=["district", "city", "venues", "distance", "rank"])

    return scored.groupBy("district", "city").applyInPandas(choose, "district string, city string, venues array<string>, distance double, rank int")


def _neighbours(z: DataFrame, wanted: DataFrame) -> DataFrame:
    """(district, city, t): the 60 nearest venues of every city to each venue of the district's region."""
    cities = F.broadcast(z.select("city").distinct())
    near = knn.nearest(wanted.join(cities), z.select("city", F.col("venue").alias("id"), F.col("z").alias("v")).join(F.broadcast(wanted.select("district").distinct())), ["district", "city"], 60)
    return cut(near.select("district", "city", "t").distinct())


def _candidates(spark: SparkSession, d: str, z: DataFrame) -> DataFrame:
    """(district, city, venue): the candidates of the region asked of each district."""
    members = cut(_members(spark, d))
    wanted = members.join(_asked(spark, d, members), ["district", "region"]).select("district", F.col("venue").alias("id"), "v").distinct()
    return _neighbours(z, wanted).withColumnRenamed("t", "venue")


@query()
def discrepancy_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Regions where the candidates of a district are denser than other venues: a scan of candidates against all on 50 x 50 cells per city, merged."""
    z = _z(spark, d)
    good = _candidates(spark, d, z)
    spots = z.select("city", "venue").join(places(spark, d, "lng", "lat").withColumnRenamed("id", "venue"), "venue")
    cells = cut(grids.placed(spots, table(spark, d, "city_box"), "city", 50))
    marked = cells.join(good, ["city", "venue"])
    every = grids.frequency(cells, ["city"]).join(good.select("district", "city").distinct(), "city")
    two = grids.both(grids.frequency(marked, ["district", "city"]), every, ["district", "city"])
    found = scan.merge(scan.rectangles(two, ["district", "city"], 50, 10, 8, 500), ["district", "city"], 50)
    return found.select("district", "city", "region_no", F.round("value", 6).alias("value"), "parts", F.size("cells").alias("size"))


@query()
def density_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of all candidate venues: eight within 150 m; while there is none, up to five times 1.3 times as far and 1.4 times fewer."""
    z = _z(spark, d)
    good = _candidates(spark, d, z).select("venue").distinct()
    spots = cut(places(spark, d, "lng", "lat").withColumnRenamed("id", "venue").join(good, "venue", "left_semi"))
    eps, least = 150.0, 8.0
    for _ in range(6):
        found = cut(regions.density_clusters(spots, eps, max(2, round(least))).where("cluster is not null"))
        if found.limit(1).count():
            break
        eps, least = eps * 1.3, least / 1.4
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("spots"), F.sum(F.col("core").cast("int")).alias("core"))


@query(with_(_Z) + f""", q as (select * from w where city = '{FROM}'), t as (select * from w where city = '{TO}'), nm as (select _id as id, max(regexp_extract(name, '(\\S+)$', 1)) as brand from venue where _id is not null group by _id),
k as (select q.venue as q, t.venue as t, row_number() over (partition by q.venue order by round(list_distance(q.v, t.v), 9), t.venue) as rank from q join t on t.top = q.top),
b as (select q, min(rank) as first from k join nm a on a.id = q join nm c on c.id = t where rank <= 20 and a.brand = c.brand group by q)
select q, cast(first as int) as first from b""")
def brand_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the first neighbour that carries the same last name word, among the 20 nearest in the category; see ``brand_rank_whole``."""
    a, b = _sides(spark, d)
    near = knn.nearest(a.select("top", "id", "v"), b.select("top", "id", "v"), ["top"], 20)
    word = F.max(F.regexp_extract("name", r"(\S+)$", 1)).alias("brand")
    names = table(spark, d, "venue").dropna(subset=["_id"]).groupBy("_id").agg(word)
    left, right = names.select(F.col("_id").alias("q"), F.col("brand").alias("x")), names.select(F.col("_id").alias("t"), F.col("brand").alias("y"))
    return near.join(left, "q").join(right, "t").where("x = y").groupBy("q").agg(F.min("rank").alias("first"))


@query(with_(_Z) + f""", q as (select * from w where city = '{FROM}'), t as (select * from w where city = '{TO}'), nm as (select _id as id, max(regexp_extract(name, '(\\S+)$', 1)) as brand from venue where _id is not null group by _id),
k as (select q.venue as q, t.venue as t, row_number() over (partition by q.venue order by round(list_distance(q.v, t.v), 9), t.venue) as rank, count(*) over (partition by q.venue) as size from q join t on t.top = q.top)
select q, cast(min(rank) as int) as first, max(size) as size from k join nm a on a.id = q join nm c on c.id = t where a.brand = c.brand group by q""")
def brand_rank_whole(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the first neighbour that carries the same last name word among all venues of the category, and how many these are."""
    a, b = _sides(spark, d)
    word = F.max(F.regexp_extract("name", r"(\S+)$", 1)).alias("brand")
    names = table(spark, d, "venue").dropna(subset=["_id"]).groupBy(F.col("_id").alias("id")).agg(word)
    left, right = (cut(x.select("top", "id", "v").join(names, "id", "left")) for x in (a, b))
    return knn.first_same(left, right, ["top"], "brand").select("q", "first", "size")


@query(_K + """, s5 as (select top, rank, distance from k where rank <= 3), m as (select cast(top as varchar) as top, avg(case when rank = 1 then distance end) as a, avg(case when rank = 2 then distance end) as b, avg(case when rank = 3 then distance end) as c from s5 group by top)
select top, round(a, 4) as "1", round(b, 4) as "2", round(c, 4) as "3", round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (cast(a is not null as int) + cast(b is not null as int) + cast(c is not null as int)), 4) as mean from m""")
def knn_score_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of the first three neighbours by top category, as a table."""
    a, b = _sides(spark, d)
    near = knn.nearest(a.select("top", "id", "v"), b.select("top", "id", "v"), ["top"], 3)
    scores = near.select(F.col("top").cast("string").alias("top"), F.col("rank").cast("string").alias("rank"), "distance")
    out = score_table(scores, "top", "rank", "distance", ["1", "2", "3"])
    return out.select("top", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in ("1", "2", "3", "mean")])
