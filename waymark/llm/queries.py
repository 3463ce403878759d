"""Queries of the llm operators and the SQL they are compared with."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import folded, letters
from waymark.lineage import cut
from waymark.llm import clusters, distinct, langid, mixing, packing, terms, together
from waymark.llm.tokens import TOKEN_RE2, token_count
from waymark.sources.tables import table

CAPACITY = 1_024


def _visits(spark: SparkSession, d: str) -> DataFrame:
    """One row per check-in record: id, day, city, lid, uid."""
    return table(spark, d, "checkin").select(
        F.col("_id").alias("id"), F.to_date("time").cast("string").alias("day"), letters(F.col("city")).alias("city"),
        folded(F.col("lid")).alias("lid"), "uid",
    ).where(F.col("id").isNotNull()).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Days and cities with many records of few users."""
    rows = cut(_visits(spark, d).select("id", "day", "city", "uid").dropna())
    n = rows.groupBy("city", "day").agg(F.count(F.lit(1)).alias("records")).where("records >= 30")
    users = distinct.count(distinct.bitmaps(rows, ["city", "day"], "uid", distinct.dictionary(rows, "uid")), ["city", "day"])
    return n.join(users, ["city", "day"]).where(F.col("members") * 4 < F.col("records")).select("city", "day")


def _levels(base: DataFrame, keys: list[str], of: str) -> DataFrame:
    """The sizes of ``base``'s sets for every choice of its keys; a key that is added up is ``*``."""
    out = None
    for n in range(len(keys) + 1):
        for to in combinations(keys, n):
            maps = base if n == len(keys) else distinct.merge(base, keys, list(to))
            sizes = distinct.count(maps, list(to)).select(*[(F.col(k) if k in to else F.lit("*")).alias(k) for k in keys], F.lit(of).alias("of"), "members")
            out = sizes if out is None else out.unionByName(sizes)
    return out


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Different users of days, cities, venues and all combinations, and different venues of days, cities and both, added up from two sets of bitmaps."""
    rows = cut(_visits(spark, d))
    out = []
    for what, keys in (("uid", ["city", "day", "lid"]), ("lid", ["city", "day"])):
        base = cut(distinct.bitmaps(rows.dropna(subset=[what]), keys, what, distinct.dictionary(rows, what)))
        out.append(_levels(base, keys, what))
    return out[0].unionByName(out[1].withColumn("lid", F.lit("*")))


def p3_venues(spark: SparkSession, d: str) -> DataFrame:
    """Different users of each venue, added up from those of its days."""
    rows = cut(_visits(spark, d).select("id", "day", "lid", "uid").dropna(subset=["lid", "uid"]))
    base = distinct.bitmaps(rows, ["day", "lid"], "uid", distinct.dictionary(rows, "uid"))
    return distinct.count(distinct.merge(base, ["day", "lid"], ["lid"]), ["lid"]).select("lid", F.col("members").alias("users"))


def p3_returning(spark: SparkSession, d: str) -> DataFrame:
    """Users seen in a city both on a day and on the day before: an AND of two bitmaps."""
    rows = cut(_visits(spark, d).select("id", "day", "city", "uid").dropna())
    maps = cut(distinct.bitmaps(rows, ["city", "day"], "uid", distinct.dictionary(rows, "uid")))
    earlier = maps.withColumn("day", F.date_add(F.to_date("day"), 1).cast("string"))
    return distinct.common(maps, earlier, ["city", "day"]).select("city", "day", F.col("members").alias("users"))


_VISITS_SQL = """
with v as (select distinct _id as id, strftime("time", '%Y-%m-%d') as day, nullif(regexp_replace(lower(city), '[^a-z]', '', 'g'), '') as city,
  nullif(lower(trim(lid)), '') as lid, uid from checkin where _id is not null)
"""
P3_SQL = {
    "p3_found": _VISITS_SQL + """
select city, day from v where city is not null and day is not null and uid is not null
group by city, day having count(distinct id) >= 30 and count(distinct uid) * 4 < count(distinct id)""",
    "p3_counts": _VISITS_SQL + """, r as (
select city, day, lid, grouping(city) as gc, grouping(day) as gd, grouping(lid) as gl, 'uid' as of, count(distinct uid) as members from v group by cube (city, day, lid)
union all
select city, day, null, grouping(city), grouping(day), 1, 'lid', count(distinct lid) from v group by cube (city, day))
select case when gc = 1 then '*' else city end as city, case when gd = 1 then '*' else day end as day, case when gl = 1 then '*' else lid end as lid, of, members from r where members > 0""",
    "p3_venues": _VISITS_SQL + "select lid, count(distinct uid) as users from v where lid is not null and uid is not null group by lid",
    "p3_returning": _VISITS_SQL + """
, u as (select distinct city, day, uid from v where city is not null and day is not null and uid is not null)
select a.city, a.day, count(*) as users from u a join u b on a.city = b.city and a.uid = b.uid and cast(a.day as date) = cast(b.day as date) + 1 group by a.city, a.day""",
}


def _term_sets(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Fields and their records for the term counts."""
    cats = table(spark, d, "venue").select("_id", F.array("cat").alias("cats"))
    return [("photos.tags", terms.records(table(spark, d, "photos"), "_id", "tags")), ("venue.cat", terms.records(cats, "_id", "cats"))]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for field, found in _term_sets(spark, d):
        recs = cut(found)
        total = recs.agg(F.count(F.lit(1)).alias("_n"))
        freq = terms.frequencies(recs).crossJoin(F.broadcast(total))
        parts.append(terms.marked(freq, F.col("_n")).select(F.lit(field).alias("field"), "term", "in_records", "occurrences", "mark"))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags and categories too rare or too common to tell places apart."""
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every tag and category with its records, occurrences and mark."""
    return _terms(spark, d)


_TERMS_SQL = """
with raw as (
  select 'photos.tags' as field, cast(_id as varchar) as id, list_sort(list_filter(list_transform(tags, lambda t: nullif(lower(trim(t)), '')), lambda t: t is not null)) as ts from photos
  union all
  select 'venue.cat', _id, [lower(trim(cat))] from venue where trim(cat) <> ''
), r as (select field, id, max(struct_pack(n := len(ts), ts := ts)).ts as ts from raw where len(ts) > 0 and id is not null group by field, id),
n as (select field, count(*) as n from r group by field),
o as (select field, id, unnest(ts) as term from r),
c as (select field, term, count(distinct id) as in_records, count(*) as occurrences from o group by field, term),
m as (select c.*, case when in_records < 3 then 'rare' when in_records * 10 > n then 'common' end as mark from c join n using (field))
"""
P6_SQL = {
    "p6_found": _TERMS_SQL + "select field, term, mark from m where mark is not null",
    "p6_terms": _TERMS_SQL + "select field, term, in_records, occurrences, mark from m",
}


def _pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    sets = [("photos.tags", "photos"), ("venue.tags", "venue")]
    parts = [together.pairs(cut(terms.records(table(spark, d, t), "_id", "tags")), least).withColumn("field", F.lit(f)) for f, t in sets]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Tag pairs on at least 20 records and at least five times as often as by chance, beyond what chance explains.

    Such a pair's log-likelihood ratio is 32 at least (20 records against 4 expected), so the test of significance removes none.
    """
    out = _pairs(spark, d, 20).where("significant").where(F.col("n_ab") * F.col("n") >= F.lit(5) * F.col("n_a") * F.col("n_b"))
    return out.select("field", "item_a", "item_b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of tags that stand together, with lift, log-likelihood ratio and significance."""
    return _pairs(spark, d, 1).select("field", "item_a", "item_b", "n_ab", F.round("lift", 4).alias("lift"), F.round("llr", 3).alias("llr"), "significant")


_PAIRS_SQL = """
with raw as (
  select 'photos.tags' as field, cast(_id as varchar) as id, list_sort(list_filter(list_transform(tags, lambda t: nullif(lower(trim(t)), '')), lambda t: t is not null)) as ts from photos
  union all
  select 'venue.tags', _id, list_sort(list_filter(list_transform(tags, lambda t: nullif(lower(trim(t)), '')), lambda t: t is not null)) from venue
), r as (select field, id, max(struct_pack(n := len(ts), ts := ts)).ts as ts from raw where len(ts) > 0 and id is not null group by field, id),
n as (select field, count(*) as n from r group by field),
o as (select distinct field, id, unnest(ts) as t from r),
k as (select field, t, count(*) as k from o group by field, t),
ab as (select a.field, a.t as item_a, b.t as item_b, count(*) as n_ab from o a join o b on a.field = b.field and a.id = b.id and a.t < b.t group by all),
p as (select ab.*, x.k as n_a, y.k as n_b, n.n from ab join k x on x.field = ab.field and x.t = item_a join k y on y.field = ab.field and y.t = item_b join n on n.field = ab.field)
"""
_PAIRS_SQL += """,
x as (select *, cast(n_ab as double) as k1, cast(n_a - n_ab as double) as k2, cast(n_b - n_ab as double) as k3, cast(n - n_a - n_b + n_ab as double) as k4, cast(n_a as double) as a, cast(n_b as double) as b, cast(n as double) as s from p),
y as (select *, k1 * s / (a * b) as lift, 2 * (case when k1 > 0 then k1 * ln(k1 * s / (a * b)) else 0 end + case when k2 > 0 then k2 * ln(k2 * s / (a * (s - b))) else 0 end
 + case when k3 > 0 then k3 * ln(k3 * s / ((s - a) * b)) else 0 end + case when k4 > 0 then k4 * ln(k4 * s / ((s - a) * (s - b))) else 0 end) as llr from x)
"""
P7_SQL = {
    "p7_found": _PAIRS_SQL + "select field, item_a, item_b from p where n_ab >= 20 and n_ab * n >= 5 * n_a * n_b",
    "p7_pairs": _PAIRS_SQL + "select field, item_a, item_b, n_ab, round(lift, 4) as lift, round(llr, 3) as llr, llr >= 10.828 and lift > 1 as significant from y",
}


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", folded(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_doc_tokens(spark, d), "doc_id", "tokens", CAPACITY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container and offset of every document (of each piece of a cut one)."""
    return _packed(spark, d).select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), "cut", "container", "start", "certificate")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    return p8_containers(spark, d).where("cut").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """What lies in the containers of each document: pieces, tokens, containers, whether it was cut."""
    per = _packed(spark, d).groupBy(F.col("item").alias("doc_id"))
    return per.agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), F.count_distinct("container").alias("containers"), F.bool_or("cut").alias("cut"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and tokens packed, containers above their capacity, the certified least number, and whether those used exceed it by less than 1 %."""
    r = packing.report(cut(_packed(spark, d)), CAPACITY)
    return r.select("pieces", "tokens", "overfull", "least_containers", (F.col("containers") * 100 < F.col("least_containers") * 101 + 100).alias("tight"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and the share of their space filled."""
    return packing.report(cut(_packed(spark, d)), CAPACITY).select("containers", "least_containers", "fullest", F.round("used_share", 6).alias("used_share"))


_TOKENS_SQL = f"""
with t as (select doc_id, nullif(lower(trim(source)), '') as source, coalesce(len(regexp_extract_all("text", '{TOKEN_RE2}')), 0) as tokens from documents)
"""
_SIZES_SQL = _TOKENS_SQL + """,
c as (select case when i < tokens // 1024 then 1024 else tokens % 1024 end as s, count(*) as n from t, range(0, 100000) r(i) where i < tokens // 1024 + cast(tokens % 1024 > 0 as int) group by 1),
e as (select max(ceil(b / 1024.0)) as b from (select e, sum(n * case when s > 1024 - e then 1024 when s < e then 0 else s end) as b from c, range(0, 513) r(e) group by e)),
k as (select max(ceil(b / (1024.0 * k))) as b from (select k, sum(n * case when (k + 1) * s % 1024 = 0 then s * k else (k + 1) * s // 1024 * 1024 end) as b from c, range(1, 33) r(k) group by k))
"""
P8_SQL = {
    "p8_found": _TOKENS_SQL + "select doc_id from t where tokens > 1024",
    "p8_pieces": _TOKENS_SQL + "select doc_id, cast(ceil(tokens / 1024.0) as bigint) as pieces, tokens, cast(ceil(tokens / 1024.0) as bigint) as containers, tokens > 1024 as cut from t where tokens > 0",
    "p8_report": _SIZES_SQL + "select cast(sum(n) as bigint) as pieces, cast(sum(n * s) as bigint) as tokens, cast(0 as bigint) as overfull, cast(greatest((select b from e), (select b from k)) as bigint) as least_containers, true as tight from c",
}


# The tree above the sources: kinds of text, and inside them the languages of the labels.
DOMAINS = {
    "note": ["tip", "caption", "notice"], "talk": ["review", "forum", "transcript"], "story": ["guide", "diary", "archive"],
}
LEVELS = ["domain", "language", "source"]


def _domain(source: Column) -> Column:
    named = F.create_map(*[F.lit(x) for domain, names in DOMAINS.items() for n in names for x in (n, domain)])
    return F.coalesce(F.try_element_at(named, source), F.lit("other"))


def _leaf_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: doc_id, domain, language, source, tokens."""
    docs = table(spark, d, "documents").select(
        "doc_id", folded(F.col("source")).alias("source"), F.coalesce(langid.label_code(F.col("lang")), F.lit("none")).alias("language"), token_count(F.col("text")).alias("tokens")
    )
    return cut(docs.withColumn("domain", _domain(F.col("source"))))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    goal = table(spark, d, "mix_target").select(folded(F.col("source")).alias("source"), "weight", "max_repeat").dropna(subset=["source"])
    return goal.withColumn("domain", _domain(F.col("source")))


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _leaf_tokens(spark, d)
    return docs, mixing.plan(docs, mixing.spread(docs, _targets(spark, d), LEVELS), LEVELS)


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """Size, wanted tokens, budget after redistribution and shortage of each leaf of the tree."""
    return _tree(spark, d)[1].select(*LEVELS, "size", F.round("want", 2).alias("want"), F.round("budget", 2).alias("budget"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is taken."""
    docs, plan = _tree(spark, d)
    return mixing.select(docs, plan, LEVELS, "doc_id")


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    """One row per source of the targets: its plan and what was really drawn."""
    docs, plan = _tree(spark, d)
    leaves = mixing.report(plan, mixing.select(docs, plan, LEVELS, "doc_id"), LEVELS)
    per = leaves.groupBy("domain", "source").agg(
        F.sum("size").alias("size"), F.sum("budget").alias("budget"), F.sum("taken").alias("taken"), F.max("most_copies").alias("most_copies"), F.sum("share").alias("share"),
    )
    rows = _targets(spark, d).join(per, ["domain", "source"])
    total = rows.agg(F.sum("size").alias("_total"))
    return rows.join(F.broadcast(total)).withColumn("short", F.col("weight") * F.col("_total") > F.col("max_repeat") * F.col("size")).drop("_total")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short even at their cap."""
    return _by_source(spark, d).where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each source really reached, and what it is made of."""
    return _by_source(spark, d).select("domain", "source", "weight", "size", F.round("budget", 2).alias("budget"), "taken", "most_copies", F.round("share", 6).alias("share"), "short")


def p9_reached(spark: SparkSession, d: str) -> DataFrame:
    """Budget of each source, and whether what was drawn stays inside it and its repetitions and, but for the end of each leaf, fills it."""
    longest = _leaf_tokens(spark, d).agg(F.max("tokens").alias("_longest"), F.count_distinct("language").alias("_languages"))
    rows = _by_source(spark, d).join(F.broadcast(longest))
    inside = (F.col("taken") <= F.col("budget") + 0.01) & (F.col("most_copies") <= F.col("max_repeat"))
    filled = F.col("budget") - F.col("taken") <= F.col("_longest") * F.col("_languages")
    return rows.select("domain", "source", "size", F.round("budget", 2).alias("budget"), "short", (inside & filled).alias("kept"))


def _filled_sql(name: str, above: str, path: list[str]) -> str:
    """SQL of one level of the tree: ``name`` has the path and its budget g, from ``above`` with the parent's."""
    keys, up = ", ".join(path), ", ".join(path[:-1])
    over = f"partition by {up}" if up else ""
    return f"""
{name}0 as (select {keys}, sum(weight) as w, sum(case when weight > 0 then cap else 0 end) as cap from leaf group by {keys}),
{name}1 as (select n.*, u.g as b from {name}0 n join {above} u {f"using ({up})" if up else "on true"} where w > 0 and cap > 0),
{name}2 as (select *, sum(w) over ({over}) as tw, sum(cap) over ({over}) as tc, coalesce(sum(w) over ({over} order by cap / w, {path[-1]} rows between unbounded preceding and 1 preceding), 0) as pw,
 coalesce(sum(cap) over ({over} order by cap / w, {path[-1]} rows between unbounded preceding and 1 preceding), 0) as pc from {name}1),
{name}3 as (select *, max((least(b, tc) - pc) / (tw - pw)) over ({over}) as level from {name}2),
{name} as (select {", ".join("x." + c for c in path)}, coalesce(least(y.cap, y.w * greatest(y.level, 0)), 0) as g from {name}0 x left join {name}3 y using ({keys}))"""


_DOMAIN_SQL = "case " + " ".join(f"when source in ({', '.join(repr(n) for n in names)}) then '{domain}'" for domain, names in DOMAINS.items()) + " else 'other' end"
_NAMES_SQL = ", ".join(f"('{n}', '{code}')" for code, three, name, _ in langid.LANGUAGES for n in (code, *three.split(), name))
_TREE_SQL = f"""
with t as (select doc_id, nullif(lower(trim(source)), '') as source, coalesce(n.code, 'none') as language, coalesce(len(regexp_extract_all("text", '{TOKEN_RE2}')), 0) as tokens
 from documents left join (values {_NAMES_SQL}) n(name, code) on n.name = regexp_extract(lower(trim(lang)), '^[a-z]+')),
m as (select *, {_DOMAIN_SQL} as domain from (select lower(trim(source)) as source, weight, max_repeat from mix_target)),
z as (select source, language, sum(tokens) as size from t where source is not null group by all having sum(tokens) > 0),
leaf as (select domain, coalesce(language, 'none') as language, source, coalesce(size, 0) as size, max_repeat * coalesce(size, 0) as cap, weight * coalesce(size / sum(size) over (partition by source), 1) as weight from m left join z using (source)),
tot as (select sum(size) as total from leaf), root as (select least(total, (select sum(weight) from leaf) * total) as g from tot),
{_filled_sql("da", "root", ["domain"])},
{_filled_sql("db", "da", ["domain", "language"])},
{_filled_sql("dc", "db", ["domain", "language", "source"])},
plan as (select domain, language, source, cast(size as bigint) as size, weight * total as want, g as budget from leaf join dc using (domain, language, source), tot)
"""
P9_SQL = {
    "p9_found": _TOKENS_SQL + """
, z as (select m.source, m.weight, m.max_repeat, coalesce(sum(tokens), 0) as size from (select lower(trim(source)) as source, weight, max_repeat from mix_target) m left join t on t.source = m.source group by all)
select source from z where weight * (select sum(size) from z) > max_repeat * size""",
    "p9_plan": _TREE_SQL + "select domain, language, source, size, round(want, 2) as want, round(budget, 2) as budget from plan",
    "p9_reached": _TREE_SQL + """select domain, source, cast(sum(p.size) as bigint) as size, round(sum(budget), 2) as budget, any_value(m.weight * total > m.max_repeat * s.size) as short, true as kept
from plan p join m using (domain, source) join (select source, sum(size) as size from leaf group by source) s using (source), tot group by domain, source""",
}

QUERIES = {
    "p3_found": p3_found, "p3_counts": p3_counts, "p3_venues": p3_venues, "p3_returning": p3_returning,
    "p6_found": p6_found, "p6_terms": p6_terms, "p7_found": p7_found, "p7_pairs": p7_pairs,
    "p8_found": p8_found, "p8_containers": p8_containers, "p8_pieces": p8_pieces, "p8_report": p8_report, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_plan": p9_plan, "p9_documents": p9_documents, "p9_shares": p9_shares, "p9_reached": p9_reached,
}
SQL = {**P3_SQL, **P6_SQL, **P7_SQL, **P8_SQL, **P9_SQL}


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return langid.segments(docs.withColumnRenamed("lang", "label"), langid.fit(docs), ["label"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents with a missing or wrong label or in several languages."""
    return langid.doubtful(langid.languages(_segments(spark, d), ["label"]))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch in one language with its confidence; sentences is 0 for one of fragments only."""
    return _segments(spark, d).drop("label").withColumn("confidence", F.round("confidence", 6))


def p10_lettered(spark: SparkSession, d: str) -> DataFrame:
    """Documents that got a language: all that have a letter outside links, tags and markup; how much of their text lies in a stretch."""
    segs = _segments(spark, d)
    return segs.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.count(F.lit(1)).alias("stretches"), F.round(F.min("confidence"), 6).alias("least_confidence"))


QUERIES |= {"p10_found": p10_found, "p10_segments": p10_segments, "p10_lettered": p10_lettered}

SURROUNDINGS = [*range(6, 15), *range(18, 31)]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return clusters.vectors(table(spark, d, "venue_feature"), "venue_id", "f", 31, SURROUNDINGS)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_vectors(spark, d), len(SURROUNDINGS), 0.2, 5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The further venues of each cluster beside its smallest one."""
    return _clusters(spark, d).where("item <> cluster").select(F.col("cluster").alias("venue_a"), F.col("item").alias("venue_b")).distinct()


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size of each cluster: rows and different venues."""
    return p2_typical(spark, d).select("cluster", "rows", "items")


def p2_typical(spark: SparkSession, d: str) -> DataFrame:
    """Size, rows of the densest cell and most typical venues of each cluster."""
    return clusters.described(_clusters(spark, d), len(SURROUNDINGS))


def p2_venues(spark: SparkSession, d: str) -> DataFrame:
    """Every venue with a vector and its cluster (the smallest venue of it), null for none."""
    rows = _vectors(spark, d).select(F.col("item").alias("venue_id")).distinct()
    own = _clusters(spark, d).groupBy(F.col("item").alias("venue_id")).agg(F.min("cluster").alias("cluster"))
    return rows.join(own, "venue_id", "left")


_ROWS_SQL = f"""
with r as materialized (select venue_id as item, v, row_number() over () as id from (select distinct venue_id, list_transform({[i + 1 for i in SURROUNDINGS]}, lambda i: f[i]) as v from venue_feature where len(f) = 31 and venue_id is not null)
  where len(list_filter(v, lambda x: x is not null and not isnan(x) and not isinf(x))) = len(v)),
w as (select a.id, a.item, list(b.id order by b.id) as near from r a join r b on list_distance(a.v, b.v) <= 0.2 group by a.id, a.item),
g as (select near, min(item) as cluster, count(distinct item) as items, count(*) as "rows" from w group by near having count(*) = len(near) and count(distinct item) >= 5)
"""
P2_SQL = {
    "p2_found": _ROWS_SQL + "select distinct cluster as venue_a, item as venue_b from w join g using (near) where item <> cluster",
    "p2_clusters": _ROWS_SQL + """select cluster, "rows", items from g""",
    "p2_venues": _ROWS_SQL + "select item as venue_id, min(cluster) as cluster from w left join g using (near) group by item",
}

QUERIES |= {"p2_found": p2_found, "p2_clusters": p2_clusters, "p2_typical": p2_typical, "p2_venues": p2_venues}
SQL |= P2_SQL
