"""Inputs that the queries derive from the given tables, in Spark and as SQL for DuckDB.

Each is a function of (spark, sf_dir); SQL holds the same definitions as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.session import table

LENSES = ["mechanism", "product", "funding", "standard"]
STAGES = ["idea", "prototype", "pilot", "limited_sales", "scaled", "unknown"]
#: (layer, pattern of the host), in order.
LAYERS = [("link_farm", "casino|bets|pills|ads-track"), ("primary", "[.]org$"), ("social", "^m[.]"), ("media", "^blog[.]")]
AS_OF = "2024-07-01"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits: the pages, seven queries, four lenses."""
    w = Window.partitionBy("query").orderBy("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("q"), F.col("page_id") % 7).alias("query"), F.expr("element_at(array('mechanism', 'product', 'funding', 'standard'), cast(page_id % 4 + 1 as int))").alias("lens"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"))
    return p.withColumn("position", F.row_number().over(w).cast("long"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document snapshots with a url, a digest and a date, a third without."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 1200).cast("int"))
    return d.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"), "source", "lang", "text", F.sha2("text", 256).alias("sha"), F.when(F.col("doc_id") % 3 != 0, F.date_format(day, "yyyy-MM-dd")).alias("published_at"))


def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders cut to a year, a month or a day; some malformed."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    cut = F.expr("case o_orderkey % 3 when 0 then 4 when 1 then 7 else 10 end")
    bad = F.expr("case o_orderkey % 11 when 0 then '2025-13' when 1 then '0000' when 2 then 'soon' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.coalesce(bad, iso.substr(F.lit(1), cut)).alias("d"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote for each document: from its text, every fifth from another's, every seventh too short."""
    # Cut before the join, so texts are not moved.
    at = lambda key: F.col("text").substr((key % 50 + 1).cast("int"), F.when(key % 7 == 0, 10).otherwise(60).cast("int"))
    d = table(spark, sf_dir, "documents")
    other = d.where((F.col("doc_id") - 1) % 5 == 0).select((F.col("doc_id") - 1).alias("doc_id"), at(F.col("doc_id") - 1).alias("next"))
    own = d.select("doc_id", "source", at(F.col("doc_id")).alias("own"))
    return own.join(other, "doc_id", "left").select("doc_id", "source", F.coalesce("next", "own").alias("quote"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: parts with their suppliers as organisations and the first order as event."""
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem")
    orgs = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.array_sort(F.collect_set("s_name")).alias("organizations"), F.countDistinct("l_orderkey").alias("total"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("event_date"))
    return p.join(orgs, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("mechanism"), F.col("p_brand").alias("object"), "organizations", F.coalesce("total", F.lit(0).cast("long")).alias("total"), "event_date", F.expr("element_at(array('idea', 'prototype', 'pilot', 'limited_sales', 'scaled', 'unknown'), cast(p_size % 6 + 1 as int))").alias("stage"), "p_size")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results (query, key, url, vector): 20 embeddings a query (5 in every seventh), each near the seed of its reading, of seven kinds of query:
    one reading; two that are far apart; two that are near; six; a consumer reading as the largest, and as the smaller; few results."""
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  worked out once, not for each component
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))
    norm = lambda vector: let(vector, lambda v: let(length(v), lambda n: F.transform(v, lambda x: x / n)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 20).alias("query"), (F.col("vec_id") % 20).alias("s"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("u", norm(F.col("v"))).withColumn("kind", F.col("query") % 7)
    split = F.when(F.col("kind") == 5, 16).otherwise(12)
    g = F.when(F.col("kind").isin(0, 6), 0).when(F.col("kind") == 3, F.col("s") % 6).otherwise((F.col("s") >= split).cast("int")).cast("long")
    seeds = e.where("s < 6").select("query", F.col("s").alias("g"), F.col("u").alias("seed"))
    first = seeds.where("g = 0").select("query", F.col("seed").alias("own"))
    along = F.aggregate(F.zip_with("seed", "own", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    aside = let(along, lambda a: norm(F.zip_with("seed", "own", lambda x, y: x - y * a)))
    near = let(aside, lambda v: F.zip_with("own", v, lambda x, y: x * 0.815 + y * 0.5795))
    rows = e.where("kind <> 6 or s < 5").withColumn("g", g).join(seeds, ["query", "g"]).join(first, "query")
    base = F.when(F.col("kind").isin(2, 5) & (F.col("g") == 1), near).otherwise(F.col("seed"))
    page = F.when((F.col("kind") == 4) & (F.col("g") == 0) & (F.col("s") % 2 == 0), "/download").when((F.col("kind") == 5) & ((F.col("g") == 1) | (F.col("s") < 5)), "/download").otherwise("")
    host = F.when(F.col("query") % 14 == 7, F.col("s") % 3).otherwise(F.col("vec_id") % 9)
    return rows.select("query", F.col("vec_id").alias("key"), F.concat(F.lit("https://site"), host, F.lit(".example.org/"), "vec_id", page).alias("url"), norm(F.zip_with(base, "u", lambda x, y: x + y * 0.05)).alias("vector"))


SQL = {
    # The reading g is known here; the queries have to find it.
    "results": "e AS (SELECT vec_id, vec_id // 20 AS query, vec_id % 20 AS s, (vec_id // 20) % 7 AS kind, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings), "
    "eg AS (SELECT *, CASE WHEN kind IN (0, 6) THEN 0 WHEN kind = 3 THEN s % 6 WHEN kind = 5 THEN (s >= 16)::INT ELSE (s >= 12)::INT END AS g FROM e WHERE kind <> 6 OR s < 5), "
    "eb AS (SELECT eg.*, a.u AS seed, b.u AS own, list_dot_product(a.u, b.u) AS along FROM eg JOIN e a ON a.query = eg.query AND a.s = eg.g JOIN e b ON b.query = eg.query AND b.s = 0), "
    "ea AS (SELECT *, list_transform(range(1, len(seed) + 1), lambda i: seed[i] - along * own[i]) AS aside FROM eb), "
    "ew AS (SELECT *, CASE WHEN kind IN (2, 5) AND g = 1 THEN list_transform(range(1, len(seed) + 1), lambda i: own[i] * 0.815::DOUBLE + aside[i] / sqrt(list_dot_product(aside, aside)) * 0.5795::DOUBLE) ELSE seed END AS base FROM ea), "
    "ev AS (SELECT *, list_transform(range(1, len(seed) + 1), lambda i: base[i] + u[i] * 0.05::DOUBLE) AS w FROM ew), "
    "results AS (SELECT query, vec_id AS key, g, 'https://site' || (CASE WHEN query % 14 = 7 THEN s % 3 ELSE vec_id % 9 END) || '.example.org/' || vec_id || (CASE WHEN kind = 4 AND g = 0 AND s % 2 = 0 OR kind = 5 AND (g = 1 OR s < 5) THEN '/download' ELSE '' END) AS url, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS vector FROM ev), "
    "readings AS (SELECT *, min(key) OVER (PARTITION BY query, g) AS sense, count(*) OVER (PARTITION BY query, g) AS n, regexp_matches(url, '/download') AS consumer FROM results), "
    "placed AS (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY n DESC, sense) AS place FROM readings), "
    "sums AS (SELECT query, d, sum(x) FILTER (place = 1) AS x1, sum(x) FILTER (place = 2) AS x2 FROM (SELECT query, place, unnest(vector) AS x, unnest(range(len(vector))) AS d FROM placed WHERE place <= 2) GROUP BY ALL), "
    "cosines AS (SELECT query, sum(x1 * x2) / sqrt(sum(x1 * x1) * sum(x2 * x2)) AS cosine FROM sums GROUP BY 1), "
    "gate AS (SELECT query, count(*) AS hits, count(DISTINCT regexp_extract(url, '//([^/]*)/', 1)) AS hosts, max(place) AS groups, count_if(place = 1) / count(*) AS top, count_if(place = 2) / count(*) AS second, count_if(place = 1 AND consumer) / count_if(place = 1) AS consumer FROM placed GROUP BY 1)",
    "hits": "hits AS (SELECT page_id, url, 'q' || (page_id % 7) AS query, (['mechanism','product','funding','standard'])[page_id % 4 + 1] AS lens, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS position FROM pages)",
    "docs": "docs AS (SELECT doc_id, 'https://' || source || '.example.org/' || doc_id AS url, source, lang, text, sha256(text) AS sha, CASE WHEN doc_id % 3 <> 0 THEN strftime(DATE '2023-01-01' + (doc_id % 1200)::INT, '%Y-%m-%d') END AS published_at FROM documents)",
    "pdates": "pdates AS (SELECT o_orderkey, o_orderpriority, coalesce(CASE o_orderkey % 11 WHEN 0 THEN '2025-13' WHEN 1 THEN '0000' WHEN 2 THEN 'soon' END, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END)) AS d FROM orders), "
    "pd AS (SELECT *, CASE WHEN regexp_matches(d, '^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$') AND d <> '0000' THEN try_cast(CASE length(d) WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END AS DATE) END AS lo FROM pdates), "
    "pb AS (SELECT *, CASE length(d) WHEN 4 THEN make_date(year(lo), 12, 31) WHEN 7 THEN last_day(lo) ELSE lo END AS hi FROM pd)",
    "quotes": "quotes AS (SELECT d.doc_id, d.source, substr(CASE WHEN d.doc_id % 5 = 0 THEN coalesce(n.text, d.text) ELSE d.text END, d.doc_id % 50 + 1, CASE WHEN d.doc_id % 7 = 0 THEN 10 ELSE 60 END) AS quote FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1)",
    "candidates": "candidates AS (SELECT p_partkey, p_name AS name, p_type AS mechanism, p_brand AS object, o.organizations, coalesce(o.total, 0) AS total, o.event_date, (['idea','prototype','pilot','limited_sales','scaled','unknown'])[p_size % 6 + 1] AS stage, p_size FROM part LEFT JOIN (SELECT l_partkey, list_sort(list(DISTINCT s_name)) AS organizations, count(DISTINCT l_orderkey) AS total, strftime(min(l_shipdate), '%Y-%m-%d') AS event_date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) o ON p_partkey = l_partkey)",
    "host": "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www[.]', '')",
}


def sql(*names: str) -> str:
    """WITH clause of the named inputs."""
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def layer_sql(host: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({host}, '{p}') THEN '{n}'" for n, p in LAYERS) + " ELSE 'other' END"
