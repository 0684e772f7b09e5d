"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions import text, urls
from glimmer.operators import gate
from glimmer.operators import measures as M
from glimmer.plans import inputs as I
from glimmer.registry import query
from glimmer.session import table

_HOST = I.SQL["host"]
_LAYER = I.layer_sql(_HOST)
_LAYERS = [n for n, _ in I.LAYERS] + ["other"]


def _hits(spark, d):
    return I.hits(spark, d).withColumns({"layer": urls.layer(F.col("url"), I.LAYERS), "host": urls.host(F.col("url"))})


@query("agg1_term_clusters", I.sql("candidates") + "SELECT lower(mechanism) AS term, count(DISTINCT o) AS players, count(DISTINCT object) AS places FROM (SELECT mechanism, object, unnest(coalesce(organizations, [NULL])) AS o FROM candidates) GROUP BY 1")
def agg1(spark, d):
    return M.clusters(I.candidates(spark, d), "mechanism", "organizations", "object")


@query("agg2_layer_share", I.sql("hits") + f"SELECT layer, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT {_LAYER} AS layer, count(*) AS n FROM hits GROUP BY 1)")
def agg2(spark, d):
    return M.shares(_hits(spark, d), "layer")


@query("agg3_layer_by_lens", I.sql("hits") + "SELECT lens, " + ", ".join(f"count(*) FILTER (({_LAYER}) = '{n}') AS {n}" for n in _LAYERS) + " FROM hits GROUP BY lens")
def agg3(spark, d):
    return M.counts_by(_hits(spark, d), "lens", "layer", _LAYERS)


@query("agg4_top_hosts", I.sql("hits") + f"SELECT {_HOST} AS host, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def agg4(spark, d):
    return M.top(_hits(spark, d), "host", 10)


_KEY = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')"


@query(
    "agg5_funnel",
    I.sql("hits") + f"SELECT query, count(*) AS hits, count(DISTINCT {_KEY}) AS urls, count_if(page_id % 9 <> 0) AS attempts, count_if(page_id % 9 = 0) AS from_api, count_if(page_id % 5 <> 0) AS parsed, round((count_if(page_id % 5 <> 0) - count_if(page_id % 9 = 0 AND page_id % 5 <> 0)) / nullif(count_if(page_id % 9 <> 0), 0), 6) AS text_share FROM hits GROUP BY query",
)
def agg5(spark, d):
    api, ok = F.col("page_id") % 9 == 0, F.col("page_id") % 5 != 0
    share = (F.count_if(ok) - F.count_if(api & ok)) / F.nullif(F.count_if(~api), F.lit(0))
    return I.hits(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct(urls.page_key(F.col("url"))).alias("urls"), F.count_if(~api).alias("attempts"), F.count_if(api).alias("from_api"), F.count_if(ok).alias("parsed"), F.round(share, 6).alias("text_share"))


@query("agg6_reason_counts", I.sql("candidates") + "SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN organizations IS NULL THEN 'no_players' END, CASE WHEN total < 25 THEN 'rare' END, CASE WHEN stage = 'scaled' THEN 'scaled' END]) AS reason FROM candidates) WHERE reason IS NOT NULL GROUP BY 1")
def agg6(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("organizations").isNull(), F.lit("no_players")), F.when(F.col("total") < 25, F.lit("rare")), F.when(F.col("stage") == "scaled", F.lit("scaled"))))
    return I.candidates(spark, d).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PROBE = "probe AS (SELECT event_type AS term, min(ts)::DATE AS first, count(*) AS total, count_if(ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent FROM events GROUP BY 1)"


def _probes(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("as_of"))
    return M.probe(e.crossJoin(F.broadcast(last)), "event_type", "ts", F.col("as_of"), 7)  # one row is broadcast


@query("agg7_domain_baseline", f"WITH {_PROBE} SELECT round(avg(recent / total), 6) AS share, max(total) AS total FROM probe WHERE total > 0")
def agg7(spark, d):
    return M.baseline(_probes(spark, d))


@query("agg8_term_probe", f"WITH {_PROBE} SELECT term, strftime(first, '%Y-%m-%d') AS first, total, recent FROM probe")
def agg8(spark, d):
    return _probes(spark, d).withColumn("first", F.date_format("first", "yyyy-MM-dd"))


_SOURCES = "s AS (SELECT o_custkey % 200 AS term, o_orderpriority AS source, count_if(o_orderstatus = 'P') = 0 AS complete, count_if(o_totalprice > 150000) AS total, count_if(o_totalprice > 250000) AS recent FROM orders GROUP BY 1, 2)"


@query("agg9_most_informative", f"WITH {_SOURCES}, r AS (SELECT *, CASE WHEN complete AND total > 0 THEN 0 WHEN complete THEN 1 ELSE 2 END AS c FROM s) SELECT term, source, complete, total, CASE WHEN complete THEN recent END AS recent FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY c, CASE c WHEN 1 THEN 0 ELSE total END DESC, source) = 1")
def agg9(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("term"), F.col("o_orderpriority").alias("source"))
    return M.most_informative(o.agg((F.count_if(F.col("o_orderstatus") == "P") == 0).alias("complete"), F.count_if(F.col("o_totalprice") > 150000).alias("total"), F.count_if(F.col("o_totalprice") > 250000).alias("recent")), "term", "source")


@query("agg10_per_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def agg10(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


_RANKS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@query("agg11_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k FROM events WHERE value IS NOT NULL) SELECT event_type, " + ", ".join(f"max(CASE WHEN i = round_even({p}::DOUBLE * (k - 1), 0) THEN value END) AS {n}" for n, p in _RANKS.items()) + ", max(value) AS most FROM r GROUP BY 1")
def agg11(spark, d):
    return M.nearest_rank(table(spark, d, "events"), "event_type", "value", _RANKS)


@query("agg12_latency", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS k FROM events) SELECT event_type, round(median(value), 6) AS median, max(CASE WHEN i = greatest(95 * k // 100, 1) THEN value END) AS p95, count(*) AS n FROM r GROUP BY 1")
def agg12(spark, d):
    return M.latency(table(spark, d, "events"), "event_type", "value")


_NAME_KEY = "array_to_string(list_sort(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')), ' ')"


@query("agg13_merge_pool", f"SELECT {_NAME_KEY} AS key, count(*)::INT AS n, arg_min(p_type, p_partkey) AS p_type, array_to_string(list_distinct(list(p_brand)), ',') AS x FROM part GROUP BY 1".replace("array_to_string(list_distinct(list(p_brand)), ',') AS x", "count(DISTINCT p_brand)::INT AS brands"))
def agg13(spark, d):
    merged = M.merge_pool(table(spark, d, "part"), text.sorted_key(F.col("p_name")), "p_partkey", ["p_type"], ["p_brand"])
    return merged.select("key", "n", "p_type", F.size("p_brands").alias("brands"))


@query("agg14_keep_first", f"SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY {_NAME_KEY} ORDER BY p_partkey) = 1")
def agg14(spark, d):
    p = table(spark, d, "part").withColumn("key", text.sorted_key(F.col("p_name")))
    return M.keep_first(p, ["key"], ["p_partkey"]).select("p_partkey", "p_name")


@query("agg15_implementers", "SELECT l_partkey AS item, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN lower(trim(s_name)) END) AS implementers, count(DISTINCT s_nationkey) AS domains FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def agg15(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct(F.when(F.col("l_returnflag").isin("A", "R"), F.lower(F.trim("s_name")))).alias("implementers"), F.countDistinct("s_nationkey").alias("domains"))


@query("agg16_newest_event", I.sql("pdates") + "SELECT o_orderpriority, max(d) AS newest, count(DISTINCT d) AS n FROM pdates WHERE d <> 'soon' GROUP BY 1")
def agg16(spark, d):
    return I.partial_dates(spark, d).where("d <> 'soon'").groupBy("o_orderpriority").agg(F.max("d").alias("newest"), F.countDistinct("d").alias("n"))


@query("agg18_documents_per_group", I.sql("docs") + "SELECT g AS lens, coalesce(n, 0) AS n FROM (SELECT unnest(['src0', 'src1', 'src99']) AS g) LEFT JOIN (SELECT source, count(*) AS n FROM docs GROUP BY 1) ON source = g")
def agg18(spark, d):
    groups = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("src0", "src1", "src99")])).alias("lens"))
    n = table(spark, d, "documents").groupBy(F.col("source").alias("lens")).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(n, "lens", "left").select("lens", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("agg19_leaf_coverage", "SELECT p_brand AS leaf, count(DISTINCT p_partkey) AS aliases, count(DISTINCT l_partkey) AS searched, count(l_partkey) AS hits FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY 1")
def agg19(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 49").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    p = table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.groupBy(F.col("p_brand").alias("leaf")).agg(F.count(F.lit(1)).alias("aliases"), F.count("l_partkey").alias("searched"), F.coalesce(F.sum("k"), F.lit(0)).alias("hits"))


@query("agg20_distinctive_terms", "WITH w AS (SELECT * FROM (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) WHERE length(word) >= 4 AND word NOT IN ('with', 'from', 'that', 'this', 'into')), o AS (SELECT lang, word, count(*) AS df FROM w GROUP BY ALL), s AS (SELECT *, round(df / (1 + sum(df) OVER (PARTITION BY word) - df), 6) AS score FROM o) SELECT lang, word, df, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, df DESC, word DESC) AS rank FROM s WHERE df >= 2 QUALIFY rank <= 5")
def agg20(spark, d):
    w = table(spark, d, "documents").select("lang", "doc_id", F.explode(text.tokens(F.col("text"), 3)).alias("word"))
    return M.distinctive(w, "lang", "word", 5)


@query("agg21_consumer_share", I.sql("results") + "SELECT query, round(consumer, 6) AS share FROM gate")
def agg21(spark, d):
    """Of the largest reading of each query."""
    rows = gate.readings(I.results(spark, d)).where("place = 1")
    return rows.groupBy("query").agg(F.round(F.avg(F.col("consumer").cast("double")), 6).alias("share"))


@query("agg22_centroid_cosines", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), u AS (SELECT label, d, x / n AS x FROM m JOIN n USING (label)) SELECT p.label AS a, q.label AS b, round(sum(p.x * q.x), 5) AS cosine FROM u p JOIN u q ON p.d = q.d AND p.label < q.label GROUP BY ALL")
def agg22(spark, d):
    return M.centroid_cosines(table(spark, d, "embeddings"), "label", "embedding")


@query("agg23_repeated_use", "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT o_custkey) AS buyers, count(DISTINCT o_orderpriority) AS owners, count(DISTINCT l_suppkey) >= 3 AND count(DISTINCT o_custkey) >= 2 AND count(DISTINCT o_orderpriority) >= 2 AS repeated FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE date_diff('day', l_shipdate::DATE, DATE '2024-12-31') >= 365 GROUP BY 1")
def agg23(spark, d):
    li = table(spark, d, "lineitem").where(F.datediff(F.lit("2024-12-31").cast("date"), F.col("l_shipdate").cast("date")) >= 365).select("l_orderkey", "l_partkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand")
    out = g.agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("o_custkey").alias("buyers"), F.countDistinct("o_orderpriority").alias("owners"))
    return out.withColumn("repeated", (F.col("suppliers") >= 3) & (F.col("buyers") >= 2) & (F.col("owners") >= 2))


@query("agg24_outcome_summary", "SELECT o_orderpriority AS kind, count_if(o_orderstatus = 'F') AS mature, count_if(o_orderstatus = 'O') AS remaining, count_if(o_orderstatus = 'P') AS unchecked FROM orders GROUP BY 1")
def agg24(spark, d):
    bucket = F.expr("case o_orderstatus when 'F' then 'mature' when 'O' then 'remaining' else 'unchecked' end")
    return M.counts_by(table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), bucket.alias("b")), "kind", "b", ["mature", "remaining", "unchecked"])


@query("agg25_cost_estimate", "SELECT event_type, sum((1.5 + value * 0.000007)::DECIMAL(18, 6)) AS cost, count(*) AS calls FROM events GROUP BY 1".replace("(1.5 + value * 0.000007)::DECIMAL(18, 6)", "(1.5 + floor(value) * 0.25)::DECIMAL(18, 6)"))
def agg25(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum((1.5 + F.floor("value") * 0.25).cast("decimal(18,6)")).alias("cost"), F.count(F.lit(1)).alias("calls"))


_CALLS = "calls AS (SELECT o_orderpriority AS kind, o_totalprice::DECIMAL(18, 2) AS reserved, CASE WHEN o_orderstatus <> 'P' THEN (o_totalprice / 2)::DECIMAL(18, 2) END AS actual, o_orderkey, o_orderdate AS at FROM orders)"


def _calls(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").alias("reserved"), F.when(F.col("o_orderstatus") != "P", (F.floor(F.col("o_totalprice") / 2)).cast("decimal(18,2)")).alias("actual"), "o_orderkey", F.col("o_orderdate").alias("at"))


_CALLS = _CALLS.replace("(o_totalprice / 2)::DECIMAL", "floor(o_totalprice / 2)::DECIMAL")


@query("agg26_budget_statement", f"WITH {_CALLS} SELECT kind, sum(reserved) AS reserved, sum(actual) AS settled, sum(reserved - actual) AS refunded, count_if(actual IS NULL) AS unknown, 1000000000 - sum(coalesce(actual, reserved)) AS remaining FROM calls GROUP BY 1")
def agg26(spark, d):
    return M.statement(_calls(spark, d), F.lit(1_000_000_000))


@query("agg27_runs_affordable", f"WITH {_CALLS}, s AS (SELECT kind, 1000000000 - sum(coalesce(actual, reserved)) AS remaining, avg(reserved) AS cost FROM calls GROUP BY 1) SELECT min(floor(remaining / nullif(cost, 0)))::BIGINT AS runs FROM s")
def agg27(spark, d):
    s = _calls(spark, d).groupBy("kind").agg((F.lit(1_000_000_000) - F.sum(F.coalesce("actual", "reserved"))).alias("remaining"), F.avg("reserved").cast("double").alias("cost"))
    return s.agg(F.min(F.floor(F.col("remaining").cast("double") / F.nullif(F.col("cost"), F.lit(0.0)))).alias("runs"))


@query("agg28_distinct_sources", I.sql("hits") + f"SELECT query, count(DISTINCT lower({_KEY})) AS sources, count_if(position <= 5) AS leading FROM hits GROUP BY 1")
def agg28(spark, d):
    return I.hits(spark, d).groupBy("query").agg(F.countDistinct(F.lower(urls.page_key(F.col("url")))).alias("sources"), F.count_if(F.col("position") <= 5).alias("leading"))


HIGH, LOW = ["example.org"], ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com"]


def _of(names):
    return "(" + " OR ".join(f"host = '{n}' OR host LIKE '%.{n}'" for n in names) + ")"


@query("agg29_card_trust", I.sql("hits") + f"SELECT p AS card, CASE WHEN count(DISTINCT host) = 1 AND bool_or(t = 'low') THEN 'low' WHEN bool_and(t = 'high') THEN 'high' ELSE 'medium' END AS trust FROM (SELECT *, page_id // 2 AS p, CASE WHEN {_of(HIGH)} THEN 'high' WHEN {_of(LOW)} THEN 'low' ELSE 'medium' END AS t FROM (SELECT *, {_HOST} AS host FROM hits)) GROUP BY 1")
def agg29(spark, d):
    h = _hits(spark, d).select(F.floor(F.col("page_id") / 2).alias("card"), "host", urls.trust(F.col("url"), HIGH, LOW).alias("t"))
    trust = F.when((F.countDistinct("host") == 1) & F.bool_or(F.col("t") == "low"), "low").when(F.bool_and(F.col("t") == "high"), "high").otherwise("medium")
    return h.groupBy("card").agg(trust.alias("trust"))


@query("agg30_status_counts", I.sql("candidates") + "SELECT stage AS status, count(*) AS n FROM candidates GROUP BY 1")
def agg30(spark, d):
    return I.candidates(spark, d).groupBy(F.col("stage").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("agg31_extraction_totals", f"SELECT count(*) AS proposed, count(DISTINCT {_NAME_KEY}) AS accepted, count(*) - count(DISTINCT {_NAME_KEY}) AS duplicates, sum(p_size)::BIGINT AS tokens FROM part")
def agg31(spark, d):
    key = text.sorted_key(F.col("p_name"))
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("proposed"), F.countDistinct(key).alias("accepted"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates"), F.sum("p_size").alias("tokens"))


@query("agg32_seed_breadth", I.sql("hits") + f"SELECT query, count(*) AS hits, count(DISTINCT {_HOST}) AS hosts, count(*) >= 6 AND count(DISTINCT {_HOST}) >= 4 AS broad FROM hits GROUP BY 1")
def agg32(spark, d):
    out = _hits(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("host").alias("hosts"))
    return out.withColumn("broad", (F.col("hits") >= 6) & (F.col("hosts") >= 4))


@query("agg33_queue_counters", I.sql("candidates") + "SELECT count_if(stage = 'prototype' AND organizations IS NOT NULL) AS early_cited, count_if(stage = 'unknown') AS unknown, count_if(p_size % 10 = 0) AS outside, count_if(total >= 30) AS confident FROM candidates")
def agg33(spark, d):
    return I.candidates(spark, d).agg(F.count_if((F.col("stage") == "prototype") & F.col("organizations").isNotNull()).alias("early_cited"), F.count_if(F.col("stage") == "unknown").alias("unknown"), F.count_if(F.col("p_size") % 10 == 0).alias("outside"), F.count_if(F.col("total") >= 30).alias("confident"))
