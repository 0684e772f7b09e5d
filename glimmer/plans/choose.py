"""Queries of joins, selection, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions import text, urls
from glimmer.operators import matching, redirects, select
from glimmer.plans import inputs as I
from glimmer.registry import query
from glimmer.session import table, written

_HOST = I.SQL["host"]
_KEY = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')"
_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{s}'" for s in text.STOP_WORDS) + ")))"


# JON1: hits find documents by their url or their final url.
_DOC_URLS = "'https://' || source || '.example.org/' || doc_id"
_D2 = f"d AS (SELECT doc_id, {_DOC_URLS} AS url, CASE WHEN doc_id % 4 = 1 THEN 'https://final.example.org/' || doc_id ELSE {_DOC_URLS} END AS final FROM documents)"
_H2 = f"h AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'https://final.example.org/' || doc_id || '#top' ELSE {_DOC_URLS} || '/' END AS url, 'q' || (doc_id % 7) AS query, (doc_id % 10)::BIGINT AS position FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT {_DOC_URLS}, 'extra', 3 FROM documents WHERE doc_id % 6 = 0)"


@query("jon1_document_contexts", f"WITH {_D2}, {_H2} SELECT d.doc_id, coalesce(string_agg(DISTINCT query, ',' ORDER BY query), 'unassigned') AS queries, coalesce(min(position), 9999) AS position FROM d LEFT JOIN (SELECT {_KEY} AS k, query, position FROM h) hk ON k = d.url OR k = d.final GROUP BY 1")
def jon1(spark, d):
    docs = table(spark, d, "documents")
    u = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id")
    final = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://final.example.org/"), "doc_id")).otherwise(u)
    hit = F.when(F.col("doc_id") % 4 == 1, F.concat(final, F.lit("#top"))).otherwise(F.concat(u, F.lit("/")))
    hits = docs.where("doc_id % 3 <> 2").select(urls.page_key(hit).alias("k"), F.concat(F.lit("q"), F.col("doc_id") % 7).alias("query"), (F.col("doc_id") % 10).alias("position"))
    hits = hits.unionByName(docs.where("doc_id % 6 = 0").select(urls.page_key(u).alias("k"), F.lit("extra").alias("query"), F.lit(3).cast("long").alias("position")))
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.array(u, final))).alias("k"))
    return keys.join(hits, "k", "left").groupBy("doc_id").agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("query")), ","), F.lit("")), F.lit("unassigned")).alias("queries"), F.coalesce(F.min("position"), F.lit(9999).cast("long")).alias("position"))


_MOVED = "CASE WHEN id % 56 IN (48, 49) THEN id + 1 WHEN id % 56 = 50 THEN id - 2 WHEN id % 56 = 51 THEN id - 1 WHEN id % 40 = 13 THEN 13 WHEN id % 56 < 48 AND id % 16 <> 0 THEN id - 1 END"
_ENDS = f"u AS (SELECT p_partkey AS id, p_brand AS leaf, p_size FROM part), r AS (SELECT id AS src, {_MOVED} AS dst FROM u WHERE {_MOVED} <> id), walk AS (SELECT src, dst AS here FROM r UNION SELECT walk.src, r.dst FROM walk JOIN r ON r.src = walk.here), loops AS (SELECT src FROM walk WHERE src = here), ends AS (SELECT src, coalesce(min(here) FILTER (here NOT IN (SELECT src FROM r)), min(here) FILTER (here IN (SELECT src FROM loops))) AS final FROM walk GROUP BY 1), f AS (SELECT u.*, coalesce(final, id) AS final FROM u LEFT JOIN ends ON src = id)"


@query("jon2_leaf_coverage", f"WITH RECURSIVE {_ENDS}, l AS (SELECT DISTINCT leaf, final FROM f WHERE p_size % 3 = 0) SELECT leaf, count(id) FILTER (id % 2 = 0) AS documents, count(id) FILTER (id % 4 = 0) AS extraction, count(id) FILTER (id % 12 = 0) AS candidates FROM l LEFT JOIN f USING (final) GROUP BY 1".replace("l LEFT JOIN f USING (final)", "l LEFT JOIN (SELECT id, final FROM f) USING (final)"))
def jon2(spark, d):
    """Addresses are parts: some end in chains, in loops, before loops, and many at one."""
    u = table(spark, d, "part").select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("leaf"), "p_size")
    ends = redirects.resolved(u.select(F.col("url").alias("src"), F.expr(_MOVED.replace("id", "url")).alias("dst")))
    stages = {name: u.where(F.col("url") % n == 0) for name, n in (("documents", 2), ("extraction", 4), ("candidates", 12))}
    return redirects.leaf_coverage(u.where("p_size % 3 = 0").select("url", "leaf"), stages, ends)


@query("jon3_date_lookup", I.sql("docs") + "SELECT p.page_id, coalesce(a.published_at, b.published_at) AS published_at FROM (SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'https://src' || (page_id % 20) || '.example.org/' || page_id ELSE 'https://src' || (page_id % 20) || '.example.org/' || page_id || '/' END AS url FROM pages) p LEFT JOIN docs a ON a.url = p.url LEFT JOIN docs b ON b.url = regexp_replace(p.url, '/+$', '')")
def jon3(spark, d):
    known = I.docs(spark, d).groupBy("url").agg(F.min_by("published_at", "doc_id").alias("published_at"))  # the first writer wins
    p = table(spark, d, "pages").select("page_id", F.expr("'https://src' || (page_id % 20) || '.example.org/' || page_id || case page_id % 2 when 0 then '' else '/' end").alias("u"))
    a, b = known.toDF("ua", "da"), known.toDF("ub", "db")
    return p.join(a, F.col("u") == F.col("ua"), "left").join(b, urls.page_key(F.col("u")) == F.col("ub"), "left").select("page_id", F.coalesce("da", "db").alias("published_at"))


@query("jon4_stored_answers", "SELECT d.doc_id, coalesce(a.a, b.a, 'none') AS answer FROM documents d LEFT JOIN (SELECT item_id * 3 AS k, 'id ' || item_id AS a FROM benchmark) a ON a.k = d.doc_id LEFT JOIN (SELECT 'src' || item_id AS t, 'title ' || item_id AS a FROM benchmark WHERE item_id < 10) b ON b.t = d.source")
def jon4(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    by_id = b.select((F.col("item_id") * 3).alias("doc_id"), F.concat(F.lit("id "), "item_id").alias("x"))
    by_title = b.where("item_id < 10").select(F.concat(F.lit("src"), "item_id").alias("source"), F.concat(F.lit("title "), "item_id").alias("y"))
    return table(spark, d, "documents").select("doc_id", "source").join(by_id, "doc_id", "left").join(by_title, "source", "left").select("doc_id", F.coalesce("x", "y", F.lit("none")).alias("answer"))


@query("jon5_verbatim_evidence", I.sql("quotes") + "SELECT q.doc_id AS quote_id, d.doc_id FROM quotes q JOIN documents d ON contains(d.text, q.quote) WHERE length(q.quote) >= 20")
def jon5(spark, d):
    q = I.quotes(spark, d).select(F.col("doc_id").alias("quote_id"), "quote")
    return matching.contained(q, table(spark, d, "documents").select("doc_id", "text"))


@query("jon6_unplaced_quotes", I.sql("quotes") + "SELECT q.doc_id, count(DISTINCT o.doc_id) AS others FROM quotes q JOIN quotes o ON trim(regexp_replace(q.quote, '\\s+', ' ', 'g')) = trim(regexp_replace(o.quote, '\\s+', ' ', 'g')) AND o.doc_id <> q.doc_id GROUP BY 1")
def jon6(spark, d):
    q = I.quotes(spark, d).select("doc_id", text.quote_key(F.col("quote")).alias("k")).distinct()
    # Counted by quote, not joined with itself: a quote of very many documents stays one row.
    n = q.groupBy("k").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return q.join(n, "k").groupBy("doc_id").agg(F.sum("others").alias("others"))


@query("jon7_similar_names", f"WITH t AS (SELECT item_id AS id, unnest({_TOK}) AS t, len({_TOK}) AS n FROM benchmark), s AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.t = b.t WHERE a.id <> b.id GROUP BY ALL), r AS (SELECT a, b, round(CASE WHEN i >= 2 THEN i / least(na, nb) ELSE i / (na + nb - i) END, 6) AS score FROM s) SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM r WHERE score >= 0.1 QUALIFY rank <= 2")
def jon7(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    return matching.similar_names(t, t, 0.1, 3).where("a <> b").withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where("rank <= 2")


_STEM = f"list_distinct(list_transform({_TOK}, lambda x: substr(x, 1, 5)))"


def _sim_sql(name, tokens, weight):
    return f"{name}t AS (SELECT item_id AS id, unnest({tokens}) AS t, len({tokens}) AS n FROM benchmark), {name} AS (SELECT a, b, round(CASE WHEN i >= 2 THEN i / least(na, nb) ELSE i / (na + nb - i) END, 6) AS s0, s0 * {weight} AS score FROM (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM {name}t a JOIN {name}t b ON a.t = b.t WHERE a.id <> b.id GROUP BY ALL) WHERE s0 >= 0.1)"


@query("jon8_nearest_candidates", f"WITH {_sim_sql('x', _TOK, 1.0)}, {_sim_sql('y', _STEM, 0.99)} SELECT a, b, round(max(score), 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(max(score), 6) DESC, b) AS rank FROM (SELECT a, b, score FROM x UNION ALL SELECT a, b, score FROM y) GROUP BY a, b QUALIFY rank <= 3")
def jon8(spark, d):
    b = table(spark, d, "benchmark")
    t = b.select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    s = t.select("id", F.array_distinct(F.transform("tokens", lambda x: F.substring(x, 1, 5))).alias("tokens"))
    return matching.nearest_candidates([t, s], [t, s], [1.0, 0.99], 3)


@query("jon9_cosine_pairs", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.4")
def jon9(spark, d):
    return matching.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 6))


@query("jon10_cosine_ranking", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(list_inner_product(v, (SELECT v FROM e WHERE vec_id = 0)), 6) AS cosine FROM e")
def jon10(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot, 6).alias("cosine"))  # one query vector


_FP = "sha256(coalesce('s' || p_name, 'n') || '|' || coalesce('s' || p_size, 'n') || '|')"


@query("jon11_reusable_decisions", f"WITH s AS (SELECT DISTINCT {_FP} AS f FROM part WHERE p_partkey % 5 = 0) SELECT p_partkey, f IS NOT NULL AS reused FROM part LEFT JOIN s ON f = {_FP}")
def jon11(spark, d):
    p = table(spark, d, "part").withColumn("f", text.fingerprint(F.col("p_name"), F.col("p_size")))
    stored = p.where("p_partkey % 5 = 0").select("f").distinct().withColumn("x", F.lit(True))
    return p.join(stored, "f", "left").select("p_partkey", F.col("x").isNotNull().alias("reused"))


@query("jon12_compatible_run", "SELECT o_custkey % 50 AS area, o_orderkey AS run FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') DESC, o_orderkey DESC) = 1")
def jon12(spark, d):
    good = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select((F.col("o_custkey") % 50).alias("area"), F.col("o_orderkey").alias("run"), good.alias("good"))
    return o.withColumn("n", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("good"), F.desc("run")))).where("n = 1").select("area", "run")


@query("jon13_not_excluded", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def jon13(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("jon14_cluster_statistics", "SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_type)) AS members, max(p_size) OVER (PARTITION BY lower(p_type)) AS largest FROM part")
def jon14(spark, d):
    p = table(spark, d, "part")
    stats = p.groupBy(F.lower("p_type").alias("t")).agg(F.count(F.lit(1)).alias("members"), F.max("p_size").alias("largest"))
    return p.join(stats, F.lower("p_type") == F.col("t")).select("p_partkey", "members", "largest")


@query("jon15_area_lookup", "SELECT n_nationkey, min(r_name) AS area FROM nation LEFT JOIN region ON contains(lower(n_name || ' ' || n_regionkey), lower(substr(r_name, 1, 2))) GROUP BY 1")
def jon15(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")  # areas are a fixed short list
    return n.join(F.broadcast(r), F.lower(F.concat("n_name", F.lit(" "), "n_regionkey")).contains(F.lower(F.substring("r_name", 1, 2))), "left").groupBy("n_nationkey").agg(F.min("r_name").alias("area"))


@query("jon16_host_overlap", I.sql("hits") + f"SELECT host, count(DISTINCT query) AS queries FROM (SELECT *, {_HOST} AS host FROM hits) WHERE host IN (SELECT DISTINCT {_HOST} FROM hits WHERE lens = 'standard') GROUP BY 1")
def jon16(spark, d):
    h = I.hits(spark, d).withColumn("host", urls.host(F.col("url")))
    return h.join(h.where("lens = 'standard'").select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.countDistinct("query").alias("queries"))


_SEEN = "regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || substr(regexp_extract(html, '<p>([^<]*)', 1), 1, 600) AS text"


@query(
    "jon16_reference_rows",
    f"WITH r AS (SELECT item_id, unnest({_TOK}) AS t, len({_TOK}) AS na FROM benchmark), h AS (SELECT page_id, url, {_SEEN} FROM pages), p AS (SELECT page_id, url, unnest({_TOK}) AS t, len({_TOK}) AS nb FROM h), s AS (SELECT item_id, page_id, url, na, nb, count(*) AS i FROM r JOIN p ON r.t = p.t GROUP BY ALL), x AS (SELECT *, round(CASE WHEN i >= 2 THEN i / least(na, nb) ELSE i / (na + nb - i) END, 6) AS score FROM s) SELECT item_id, count(*) AS hits, min(page_id) AS page_id, arg_min(url, page_id) AS url, arg_min(score, page_id) AS score FROM x WHERE score >= 0.34 GROUP BY 1",
)
def jon16_rows(spark, d):
    """Reference rows (the benchmark's items) that are seen in titles and snippets of results, with the first of these."""
    found = table(spark, d, "pages").select("page_id", "url", F.expr(_SEEN))
    titles = found.select(F.col("page_id").alias("position"), "url", text.tokens(F.col("text")).alias("tokens"))
    reference = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    return matching.first_mentions(reference, titles).select(F.col("a").alias("item_id"), "hits", F.col("position").alias("page_id"), "url", "score")


@query("jon17_surviving_source", I.sql("hits") + f"SELECT page_id, min(page_id) OVER (PARTITION BY lower({_KEY})) AS source_id FROM hits")
def jon17(spark, d):
    h = I.hits(spark, d).select("page_id", F.lower(urls.page_key(F.col("url"))).alias("k"))
    return h.join(h.groupBy("k").agg(F.min("page_id").alias("source_id")), "k").select("page_id", "source_id")


@query(
    "win1_fair_urls",
    I.sql("hits") + f", o AS (SELECT *, {_KEY} AS k, {_HOST} AS owner, row_number() OVER (PARTITION BY query ORDER BY position, {_KEY}) AS depth FROM hits), u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY depth, query) = 1), c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY owner ORDER BY depth, query) <= 2 OR any_value(owner LIKE '%.org') OVER (PARTITION BY page_id)) SELECT page_id, query, depth FROM c ORDER BY depth, query LIMIT 100",
)
def win1(spark, d):
    h = I.hits(spark, d).select("page_id", "query", F.col("query").alias("first_seen"), "position", urls.page_key(F.col("url")).alias("url_key"), urls.host(F.col("url")).alias("owner"))
    return select.fair_urls(h, 2, 100, "owner like '%.org'").select("page_id", "query", F.col("depth").cast("long").alias("depth"))


# Sub-segments are parts, a third with a Russian name too; three lenses each: the primary one, then two of the others in turn.
_PRIMARY, _OTHERS = "product", ["funding", "standard", "research"]


@query(
    "win2_query_plan",
    f"WITH e AS (SELECT p_partkey, 'en' AS lang, CASE k WHEN 0 THEN '{_PRIMARY}' ELSE ({_OTHERS})[(p_partkey + k - 1) % 3 + 1] END AS lens, k AS depth FROM part, (SELECT unnest(range(3)) AS k)), r AS (SELECT p_partkey, 'ru' AS lang, '{_PRIMARY}' AS lens, 0 AS depth FROM part WHERE p_partkey % 3 = 0 ORDER BY p_partkey LIMIT 200) SELECT * FROM (SELECT * FROM e ORDER BY depth, p_partkey LIMIT 1000 - (SELECT count(*) FROM r)) UNION ALL SELECT * FROM r",
)
def win2(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    return select.query_plan(p, "p_partkey", F.col("p_partkey") % 3 == 0, _PRIMARY, _OTHERS, 1000)


_LEAF = "p_brand AS leaf, lower(p_name) AS q, min(p_partkey) AS k"


@query("win3_tree_plan", f"WITH v AS (SELECT {_LEAF} FROM part GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY k) AS depth FROM v QUALIFY depth <= 3), o AS (SELECT *, CASE WHEN depth = 3 OR (depth = 2 AND regexp_extract(leaf, '[0-9]+')::INT % 3 = 0) THEN 'research' ELSE 'mechanism' END AS lens FROM n) SELECT leaf, q AS query, lens, depth FROM o QUALIFY row_number() OVER (PARTITION BY q, lens ORDER BY depth, leaf) = 1 ORDER BY depth, leaf LIMIT 60")
def win3(spark, d):
    """One query for each leaf before any second; the same words can be asked once with each lens."""
    v = table(spark, d, "part").groupBy(F.col("p_brand").alias("leaf"), F.lower("p_name").alias("query")).agg(F.min("p_partkey").alias("k"))
    n = v.withColumn("depth", F.row_number().over(Window.partitionBy("leaf").orderBy("k")).cast("long")).where("depth <= 3")
    research = (F.col("depth") == 3) | ((F.col("depth") == 2) & (F.regexp_extract("leaf", "[0-9]+", 0).cast("int") % 3 == 0))
    n = n.withColumn("lens", F.when(research, "research").otherwise("mechanism"))
    u = n.withColumn("u", F.row_number().over(Window.partitionBy("query", "lens").orderBy("depth", "leaf"))).where("u = 1")
    return u.select("leaf", "query", "lens", "depth").orderBy("depth", "leaf").limit(60)


@query("win4_interleaved", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part")
def win4(spark, d):
    return select.interleaved(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", F.col("turn").cast("long").alias("turn"))


@query("win5_evidence_pick")
def win5(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("card"), F.col("l_returnflag").alias("query"), F.col("l_linenumber").cast("long").alias("rank"), (F.col("l_suppkey") % 10).alias("owner"), F.col("l_orderkey").alias("id"))
    return select.picked(li, 2)


@query("win6_daily_quota", "WITH c AS (SELECT event_id, ts::DATE AS day, user_id, ts FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts, event_id) <= 2 AS own FROM c) SELECT event_id, own AND sum(own::INT) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 100 AS ok FROM o")
def win6(spark, d):
    c = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("caller"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return select.admitted(c, 2, 100).select(F.col("id").alias("event_id"), "ok")


@query("win7_check_budget", I.sql("candidates") + "SELECT p_partkey, CASE WHEN stage <> 'scaled' THEN 'known' WHEN sum((stage = 'scaled')::INT) OVER (PARTITION BY object ORDER BY total DESC, p_partkey ROWS UNBOUNDED PRECEDING) <= 5 THEN 'checked' ELSE 'unchecked' END AS state FROM candidates")
def win7(spark, d):
    need = F.col("stage") == "scaled"
    nth = F.sum(need.cast("int")).over(Window.partitionBy("object").orderBy(F.desc("total"), "p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    return I.candidates(spark, d).select("p_partkey", F.when(~need, "known").when(nth <= 5, "checked").otherwise("unchecked").alias("state"))


@query("win8_batches", "WITH n AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 12 AS batch FROM part) SELECT p_brand, batch, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS items FROM n GROUP BY ALL")
def win8(spark, d):
    return select.batches(table(spark, d, "part"), "p_brand", "p_partkey", 12).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("win9_context_windows")
def win9(spark, d):
    return select.contexts(table(spark, d, "documents"), "doc_id", "text", r"(?i)\b(?:licensed|released|token)\b")


@query("win10_passages")
def win10(spark, d):
    return select.passages(table(spark, d, "documents"), "doc_id", "text").withColumn("passage", F.sha2("passage", 256))


def plan_of_reading(spark, d):
    """Passages of each document, asked for with the benchmark item of the same number."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.array("text").alias("queries"))
    return select.reading_plan(docs.join(items, F.col("doc_id") == F.col("item_id"), "left").select("doc_id", "text", "queries"), "doc_id", "text", "queries")


@query("win11_passage_scores")
def win11(spark, d):
    """The passages that are read: the opening, relevant ones, then novel ones."""
    return plan_of_reading(spark, d).where("shown").select("doc_id", "n", F.round("score", 6).alias("score"))


@query("win12_unread_sections")
def win12(spark, d):
    """Unread passages with many words that the read ones lack, the most novel first."""
    return plan_of_reading(spark, d).where("unread is not null").select("doc_id", "n", F.round("fresh", 6).alias("share"), F.col("unread").alias("rank"))


def runs_of_documents(spark, d):
    """Documents in sixteen runs, grouped by language."""
    return table(spark, d, "documents").select(F.concat(F.lit("r"), F.col("doc_id") % 16).alias("run"), F.col("lang").alias("group"), F.size(text.tokens(F.col("text"))).cast("double").alias("score"), F.sha2("text", 256).alias("sha"), "source", F.col("doc_id").alias("id"))


@query("win13_balanced_selection")
def win13(spark, d):
    return select.balanced(runs_of_documents(spark, d), 20, 3)


@query(
    "win14_running_spend",
    "WITH RECURSIVE n AS (SELECT o_orderkey, o_orderpriority AS kind, o_totalprice::DECIMAL(18, 2) AS amount, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders), r(k, kind, o_orderkey, total, within) AS (SELECT k, kind, o_orderkey, CASE WHEN amount <= 5000000 THEN amount ELSE 0 END::DECIMAL(18, 2), amount <= 5000000 FROM n WHERE k = 1 UNION ALL SELECT n.k, n.kind, n.o_orderkey, (r.total + CASE WHEN r.total + n.amount <= 5000000 THEN n.amount ELSE 0 END)::DECIMAL(18, 2), r.total + n.amount <= 5000000 FROM r JOIN n ON n.kind = r.kind AND n.k = r.k + 1) SELECT o_orderkey, CASE WHEN within THEN total END AS spent, within FROM r",
)
def win14(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return select.within_budget(c, 5_000_000).select(F.col("id").alias("o_orderkey"), "spent", "within")


_STAGE_CLASS = "CASE stage WHEN 'idea' THEN 3 WHEN 'prototype' THEN 2 WHEN 'pilot' THEN 2 WHEN 'scaled' THEN 0 ELSE 1 END"


@query("top1_working_order", I.sql("candidates") + f"SELECT p_partkey, row_number() OVER (PARTITION BY object ORDER BY (p_size % 10 <> 0) DESC, {_STAGE_CLASS} DESC, (organizations IS NOT NULL) DESC, total DESC, p_partkey) AS place FROM candidates")
def top1(spark, d):
    order = [F.desc(F.col("p_size") % 10 != 0), F.desc(F.expr(_STAGE_CLASS)), F.desc(F.col("organizations").isNotNull()), F.desc("total"), F.col("p_partkey")]
    return select.placed(I.candidates(spark, d).select("p_partkey", "p_size", "stage", "organizations", "total", "object"), "object", order).select("p_partkey", "place")


@query("top2_investigation_order", I.sql("candidates") + "SELECT p_partkey, row_number() OVER (PARTITION BY object ORDER BY (p_size % 10 <> 0) DESC, (stage = 'scaled') DESC, p_partkey) AS place FROM candidates")
def top2(spark, d):
    order = [F.desc(F.col("p_size") % 10 != 0), F.desc(F.col("stage") == "scaled"), F.col("p_partkey")]
    return select.placed(I.candidates(spark, d).select("p_partkey", "p_size", "stage", "object"), "object", order).select("p_partkey", "place")


@query("top3_final_cards", I.sql("candidates") + ", a AS (SELECT *, stage = 'idea' AS absorbed FROM candidates), r AS (SELECT p_partkey, object, absorbed, row_number() OVER (PARTITION BY object, absorbed ORDER BY total DESC, p_partkey) AS n FROM a) SELECT p_partkey, CASE WHEN absorbed THEN 'absorbed' WHEN n <= 15 THEN 'shown' ELSE 'below_the_cut' END AS state FROM r")
def top3(spark, d):
    absorbed = F.col("stage") == "idea"
    n = F.row_number().over(Window.partitionBy("object", absorbed).orderBy(F.desc("total"), "p_partkey"))
    return I.candidates(spark, d).select("p_partkey", F.when(absorbed, "absorbed").when(n <= 15, "shown").otherwise("below_the_cut").alias("state"))


@query("top4_best_of_pool", I.sql("candidates") + "SELECT p_partkey, total FROM candidates WHERE total >= 20 ORDER BY total DESC, p_partkey LIMIT 25")
def top4(spark, d):
    return I.candidates(spark, d).where("total >= 20").select("p_partkey", "total").orderBy(F.desc("total"), "p_partkey").limit(25)


@query("top5_rejected_list", I.sql("candidates") + "SELECT p_partkey, total, (SELECT count(*) FROM candidates WHERE stage = 'scaled') AS rejected FROM candidates WHERE stage = 'scaled' ORDER BY total DESC, p_partkey LIMIT 60")
def top5(spark, d):
    r = I.candidates(spark, d).where("stage = 'scaled'").select("p_partkey", "total")
    return r.orderBy(F.desc("total"), "p_partkey").limit(60).crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("rejected"))))


@query("top6_continuations", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 40) DESC, p_partkey) <= 4")
def top6(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") > 40), "p_partkey")
    return table(spark, d, "part").withColumn("n", F.row_number().over(w)).where("n <= 4").select("p_brand", "p_partkey")


_LEAVES = "v AS (SELECT p_brand AS leaf, p_name AS name, min(p_partkey) AS k, count_if(p_size = 1) AS hits FROM part GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY k) AS i, sum(hits) OVER (PARTITION BY leaf) AS found FROM v QUALIFY i <= 3), q AS (SELECT leaf, coalesce(arg_min(name, i) FILTER (i > 1 AND k % 3 = 0), array_to_string(list_slice(string_split(max(name) FILTER (i = 1), ' '), 1, 6), ' ') || ' research prototype') AS query FROM n WHERE found < 3 GROUP BY leaf)"


@query(
    "top7_recovery_queries",
    f"WITH {_LEAVES}, u AS (SELECT leaf, count_if(k % 3 <> 0) + (leaf IN (SELECT leaf FROM q))::INT AS used FROM v GROUP BY 1), w AS (SELECT v.leaf, v.name, used + row_number() OVER (PARTITION BY v.leaf ORDER BY v.k, v.name) AS level FROM v JOIN u USING (leaf) WHERE v.k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM q WHERE q.leaf = v.leaf AND q.query = v.name)) SELECT leaf, query, 'recovery' AS kind FROM q UNION ALL SELECT leaf, name, 'variant' FROM (SELECT * FROM w ORDER BY level, leaf LIMIT 40)",
)
def top7(spark, d):
    """A leaf with under three hits is asked with its first alias that was not used, else with the first six words of its name and a suffix. Every third alias
    was not used; forty of those left follow, each time one of the leaf that is used least."""
    v = table(spark, d, "part").groupBy(F.col("p_brand").alias("leaf"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"), F.count_if(F.col("p_size") == 1).alias("hits"))
    v = written(v, "variants")
    few = v.groupBy("leaf").agg(F.sum("hits").alias("found")).where("found < 3").select("leaf")
    n = v.join(few, "leaf").withColumn("i", F.row_number().over(Window.partitionBy("leaf").orderBy("k"))).where("i <= 3")
    unused = F.when((F.col("i") > 1) & (F.col("k") % 3 == 0), F.col("i"))
    own = F.max(F.when(F.col("i") == 1, F.col("name")))
    g = n.groupBy("leaf").agg(F.min_by(F.when(unused.isNotNull(), F.col("name")), unused).alias("alias"), own.alias("own"))
    q = g.select("leaf", F.coalesce("alias", F.concat(F.array_join(F.slice(F.split("own", " "), 1, 6), " "), F.lit(" research prototype"))).alias("query"))
    used = v.groupBy("leaf").agg(F.count_if(F.col("k") % 3 != 0).alias("used")).join(q.select("leaf", F.lit(1).alias("asked")), "leaf", "left")
    used = used.select("leaf", (F.col("used") + F.coalesce("asked", F.lit(0))).alias("used"))
    rest = v.where("k % 3 = 0").join(q.select("leaf", F.col("query").alias("name")), ["leaf", "name"], "left_anti").join(used, "leaf")
    more = select.least_used(rest.select("leaf", "name", "k", "used"), "leaf", "used", ["k", "name"], 40)
    return q.select("leaf", "query", F.lit("recovery").alias("kind")).unionByName(more.select("leaf", F.col("name").alias("query"), F.lit("variant").alias("kind")))


@query("top8_best_per_feature", I.sql("candidates") + "SELECT object, max(total) AS total, min(event_date) AS event_date, max(len(organizations))::INT AS players FROM candidates GROUP BY 1")
def top8(spark, d):
    return I.candidates(spark, d).groupBy("object").agg(F.max("total").alias("total"), F.min("event_date").alias("event_date"), F.max(F.when(F.col("organizations").isNotNull(), F.size("organizations"))).alias("players"))


@query("top9_search_phrase", f"WITH w AS (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), 1) AS p FROM benchmark) GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM w GROUP BY 1), r AS (SELECT item_id, w, p FROM w JOIN f USING (w) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, p) <= 4) SELECT item_id, string_agg(w, ' ' ORDER BY p) AS phrase FROM r GROUP BY 1")
def top9(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(text.words(F.col("text"))).alias("p", "w")).groupBy("item_id", "w").agg(F.min("p").alias("p"))
    df = w.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    r = w.join(df, "w").withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "p"))).where("n <= 4")
    return r.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias("phrase"))


@query("set1_union_of_evidence", "SELECT kind, count(*) AS n FROM (SELECT 'page' AS kind FROM pages UNION ALL SELECT 'document' FROM documents UNION ALL SELECT 'item' FROM benchmark) GROUP BY 1")
def set1(spark, d):
    parts = [table(spark, d, t).select(F.lit(k).alias("kind")) for k, t in (("page", "pages"), ("document", "documents"), ("item", "benchmark"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("set2_shared_hosts", I.sql("hits") + f"SELECT {_HOST} AS host FROM hits WHERE lens = 'product' INTERSECT SELECT {_HOST} FROM hits WHERE lens = 'funding'")
def set2(spark, d):
    h = I.hits(spark, d).withColumn("host", urls.host(F.col("url")))
    return h.where("lens = 'product'").select("host").intersect(h.where("lens = 'funding'").select("host"))


@query("set3_symmetric_difference", "SELECT item_id, array_to_string(list_sort(list_concat(list_filter(x, lambda t: NOT list_contains(y, t)), list_filter(y, lambda t: NOT list_contains(x, t)))), ' ') AS terms FROM (SELECT a.item_id, a.x, b.x AS y FROM (SELECT item_id, " + _TOK + " AS x FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, " + _TOK + " AS x FROM benchmark) b USING (item_id))")
def set3(spark, d):
    t = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("x"))
    o = t.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return t.join(o, "item_id").select("item_id", F.array_join(F.array_sort(F.concat(F.array_except("x", "y"), F.array_except("y", "x"))), " ").alias("terms"))


@query("set4_unmatched", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set4(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("set5_distinct_in_order", "SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: [lpad(list_position(w, x)::VARCHAR, 9, '0'), x])), lambda x: x[2]), ' ') AS words FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark)")
def set5(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(text.words(F.col("text"))), " ").alias("words"))
