"""Queries of scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions import text
from glimmer.operators import growth
from glimmer.plans import inputs as I
from glimmer.registry import query
from glimmer.session import new_path, table
from glimmer.sources import html, runs, sinks
from glimmer.streaming import admission


@query("src1_scan_json", "SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def src1(spark, d):
    """Events as JSON lines, every tenth cut short: it is dropped."""
    path = new_path(spark, "json")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return runs.scan_json(spark, path, "event_id long, event_type string, value double")


# Runs are months of shipment: a folder each, with its rows; a month of orders has a manifest, in every fifth of a fixture, every seventh cut short.
_MONTH = "year({0}) * 12 + month({0})"
_MANIFESTS = f"m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS run_id, {_MONTH.format('o_orderdate')} AS m FROM orders)"


def _run_folders(spark, d):
    """Folders run=.../ of rows and of manifests, written as files; every fourth row is cut short."""
    rows, manifests = new_path(spark, "run-rows"), new_path(spark, "run-manifests")
    line = F.to_json(F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    runs.write_folders(table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("run"), F.when(F.col("l_linenumber") % 4 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")), rows)
    months = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.expr(_MONTH.format("o_orderdate")).alias("m")).distinct()
    line = F.to_json(F.struct(F.when(F.col("m") % 5 == 0, "fixture").otherwise("live").alias("mode"), F.concat(F.lit("orders of "), "run").alias("query")))
    runs.write_folders(months.select("run", F.when(F.col("m") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")), manifests)
    return rows, runs.manifests(spark, manifests)


@query("src2_live_runs", f"WITH {_MANIFESTS} SELECT run_id, count(*) AS rows, sum(l_quantity) AS quantity FROM (SELECT strftime(l_shipdate, '%Y-%m') AS run_id, l_quantity FROM lineitem WHERE l_linenumber % 4 <> 0) JOIN m USING (run_id) WHERE m % 5 <> 0 AND m % 7 <> 0 GROUP BY 1")
def src2(spark, d):
    """Rows of all runs, kept if the run has a manifest that can be read and says that it was live."""
    rows, manifests = _run_folders(spark, d)
    return runs.of_live_runs(runs.run_rows(spark, rows, "l_orderkey long, l_linenumber int, l_quantity double"), manifests).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("src3_run_catalogue", f"WITH {_MANIFESTS} SELECT run_id, CASE WHEN m % 5 = 0 THEN 'fixture' ELSE 'live' END AS mode, 'orders of ' || run_id AS query FROM m WHERE m % 7 <> 0 ORDER BY 1 DESC LIMIT 40")
def src3(spark, d):
    """The newest 40 runs whose manifest can be read."""
    return runs.catalogue(_run_folders(spark, d)[1])


@query("src4_reference_items", "SELECT n_nationkey AS number, r_name AS area, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src4(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return runs.reference_items(n.select(F.col("n_nationkey").alias("number"), F.col("r_name").alias("area"), F.col("n_name").alias("name")), 25)


@query("src5_search_results", I.sql("hits") + "SELECT query, row_number() OVER (PARTITION BY query ORDER BY page_id) AS position, url FROM hits WHERE page_id % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY page_id) <= 10")
def src5(spark, d):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    doc = F.concat(F.lit("<doc>"), F.when(F.col("page_id") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("<url>"), esc(F.col("url")), F.lit("</url>"))), F.lit("<title>t</title><passage>one</passage><passage>two</passage></doc>"))
    docs = I.hits(spark, d).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("page_id", doc.alias("x")))).alias("r"))
    xml = docs.select("query", F.concat(F.lit("<r>"), F.array_join(F.transform("r", lambda r: r["x"]), ""), F.lit("</r>")).alias("xml"))
    return runs.search_results(xml, "xml", 10).select("query", F.col("position").cast("long").alias("position"), "url")


@query("src6_feed_entries", "SELECT 'q' || (item_id % 5) AS query, 'urn:' || item_id AS url FROM benchmark WHERE length(trim(text)) >= 120 AND length('paper ' || item_id) + 2 + length(trim(text)) >= 200")
def src6(spark, d):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    e = F.concat(F.lit("<entry><id>urn:"), "item_id", F.lit("</id><title>paper "), "item_id", F.lit("</title><summary>"), esc(F.col("text")), F.lit("</summary><published>2024-02-03T00:00:00Z</published></entry>"))
    feeds = table(spark, d, "benchmark").groupBy(F.concat(F.lit("q"), F.col("item_id") % 5).alias("query")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(e), ""), F.lit("</feed>")).alias("xml"))
    return runs.feed_entries(feeds, "xml").select("query", "url")


@query("src7_works", "SELECT 'W' || min(item_id) AS id FROM benchmark WHERE length(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')) >= 200 GROUP BY item_id // 2".replace("'W' || min(item_id) AS id", "min('W' || item_id) AS id"))
def src7(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
    index = w.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("abstract_inverted_index"))
    json = index.select(F.to_json(F.struct(F.concat(F.lit("W"), "item_id").alias("id"), F.concat(F.lit("title "), F.floor(F.col("item_id") / 2)).alias("title"), F.lit("2024-01-02").alias("publication_date"), "abstract_inverted_index", F.array(F.lit("a")).alias("authors"))).alias("json"))
    return runs.works(json, "json").select("id")


@query("src8_html_documents")
def src8(spark, d):
    return html.documents(table(spark, d, "pages"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents), g AS (SELECT doc_id, line, text, line // 40 AS page FROM l)"


@query("src9_running_lines", f"WITH {_LINES}, o AS (SELECT doc_id, trim(text) AS t, count(*) AS k FROM g WHERE length(trim(text)) BETWEEN 4 AND 79 GROUP BY ALL), n AS (SELECT doc_id, max(page) + 1 AS pages FROM g GROUP BY 1), bad AS (SELECT doc_id, t FROM o JOIN n USING (doc_id) WHERE k >= greatest(3, pages / 2)) SELECT g.doc_id, count(*) AS lines FROM g LEFT JOIN bad ON g.doc_id = bad.doc_id AND trim(g.text) = bad.t WHERE bad.t IS NULL AND NOT regexp_matches(trim(g.text), '^[0-9]+$') GROUP BY 1")
def src9(spark, d):
    lines = runs.page_lines(table(spark, d, "documents"), "doc_id", "text")
    return runs.without_running_lines(lines, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query("src10_reflowed")
def src10(spark, d):
    return runs.reflowed(runs.page_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id").withColumn("text", F.sha2("text", 256))


@query("src11_routes", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'html' WHEN page_id % 5 = 2 THEN 'pdf' WHEN contains(lower(html), '<html') THEN 'html' ELSE 'text' END AS route FROM pages")
def src11(spark, d):
    p = table(spark, d, "pages")
    declared = F.when(F.col("page_id") % 5 == 0, F.lit("application/PDF")).when(F.col("page_id") % 5 == 1, F.lit("text/html"))
    body = F.when(F.col("page_id") % 5 == 2, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html"))
    return p.select("page_id", runs.route(declared, body).alias("route"))


@query("src12_stored_answers", "SELECT d.doc_id, coalesce(a.text, b.text, 'no answer') AS answer FROM documents d LEFT JOIN benchmark a ON a.item_id = d.doc_id LEFT JOIN (SELECT 'src' || item_id AS source, text FROM benchmark) b USING (source)")
def src12(spark, d):
    b = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    out = runs.stored_answers(docs, b.select("item_id", "text"), b.select(F.concat(F.lit("src"), "item_id"), "text"), "no answer")
    return out.select(F.col("id").alias("doc_id"), "answer")


@query("snk1_stage_table", I.sql("hits") + "SELECT query AS run_id, count(*) AS rows FROM hits GROUP BY 1")
def snk1(spark, d):
    path = new_path(spark, "stage")
    sinks.write_stage(I.hits(spark, d).withColumnRenamed("query", "run_id"), path)
    return sinks.read_stage(spark, path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("rows"))


@query("snk2_partial_tables", I.sql("hits") + "SELECT lens AS run_id, count(*) AS rows FROM hits GROUP BY 1")
def snk2(spark, d):
    """Two packets of a run, each written as it is done: what is there can be read at any time."""
    path = new_path(spark, "partial")
    h = I.hits(spark, d).withColumnRenamed("lens", "run_id")
    sinks.append_packet(h.where("position <= 10"), path, 0)
    sinks.append_packet(h.where("position > 10"), path, 1)
    return sinks.read_stage(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query("snk3_versioned_results", "SELECT p_partkey FROM part WHERE p_size % 3 = 2 OR p_size % 3 = 0")
def snk3(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3).alias("version"))
    return sinks.of_version(v, 2, legacy=True).select("p_partkey")


@query("snk4_review_round_trip", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS decision FROM part")
def snk4(spark, d):
    path = new_path(spark, "review")
    pairs = sinks.reviews(table(spark, d, "part").select("p_partkey"))
    pairs.where("p_partkey % 3 = 0").withColumn("decision", F.lit("accepted")).write.parquet(path)
    return sinks.reviewed(pairs.drop("decision"), spark.read.parquet(path), ["p_partkey"]).select("p_partkey", "decision")


@query("snk5_flat_export", "SELECT p_brand AS run, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_partkey AS id, 'card' AS kind FROM part WHERE p_size > 10 UNION ALL SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_partkey, 'excluded' FROM part WHERE p_size <= 10 QUALIFY n <= 12")
def snk5(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("id"), "p_size")
    return sinks.flat_export(p.where("p_size > 10"), p.where("p_size <= 10"))


def _stream(spark, d):
    return spark.readStream.schema(admission.EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)


@query("st1_daily_admission", "WITH c AS (SELECT event_id, ts::DATE AS day, user_id, ts FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts, event_id) <= 2 AS own FROM c) SELECT event_id, own AND sum(own::INT) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 100 AS ok FROM o")
def st1(spark, d):
    path = new_path(spark, "admitted")
    admission.admit(_stream(spark, d), path, new_path(spark, "stream"), 2, 100).awaitTermination()
    return spark.read.parquet(path).select(F.col("id").alias("event_id"), "ok")


_FOLD = "list_reduce(list(m ORDER BY seen_at, id), lambda a, x: CASE WHEN a <> '' AND length(x) > length(a) AND contains(lower(x), lower(a)) THEN x ELSE a END)"
HEADS_SQL = f"SELECT key, {_FOLD} AS mechanism, arg_min(event_date, (seen_at, id)) FILTER (event_date IS NOT NULL) AS event_date, count(*) AS proposed, 1::BIGINT AS accepted, count(*) - 1 AS duplicates, count(DISTINCT evidence) - count_if(f AND evidence IS NOT NULL)::BIGINT AS evidence_from_duplicates FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen_at, id) = 1 AS f FROM p) GROUP BY 1"
_TERMS = "Cooling by a film of water under the plate"


def proposals(spark, d):
    """Proposals from events: five keys, mechanisms that grow, others that do not belong to them, some without evidence or date."""
    m = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("other "), F.col("user_id") % 5)).otherwise(F.substring(F.lit(_TERMS), F.lit(1), (F.col("event_id") % 29 + F.floor(F.col("event_id") / 1000) + 4).cast("int")))
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.when(F.col("user_id") % 4 != 0, F.concat_ws(":", "user_id", "props")).alias("evidence"), m.alias("mechanism"), day.alias("event_date"))


_PROPOSALS = f"WITH p AS (SELECT event_type AS key, ts AS seen_at, event_id AS id, CASE WHEN user_id % 4 <> 0 THEN user_id || ':' || props END AS evidence, CASE WHEN user_id % 7 = 0 THEN 'other ' || (user_id % 5) ELSE substr('{_TERMS}', 1, (event_id % 29 + event_id // 1000 + 4)::INT) END AS m, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS event_date FROM events) "


@query("st2_evidence_across_packets", _PROPOSALS + HEADS_SQL)
def st2(spark, d):
    """Packets are quarters of the events by time, or nearly (a sketch of bounded size tells the cuts; what is accepted does not depend on them), written to a source that grows; after each one the stream goes on from its checkpoint."""
    rows, source, path = proposals(spark, d), new_path(spark, "packets"), new_path(spark, "evidence")
    cuts = rows.agg(F.percentile_approx(F.unix_micros("at"), [0.25, 0.5, 0.75], 10_000)).first()[0]
    no = sum(((F.unix_micros("at") > c).cast("int") for c in cuts or []), F.lit(0))
    stream = spark.readStream.schema(rows.schema).parquet
    state = new_path(spark, "stream")
    for k in range(4):
        rows.where(no == k).write.mode("append").parquet(source)
        admission.merge_evidence(stream(source), path, state).awaitTermination()
    return admission.heads_of(spark, path)


@query("sc0_terms_of_documents", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 3))), ' ') AS terms FROM documents")
def sc0(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(text.words(F.col("text")), lambda w: F.length(w) > 3))), " ").alias("terms"))
