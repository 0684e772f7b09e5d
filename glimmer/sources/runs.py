"""Scans of run tables: JSON lines, catalogues of runs, feeds and stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_json(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A run's JSON lines. Blank lines are no rows; malformed ones are dropped, or fatal if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_folders(rows: DataFrame, path: str) -> None:
    """Lines (run, value) as text files, a folder run=.../ for each run; a run with very many lines is several files."""
    rows.hint("rebalance", "run").write.partitionBy("run").text(path)


def run_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines of many run folders, with `run_id` from the file's path. Blank lines and lines that cannot be read are no rows, whatever columns a query reads."""
    run = F.regexp_extract("_metadata.file_path", r"/run=([^/]+)/[^/]*$", 1)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).withColumn("run_id", run)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, mode, query) of the manifests in run folders that can be read; one that is cut short is no row."""
    return run_rows(spark, path, "mode string, query string").select("run_id", "mode", "query")


def live_runs(manifests: DataFrame) -> DataFrame:
    """Runs whose manifest says that they were live."""
    return manifests.where("mode = 'live'").select("run_id")


def of_live_runs(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    return rows.join(live_runs(manifests), "run_id", "left_semi")


def catalogue(manifests: DataFrame, n: int = 40) -> DataFrame:
    """The newest runs with a readable manifest."""
    return manifests.orderBy(F.desc("run_id")).limit(n)


def reference_items(rows: DataFrame, expected: int = 100) -> DataFrame:
    """Rows (number, area, name) without blank ones; the read fails if there are not exactly `expected`."""
    good = rows.where("trim(coalesce(name, '')) <> ''")
    n = good.agg(F.count(F.lit(1)).alias("_n"))
    checked = n.select(F.assert_true(F.col("_n") == expected, F.lit(f"not exactly {expected} rows")).alias("_ok"), "_n")
    return good.crossJoin(F.broadcast(checked)).where("_n is not null and _ok is null").drop("_n", "_ok")  # one row


_RESULTS = "struct<doc:array<struct<url:string,title:string,passage:array<string>>>>"
_FEED = "struct<entry:array<struct<id:string,title:string,summary:string,published:string>>>"


def search_results(rows: DataFrame, xml: str, count: int, snippet: int = 600) -> DataFrame:
    """(query, position, url, title, snippet) of answers in XML: in order, without those that have no url, the first `count`."""
    docs = rows.select("query", F.posexplode(F.from_xml(xml, _RESULTS)["doc"]).alias("n", "doc")).where("doc.url is not null")
    w = Window.partitionBy("query").orderBy("n")
    hits = docs.select("query", F.row_number().over(w).alias("position"), "doc.url", "doc.title", F.substring(F.array_join("doc.passage", " "), 1, snippet).alias("snippet"))
    return hits.where(F.col("position") <= count)


def feed_entries(rows: DataFrame, xml: str, least_summary: int = 120, least_text: int = 200) -> DataFrame:
    """(query, url, title, text, published) of feeds; entries with short summaries or texts go."""
    e = rows.select("query", F.explode(F.from_xml(xml, _FEED)["entry"]).alias("e")).select("query", F.col("e.id").alias("url"), F.trim("e.title").alias("title"), F.trim("e.summary").alias("summary"), F.substring("e.published", 1, 10).alias("published"))
    text = F.concat_ws("\n\n", "title", "summary")
    return e.where((F.length("summary") >= least_summary) & (F.length(text) >= least_text)).select("query", "url", "title", text.alias("text"), "published")


_WORK = "id string, title string, publication_date string, abstract_inverted_index map<string,array<int>>, authors array<string>"


def works(rows: DataFrame, json: str, least: int = 200, authors: int = 6) -> DataFrame:
    """(id, title, text, published, authors) of scholarly works: abstracts rebuilt, short ones dropped, one of each title."""
    from glimmer.functions.text import from_inverted, sorted_key

    w = rows.select(F.from_json(json, _WORK).alias("w")).select("w.*").withColumn("text", from_inverted(F.col("abstract_inverted_index"))).where(F.length("text") >= least)
    first = F.row_number().over(Window.partitionBy(sorted_key(F.col("title"))).orderBy("id"))
    return w.withColumn("_n", first).where("_n = 1").select("id", "title", "text", F.col("publication_date").alias("published"), F.slice("authors", 1, authors).alias("authors"))


def page_lines(docs: DataFrame, key: str, text: str, lines: int = 40) -> DataFrame:
    """(key, page, line, text) of paged documents: pages of so many lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "text")).select(key, F.floor(F.col("n") / lines).alias("page"), F.col("n").alias("line"), "text")


def without_running_lines(lines: DataFrame, key: str) -> DataFrame:
    """Without lines of 4 to 79 characters that occur max(3, pages / 2) times in a document, and without page numbers."""
    pages = lines.groupBy(key).agg((F.max("page") + 1).alias("pages"))
    often = lines.where(F.length(F.trim("text")).between(4, 79)).groupBy(key, F.trim("text").alias("t")).agg(F.count(F.lit(1)).alias("k")).join(pages, key)
    often = often.where(F.col("k") >= F.greatest(F.lit(3), F.col("pages") / 2)).select(F.col(key).alias("_k"), "t")
    kept = lines.where(~F.trim("text").rlike("^[0-9]+$"))
    return kept.join(often, (F.col(key) == F.col("_k")) & (F.trim("text") == F.col("t")), "left_anti")


def reflowed(lines: DataFrame, key: str) -> DataFrame:
    """(key, paragraph, text): a line goes on if the one before ends with a hyphen or in mid-sentence."""
    w = Window.partitionBy(key).orderBy("line")
    t = F.trim("text")
    before = F.lag(t).over(w)
    goes_on = F.coalesce((before != "") & (t != "") & ~before.rlike(r"[.!?:;]$"), F.lit(False))
    p = lines.withColumn("joined", goes_on).withColumn("paragraph", F.sum((~F.col("joined")).cast("int")).over(w))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", t.alias("t")))), lambda x: x["t"]), " ")
    return p.groupBy(key, "paragraph").agg(F.regexp_replace(whole, r"(\p{L})- (\p{Ll})", "$1$2").alias("text")).where("text <> ''")


def route(content_type: Column, body: Column) -> Column:
    """pdf, html or text by the declared type, else by the first bytes."""
    declared = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(declared.contains("pdf"), "pdf").when(declared.contains("html"), "html").when(body.startswith("%PDF-"), "pdf").when(F.lower(body).contains("<html"), "html").otherwise("text")


def stored_answers(rows: DataFrame, by_id: DataFrame, by_title: DataFrame, default: str) -> DataFrame:
    """Adds `answer` to rows (id, title): by id, else by title, else the default."""
    a, b = by_id.toDF("id", "_a"), by_title.toDF("title", "_b")
    return rows.join(a, "id", "left").join(b, "title", "left").withColumn("answer", F.coalesce("_a", "_b", F.lit(default))).drop("_a", "_b")
