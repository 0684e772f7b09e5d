"""Queries of evidence checks, decision tables, entity resolution and text mining."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions import dates, text, urls
from glimmer.operators import decide, gate, growth, matching, resolve
from glimmer.operators.components import connected_components
from glimmer.plans import inputs as I
from glimmer.plans.choose import plan_of_reading
from glimmer.plans.scans import HEADS_SQL
from glimmer.registry import query
from glimmer.session import new_path, table, written

_HOST = I.SQL["host"]
_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query("flt1_content_gate", "SELECT doc_id, length(t) >= 160 AND len(list_distinct(list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 4))) >= 6 AS useful FROM (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), 'licensed under|released under|license')), chr(10)) AS t FROM documents)")
def flt1(spark, d):
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.lower(x).rlike("licensed under|released under|license")), "\n")
    docs = table(spark, d, "documents").select("doc_id", kept.alias("t"))
    return docs.select("doc_id", ((F.length("t") >= 160) & (F.size(F.array_distinct(F.filter(text.words(F.col("t")), lambda w: F.length(w) >= 4))) >= 6)).alias("useful"))


@query("flt2_recency", I.sql("docs") + "SELECT doc_id, CASE WHEN published_at < '2024-06-01' THEN 'older_than_cutoff' END AS reason FROM docs")
def flt2(spark, d):
    return I.docs(spark, d).select("doc_id", F.when(F.col("published_at") < "2024-06-01", "older_than_cutoff").alias("reason"))


_ROOTS = "list_filter(list_transform(regexp_extract_all(lower(p_type), '[a-z]+'), lambda x: substr(x, 1, 5)), lambda x: length(x) >= 5)"


@query("flt3_anchor_filter", f"WITH a AS (SELECT p_partkey, p_brand, len(list_filter({_ROOTS}, lambda r: contains('standard economy goods', r))) > 0 AS hit FROM part), n AS (SELECT *, count_if(hit) OVER (PARTITION BY p_brand) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM a) SELECT p_partkey, hit OR k < greatest(4, n / 3) AS kept FROM n")
def flt3(spark, d):
    roots = F.filter(F.transform(F.regexp_extract_all(F.lower("p_type"), F.lit("[a-z]+"), 0), lambda x: F.substring(x, 1, 5)), lambda x: F.length(x) >= 5)
    hit = F.exists(roots, lambda r: F.lit("standard economy goods").contains(r))
    a = table(spark, d, "part").select("p_partkey", "p_brand", hit.alias("hit"))
    few = a.groupBy("p_brand").agg((F.count_if("hit") < F.greatest(F.lit(4), F.count(F.lit(1)) / 3)).alias("few"))
    return a.join(few, "p_brand").select("p_partkey", (F.col("hit") | F.col("few")).alias("kept"))


_ELLIPSIS = "CASE WHEN doc_id % 2 = 0 AND length(text) > 200 THEN substr(text, 5, 40) || '...' || substr(text, 100, 50) WHEN doc_id % 3 = 0 THEN substr(text, 100, 30) || ' … ' || substr(text, 5, 30) ELSE substr(text, 10, 50) END"


@query(
    "flt4_quote_parts",
    f"WITH q AS (SELECT doc_id, text, {_ELLIPSIS} AS quote FROM documents), p AS (SELECT *, list_filter(list_transform(string_split_regex(quote, '\\.\\.\\.|…'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM q) SELECT doc_id, contains(text, quote) OR (len(parts) >= 2 AND len(list_filter(parts, lambda x: length(x) < 20 OR len(string_split_regex(x, '\\s+')) < 3)) = 0 AND regexp_matches(text, '(?s)' || array_to_string(list_transform(parts, lambda x: regexp_escape(x)), '.*'))) AS found FROM p",
)
def flt4(spark, d):
    docs = table(spark, d, "documents").withColumn("quote", F.expr(_ELLIPSIS))
    return docs.select("doc_id", matching.ordered_parts(F.col("quote"), F.col("text")).alias("found"))


_SPANS = "array<struct<name:string,mechanism:string,stage:string,evidence:array<struct<span_id:int,quote:string>>>>"


@query("flt5_extraction")
def flt5(spark, d):
    """Stored answers of the extraction, checked against the documents they name; a reason for each candidate that is refused."""
    docs = table(spark, d, "documents")
    quote = F.substring("text", 20, 60)
    cand = F.struct(F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("c"), "doc_id")).alias("name"), F.lit("m").alias("mechanism"), F.when(F.col("doc_id") % 2 == 0, F.lit("pilot")).otherwise(F.lit("odd")).alias("stage"), F.array(F.struct(F.lit(0).alias("span_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("never said anywhere in here")).otherwise(quote).alias("quote"))).alias("evidence"))
    answers = docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("says"), "doc_id", F.to_json(F.array(cand)).alias("json"))
    rows = answers.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "says", "text", F.posexplode(F.slice(F.from_json("json", _SPANS), 1, 6)).alias("n", "c"))
    quote_ok = F.exists("c.evidence", lambda e: F.col("text").contains(e["quote"]))
    reason = F.when(F.col("says") != F.col("doc_id"), "other_document").when(F.col("c.name").isNull(), "no_name").when(~quote_ok, "quote_not_found").otherwise("accepted")
    return rows.select("doc_id", "n", F.when(F.col("c.stage").isin(I.STAGES), F.col("c.stage")).otherwise("unknown").alias("stage"), reason.alias("reason"))


_TERM = "CASE p_partkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN p_name WHEN 2 THEN upper(substr(p_name, 1, 2)) WHEN 3 THEN p_brand ELSE 'something else' END"


@query("flt6_canonical_terms", f"SELECT p_partkey, CASE WHEN lower({_TERM}) IN ('n/a', 'none', 'unknown', 'null') THEN 'null_like' WHEN length({_TERM}) NOT BETWEEN 3 AND 60 THEN 'length' WHEN {_TERM} = p_brand THEN 'organisation' WHEN NOT contains(lower(p_name || ' ' || p_type), lower({_TERM})) THEN 'not_in_quotes' ELSE 'valid' END AS state FROM part")
def flt6(spark, d):
    t = F.expr(_TERM)
    state = F.when(F.lower(t).isin("n/a", "none", "unknown", "null"), "null_like").when(~F.length(t).between(3, 60), "length").when(t == F.col("p_brand"), "organisation").when(~F.lower(F.concat_ws(" ", "p_name", "p_type")).contains(F.lower(t)), "not_in_quotes").otherwise("valid")
    return table(spark, d, "part").select("p_partkey", state.alias("state"))


@query("flt7_domain_verdict", "SELECT p_partkey, coalesce(v, true) AS in_domain FROM part LEFT JOIN (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS v FROM supplier) ON s_suppkey = p_partkey")
def flt7(spark, d):
    v = table(spark, d, "supplier").select("s_suppkey", F.expr("case s_suppkey % 3 when 0 then false when 1 then true end").alias("v"))
    return table(spark, d, "part").join(v, F.col("p_partkey") == F.col("s_suppkey"), "left").select("p_partkey", F.coalesce("v", F.lit(True)).alias("in_domain"))


# Every third answer gives a quote that its snippet does not hold.
_SNIP = "p_name || ' made by ' || CASE l_linenumber % 3 WHEN 0 THEN 'others' ELSE s_name END || ' in ' || p_type"


@query("flt8_implementers", f"SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE contains(lower({_SNIP}), lower('made by ' || s_name)) AND l_returnflag IN ('A', 'R') AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_partkey = p_partkey AND k.l_suppkey = s_suppkey AND k.l_returnflag = 'N')")
def flt8(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    known = li.where("l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    rows = table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ok = F.lower(F.expr(_SNIP)).contains(F.lower(F.concat(F.lit("made by "), "s_name"))) & F.col("l_returnflag").isin("A", "R")
    return rows.where(ok).select("p_partkey", "s_suppkey").distinct().join(known, ["p_partkey", "s_suppkey"], "left_anti")


_AMOUNT = "CASE o_orderkey % 4 WHEN 0 THEN '$' || floor(o_totalprice)::BIGINT WHEN 1 THEN floor(o_totalprice)::BIGINT || ' EUR' WHEN 2 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE '5 mln RUB' END"
_SAID = "'round of ' || CASE WHEN o_orderkey % 4 = 1 THEN 'some EUR' ELSE amount END || ' on ' || d"


@query("flt9_rounds", I.sql("pdates") + f", r AS (SELECT p.o_orderkey, p.d, p.hi, {_AMOUNT} AS amount FROM pb p JOIN orders o USING (o_orderkey)) SELECT o_orderkey, CASE WHEN hi IS NULL OR hi > DATE '2000-01-01' THEN 'date' WHEN NOT regexp_matches(amount, '[$€]|EUR|USD|RUB') THEN 'no_unit' WHEN NOT contains({_SAID}, amount) THEN 'not_in_quote' ELSE 'valid' END AS state FROM r")
def flt9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(re.sub(r"floor\(o_totalprice\)::BIGINT(::VARCHAR)?", "string(bigint(floor(o_totalprice)))", _AMOUNT)).alias("amount"))
    r = I.partial_dates(spark, d).join(o, "o_orderkey")
    hi = dates.last_day(F.col("d"))
    state = F.when(hi.isNull() | (hi > F.lit("2000-01-01").cast("date")), "date").when(~F.col("amount").rlike("[$€]|EUR|USD|RUB"), "no_unit").when(~F.expr(_SAID).contains(F.col("amount")), "not_in_quote").otherwise("valid")
    return r.select("o_orderkey", state.alias("state"))


@query("flt10_hypotheses", I.sql("quotes") + "SELECT q.doc_id, CASE WHEN q.doc_id % 11 = 0 THEN 'rejected' WHEN contains(coalesce(d.text, ''), q.quote) THEN 'confirmed' ELSE 'quote_not_found' END AS status FROM quotes q LEFT JOIN documents d USING (doc_id)")
def flt10(spark, d):
    q = I.quotes(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left")
    return q.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "rejected").when(F.coalesce("text", F.lit("")).contains(F.col("quote")), "confirmed").otherwise("quote_not_found").alias("status"))


_CLAMP = "CASE WHEN p_size % 8 IN (0, 1) THEN 'early' WHEN p_size % 8 = 2 THEN 'mature' ELSE 'whatever' END"


_SAYS = "CASE p_partkey % 5 WHEN 0 THEN 'never said' WHEN 1 THEN substr(p_type, 1, 3) ELSE p_type END"


@query("flt11_assessment", f"SELECT p_partkey, CASE WHEN {_CLAMP} NOT IN ('early', 'mature') THEN 'unknown' WHEN NOT (length({_SAYS}) >= 5 AND contains(p_type || ' ' || p_name, {_SAYS})) THEN 'unknown' WHEN {_CLAMP} = 'early' AND length(p_name) < 10 THEN 'unknown' ELSE {_CLAMP} END AS assessed FROM part")
def flt11(spark, d):
    """A stage needs a quote that is long enough and stands in the text."""
    c, said = F.expr(_CLAMP), F.expr(_SAYS)
    inside = (F.length(said) >= 5) & F.concat_ws(" ", "p_type", "p_name").contains(said)
    return table(spark, d, "part").select("p_partkey", F.when(~c.isin("early", "mature"), "unknown").when(~inside, "unknown").when((c == "early") & (F.length("p_name") < 10), "unknown").otherwise(c).alias("assessed"))


@query("flt12_stale_downgrade", I.sql("candidates") + "SELECT p_partkey, CASE WHEN stage IN ('prototype', 'pilot') AND event_date <= '1999-01-01' AND date_diff('day', event_date::DATE, DATE '1999-01-01') <= 730 THEN 'early' ELSE 'unknown' END AS assessed FROM candidates")
def flt12(spark, d):
    e = F.col("event_date")
    near = (e <= "1999-01-01") & (F.datediff(F.lit("1999-01-01").cast("date"), F.try_to_date(e)) <= 730)
    return I.candidates(spark, d).select("p_partkey", F.when(F.col("stage").isin("prototype", "pilot") & near, "early").otherwise("unknown").alias("assessed"))


# Positions: a quote with the address it is said to stand at, as cards have it: with tracking parameters, with www, or of a page that was not stored.
_SAID_AT = "CASE doc_id % 6 WHEN 1 THEN url || '/?utm_source=x' WHEN 2 THEN replace(url, 'https://', 'https://www.') WHEN 5 THEN 'https://elsewhere.example.net/' || doc_id ELSE url END"
_PLAIN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_URL_KEY = "regexp_replace(lower(regexp_extract({0}, '^https?://(?:www[.])?([^/?#]*)', 1)) || regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')"
_REASONS = "array_to_string(list_filter([CASE WHEN length(quote) < 20 THEN 'no_quote' WHEN NOT ok THEN 'quote_unverified' END, CASE WHEN n_players = 0 THEN 'no_players' END, CASE WHEN NOT dated AND NOT measured THEN 'neither_dated_nor_measured' END], lambda x: x IS NOT NULL), ',')"
_CHECK = f""", p AS (SELECT q.doc_id, {_PLAIN.format("q.quote")} AS quote, {_SAID_AT.replace("doc_id", "q.doc_id")} AS said, published_at FROM quotes q JOIN docs d USING (doc_id)),
t AS (SELECT {_URL_KEY.format("url")} AS k, {_PLAIN.format("text")} AS text FROM docs),
c AS (SELECT p.*, length(quote) >= 20 AND CASE WHEN t.k IS NOT NULL THEN contains(t.text, quote) ELSE EXISTS (SELECT 1 FROM t o WHERE contains(o.text, p.quote)) END AS ok, (doc_id % 4)::BIGINT AS n_players,
  coalesce(published_at >= '2024-01-01' AND published_at <= '2024-07-01', false) AS dated, doc_id % 5 = 1 AND doc_id % 3 > 0 AS measured FROM p LEFT JOIN t ON t.k = {_URL_KEY.format("said")})"""
_GROUNDED = "ok AND n_players >= 1 AND (dated OR measured)"


def _checks(spark, d):
    """Each position's quote is looked for in the document of its address, or in all documents if that was not stored; a position is
    grounded with a verified quote, a player, and a fresh date or a measurement."""
    docs = I.docs(spark, d)
    said = F.expr(_SAID_AT)
    p = I.quotes(spark, d).select("doc_id", text.quote_key(F.col("quote")).alias("quote")).join(docs.select("doc_id", "url", "published_at"), "doc_id").withColumn("k", urls.path_key(said))
    t = docs.select(urls.path_key(F.col("url")).alias("k"), text.quote_key(F.col("text")).alias("text"))
    own = p.join(t, "k", "left").select("doc_id", "quote", "published_at", F.col("text").isNotNull().alias("stored"), ((F.length("quote") >= 20) & F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False))).alias("ok"))
    own = written(own, "positions")
    pool = matching.held(own.where("not stored").select(F.col("doc_id").alias("quote_id"), "quote"), docs.select("doc_id", text.quote_key(F.col("text")).alias("text"))).select(F.col("quote_id").alias("doc_id")).withColumn("pooled", F.lit(True))
    dated = F.coalesce(F.col("published_at").between("2024-01-01", "2024-07-01"), F.lit(False))
    measured = (F.col("doc_id") % 5 == 1) & (F.col("doc_id") % 3 > 0)
    return own.join(pool, "doc_id", "left").select("doc_id", "quote", (F.col("ok") | F.coalesce("pooled", F.lit(False))).alias("ok"), (F.col("doc_id") % 4).alias("n_players"), dated.alias("dated"), measured.alias("measured"))


def _is_grounded():
    return F.col("ok") & (F.col("n_players") >= 1) & (F.col("dated") | F.col("measured"))


@query("flt13_position_checks", I.sql("quotes", "docs") + _CHECK + f" SELECT doc_id, {_REASONS} AS reasons, {_GROUNDED} AS grounded FROM c")
def flt13(spark, d):
    quote = F.when(F.length("quote") < 20, "no_quote").when(~F.col("ok"), "quote_unverified")
    reasons = F.array_compact(F.array(quote, F.when(F.col("n_players") == 0, F.lit("no_players")), F.when(~F.col("dated") & ~F.col("measured"), F.lit("neither_dated_nor_measured"))))
    return _checks(spark, d).select("doc_id", F.array_join(reasons, ",").alias("reasons"), _is_grounded().alias("grounded"))


@query("agg17_quality_report", I.sql("quotes", "docs") + _CHECK + f" SELECT count(*) AS positions, count_if({_GROUNDED}) AS grounded, count(DISTINCT CASE WHEN {_GROUNDED} THEN quote END) AS mechanisms, count_if({_GROUNDED} AND n_players > 1) AS two_players, count_if(length(quote) < 20) AS no_quote, count_if(length(quote) >= 20 AND NOT ok) AS unverified FROM c")
def agg17(spark, d):
    short = F.length("quote") < 20
    return _checks(spark, d).agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(_is_grounded()).alias("grounded"), F.countDistinct(F.when(_is_grounded(), F.col("quote"))).alias("mechanisms"), F.count_if(_is_grounded() & (F.col("n_players") > 1)).alias("two_players"),
        F.count_if(short).alias("no_quote"), F.count_if(~short & ~F.col("ok")).alias("unverified"),
    )


@query("d9_grounded", I.sql("quotes", "docs") + _CHECK + f" SELECT doc_id, {_GROUNDED} AS grounded FROM c")
def d9(spark, d):
    return _checks(spark, d).select("doc_id", _is_grounded().alias("grounded"))


# A round counts for a card if its organisation is one of the card's players, or its quote has a word of the card's term. Every third quote is about another part.
_ROUND = "'funding for ' || CASE l_linenumber % 3 WHEN 0 THEN 'something else' ELSE p_name END"


@query("flt14_relevant_rounds", f"WITH r AS (SELECT p_brand, l_returnflag = 'R' OR len(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: length(w) > 4 AND contains(lower({_ROUND}), w))) > 0 AS hit FROM part JOIN lineitem ON l_partkey = p_partkey) SELECT p_brand, count_if(hit) AS kept, count_if(NOT hit) AS dropped FROM r GROUP BY 1")
def flt14(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name").join(table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag"), F.col("p_partkey") == F.col("l_partkey"))
    quote = F.lower(F.expr(_ROUND))
    words = F.exists(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), 0), lambda w: (F.length(w) > 4) & quote.contains(w))
    hit = (F.col("l_returnflag") == "R") | words
    return p.groupBy("p_brand").agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("dropped"))


@query("flt15_headline", "SELECT l_partkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND date_diff('day', l_shipdate::DATE, DATE '1998-01-01') BETWEEN 0 AND 760 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1")
def flt15(spark, d):
    age = F.datediff(F.lit("1998-01-01").cast("date"), F.col("l_shipdate").cast("date"))
    li = table(spark, d, "lineitem").where((F.col("l_returnflag") != "N") & age.between(0, 760))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    return li.withColumn("n", F.row_number().over(w)).where("n = 1").select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("flt16_evidence_packet", I.sql("quotes") + ", u AS (SELECT source, 0 AS rank, doc_id, quote FROM quotes UNION ALL SELECT source, 1, doc_id, reverse(quote) FROM quotes), f AS (SELECT source, rank, doc_id, substr(quote, 1, 1100) AS quote FROM u WHERE length(quote) >= 20 QUALIFY row_number() OVER (PARTITION BY source, quote ORDER BY rank, doc_id) = 1) SELECT source, 'e' || row_number() OVER (PARTITION BY source ORDER BY rank, doc_id) AS id, sha256(quote) AS quote FROM f")
def flt16(spark, d):
    q = I.quotes(spark, d)
    u = q.select("source", F.lit(0).alias("rank"), "doc_id", "quote").unionByName(q.select("source", F.lit(1).alias("rank"), "doc_id", F.reverse("quote").alias("quote"))).where(F.length("quote") >= 20)
    f = u.withColumn("n", F.row_number().over(Window.partitionBy("source", "quote").orderBy("rank", "doc_id"))).where("n = 1")
    return f.select("source", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id"))).alias("id"), F.sha2(F.substring("quote", 1, 1100), 256).alias("quote"))


@query("flt17_cards", I.sql("candidates") + "SELECT p_partkey AS id, 'card ' || name AS title, coalesce(array_to_string(list_slice(organizations, 1, 2), '; '), '') AS players, [total - least(total, 5), least(total, 5)][1] AS old, least(total, 5) AS recent FROM candidates")
def flt17(spark, d):
    c = I.candidates(spark, d)
    card = F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("card "), "name").alias("title"), F.coalesce(F.array_join(F.slice("organizations", 1, 2), "; "), F.lit("")).alias("players"), F.array(F.col("total") - F.least("total", F.lit(5)), F.least("total", F.lit(5)).cast("long")).alias("series"))
    return c.select(card.alias("c")).select("c.id", "c.title", "c.players", F.get("c.series", F.lit(0)).alias("old"), F.get("c.series", F.lit(1)).alias("recent"))


@query("flt18_loudness", I.sql("candidates") + "SELECT p_partkey, CASE WHEN total * 15 >= 400 THEN CASE WHEN p_size % 2 = 0 THEN 'hype' ELSE 'well_known' END WHEN total * 15 > 150 THEN 'well_known' ELSE 'early' END AS kind FROM candidates")
def flt18(spark, d):
    n, share = F.col("total") * 15, F.when(F.col("p_size") % 2 == 0, 0.6).otherwise(0.4)
    return I.candidates(spark, d).select("p_partkey", F.when(n >= 400, F.when(share > 0.5, "hype").otherwise("well_known")).when(n > 150, "well_known").otherwise("early").alias("kind"))


@query("flt19_source_trust", f"SELECT page_id, CASE WHEN h LIKE '%.org' AND (h = 'example.org' OR h LIKE '%.example.org') THEN 'high' WHEN h = 'casino-win.example.com' OR h LIKE '%.casino-win.example.com' THEN 'low' ELSE 'medium' END AS trust FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def flt19(spark, d):
    return table(spark, d, "pages").select("page_id", urls.trust(F.col("url"), ["example.org"], ["casino-win.example.com"]).alias("trust"))


@query("flt20_exclusion_class", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'standard|promo') THEN 'mature' WHEN regexp_matches(lower(p_type), 'economy') THEN 'hype' ELSE 'noise' END AS class FROM part")
def flt20(spark, d):
    t = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(t.rlike("standard|promo"), "mature").when(t.rlike("economy"), "hype").otherwise("noise").alias("class"))


_VERDICT = "CASE WHEN hits < 6 OR hosts < 4 THEN 'no_material' WHEN consumer >= 0.4 THEN 'wrong_sense' WHEN second >= 0.25 AND cosine < 0.8 THEN 'ambiguous' WHEN groups >= 5 AND top < 0.3 THEN 'too_broad' ELSE 'ok' END AS verdict"


@query("d5_query_fitness", I.sql("results") + f"SELECT query, {_VERDICT} FROM gate LEFT JOIN cosines USING (query)")
def d5(spark, d):
    return gate.judged(gate.readings(I.results(spark, d))).select("query", "verdict")


@query("flt21_query_gate", I.sql("results") + f"SELECT query, hits, hosts, groups, round(top, 6) AS top, round(second, 6) AS second, round(consumer, 6) AS consumer, round(cosine, 5) AS cosine, {_VERDICT} FROM gate LEFT JOIN cosines USING (query)")
def flt21(spark, d):
    """The gate with all that its verdict rests on."""
    r = gate.judged(gate.readings(I.results(spark, d)))
    return r.select("query", "hits", "hosts", "groups", *(F.round(c, 6).alias(c) for c in ("top", "second", "consumer")), F.round("cosine", 5).alias("cosine"), "verdict")


@query(
    "d6_plan_check",
    "WITH w AS (SELECT p_brand, CASE WHEN p_brand < 'Brand#2' THEN 'the ' || p_type ELSE p_type || ' ' || p_name END AS direction, p_name, p_size FROM part), d AS (SELECT DISTINCT p_brand, min(direction) OVER (PARTITION BY p_brand) AS direction FROM w), b AS (SELECT p_brand, p_name FROM w WHERE p_size % 50 = 7 GROUP BY ALL) SELECT d.p_brand, CASE WHEN count(p_name) = 0 THEN 'no_material' WHEN len(list_filter(regexp_extract_all(lower(any_value(direction)), '[a-z]+'), lambda x: length(x) > 3)) <= 1 THEN 'confirm' ELSE 'ok' END AS verdict, least(count(p_name), 12) AS shown FROM d LEFT JOIN b USING (p_brand) GROUP BY 1",
)
def d6(spark, d):
    """A plan is checked for each direction, those without a branch too; a direction of one significant word has to be confirmed, and twelve branches are shown at most."""
    p = table(spark, d, "part")
    direction = F.when(F.col("p_brand") < "Brand#2", F.concat(F.lit("the "), "p_type")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    named = p.groupBy("p_brand").agg(F.min(direction).alias("direction"))
    branches = p.where("p_size % 50 = 7").groupBy("p_brand").agg(F.count_distinct("p_name").alias("n"))
    n = F.coalesce("n", F.lit(0))
    significant = F.size(F.filter(F.regexp_extract_all(F.lower("direction"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3))
    verdict = F.when(n == 0, "no_material").when(significant <= 1, "confirm").otherwise("ok")
    return named.join(branches, "p_brand", "left").select("p_brand", verdict.alias("verdict"), F.least(n, F.lit(12)).alias("shown"))


@query("flt22_fetch_outcome", "SELECT count(*) AS fetched, count_if(page_id % 13 <> 0) AS ok, count_if(page_id % 13 <> 0 AND contains(html, '<article>')) AS parsed FROM pages")
def flt22(spark, d):
    ok = F.col("page_id") % 13 != 0
    return table(spark, d, "pages").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(ok).alias("ok"), F.count_if(ok & F.col("html").contains("<article>")).alias("parsed"))


@query("flt23_outside_request", I.sql("candidates") + "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'outside_request' END AS reason FROM candidates")
def flt23(spark, d):
    return I.candidates(spark, d).select("p_partkey", F.when(F.col("p_size") % 10 == 0, "outside_request").alias("reason"))


_D1 = "(CASE WHEN p_size % 7 = 0 THEN 2.0 ELSE 0 END + CASE WHEN coalesce(len(organizations), 0) >= 2 THEN 1 WHEN coalesce(len(organizations), 0) = 0 THEN -1 ELSE 0 END + CASE WHEN coalesce(event_date, '') >= '1996-06-01' THEN 1 ELSE 0 END + CASE WHEN p_size % 5 >= 3 THEN 2 WHEN p_size % 5 = 2 THEN 1 ELSE 0 END)::DOUBLE"
_IN = f", i AS (SELECT *, {_D1} AS d1, CASE WHEN p_size % 9 <> 0 THEN name END AS term, p_size % 8 AS n_evidence, CASE WHEN p_size % 11 <> 0 THEN total * (p_size % 20) END AS t, CASE WHEN p_size % 12 <> 0 THEN floor(total * (p_size % 20) / (2 + p_size % 3)) END AS r, p_size * 2 AS age, coalesce(len(organizations), 0) > 0 AS named, CASE WHEN p_size % 4 = 1 THEN greatest(423, least(p_size * 2000 * 0.02, 3384)) ELSE 423 END AS loud, coalesce(event_date, '') >= '1996-06-01' AS fresh, p_size % 5 AS players FROM candidates)"


def _scored(spark, d):
    c = I.candidates(spark, d).withColumns({"rule": F.col("p_size") % 7 == 0, "orgs": F.when(F.col("organizations").isNull(), 0).otherwise(F.size("organizations")), "fresh": F.coalesce("event_date", F.lit("")) >= "1996-06-01", "players": F.col("p_size") % 5})
    c = decide.evidence_score(c, "rule", "orgs", "fresh", "players")
    t = F.col("total") * (F.col("p_size") % 20)
    return c.withColumns(
        {"term": F.when(F.col("p_size") % 9 != 0, F.col("name")), "n_evidence": F.col("p_size") % 8, "recent": F.when(F.col("p_size") % 12 != 0, F.floor(t / (2 + F.col("p_size") % 3))), "age_months": F.col("p_size") * 2, "base": F.lit(0.4), "named": F.col("orgs") > 0, "area": F.when(F.col("p_size") % 4 == 1, F.col("p_size") * 2000).cast("long"), "total": F.when(F.col("p_size") % 11 != 0, t)}
    )


@query("d1_evidence_score", I.sql("candidates") + _IN + " SELECT p_partkey, d1 FROM i")
def d1(spark, d):
    return _scored(spark, d).select("p_partkey", "d1")


_CASES = """, s AS (SELECT *, stage IN ('prototype', 'pilot') AS early, stage = 'scaled' AS scaled, CASE WHEN t < 10 THEN 0 ELSE r / t / 0.4 END AS ratio FROM i),
m AS (SELECT *, greatest(0, CASE WHEN ratio >= 1.7 THEN 4 WHEN ratio >= 1.2 THEN 2.5 WHEN ratio >= 0.9 THEN 1 ELSE 0 END + CASE WHEN t <= 3 THEN 2.5 WHEN t <= 38 THEN 1.5 ELSE 0 END + d1 + CASE WHEN early THEN 1.5 ELSE 0 END + CASE WHEN stage = 'limited_sales' THEN 1 ELSE 0 END - CASE WHEN scaled THEN 2.5 ELSE 0 END)::DOUBLE AS score0 FROM s),
k AS (SELECT *, CASE WHEN term IS NULL AND n_evidence = 0 THEN 1 WHEN term IS NULL THEN 2 WHEN n_evidence = 0 THEN 3 WHEN t IS NULL OR r IS NULL THEN 4
  WHEN age > 48 AND t > 30 AND r / t < 0.4 AND NOT fresh THEN 5 WHEN t > loud AND scaled THEN 6 WHEN t > loud THEN 7 WHEN scaled AND t > floor(loud / 4) THEN 8 WHEN t = 0 THEN 9 WHEN score0 >= 5 AND named AND age <= 48 THEN 10 ELSE 11 END AS c FROM m)"""
_SCORE = "CASE c WHEN 1 THEN 0 WHEN 2 THEN greatest(0, d1 + CASE WHEN early THEN 1.5 ELSE 0 END - CASE WHEN scaled THEN 2.5 ELSE 0 END) WHEN 3 THEN 0 WHEN 4 THEN greatest(0, d1 + CASE WHEN early THEN 1.5 ELSE 0 END) WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN CASE WHEN players >= 2 THEN 1 ELSE 0.5 END WHEN 8 THEN 0 WHEN 9 THEN greatest(0, 1 + d1 + CASE WHEN early THEN 1 ELSE 0 END - CASE WHEN scaled THEN 2.5 ELSE 0 END) ELSE score0 END"
_STATUS = "(['rejected','no_term','rejected','unmeasured','aged','scaled','too_loud','scaled','unseen','measured','measured'])[c]"
_TIER = "(['rejected','review','rejected','review','review','review','too_loud','review','review','signal','review'])[c]"


@query("d2_candidate_score", I.sql("candidates") + _IN + _CASES + f" SELECT p_partkey, {_STATUS} AS status, {_TIER} AS tier, ({_SCORE})::DOUBLE AS score FROM k")
def d2(spark, d):
    return decide.candidate_score(_scored(spark, d)).select("p_partkey", "status", "tier", "score")


@query(
    "d8_card_adjustments",
    I.sql("candidates") + _IN + _CASES + f", v AS (SELECT *, ({_SCORE})::DOUBLE AS sc, {_STATUS} AS st, {_TIER} AS ti, p_size % 4 AS domains, p_size % 6 = 0 AS doubtful, p_size % 10 AS impl, p_size % 3 AS rounds, p_size % 3 AS events, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'early' END AS assessed FROM k), x AS (SELECT *, CASE WHEN doubtful THEN greatest(0, sc + CASE WHEN domains >= 2 THEN 1.5 ELSE 0 END - 3) ELSE sc + CASE WHEN domains >= 2 THEN 1.5 ELSE 0 END END + CASE WHEN impl >= 8 THEN 0 WHEN impl >= 3 THEN 2.5 WHEN impl = 2 THEN 1.5 ELSE 0 END AS s1 FROM v), w AS (SELECT *, ti = 'review' AND s1 >= 5 AND st = 'measured' AND age <= 48 AND impl < 8 AS up, s1 + CASE WHEN rounds > 0 THEN 1 ELSE 0 END + CASE WHEN events >= 2 THEN 0.5 ELSE 0 END AS cs FROM x) SELECT p_partkey, cs::DOUBLE AS card_score, CASE WHEN ti = 'rejected' THEN 'rejected' WHEN impl >= 8 THEN 'too_loud' WHEN assessed <> 'early' THEN 'review' WHEN (up OR ti = 'signal') AND domains < 2 THEN 'review' WHEN up THEN 'signal' ELSE ti END AS card_tier FROM w",
)
def d8(spark, d):
    s = decide.candidate_score(_scored(spark, d))
    p = F.col("p_size")
    s = s.withColumns({"domains": p % 4, "doubtful": p % 6 == 0, "implementers": p % 10, "rounds": p % 3, "events": p % 3, "assessed": F.when(p % 5 == 0, "unknown").otherwise("early")})
    return decide.adjusted(s).select("p_partkey", "card_score", "card_tier")


def _facts(spark, d):
    """Stored answers with facts on repeated use; some have a string for a boolean, an id twice, or a party that the quote lacks."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    k = F.col("o_orderkey")
    yes = F.when(k % 6 == 0, F.lit('"true"')).otherwise(F.lit("true"))
    one = lambda i: F.concat(F.lit('{"id":"'), F.when(k % 10 == 0, F.lit("f0")).otherwise(F.concat(F.lit("f"), F.lit(i))), F.lit('","customer":"C'), "o_custkey", F.lit('","supplier":"S'), F.lit(i), F.lit('","date":"'), "date", F.lit('","supports":'), yes, F.lit(',"distinct_parties":true,"in_use":true,"named":true,"dated":true,"own_words":true}'))
    return o.select("o_orderkey", F.concat(F.lit("["), one(0), F.lit(","), one(1), F.lit("]")).alias("json"), F.concat(F.lit("C"), "o_custkey", F.lit(" uses S0"), F.when(k % 4 == 0, F.lit("")).otherwise(F.lit(" and S1"))).alias("quote"))


_FACT_SQL = "f AS (SELECT o_orderkey, o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') <= '1998-01-01' AS p0, o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') <= '1998-01-01' AS p1 FROM orders)"


@query("d3_maturity", f"WITH {_FACT_SQL} SELECT o_orderkey, p0::BIGINT + p1::BIGINT AS passed, CASE WHEN p0 AND p1 THEN 'mature' ELSE 'keep' END AS decision FROM f")
def d3(spark, d):
    n = decide.passed_facts(_facts(spark, d), "json", "quote", "1998-01-01").groupBy("o_orderkey").agg(F.count_if("passed").alias("passed"))
    return n.withColumn("decision", F.when(F.col("passed") >= 2, "mature").otherwise("keep"))


@query("d4_refutation", f"WITH {_FACT_SQL} SELECT o_orderkey, CASE WHEN p0 AND NOT p1 THEN 'refuted' ELSE 'keep' END AS decision FROM f")
def d4(spark, d):
    f = decide.passed_facts(_facts(spark, d), "json", "quote", "1998-01-01")
    n = f.groupBy("o_orderkey").agg(F.count_if("passed").alias("k"), F.bool_or(F.col("passed") & (F.col("f.id") == "f0")).alias("main"))
    return n.select("o_orderkey", F.when((F.col("k") == 1) & F.col("main"), "refuted").otherwise("keep").alias("decision"))


@query("d7_sequential_routing", f"WITH {_FACT_SQL} SELECT o_orderkey, CASE WHEN p0 AND p1 THEN 'mature' WHEN p0 THEN 'refuted' WHEN row_number() OVER (PARTITION BY p0, p1, o_orderkey % 50 ORDER BY o_orderkey) <= 20 THEN 'remaining' ELSE 'unchecked' END AS bucket FROM f")
def d7(spark, d):
    f = decide.passed_facts(_facts(spark, d), "json", "quote", "1998-01-01")
    n = f.groupBy("o_orderkey").agg(F.bool_or(F.col("passed") & (F.col("f.supplier") == "S0")).alias("p0"), F.bool_or(F.col("passed") & (F.col("f.supplier") == "S1")).alias("p1"))
    w = F.row_number().over(Window.partitionBy("p0", "p1", F.col("o_orderkey") % 50).orderBy("o_orderkey"))
    return n.select("o_orderkey", F.when(F.col("p0") & F.col("p1"), "mature").when(F.col("p0"), "refuted").when(w <= 20, "remaining").otherwise("unchecked").alias("bucket"))


_E1 = "WITH p AS (SELECT p_brand || '/' || p_type AS key, p_size AS seen_at, p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS evidence, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE substr('pump with a magnetic bearing', 1, p_size % 25 + 4) END AS m, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END AS event_date FROM part) "


@query("er1_accumulate", _E1 + HEADS_SQL)
def er1(spark, d):
    """Proposals of parts in one packet, by brand and type."""
    grown = F.substring(F.lit("pump with a magnetic bearing"), F.lit(1), (F.col("p_size") % 25 + 4).cast("int"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    p = table(spark, d, "part").select(
        F.concat("p_brand", F.lit("/"), "p_type").alias("key"), F.col("p_size").alias("at"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("evidence"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(grown).alias("mechanism"), F.when(F.col("p_partkey") % 3 == 0, day).alias("event_date"),
    )
    return growth.accept(p)[0]


@query("er2_leader_clusters")
def er2(spark, d):
    # Null for none; a filter or a comparison of its own would make the tokens a second time.
    tokens = F.get(F.filter(F.array(text.tokens(F.col("text"))), lambda t: F.size(t) > 0), F.lit(0))
    return resolve.leaders(table(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens.alias("tokens")))


@query("er3_guarded_merge")
def er3(spark, d):
    """The table has no pairs of 0.9 and more, so pairs of 0.4 and more are proposed; the checks decide."""
    e = table(spark, d, "embeddings")
    pairs = matching.cosine_pairs(e, "vec_id", "embedding", 0.4).withColumnRenamed("cosine", "score")
    rows = e.selectExpr("vec_id AS id", "CASE vec_id % 7 WHEN 0 THEN 'photonic circuit' WHEN 1 THEN 'digital logic' WHEN 2 THEN 'analog logic' ELSE 'plain circuit' END AS text", "CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'image sensor' ELSE 'image sensor node' END AS object")
    return resolve.equivalents(pairs, rows, 0.4)


_CARDS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' ' || p_partkey % 5 || ' ' || p_partkey // 500 END AS term, p_type || ' ' || p_brand || ' ' || p_size AS name FROM part"


@query("er4_mechanism_groups", f"WITH RECURSIVE c AS ({_CARDS}), e AS (SELECT id AS a, min(id) OVER (PARTITION BY term) AS b FROM c WHERE term IS NOT NULL UNION SELECT id, min(id) OVER (PARTITION BY name) FROM c), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), g AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1) SELECT g.id, root, array_to_string({_W.format('coalesce(term, name)')}, ' ') AS mechanism FROM g JOIN c ON c.id = root")
def er4(spark, d):
    return resolve.mechanisms(table(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' ' || p_partkey % 5 || ' ' || p_partkey div 500 END AS term", "p_type || ' ' || p_brand || ' ' || p_size AS name"))


@query("er5_one_to_one")
def er5(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    # All pairs: a rank before the matching would count both directions and the item itself.
    pairs = matching.similar_names(t, t, 0.1, 1 << 30).where("a < b")
    return matching.one_to_one(pairs)


@query("er6_conflicts", "SELECT DISTINCT a.l_orderkey AS candidate, a.l_linenumber::BIGINT AS x, b.l_linenumber::BIGINT AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND ((a.l_linenumber = 1 AND b.l_linenumber = 4) OR (a.l_linenumber = 2 AND b.l_linenumber = 5))")
def er6(spark, d):
    accepted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").cast("long").alias("number"))
    protected = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((1, 4), (2, 5))])).alias("p")).select("p.x", "p.y")
    return resolve.conflicts(accepted, protected)


@query("er7_senses", I.sql("results") + "SELECT query, key, sense FROM readings")
def er7(spark, d):
    return resolve.senses(I.results(spark, d), "query", "key", "vector", gate.APART)


@query("jb1_abbreviations")
def jb1(spark, d):
    """Abbreviations of words of the documents; the documents hold none of their own, so each line gets one of its first words."""
    t = F.regexp_replace("text", r"(?m)^(\w)(\w+) (\w)(\w+) ", r"$1$2 $3$4 ($1$3) ")
    return resolve.abbreviations(table(spark, d, "documents").select("doc_id", t.alias("text")), "doc_id", "text")


@query("jb2_expansions")
def jb2(spark, d):
    """Terms that are an abbreviation or hold one as a word, written out by the document's own definition, else by the first anywhere."""
    a = written(jb1(spark, d), "abbreviations")
    first = a.groupBy("abbreviation").agg(F.min_by("expansion", F.struct("doc_id", "expansion")).alias("anywhere"))
    own = a.select("doc_id", "abbreviation", "expansion")
    term = F.when(F.col("doc_id") % 2 == 0, F.col("abbreviation")).otherwise(F.concat("abbreviation", F.lit(" management")))
    terms = own.select("doc_id", "abbreviation", term.alias("term")).distinct()
    full = F.coalesce("expansion", "anywhere")
    return terms.join(own, ["doc_id", "abbreviation"], "left").join(first, "abbreviation", "left").select("doc_id", "term", F.replace("term", F.col("abbreviation"), full).alias("expansion"))


@query("jb3_packets", "SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || lang, ';' ORDER BY doc_id)) AS packet FROM documents GROUP BY 1")
def jb3(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))), lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["lang"]))
    return table(spark, d, "documents").groupBy("source").agg(F.sha2(F.array_join(parts, ";"), 256).alias("packet"))


@query("jb4_another_pass")
def jb4(spark, d):
    """Why a document is read once more: the answer said so, it was empty though text was unread, or unread passages bring new content."""
    plan = plan_of_reading(spark, d)
    n = plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.count_if("shown").alias("read"), F.count("unread").alias("novel"))
    more, empty = F.col("doc_id") % 11 == 0, F.col("doc_id") % 10 == 0
    reason = F.when(more, "more_announced").when(empty & (F.col("passages") > F.col("read")), "empty_answer").when(F.col("novel") > 0, "novel_sections")
    return n.select("doc_id", "passages", "read", "novel", reason.alias("reason"))


_ANSWERS = "a AS (SELECT p_partkey // 30 AS batch, p_partkey AS id, p_name AS name FROM part), f AS (SELECT lower(trim(name)) AS name, min(batch) AS batch FROM a WHERE trim(name) <> '' GROUP BY 1), g AS (SELECT b.batch, count(f.name) AS n FROM (SELECT unnest(range((SELECT max(batch) + 2 FROM a))) AS batch) b LEFT JOIN f USING (batch) GROUP BY 1)"


@query("jb5_hypotheses", f"WITH {_ANSWERS} SELECT f.name, min(a.id) AS p_partkey, f.batch::INT AS batch FROM f JOIN a ON lower(trim(a.name)) = f.name AND a.batch = f.batch WHERE f.batch < (SELECT min(batch) FROM g WHERE n = 0) GROUP BY ALL")
def jb5(spark, d):
    """Answers come in batches of thirty; the list ends with the first one that has no new name."""
    answers = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 30).cast("int").alias("batch"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return growth.until_no_growth(answers, new_path(spark, "hypotheses")).select("name", F.col("id").alias("p_partkey"), "batch")
