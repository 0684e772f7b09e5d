"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions import dates, text, urls
from glimmer.plans import inputs as I
from glimmer.registry import query
from glimmer.session import table

_AS_OF = F.lit
_HOST = I.SQL["host"]
_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("sc1_host_domain", f"SELECT page_id, {_HOST} AS host, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS domain FROM pages")
def sc1(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.domain(F.col("url")).alias("domain"))


@query("sc2_url_keys", f"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS page_key, {_HOST} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path_key FROM pages")
def sc2(spark, d):
    return table(spark, d, "pages").select("page_id", urls.page_key(F.col("url")).alias("page_key"), urls.path_key(F.col("url")).alias("path_key"))


_UNIT_URL = "CASE page_id % 6 WHEN 0 THEN 'https://doi.org/10.1000/Ab.' || page_id WHEN 1 THEN 'http://arxiv.org/abs/2401.0' || (1000 + page_id % 9000) || 'v2' WHEN 2 THEN 'https://github.com/Owner' || (page_id % 5) || '/repo/issues' WHEN 3 THEN 'https://openalex.org/W' || page_id ELSE url END"


@query(
    "sc3_source_unit",
    f"WITH u AS (SELECT page_id, lower({_UNIT_URL}) AS url FROM pages) SELECT page_id, CASE WHEN regexp_matches(url, 'doi[.]org/10') THEN 'doi:' || regexp_extract(url, 'doi[.]org/(10[.][0-9]{{4,9}}/[^?#]+)', 1) WHEN contains(url, 'arxiv.org/') THEN 'arxiv:' || regexp_extract(url, 'abs/([0-9]{{4}}[.][0-9]{{4,5}})', 1) WHEN contains(url, 'openalex.org/') THEN 'openalex:' || regexp_extract(url, 'org/(w[0-9]+)', 1) WHEN contains(url, 'github.com/') THEN 'github:' || regexp_extract(url, 'com/([^/?#]+/[^/?#]+)', 1) ELSE 'host:' || {_HOST} END AS unit FROM u",
)
def sc3(spark, d):
    return table(spark, d, "pages").withColumn("u", F.expr(_UNIT_URL)).select("page_id", urls.source_unit(F.col("u")).alias("unit"))


@query("sc4_layer", f"SELECT page_id, {I.layer_sql(_HOST)} AS layer FROM pages")
def sc4(spark, d):
    return table(spark, d, "pages").select("page_id", urls.layer(F.col("url"), I.LAYERS).alias("layer"))


@query("sc5_date_bounds", I.sql("pdates") + "SELECT o_orderkey, strftime(lo, '%Y-%m-%d') AS lo, strftime(hi, '%Y-%m-%d') AS hi FROM pb")
def sc5(spark, d):
    return I.partial_dates(spark, d).withColumn("b", dates.bounds(F.col("d"))).select("o_orderkey", F.date_format("b.lo", "yyyy-MM-dd").alias("lo"), F.date_format("b.hi", "yyyy-MM-dd").alias("hi"))


@query("sc6_date_known_by", I.sql("pdates") + "SELECT o_orderkey, CASE WHEN hi <= DATE '1996-06-30' THEN d END AS d FROM pb")
def sc6(spark, d):
    return I.partial_dates(spark, d).select("o_orderkey", dates.known_by(F.col("d"), F.lit("1996-06-30").cast("date")).alias("d"))


@query(
    "sc7_freshness",
    I.sql("pdates") + "SELECT o_orderkey, hi IS NOT NULL AND coalesce(date_diff('day', least(hi, DATE '1998-08-02'), DATE '1998-08-02') / 30.4 <= 24, false) AS fresh, (1998 * 12 + 8 - (year(lo) * 12 + month(lo)))::INT AS months FROM pb",
)
def sc7(spark, d):
    now = F.lit("1998-08-02").cast("date")
    # A date that cannot be read is null in least() only if both are.
    return I.partial_dates(spark, d).select("o_orderkey", (dates.is_fresh(F.col("d"), now) & dates.last_day(F.col("d")).isNotNull()).alias("fresh"), dates.months_between(F.col("d"), now).alias("months"))


@query("sc8_normal_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM documents")
def sc8(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normal_text(F.col("text")).alias("text"))


@query("sc9_from_inverted_index", "SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM benchmark")
def sc9(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("item_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("w", "ps")))).alias("json"))
    return index.select("item_id", text.from_inverted(F.from_json("json", "map<string,array<int>>")).alias("text"))


@query("sc10_token_sets", f"SELECT doc_id, len(list_distinct(list_filter({_W.format('text')}, lambda x: length(x) > 2 AND x NOT IN {_in(text.STOP_WORDS)})))::INT AS tokens, len(list_distinct(list_filter({_W.format('text')}, lambda x: length(x) > 3)))::INT AS gate_words FROM documents")
def sc10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"), F.size(text.tokens(F.col("text"), 3, ["-"])).alias("gate_words"))


_T = f"list_distinct(list_filter({_W.format('text')}, lambda x: length(x) > 2 AND x NOT IN {_in(text.STOP_WORDS)}))"


@query(
    "sc11_set_similarity",
    f"WITH t AS (SELECT item_id, {_T} AS s FROM benchmark), p AS (SELECT a.item_id, a.s AS x, b.s AS y, len(list_intersect(a.s, b.s)) AS i, len(list_distinct(list_concat(a.s, b.s))) AS u FROM t a JOIN t b ON b.item_id = a.item_id + 1) SELECT item_id, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS jaccard, round(CASE WHEN i >= 2 THEN i / least(len(x), len(y)) WHEN u > 0 THEN i / u ELSE 0 END, 6) AS overlap FROM p",
)
def sc11(spark, d):
    t = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("x"))
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return t.join(other, "item_id").select("item_id", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(text.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


_ORG = "s_name || CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' AI Labs' WHEN 2 THEN ' (NIST)' ELSE '' END"


@query("sc12_organisation_key", f"SELECT s_suppkey, array_to_string(list_filter({_W.format('(' + _ORG + ')')}, lambda x: x NOT IN {_in(text.LEGAL_WORDS)}), ' ') AS key FROM supplier")
def sc12(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.organisation_key(F.expr(_ORG)).alias("key"))


@query("sc13_name_keys", f"SELECT p_partkey, array_to_string({_W.format('p_name')}, ' ') AS name_key, array_to_string(list_sort({_W.format('p_name')}), ' ') AS sorted_key, trim(regexp_replace('  ' || p_type || '  x ', '\\s+', ' ', 'g')) AS quote_key FROM part")
def sc13(spark, d):
    return table(spark, d, "part").select("p_partkey", text.name_key(F.col("p_name")).alias("name_key"), text.sorted_key(F.col("p_name")).alias("sorted_key"), text.quote_key(F.expr("'  ' || p_type || '  x '")).alias("quote_key"))


_TERM = "CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN substr(p_type, 1, 4) ELSE substr(p_brand, 1, 5) END"


@query("sc14_acronym", f"SELECT p_partkey, length({_TERM}) BETWEEN 2 AND 6 AND 2 * length(regexp_replace({_TERM}, '[^A-Z]', '', 'g')) > length({_TERM}) AS acronym FROM part")
def sc14(spark, d):
    return table(spark, d, "part").select("p_partkey", text.is_acronym(F.expr(_TERM)).alias("acronym"))


@query("sc15_rule_setter", f"SELECT s_suppkey, list_has_any({_W.format('(' + _ORG + ')')}, [{_in(text.RULE_SETTERS)[1:-1]}]) AS sets_rules FROM supplier")
def sc15(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.sets_rules(F.expr(_ORG)).alias("sets_rules"))


_QUERY = "CASE p_partkey % 3 WHEN 0 THEN 'Find weak signals in ' || p_type WHEN 1 THEN 'news' ELSE p_name END"


@query("sc16_without_task_words", f"WITH q AS (SELECT p_partkey, {_QUERY} AS q FROM part), k AS (SELECT *, regexp_replace(array_to_string(list_filter(string_split_regex(trim(q), '\\s+'), lambda x: lower(x) NOT IN {_in(text.TASK_WORDS)}), ' '), '^(?:in|on|for|of|about) ', '') AS k FROM q) SELECT p_partkey, CASE WHEN length(k) < 3 THEN q ELSE k END AS query FROM k")
def sc16(spark, d):
    return table(spark, d, "part").select("p_partkey", text.without_task_words(F.expr(_QUERY)).alias("query"))


@query("sc17_fingerprint", "SELECT p_partkey, sha256(coalesce('s' || p_name, 'n') || '|' || coalesce('s' || nullif(p_size, 7), 'n') || '|') AS fingerprint FROM part")
def sc17(spark, d):
    return table(spark, d, "part").select("p_partkey", text.fingerprint(F.col("p_name"), F.expr("nullif(p_size, 7)")).alias("fingerprint"))


FAMILIES = text.TECH_FAMILIES
_TECH = "lower(p_type || ' ' || p_name || CASE p_size % 8 WHEN 0 THEN ' photonic neuromorphic' WHEN 1 THEN ' in-memory digital logic' WHEN 2 THEN ' LoRaWAN node' WHEN 3 THEN ' LoRA weights' WHEN 4 THEN ' event-driven analog' WHEN 5 THEN ' fine-tuning' WHEN 6 THEN ' NPU inference' ELSE '' END)"
_OTHER = "CASE p_partkey % 3 WHEN 0 THEN 'digital inference by accelerator' WHEN 1 THEN 'lorawan training' ELSE 'plain' END"
_APART = "CASE " + " ".join(f"WHEN (regexp_matches({_TECH}, '{p}') AND regexp_matches({_OTHER}, '{q}')) OR (regexp_matches({_OTHER}, '{p}') AND regexp_matches({_TECH}, '{q}')) THEN {i}" for i, (p, q) in enumerate(text.TECH_FORBIDDEN)) + " END"


@query("sc18_family_markers", "SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_TECH}, '{p}') THEN '{n}' END" for n, p in sorted(FAMILIES.items())) + f"], lambda x: x IS NOT NULL), ',') AS markers, {_APART} AS apart, len(list_distinct(list_transform({_W.format('p_name')}, lambda x: substr(x, 1, 6))))::INT AS stems FROM part")
def sc18(spark, d):
    """Families that a text has marks of, the rule that keeps it apart from another text, and the stems of its name."""
    tech = F.expr(_TECH)
    return table(spark, d, "part").select("p_partkey", F.array_join(text.markers(tech, FAMILIES), ",").alias("markers"), text.forbidden(tech, F.expr(_OTHER)).alias("apart"), F.size(text.stems(F.col("p_name"))).alias("stems"))


_ANSWER = "CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Sure: ' || props || ' done' ELSE 'no answer' END"


@query("sc19_lenient_json", f"SELECT event_id, try_cast(json_extract_string(nullif(regexp_extract({_ANSWER}, '(?s)(\\{{.*\\}})', 1), ''), '$.k') AS BIGINT) AS k FROM events")
def sc19(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json(text.json_body(F.expr(_ANSWER)), "k long").getField("k").alias("k"))


_MIXED = "'технология ' || p_type || ' для ' || p_brand || ' и ' || substr(p_name, 1, 3)"


@query("sc20_longest_latin", f"WITH r AS (SELECT p_partkey, list_filter(regexp_extract_all({_MIXED}, '[A-Za-z][A-Za-z0-9-]*(?: [A-Za-z][A-Za-z0-9-]*){{0,5}}'), lambda x: length(x) > 4) AS r FROM part) SELECT p_partkey, list_filter(r, lambda x: length(x) = list_max(list_transform(r, lambda y: length(y))))[1] AS fragment FROM r")
def sc20(spark, d):
    return table(spark, d, "part").select("p_partkey", text.longest_latin(F.expr(_MIXED)).alias("fragment"))


@query("sc21_plausible_year", "SELECT o_orderkey, CASE WHEN y BETWEEN 1990 AND 2024 THEN y END AS y FROM (SELECT o_orderkey, try_cast(regexp_extract(CASE o_orderkey % 4 WHEN 0 THEN '1889' || o_orderkey WHEN 1 THEN 'x' ELSE strftime(o_orderdate, '%Y%m%d') END, '^([0-9]{4})', 1) AS INT) AS y FROM orders)")
def sc21(spark, d):
    t = F.expr("case o_orderkey % 4 when 0 then '1889' || o_orderkey when 1 then 'x' else date_format(o_orderdate, 'yyyyMMdd') end")
    return table(spark, d, "orders").select("o_orderkey", dates.plausible_year(t, F.lit(I.AS_OF).cast("date")).alias("y"))


@query("sc22_probe_term", "SELECT item_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 6), ' ') AS term FROM benchmark")
def sc22(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.probe_term(F.col("text")).alias("term"))


@query("sc23_comparison_text", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || substr(p_type, 1, 300) AS text FROM part")
def sc23(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", F.substring("p_type", 1, 300)).alias("text"))


_ODD_URL = "CASE page_id % 7 WHEN 0 THEN 'ftp://x.org/a' WHEN 1 THEN 'http://u@x.org/' WHEN 2 THEN 'http://x.org:8080/' WHEN 3 THEN 'http://10.0.0.1/' WHEN 4 THEN 'https://x.internal:443/' ELSE url END"


@query("sc24_allowed_address", f"WITH u AS (SELECT page_id, regexp_extract(lower({_ODD_URL}), '^https?://([^/?#]*)', 1) AS a FROM pages) SELECT page_id, a <> '' AND NOT contains(a, '@') AND regexp_extract(a, ':([0-9]*)$', 1) IN ('', '80', '443') AND contains(a, '.') AND NOT regexp_matches(regexp_replace(a, ':[0-9]*$', ''), '^[0-9.]+$') AND NOT regexp_matches(regexp_replace(a, ':[0-9]*$', ''), '(?:^|[.])(?:localhost|local|internal)$') AS allowed FROM u")
def sc24(spark, d):
    return table(spark, d, "pages").select("page_id", urls.allowed(F.expr(_ODD_URL)).alias("allowed"))
