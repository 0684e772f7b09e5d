"""Fair selection under quotas, query plans, batches and passages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.text import STOP_WORDS
from glimmer.session import in_slices


def fair_urls(hits: DataFrame, per_owner: int, limit: int, exempt: str = "false") -> DataFrame:
    """Hits (query, first_seen, position, url_key, owner) in fair order: one of each query before any second, each url
    once, at most `per_owner` of an owner (exempt ones use its places but always pass), `limit` in all."""
    depth = F.row_number().over(Window.partitionBy("query").orderBy("position", "url_key"))
    ordered = hits.withColumn("depth", depth)
    first = F.row_number().over(Window.partitionBy("url_key").orderBy("depth", "first_seen"))
    unique = ordered.withColumn("_n", first).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("owner").orderBy("depth", "first_seen"))
    kept = unique.withColumn("_o", place).where((F.col("_o") <= per_owner) | F.expr(exempt))
    return kept.orderBy("depth", "first_seen").limit(limit).drop("_n", "_o")


def admitted(calls: DataFrame, per_caller: int, per_day: int) -> DataFrame:
    """Calls (day, caller, at, id) with `ok`: within the caller's and the day's quota; refused calls do not count."""
    mine = F.row_number().over(Window.partitionBy("day", "caller").orderBy("at", "id"))
    own = calls.withColumn("_mine", mine).withColumn("_ok", F.col("_mine") <= per_caller)
    nth = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy("day").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("ok", F.col("_ok") & (nth <= per_day)).drop("_mine", "_ok")


def query_plan(subjects: DataFrame, key: str, russian, primary: str, others: list[str], limit: int, lenses: int = 3, share: float = 0.2) -> DataFrame:
    """(key, lang, lens, depth): each subject is asked with the primary lens before any is asked with a second; the others take turns. Those
    with a Russian name are asked in Russian too, up to `share` of the `limit`, which they take from the end of the English ones. Both parts are cut to `limit`."""
    depth = F.explode(F.sequence(F.lit(0), F.lit(lenses - 1)))
    turn = F.element_at(F.array(*[F.lit(x) for x in others]), ((F.col(key) + F.col("depth") - 1) % len(others) + 1).cast("int"))
    english = subjects.select(key, depth.alias("depth")).select(key, F.lit("en").alias("lang"), F.when(F.col("depth") == 0, primary).otherwise(turn).alias("lens"), F.col("depth").cast("long").alias("depth"))
    ru = subjects.where(russian).select(key, F.lit("ru").alias("lang"), F.lit(primary).alias("lens"), F.lit(0).cast("long").alias("depth")).orderBy(key).limit(int(limit * share))
    return english.orderBy("depth", key).limit(limit - ru.count()).unionByName(ru)


def placed(rows: DataFrame, key: str, order: list, name: str = "place") -> DataFrame:
    """Adds the place of each row within its key, from 1, in order. Rows are sorted by ranges and a small table of the ranges' sizes carries
    the places on, so a key with a third of all rows is many tasks."""
    from glimmer.session import written

    dealt = written(rows.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    own = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    own = own.join(sizes, own[key].eqNullSafe(sizes["_key"]) & (own["_part"] == sizes["_of"]))
    return own.select(*rows.columns, (F.col("_base") + F.col("_n")).cast("long").alias(name))


def least_used(variants: DataFrame, leaf: str, used: str, order: list[str], budget: int) -> DataFrame:
    """The first `budget` variants, each time the next one (by `order`) of the leaf that is used least, ties to the least leaf. `used` is the
    leaf's count before. Taking one raises its leaf by one, so the i-th variant of a leaf comes at the level used + i, and leaves are filled like basins: a
    sort by level, of which the first ones are kept."""
    placed_rows = placed(variants, leaf, [F.col(c) for c in order], "_nth")
    return placed_rows.withColumn("_level", F.col(used) + F.col("_nth")).orderBy("_level", leaf).limit(budget).drop("_nth", "_level")


def interleaved(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds `turn`, the place within the group: ordered by (turn, group), rows alternate between groups."""
    return placed(rows, group, [F.col(order)], "turn")


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """(group, batch, items) with up to `size` values of `order` in each batch."""
    n = placed(rows.select(group, order), group, [F.col(order)], "n")
    return n.select(group, order, F.floor((F.col("n") - 1) / size).alias("batch")).groupBy(group, "batch").agg(F.sort_array(F.collect_list(order)).alias("items"))


@cache
def _piece(size: int) -> re.Pattern:
    """What one passage takes from where it begins: all that is left if it fits, else as much as ends before a line end, else before a blank, in the second half, else `size` characters."""
    half = f".{{{max(1, size // 2)},{max(1, size - 1)}}}"
    return re.compile(rf"(?s).{{1,{size}}}\Z|{half}(?=\n)|{half}(?= )|.{{{size}}}")


_BLANK_OR_END = re.compile(r"\s|\Z")


def cut(text: str, size: int = 1200) -> list[tuple[int, int]]:
    """(start, end) of passages of up to `size` characters, without blanks at the ends; blank ones are left out. A passage begins at the first blank of
    the last min(160, size / 5) characters of the one before (or where that ends), so a sentence across a boundary is whole in one of them."""
    out, m = [], _piece(size).match(text)
    while m:
        words = m[0].strip()
        if words:
            start = m.start() + m[0].index(words)
            out.append((start, start + len(words)))
        again = _BLANK_OR_END.search(text, max(m.start() + 1, m.end() - min(160, size // 5)), m.end())
        m = _piece(size).match(text, again.start()) if m.end() < len(text) else None
    return out


def passages(docs: DataFrame, key: str, text: str, size: int = 1200) -> DataFrame:
    """(key, n, start, end, passage) of each document."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(pdf[key], pdf[text], strict=True) if t for i, (a, b) in enumerate(cut(t, size))]
            yield pd.DataFrame(rows, columns=[key, "n", "start", "end", "passage"])

    kind = docs.schema[key].dataType.simpleString()
    return in_slices(docs.select(key, text), split, f"{key} {kind}, n int, start int, end int, passage string")


def contexts(docs: DataFrame, key: str, text: str, pattern: str, before: int = 350, after: int = 650, most: int = 3) -> DataFrame:
    """(key, n, start, end): windows around matches of a pattern, at most so many of a text; a match whose window would overlap one before is passed over."""
    marker = re.compile(pattern)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                last, n = 0, 0
                for m in marker.finditer(t or ""):
                    if n == most:
                        break
                    a, b = max(0, m.start() - before), min(len(t), m.end() + after)
                    if n and a < last:
                        continue
                    rows.append((k, n, a, b))
                    last, n = b, n + 1
            yield pd.DataFrame(rows, columns=[key, "n", "start", "end"])

    kind = docs.schema[key].dataType.simpleString()
    return in_slices(docs.select(key, text), find, f"{key} {kind}, n int, start int, end int")


def incidence(sets: list[set], words: list[str]) -> np.ndarray:
    """(sets x words), true where the set holds the word."""
    column = {w: i for i, w in enumerate(words)}
    held = np.zeros((len(sets), len(words)), bool)
    for row, s in zip(held, sets, strict=True):
        for w in s & column.keys():
            row[column[w]] = True
    return held


def weighted(tokens: list[set], queries: list[set]) -> list[float]:
    """For each passage the best share of a query's words that it holds, words weighed by 1 + ln((passages + 1) / (1 + passages with the word))."""
    words = sorted(set().union(*queries))
    if not words:
        return [0.0] * len(tokens)
    held, asked = incidence(tokens, words), incidence(queries, words)
    weight = 1 + np.log((len(tokens) + 1) / (1 + held.sum(axis=0)))
    best = np.zeros(len(tokens))
    for q in asked:
        # Words of the query alone, so passages that hold as much of it have the very same sum.
        part = np.where(held[:, q], weight[q], 0.0).sum(axis=1) / max(1.0, weight[q].sum())
        best = np.maximum(best, part.round(12))
    return best.tolist()


def chosen(tokens: list[set], scores: list[float], most: int) -> list[int]:
    """The passages that are read: all of a few; else the opening, then up to two thirds by their positive score, then by the share of words that none read so far has."""
    n, score = len(tokens), np.array(scores)
    if n <= most:
        return list(range(n))
    read = np.zeros(n, bool)
    read[0] = True
    ranked = np.argsort(-score, kind="stable")
    ranked = ranked[(score[ranked] > 0) & (ranked != 0)]
    read[ranked[: max(0, most * 2 // 3 - 1)]] = True
    fresh = incidence(tokens, sorted(set().union(*tokens)))
    size = np.maximum(1, fresh.sum(axis=1))
    fresh &= ~fresh[read].any(axis=0)
    while read.sum() < most:
        # The last key is the first in the order; the least index comes last of equal ones.
        share = np.where(read, -1.0, fresh.sum(axis=1) / size)
        best = np.lexsort((-np.arange(n), score, share))[-1]
        read[best] = True
        fresh &= ~fresh[best]
    return np.flatnonzero(read).tolist()


def reading_plan(docs: DataFrame, key: str, text: str, queries: str, most: int = 12, size: int = 1200, novel: float = 0.35, limit: int = 12) -> DataFrame:
    """(key, n, start, end, score, shown, fresh, unread) for each passage of a document with an array of queries: its score, whether it is read, the share of
    its words that the read ones lack, and for the `limit` most novel unread ones of at least `novel` their rank."""

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done = []
            for k, t, asked in zip(pdf[key], pdf[text], pdf[queries], strict=True):
                spans = cut(t or "", size)
                if not spans:
                    continue
                tokens = [terms(t[a:b]) for a, b in spans]
                scores = weighted(tokens, [q for q in map(terms, asked if asked is not None else []) if q])
                shown = np.zeros(len(spans), bool)
                shown[chosen(tokens, scores, most)] = True
                known = set().union(*(tokens[i] for i in np.flatnonzero(shown)))
                fresh = np.where(shown, 0.0, [len(w - known) / max(1, len(w)) for w in tokens])
                rank = np.zeros(len(spans), "int32")
                # Shown and empty ones have nothing new, also where `novel` is zero.
                told = np.argsort(-fresh, kind="stable")
                told = told[(fresh[told] >= novel) & (fresh[told] > 0)][:limit]
                rank[told] = np.arange(1, len(told) + 1)
                done += [(k, i, *span, *row) for i, (span, row) in enumerate(zip(spans, zip(scores, shown.tolist(), fresh.tolist(), rank.tolist(), strict=True), strict=True))]
            out = pd.DataFrame(done, columns=[key, "n", "start", "end", "score", "shown", "fresh", "unread"])
            yield out.assign(unread=out["unread"].astype("Int32").replace(0, pd.NA))

    kind = docs.schema[key].dataType.simpleString()
    return in_slices(docs.select(key, text, queries), plan, f"{key} {kind}, n int, start int, end int, score double, shown boolean, fresh double, unread int")


def terms(text: str) -> set[str]:
    """Distinct words of 3 letters and more in lower case, without stop words."""
    return {w for w in re.findall(r"\w{3,}", text.lower()) if w not in STOP_WORDS}


def picked(rows: DataFrame, per_query: int, per_owner: int = 2) -> DataFrame:
    """Evidence (card, query, rank, owner, id): better rank first, so many of a query and so many of an owner over all
    queries of the card. Both caps act on the same choice, so a card's rows are one run of a sorted partition, read once with two small counters."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        card, queries, owners = object(), {}, {}
        for batch in batches:
            keep = []
            for c, q, o in zip(*(batch.column(n).to_pylist() for n in ("card", "query", "owner")), strict=True):
                if c != card:
                    card, queries, owners = c, {}, {}
                ok = queries.get(q, 0) < per_query and owners.get(o, 0) < per_owner
                if ok:
                    queries[q] = queries.get(q, 0) + 1
                    owners[o] = owners.get(o, 0) + 1
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    order = [F.asc_nulls_last(c) for c in ("card", "query", "rank", "id", "owner")]
    return rows.repartition("card").sortWithinPartitions(*order).mapInArrow(pick, rows.schema)


def balanced(rows: DataFrame, limit: int, per_source: int) -> DataFrame:
    """Documents (run, group, score, sha, source, id) chosen from the least served group in turn; equal texts and full
    sources are passed over; every row gets a reason.

    The counters are shared within a run, so a run is decided in one task, but only over rows that can be chosen: of equal texts of a source the
    first; of equal texts one more than sources can be full; of a source the first per_source + limit (at most `limit` of these are copies of what
    was chosen, then the source is full); and of a group as many as can be chosen, be copies, or be of full sources before `limit` are chosen.
    The windows that cut these keep only so many rows of a key before the shuffle. Rows beyond them get their reason from what the run has chosen.
    """
    order = [F.desc("score"), F.col("id")]
    full = -(-limit // per_source)
    reach = limit + limit * (full + 1) + full * (per_source + limit)
    first = F.struct((-F.col("score")).alias("score"), "id")
    slim = rows.select("run", "group", "score", "sha", "source", "id")
    some = slim.groupBy("run", "group", "sha", "source").agg(F.min_by(F.struct("score", "id"), first).alias("r")).select("run", "group", "r.score", "sha", "source", "r.id")
    for keys, most in ((["run", "group", "sha"], full + 1), (["run", "group", "source"], per_source + limit), (["run", "group"], reach)):
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {g: list(q.sort_values(["score", "id"], ascending=[False, True]).itertuples()) for g, q in pdf.groupby("group")}
        served, seen, sources, reason = dict.fromkeys(sorted(queues), 0), set(), {}, {}
        taken = 0
        while taken < limit and any(queues.values()):
            g = min((g for g in queues if queues[g]), key=lambda g: (served[g], g))
            r = queues[g].pop(0)
            if r.sha in seen:
                reason[r.Index] = "duplicate"
            elif sources.get(r.source, 0) >= per_source:
                reason[r.Index] = "source_quota"
            else:
                reason[r.Index], taken = "selected", taken + 1
                seen.add(r.sha)
                served[g] += 1
                sources[r.source] = sources.get(r.source, 0) + 1
        return pdf.assign(reason=[reason.get(i, "limit") for i in pdf.index])

    from glimmer.session import written

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema)
    done = written(some.groupBy("run").applyInPandas(choose, types + ", reason string"), "chosen")
    taken = done.where("reason = 'selected'")
    copies = taken.select("run", "sha").distinct().withColumn("_copy", F.lit(True))
    sources = taken.groupBy("run", "source").agg((F.count(F.lit(1)) >= per_source).alias("_full"))
    out = rows.join(done.select("run", "group", "id", F.col("sha"), "reason"), ["run", "group", "id", "sha"], "left").join(copies, ["run", "sha"], "left").join(sources, ["run", "source"], "left")
    rest = F.when(F.col("_copy"), "duplicate").when(F.col("_full"), "source_quota").otherwise("limit")
    return out.withColumn("reason", F.coalesce("reason", rest)).select(*rows.columns, "reason")


def within_budget(calls: DataFrame, budget: float, few: int = 200_000) -> DataFrame:
    """Calls (kind, at, id, amount) with `within`, whether each is let through in order of (at, id), and `spent`, the kind's total
    after it (null for a refused call). A refused call spends nothing, so smaller calls after it can still pass. Amounts are not negative.

    What is left only shrinks, so a call above it is refused for good. In each round those go, and the calls up to the first that exceeds what is
    left pass: sums of days first, then calls of the day in question, so no task sees a whole kind. The last few are taken one by one.
    """
    from glimmer.session import written

    kind = F.col("amount").cast("decimal(38,6)")
    left = written(calls.withColumns({"amount": kind, "day": F.to_date("at")}).select("kind", "day", "at", "id", "amount"), "calls")
    state = left.select("kind").distinct().withColumn("rest", F.lit(budget).cast("decimal(38,6)"))
    passed = []

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        out, rest = [], pdf["rest"].iat[0]
        for r in pdf.sort_values(["at", "id"]).itertuples():
            if r.amount <= rest:
                rest -= r.amount
                out.append((r.id, rest))
        return pd.DataFrame(out, columns=["id", "rest"])

    while True:
        left = written(left.join(state, "kind").where("amount <= rest"), "calls")
        if left.count() <= few:
            kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
            passed.append(left.groupBy("kind").applyInPandas(in_order, f"id {kinds['id']}, rest decimal(38,6)"))
            break
        days = left.groupBy("kind", "day").agg(F.sum("amount").alias("total"))
        before = Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select("kind", "day", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("kind", "day").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
        # Only days that can be reached are looked into.
        some = left.join(days, ["kind", "day"]).where("base <= rest").withColumn("total", (F.col("base") + F.sum("amount").over(inside)).cast("decimal(38,6)"))
        taken = written(some.where("total <= rest").select("kind", "id", (F.col("rest") - F.col("total")).cast("decimal(38,6)").alias("rest")), "passed")
        passed.append(taken.select("id", "rest"))
        state = left.groupBy("kind").agg(F.first("rest").alias("was")).join(taken.groupBy("kind").agg(F.min("rest").alias("now")), "kind", "left").select("kind", F.coalesce("now", "was").alias("rest"))
        left = left.drop("rest").join(taken.select("id"), "id", "left_anti")
    every = passed[0]
    for p in passed[1:]:
        every = every.unionByName(p)
    spent = (F.lit(budget).cast("decimal(38,6)") - F.col("rest")).cast("decimal(18,2)")
    return calls.join(every, "id", "left").select(*calls.columns, spent.alias("spent"), F.col("rest").isNotNull().alias("within"))
