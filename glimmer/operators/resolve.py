"""Entity resolution: accumulation, leader clustering and guarded merging."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.text import TECH_FAMILIES, TECH_FORBIDDEN, markers, name_key
from glimmer.operators.components import connected_components
from glimmer.operators.matching import FREQUENT
from glimmer.session import in_slices, written


#: Unlike sets hardly ever share so many parts.
SHARED = 4
#: Tokens in a section of the smallest set of its size, and the parts that these are dealt to.
SECTION, DEAL = 32, 28
#: A sketch of a section: the parity of its tokens in so many bins, then its size, up to 255.
BINS = 55
#: Up to so many keys or pairs are sent to all tasks, after a count.
KEYS = 2_000_000


def leaders(rows: DataFrame, least: float = 0.75, few: int = 200_000, most: int = 8, soon: int = 10_000) -> DataFrame:
    """(id, leader) for rows (id, tokens): each joins the first earlier leader with such a Jaccard similarity, in order of id.

    Rows that may be similar meet by shared parts of the token sets, as in `similar_sets`, but each meets its `most` first likely ones only in a part, so a large group of near copies gives no square of
    pairs. Of more than `soon` candidates each row is compared with its first one, then with four times as many. Who follows is decided after each such round (`followers`): what follows leads
    nobody, and what has found a leader asks no more. Rows that were cut short in a part and found no leader meet again those that lead or wait, with four times the bound,
    until none waits. In the end all that follow and were once cut short meet the leaders before their own, for the first.
    Rows whose tokens are null are no rows; those without tokens follow the first of their kind."""
    # Tokens are 64-bit digests from here on. Written first and looked at only then, so that what makes the tokens runs once.
    digests = F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t))))
    every = written(rows.select("id", digests.alias("tokens")), "rows").where("tokens is not null").withColumns({"h": F.xxhash64("tokens"), "k": F.xxhash64(F.lit(1), "tokens")})
    # Rows with equal tokens follow the first of them, whatever the order: they are one row until the end.
    first = written(every.select("id", "h", "k").join(every.groupBy("h", "k").agg(F.min("id").alias("first")), ["h", "k"]).select("id", "first"), "first")
    sets = every.select("id", "tokens").join(_sent(written(first.where("id <> first").select("id"), "copies")), "id", "left_anti")

    found = _met(_entries(sets, least), least, most)
    hot = found.where("part is not null").select(F.col("a").alias("id"), "part", "sketch", "cut")
    short = cut = written(hot.where("cut").select(F.col("id").alias("node")).distinct(), "cut")
    bins = written(_bins(sets), "bins")
    seen = rest = written(_near(_pairs(found), bins, least), "candidates")
    pairs = behind = None
    drop = lambda df, side: df if behind is None else df.join(behind.toDF(side), side, "left_anti")
    take = 1
    while True:
        now, later = _next(rest, take, soon)
        now = _similar(now, sets, least)
        pairs = now if pairs is None else pairs.unionByName(now)
        asked = written(drop(drop(pairs, "a"), "b"), "alike")
        new = followers(asked, few, open=cut.unionByName(later.select(F.col("b").alias("node"))).distinct())
        behind = new if behind is None else behind.unionByName(new)
        rest = written(drop(drop(later, "a"), "b"), "candidates")
        if rest.isEmpty():
            waiting = drop(drop(asked, "a").select(F.col("b").alias("node")).unionByName(cut).distinct(), "node")
            if cut.isEmpty() or (waiting := written(waiting, "waiting")).isEmpty():
                break
            most *= 4
            found = _met(drop(hot, "id"), least, most)
            rest = written(_near(_pairs(found).join(waiting.toDF("b"), "b", "left_semi").join(seen, ["a", "b"], "left_anti"), bins, least), "candidates")
            cut = written(found.where("cut").select(F.col("a").alias("node")).distinct().join(waiting, "node", "left_semi"), "cut")
            seen = seen.unionByName(rest)
        take *= 4

    led = written(drop(pairs.join(behind.toDF("b"), "b", "left_semi"), "a").groupBy("b").agg(F.min("a").alias("leader")), "led")
    late = written(led.join(short.toDF("b"), "b", "left_semi"), "late")
    if not late.isEmpty():
        seek = hot.join(late.select(F.col("b").alias("id")), "id", "left_semi").withColumn("seeks", F.lit(True))
        found = _met(drop(hot, "id").withColumn("seeks", F.lit(False)).unionByName(seek), least, None)
        rest, take = written(_near(_pairs(found).join(seen, ["a", "b"], "left_anti").join(led, "b").where("a < leader"), bins, least), "candidates"), 1
        while not rest.isEmpty():
            now, later = _next(rest, take, soon)
            led = written(led.unionByName(_similar(now, sets, least).select("b", F.col("a").alias("leader"))).groupBy("b").agg(F.min("leader").alias("leader")), "led")
            rest, take = written(later.join(led, "b").where("a < leader").select("a", "b"), "candidates"), 4 * take
    return first.join(led.withColumnRenamed("b", "first"), "first", "left").select("id", F.coalesce("leader", "first").alias("leader"))


def _next(rest: DataFrame, take: int, soon: int) -> tuple[DataFrame, DataFrame]:
    """Of candidates (a, b) the first ones of each b, all if they are few, and the others."""
    placed = rest.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy("a")) if rest.count() > soon else F.lit(1))
    return written(placed.where(F.col("place") <= take).select("a", "b"), "asked"), written(placed.where(F.col("place") > take).select("a", "b"), "later")


def _sent(keys: DataFrame) -> DataFrame:
    """A written table, for joins: sent to all tasks if it has been counted as small."""
    return F.broadcast(keys) if keys.count() <= KEYS else keys


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of sets (id, tokens: distinct digests in order) that have at least such a Jaccard similarity.

    Tokens are dealt to sections by their value, as many as fit the size (doubled sizes have doubled sections; a set goes to the sizes of all that may be similar and as large). Of sets that are so
    similar at least one section is so similar too, since the whole is a mean of its sections. So sections are compared, each a small set.
    Sections of na and nb tokens that are so similar differ in at most (1 - least) / (1 + least) * (na + nb) tokens, and so in at most d = (1 - least) / least * na. Their tokens are dealt to parts by value
    again. A differing token spoils one part, so all but d of the parts of either are equal in both, and the first d + 1 of its parts in one order hold one: only these are joined. A part of several tokens, rarest first, is
    equal by chance far less often than a token. Sections that have no more than d parts meet by their rarest tokens as well. With each part goes a sketch of its section: the parity of its tokens
    in some bins. Sketches differ in no more bins than sections in tokens, so pairs that share a part by chance end where they meet. What is left is compared by the sketches of all sections, then by the sets."""
    pairs = _pairs(_met(_entries(sets, least), least, None))
    return _similar(written(_near(pairs, written(_bins(sets), "bins"), least), "candidates"), sets, least)


def _entries(sets: DataFrame, least: float) -> DataFrame:
    """(id, sketch, part): the parts of sets (id, tokens) by which they are joined."""
    often = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).orderBy(F.desc("f"), "t").limit(FREQUENT).toArrow()
    # How much a token tells, in whole numbers so that equal parts have equal sums; those that are not among the most frequent tell alike.
    f = np.append(often["f"].to_numpy(), 1)
    order = np.argsort(often["t"].to_numpy())
    known = sets.sparkSession.sparkContext.broadcast((often["t"].to_numpy()[order], np.rint(16 * np.log2(f.max() / f[:-1])).astype(np.int64)[order], int(16 * np.log2(f.max() / f[:-1].min(initial=f.max()))) + 16))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from _first_parts(batch.slice(at, 512), least, *known.value)

    return sets.where(F.size("tokens") > 0).select("id", "tokens").mapInArrow(parts, f"id {dict(sets.dtypes)['id']}, sketch long, part long")


def _first_parts(batch: pa.RecordBatch, least: float, frequent: np.ndarray, tells: np.ndarray, rare: int) -> Iterator[pa.RecordBatch]:
    """(id, sketch, part) of a slice of sets (id, tokens): hashes of the parts by which `similar_sets` joins. A sketch is negative where the set is smaller than the size that the sections are made for."""
    lists = batch.column("tokens")
    every = lists.flatten().to_numpy(zero_copy_only=False)
    n_of = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    at = np.minimum(np.searchsorted(frequent, every), max(len(frequent) - 1, 0))
    told = np.where(frequent[at] == every, tells[at], rare) if len(frequent) else np.full(len(every), rare)
    row_of = np.repeat(np.arange(len(n_of)), n_of)
    scale = np.floor(np.log2(n_of)).astype(np.int64)
    larger = np.floor(n_of / least + 1e-9).astype(np.int64)
    for up in range(int((np.floor(np.log2(larger)).astype(np.int64) - scale).max(initial=-1)) + 1):
        g = scale + up
        # Sections of all rows that go here, numbered on.
        sections = np.where(larger >= 1 << g, np.maximum((1 << g) // SECTION, 1), 0)
        start = np.cumsum(sections) - sections
        row_at = np.repeat(np.arange(len(n_of)), sections)
        here = (sections > 0)[row_of]
        row, t, w = row_of[here], every[here].view(np.uint64), told[here]
        at = start[row] + (t & (sections[row] - 1).astype(np.uint64)).astype(np.int64)
        n = np.bincount(at, minlength=len(row_at))
        kept, bare = _cut(at, (t >> np.uint64(32)).astype(np.int64) % DEAL, t, w, np.floor((1 - least) / least * n + 1e-9).astype(np.int64), 1)
        single = bare[at]
        by_token, _ = _cut(at[single], np.arange(int(single.sum())), t[single], w[single], n - np.ceil(least * n - 1e-9).astype(np.int64), 1)
        sketch = np.zeros(len(n), np.int64)
        np.bitwise_xor.at(sketch, at, np.int64(1) << (_mixed(t) % np.uint64(BINS)).astype(np.int64))
        sketch |= np.minimum(n, 255) << BINS
        if up:
            sketch |= np.int64(-(2**63))
        for (s, part, _), salt in ((kept, 1), (by_token, 2)):
            part = _mixed(part + (g[row_at[s]].astype(np.uint64) * np.uint64(4) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row_at[s])), pa.array(sketch[s]), pa.array(part)], names=["id", "sketch", "part"])


def _met(entries: DataFrame, least: float, most: int | None) -> DataFrame:
    """(a, b, part, sketch, cut) of (id, sketch, part), written. Pairs have no part: a row meets its `most` first likely ones in each part, earlier by id. The entries of parts in which a row was cut short
    come as (a: id, part, sketch, cut: is it this row). Where entries have a column `seeks`, those that seek meet all others, earlier or not, and not each other."""
    kind = dict(entries.dtypes)["id"]
    if "seeks" not in entries.columns:
        entries = entries.withColumn("seeks", F.lit(False))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, 65_536
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= due:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                part = whole.column("part").to_numpy()
                # The last part may go on; a part of very many rows is not looked at again for each batch.
                ends = int(np.searchsorted(part, part[-1]))
                if ends:
                    yield from _likely(whole.slice(0, ends), least, most)
                held, n = [whole.slice(ends)], n - ends
                due = max(65_536, 2 * n)
        if n:
            yield from _likely(pa.Table.from_batches(held).combine_chunks().to_batches()[0], least, most)

    dealt = entries.select("id", "sketch", "part", "seeks").repartition("part").sortWithinPartitions("part", "seeks", "id")
    return written(dealt.mapInArrow(meet, f"a {kind}, b {kind}, part long, sketch long, cut boolean"), "met")


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("part is null and a < b").select("a", "b").distinct()


def _likely(batch: pa.RecordBatch, least: float, most: int | None) -> Iterator[pa.RecordBatch]:
    """What `_met` returns of whole parts (id, sketch, part, seeks), in order of part, seeks and id."""
    ids, sketch, part, seeks = batch.column("id"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("sketch", "part", "seeks"))
    bins, n, own = sketch & ((1 << BINS) - 1), (sketch >> BINS) & 255, sketch >= 0
    # Sizes from 255 on are not known.
    apart = np.where(n < 255, (1 - least) / (1 + least) * n, 1e9)
    new = np.r_[True, part[1:] != part[:-1]][: len(part)]
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    asked = np.where(seeks, np.add.reduceat(~seeks, np.flatnonzero(new), dtype=np.int64)[np.cumsum(new) - 1], np.arange(len(part)) - start)
    names = ["a", "b", "part", "sketch", "cut"]
    none = lambda k, kind: pa.nulls(k, kind)
    met, cut, out, r = np.zeros(len(part), np.int64), np.zeros(len(part), bool), [], 0
    i = np.flatnonzero(asked > 0)
    while len(i):
        j = start[i] + r
        ok = (own[i] | own[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (np.bitwise_count(bins[i] ^ bins[j]) <= apart[i] + apart[j] + 1e-9)
        out.append((j[ok], i[ok]))
        met[i[ok]] += 1
        r += 1
        i = i[asked[i] > r]
        if most:
            full = met[i] >= most
            cut[i[full]] = True
            i = i[~full]
        if not len(i) or r % 64 == 0:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), *(none(len(a), k) for k in (pa.int64(), pa.int64(), pa.bool_()))], names=names)
            out = []
    if cut.any():
        hot = np.flatnonzero(np.logical_or.reduceat(cut, np.flatnonzero(new))[np.cumsum(new) - 1])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(hot)), none(len(hot), ids.type), pa.array(part[hot]), pa.array(sketch[hot]), pa.array(cut[hot])], names=names)


def _bins(sets: DataFrame) -> DataFrame:
    """(id, n, bins) of sets (id, tokens): the size, and for each section the parity of its tokens in 64 bins."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            t = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            sections = np.maximum((1 << np.floor(np.log2(n)).astype(np.int64)) // SECTION, 1)
            start = np.r_[0, np.cumsum(sections)]
            bins = np.zeros(start[-1], np.uint64)
            np.bitwise_xor.at(bins, np.repeat(start[:-1], n) + (t & np.repeat(sections - 1, n).astype(np.uint64)).astype(np.int64), np.uint64(1) << (_mixed(t) >> np.uint64(58)))
            bins = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(bins.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), bins], names=["id", "n", "bins"])

    return sets.where(F.size("tokens") > 0).mapInArrow(sketch, f"id {dict(sets.dtypes)['id']}, n long, bins array<long>")


def _near(pairs: DataFrame, bins: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) but those that differ in too many bins. Of two sets the one with more sections is folded to as many as the other has: sections are dealt by the last bits of a token."""
    both = pairs.select("a", "b").join(bins.toDF("a", "na", "ba"), "a").join(bins.toDF("b", "nb", "bb"), "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    k = F.least(F.size("ba"), F.size("bb"))
    fold = lambda c: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.aggregate(F.sequence(i, F.size(c) - 1, k), F.lit(0).cast("long"), lambda x, at: x.bitwiseXOR(F.get(c, at))))
    folded = lambda c: F.when(F.size(c) == k, F.col(c)).otherwise(fold(c))
    differ = F.aggregate(F.zip_with(folded("ba"), folded("bb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return both.where(differ <= (1 - least) / (1 + least) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the written pairs (a, b) whose sets (id, tokens) have such a Jaccard similarity."""
    # Where few pairs are sent to the sets, only sets of these pairs are moved, once for each pair.
    one = sets.toDF("b", "tb").join(_sent(pairs), "b")
    other = sets.join(_sent(written(pairs.select(F.col("a").alias("id")).distinct(), "keys")), "id", "left_semi").toDF("a", "ta")
    both = F.size(F.array_intersect("ta", "tb"))
    return written(one.join(other, "a").where(both / (F.size("ta") + F.size("tb") - both) >= least).select("a", "b"), "pairs")


def _cut(row: np.ndarray, part: np.ndarray, t: np.ndarray, w: np.ndarray, d: np.ndarray, shared: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(row, hash, k) of the first d + k parts of each row, those that tell most first, where k is `shared` or as many as there are, and which rows have d parts at most."""
    order = np.lexsort((part, row))
    row, part = row[order], part[order]
    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.zeros(0, np.int64)
    h = _mixed(np.add.reduceat(_mixed(t[order]), start)) if len(row) else np.zeros(0, np.uint64)
    tells = np.add.reduceat(w[order], start) if len(row) else np.zeros(0, np.int64)
    row = row[start]
    order = np.lexsort((h, -tells, row))
    row, h = row[order], h[order]
    has = np.bincount(row, minlength=len(d))
    place = np.arange(len(row)) - (np.cumsum(has) - has)[row]
    k = np.clip(has - d, 1, shared)
    ok = place < (d + k)[row]
    return (row[ok], h[ok], k[row[ok]]), has <= d


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def followers(pairs: DataFrame, few: int = 200_000, slow: float = 0.1, open: DataFrame | None = None) -> DataFrame:
    """(node): the rows of similar pairs (a < b) that are no leaders: a row leads if no earlier row that it is similar to leads.

    This is the first maximal independent set in the order, found in rounds: a row without an earlier undecided neighbour leads, its
    neighbours follow, and all their pairs are done. Where a round ends less than a share `slow` of the pairs, rows wait for each other in chains: of those with one earlier
    neighbour only, each is the opposite of the row before, and doubled pointers carry that over the chain in logarithmically many steps. The rounds
    go on while more than `few` pairs are left; these are decided in one task, whose input is bounded by that number.

    Rows of `open` (node) may be similar to earlier rows of which no pair is known: they may follow, but do not lead, and rows that wait for them stay undecided.
    """
    left = written(pairs.select("a", "b").distinct(), "undecided")
    known = open is None or open.isEmpty()
    n, chains, done = left.count(), False, []
    while n > few:
        later = left.groupBy("b").agg(F.count(F.lit(1)).alias("k"), F.min("a").alias("a"))
        heads = left.select(F.col("a").alias("node")).distinct().join(later, F.col("node") == F.col("b"), "left_anti")
        if not known:
            heads = heads.join(open, "node", "left_anti")
        elif chains:
            heads = heads.unionByName(_ends_of_chains(later.where("k = 1").select("b", "a"), heads))
        behind = written(left.join(heads.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "followers")
        done.append(behind)
        left = written(left.join(behind.toDF("b"), "b", "left_anti").join(behind.toDF("a"), "a", "left_anti"), "undecided")
        was, n = n, left.count()
        chains = chains or was - n < slow * was
        if n == was:
            # All that are left wait.
            left = left.limit(0)
            break

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        behind, waits = set(), set(pdf.loc[pdf["waits"], "a"])
        for a, b in pdf.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):
            if a not in behind:
                (waits if a in waits else behind).add(b)
        return pd.DataFrame({"node": list(behind)}, dtype=pdf["b"].dtype)

    left = left.withColumn("waits", F.lit(False)) if known else left.join(open.select(F.col("node").alias("a"), F.lit(True).alias("waits")), "a", "left").fillna(False, "waits")
    every = left.groupBy().applyInPandas(in_order, f"node {dict(pairs.dtypes)['b']}")
    for behind in done:
        every = every.unionByName(behind)
    return written(every, "followers")


def _ends_of_chains(links: DataFrame, heads: DataFrame) -> DataFrame:
    """(node): leaders among rows with one earlier neighbour (b, a), where a chain of such rows leads back to one of the heads: those an even number of steps away."""
    at = written(links.select(F.col("b").alias("node"), F.col("a").alias("to"), F.lit(True).alias("odd")), "chain")
    while True:
        jump = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        step = at.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.when(F.col("more"), ~F.col("odd")).otherwise(F.col("odd")).alias("odd"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "chain")
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at.where("not odd").join(heads.withColumnRenamed("node", "to"), "to", "left_semi").select("node")


def guarded_merge(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, score, result) for pairs (a, b, score) of rows (id, object, markers): in order of score two groups are merged if every
    member is compatible with every other: equal known objects and equal markers. Refused pairs keep their reason.
    All pairs, vetoed ones too, make the components in which the order is followed."""
    comp = connected_components(pairs, "a", "b")
    side = rows.select("id", "object", "markers")
    p = pairs.join(comp, pairs["a"] == comp["node"]).drop("node")
    p = p.join(side.toDF("a", "oa", "ma"), "a").join(side.toDF("b", "ob", "mb"), "b")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        facts, group, out = {}, {}, []
        for r in pdf.itertuples():
            facts[r.a], facts[r.b] = (r.oa, tuple(r.ma)), (r.ob, tuple(r.mb))
        group = {i: {i} for i in facts}

        def fits(x, y):
            if facts[x][0] is None or facts[x][0] != facts[y][0]:
                return "different_object"
            return None if facts[x][1] == facts[y][1] else "different_markers"

        for r in pdf.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples():
            if group[r.a] is group[r.b]:
                out.append((r.a, r.b, r.score, "same_group"))
                continue
            why = fits(r.a, r.b) or next((f"chain_{w}" for x in sorted(group[r.a]) for y in sorted(group[r.b]) if (w := fits(x, y))), None)
            out.append((r.a, r.b, r.score, why or "merged"))
            if not why:
                both = group[r.a] | group[r.b]
                for i in both:
                    group[i] = both
        return pd.DataFrame(out, columns=["a", "b", "score", "result"])

    return p.groupBy("component").applyInPandas(merge, "a long, b long, score double, result string")


def equivalents(pairs: DataFrame, rows: DataFrame, least: float = 0.90, few: int = 200_000) -> DataFrame:
    """(a, b, score, result) for pairs (a < b, score) of at least such a similarity, of rows (id, text, object).

    In order of score, b joins the group of a. Nothing is inferred through a third row: a row that has joined a group takes no part in
    further pairs, a group is not merged into another, and a row that joins has to be similar to and fit every member. Two rows fit if no rule
    keeps their texts apart, their objects share half of their stems (an unknown object fits none), and their texts have marks of the same families.
    Only pairs that fit can merge (`_merges`); what became of the others follows from when their rows joined or got a member.
    """
    text = F.lower("text")
    stems = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("object"), F.lit(r"[\p{L}\p{N}-]{4,}"), 0), lambda w: F.substring(w, 1, 6)))
    # One bit for each rule: the text has its first, its second mark.
    bits = lambda side: sum((F.when(text.rlike("(?U)" + rule[side]), 1 << i).otherwise(0) for i, rule in enumerate(TECH_FORBIDDEN)), F.lit(0))
    facts = rows.select("id", bits(0).alias("first"), bits(1).alias("second"), stems.alias("object"), markers(text, TECH_FAMILIES).alias("families"))
    p = pairs.where(F.col("score") >= least).select("a", "b", "score")
    for end in "ab":
        p = p.join(facts.toDF(end, *[f"{name}_{end}" for name in facts.columns[1:]]), end)
    forbidden = F.col("first_a").bitwiseAND(F.col("second_b")).bitwiseOR(F.col("first_b").bitwiseAND(F.col("second_a"))) != 0
    apart = F.when(forbidden, "forbidden_pair").when(~same_object(F.col("object_a"), F.col("object_b")), "different_object").when(F.col("families_a") != F.col("families_b"), "different_families")
    judged = written(p.select("a", "b", "score", apart.alias("apart")), "judged")
    fit = judged.where("apart is null").select("a", "b", "score")
    merged = _merges(fit.where("a < b"), few).withColumn("at", _turn())

    joined = merged.select(F.col("b").alias("node"), "at", F.lit(None).cast(merged.schema["at"].dataType).alias("since"))
    heads = merged.groupBy(F.col("a").alias("node")).agg(F.min("at").alias("since")).select("node", F.lit(None).cast(merged.schema["at"].dataType).alias("at"), "since")
    state = written(joined.unionByName(heads), "states")
    found = judged
    for end in "ab":
        found = found.join(state.toDF(end, f"at_{end}", f"since_{end}"), end, "left")
    turn = _turn()
    earlier = lambda c: F.coalesce(F.col(c) < turn, F.lit(False))
    result = F.when(F.col("at_b") == turn, "merged").when(earlier("at_a") | earlier("at_b"), "already_joined").when(earlier("since_b"), "is_a_group").when(~earlier("since_a"), F.col("apart")).when(F.col("apart").isNull(), "not_all_fit")
    found = written(found.select("a", "b", "score", result.alias("result"), "apart"), "results")

    # A pair that does not fit, of a row that has members: do all of these, so far, fit b? They are counted, and those that do.
    asked = found.where("result is null").select("a", "b", "score", "apart", turn.alias("at"))
    members = merged.select("a", F.lit(None).cast(dict(found.dtypes)["b"]).alias("b"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("apart"), "at")
    so_far = Window.partitionBy("a").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = asked.unionByName(members).withColumn("members", F.count(F.when(F.col("b").isNull(), 1)).over(so_far)).where("b is not null")
    ends = fit.select(F.col("a").alias("m"), F.col("b").alias("b")).unionByName(fit.select(F.col("b").alias("m"), F.col("a").alias("b")))
    fits = ends.join(merged.select(F.col("b").alias("m"), "a", F.col("at").alias("joined")), "m").where("a < b").select("a", "b", "joined")
    counted = asked.join(fits, ["a", "b"], "left").groupBy("a", "b", "score", "apart", "members").agg(F.count(F.when(F.col("joined") < F.col("at"), 1)).alias("fitting"))
    late = counted.select("a", "b", "score", F.when(F.col("fitting") < F.col("members"), "not_all_fit").otherwise(F.col("apart")).alias("result"))
    return found.where("result is not null").select("a", "b", "score", "result").unionByName(late)


def _turn() -> Column:
    """When the turn of a pair (a, b, score) comes."""
    return F.struct((-F.col("score")).alias("s"), F.col("a").alias("a"), F.col("b").alias("b"))


def _merges(fit: DataFrame, few: int) -> DataFrame:
    """(a, b, score): those of pairs that fit, each once, in which b joins a, as in `equivalents`.

    In each round the pairs whose turn comes first for both their rows are merged: no other pair can change these rows before. Pairs of a row that joined, pairs that would join a row with members, and those of
    a head with a row that does not fit its new member are done with; so all that are left fit the groups as they are. Rounds go on while more
    than `few` pairs are left; these are followed in one task, whose input is bounded by that number."""
    left, done = written(fit, "fitting"), []
    while left.count() > few:
        ends = left.select(F.col("a").alias("node"), _turn().alias("at")).unionByName(left.select(F.col("b").alias("node"), _turn().alias("at")))
        both = ends.groupBy("node").agg(F.min("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        new = written(both.select("at.a", "at.b", (-F.col("at.s")).alias("score")), "merged")
        done.append(new)
        heads, joined = new.select("a"), new.select("b")
        kept = left.join(joined.toDF("a"), "a", "left_anti").join(joined.unionByName(heads.toDF("b")), "b", "left_anti")
        sides = left.select(F.col("a").alias("m"), "b").unionByName(left.select(F.col("b").alias("m"), F.col("a").alias("b")))
        fitting = sides.join(new.select(F.col("b").alias("m"), "a"), "m").select("a", "b")
        left = written(kept.join(heads, "a", "left_anti").unionByName(kept.join(heads, "a", "left_semi").join(fitting, ["a", "b"], "left_semi").select("a", "b", "score")), "fitting")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        fits, group, joined, keep = set(zip(pdf["a"], pdf["b"], strict=True)), {}, set(), []
        pdf = pdf.sort_values(["score", "a", "b"], ascending=[False, True, True])
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            ok = not (a in joined or b in joined or b in group) and all((min(k, b), max(k, b)) in fits for k in group.get(a, ()))
            keep.append(ok)
            if ok:
                group.setdefault(a, []).append(b)
                joined.add(b)
        return pdf.loc[keep, ["a", "b", "score"]]

    every = left.select("a", "b", "score").groupBy().applyInPandas(follow, left.schema)
    for new in done:
        every = every.unionByName(new)
    return written(every, "merged")


def mechanisms(rows: DataFrame) -> DataFrame:
    """(id, root, mechanism) for rows (id, term, name): rows are of one mechanism if they share a term or a name, directly or through others.
    Each row is linked to the first with its term and the first with its name, so a common one makes a star, not all pairs."""
    keyed = written(rows.select("id", name_key(F.col("term")).alias("term"), name_key(F.col("name")).alias("name")), "named")
    links = None
    for key in ("term", "name"):
        own = keyed.where(F.coalesce(F.col(key), F.lit("")) != "").select("id", key)
        first = own.join(own.groupBy(key).agg(F.min("id").alias("first")), key).select("id", "first")
        links = first if links is None else links.unionByName(first)
    comp = connected_components(links, "id", "first")
    rooted = keyed.select("id").join(comp, keyed["id"] == comp["node"], "left").select("id", F.coalesce("component", "id").alias("root"))
    label = keyed.select(F.col("id").alias("root"), F.coalesce(F.nullif("term", F.lit("")), F.nullif("name", F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string"))).alias("mechanism"))
    return rooted.join(label, "root").select("id", "root", "mechanism")


def senses(rows: DataFrame, group: str, key: str, vector: str, most: float = 0.18) -> DataFrame:
    """(group, key, sense): average-linkage clusters of unit vectors within each group, merged while the mean cosine distance is at most `most`.
    A group is the few results of one query."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.stack(pdf[vector].to_numpy()).astype(float)
        d = 1 - v @ v.T
        np.fill_diagonal(d, np.inf)
        members = [[i] for i in range(len(v))]
        size = np.ones(len(v))
        while len(v) > 1:
            i, j = sorted(np.unravel_index(d.argmin(), d.shape))
            if d[i, j] > most:
                break
            d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
            size[i] += size[j]
            members[i] += members[j]
            members[j] = []
        ids = pdf[key].to_numpy()
        rows = [(pdf[group].iloc[0], ids[m], ids[min(ms)]) for ms in members for m in ms]
        return pd.DataFrame(rows, columns=[group, key, "sense"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(group).applyInPandas(cluster, f"{group} {types[group]}, {key} {types[key]}, sense {types[key]}")


def abbreviations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, abbreviation, expansion): "long form (ABBR)" and "ABBR (long form)", aligned letter by letter from the right; the first definition of a
    document counts. A long form has two words or more; before a bracket an abbreviation is told by its capitals or digits."""
    reverse = re.compile(r"(?<![\w-])([A-Za-z0-9][\w-]{1,11}) \(([^()\n]{2,60})\)")
    found = re.compile(r"(?<=[ \t])\(([A-Za-z][\w-]{1,9})\)")
    before = re.compile(r"(?:[\w'-]+[ \t]+){1,12}$")

    def align(long: str, short: str) -> str | None:
        i = len(long) - 1
        for at in range(len(short) - 1, -1, -1):
            c = short[at].lower()
            if not c.isalnum():
                continue
            while i >= 0 and (long[i].lower() != c or (at == 0 and i > 0 and long[i - 1].isalnum())):
                i -= 1
            if i < 0:
                return None
            i -= 1
        return long[i + 1 :].strip()

    def mine(parts):
        for pdf in parts:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                seen = set()
                for m in found.finditer(t or ""):
                    line = t.rfind("\n", 0, m.start()) + 1
                    words = before.search(" ".join(t[line : m.start()].split(" ")[-13:]))
                    long = align(words[0].rstrip(), m[1]) if words else None
                    if long and m[1] not in seen and len(long) > len(m[1]) and len(long.split()) >= 2:
                        seen.add(m[1])
                        out.append((k, m[1], long))
                for m in reverse.finditer(t or ""):
                    letters = [c for c in m[1] if c.isalpha()]
                    told = letters and (sum(c.isupper() for c in letters) >= max(2, len(letters) // 2) or len(letters) < len(m[1].replace("-", "").replace("_", "")))
                    long = align(m[2].strip(), m[1]) if told and len(m[2].split()) >= 2 else None
                    if long and m[1] not in seen:
                        seen.add(m[1])
                        out.append((k, m[1], long))
            yield pd.DataFrame(out, columns=[key, "abbreviation", "expansion"])

    kind = docs.schema[key].dataType.simpleString()
    return in_slices(docs.select(key, text), mine, f"{key} {kind}, abbreviation string, expansion string")


def conflicts(accepted: DataFrame, protected: DataFrame) -> DataFrame:
    """(candidate, x, y): candidates accepted for both numbers of a protected pair. The table of pairs is short and fixed."""
    x, y = accepted.select("candidate", F.col("number").alias("x")), accepted.select("candidate", F.col("number").alias("y"))
    return x.join(F.broadcast(protected), "x").join(y, ["candidate", "y"]).select("candidate", "x", "y").distinct()


def same_object(a: Column, b: Column, least: float = 0.5) -> Column:
    """Jaccard of six-letter stems; an unknown object is never the same."""
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= least), F.lit(False))
