"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised on its own with `k` centroids, so a cell is a pair of
centroids. A query visits cells by the sum of both halves' distances, with a heap over
the pairs, until they hold a share of all entries (`least` at least), and the entries are
reranked by their exact inner product. The centroids are fitted on SAMPLE vectors, chosen by a hash;
all vectors are indexed. Distances rank as inner products do: entries are scaled to norms
of at most 1 and have one more component that fills them up to 1, queries have it 0.

The share is measured, not set: for PROBES vectors of the sample their true neighbours in the sample are
found, and the share is the least that has RECALL of them in visited cells. Vectors in
clusters need a few percent; directions spread evenly over the sphere need a third or more.

The work is dealt out by runs of cells of `ENTRY_BLOCK` entries about (a larger cell is cut) and by blocks of
queries: a query goes once to each run with a cell that it visits, and an entry is copied only for
each `QUERY_BLOCK` queries that visit its run. Of equal vectors only the `n` + 1 least ids can
be among the nearest, so no more are indexed, which loses nothing and bounds a group of copies.
A query's `n`-th best inner product with the sample's vectors in its cells goes with it: what is below cannot be
among its nearest, so of most runs nothing is returned, and the rows do not grow with runs times queries.

Defined results: vectors that are null, zero, of another length than most (ties: the smaller length), or hold null, NaN or
infinite components take no part, nor do rows without id; repeated rows count once, but different vectors of one
id are rows each and can both be among the nearest, and of those of a query's id the least asks; ties go to
the smaller id; with fewer candidates than `n` all are returned; an empty table gives an
empty result. Other columns of the input are left alone and can have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.session import table, written

K = 64
#: Vectors that the centroids and the recall curve are fitted on, by number and by bytes.
SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
ROUNDS = 12
#: Share of the true neighbours of PROBES vectors of the sample that are to be in visited cells.
RECALL = 0.93
PROBES = 512
LEAST = 2_000
ENTRY_BLOCK = 2_048
QUERY_BLOCK = 8_192
MAX_BROADCAST_GROUPS = 100_000


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (v**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * v @ c.T


def centroids(v: np.ndarray, k: int = K, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from k of the vectors; the same for the same vectors."""
    c = v[np.random.default_rng(seed).permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        at = _distances(v, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def visited(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> np.ndarray:
    """For each first centroid the bit mask of the second centroids to visit, by summed distance until the cells hold `want`."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, size = d1[o1].tolist(), d2[o2].tolist(), sizes[np.ix_(o1, o2)].tolist()
    masks = [0] * len(a)
    second = o2.tolist()
    heap, reached = [(a[0] + b[0], 0, 0)], [0] * len(a)
    held = 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        masks[i] |= 1 << second[j]
        held += size[i][j]
        # (i, j + 1) once it is next in its row, and the row below once this one has begun.
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    out = np.zeros(len(a), np.uint64)
    out[o1] = np.array(masks, np.uint64)
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in order, so equal vectors have equal products."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * y[:, d]
    return s


def rerank(left: pd.DataFrame, right: pd.DataFrame, n: int) -> pd.DataFrame:
    """The nearest `n` of the entries (vec_id, v, first, second) in visited cells for each query (query_id, v, masks, bound), those under its bound left out."""
    ids, first, second = left.vec_id.to_numpy(), left["first"].to_numpy(), left.second.to_numpy().astype(np.uint64)
    x = np.stack(left.v.to_numpy()).astype(np.float64)
    q_ids = right.query_id.to_numpy()
    q = np.stack(right.v.to_numpy()).astype(np.float64)
    masks = np.stack(right.masks.to_numpy()).astype(np.int64).view(np.uint64)
    bound = right["bound"].to_numpy() if "bound" in right else np.full(len(q), -np.inf)
    # What rounding can change in a product of that length, as added up in another order.
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        open_ = (masks[i : i + 256][:, first] >> second[None] & np.uint64(1)).astype(bool)
        a, b = np.nonzero(q_ids[i : i + 256, None] == ids[None])
        own = (q[i + a] == x[b]).all(axis=1)
        open_[a[own], b[own]] = False
        open_ &= s >= (bound[i : i + 256] - slack[i : i + 256])[:, None]
        s[~open_] = -np.inf
        if s.shape[1] > n:
            open_ &= s >= (np.partition(s, -n, axis=1)[:, -n] - slack[i : i + 256])[:, None]
        a, b = np.nonzero(open_)
        score = exact(q[i + a], x[b])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < n
        out.append((q_ids[i + a[top]], ids[b[top]], score[top]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def share_for(x: np.ndarray, d1: np.ndarray, d2: np.ndarray, first: np.ndarray, second: np.ndarray, n: int, recall: float = RECALL) -> float:
    """The least share of the sample `x` that holds `recall` of the `n` nearest of its first rows, whose distances to the centroids are d1 and d2."""
    sizes = np.zeros((d1.shape[1], d2.shape[1]), np.int64)
    np.add.at(sizes, (first, second), 1)
    cell, flat, need = first * sizes.shape[1] + second, sizes.ravel(), []
    for i in range(len(d1)):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(n, len(x) - 1)]
        order = np.argsort((d1[i][:, None] + d2[i][None]).ravel(), kind="stable")
        before = np.empty(len(flat), np.int64)
        before[order] = np.cumsum(flat[order]) - flat[order]
        need.append(before[cell[near]] + 1)
    found = np.concatenate(need) if need else np.empty(0)
    return float(np.quantile(found, recall, method="higher") / len(x)) if len(found) else 1.0


def nearest(rows: DataFrame, every: int, n: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, share: float | None = None, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every` the `n` nearest others found."""
    spark = rows.sparkSession
    if k > 64:
        raise ValueError("a mask has 64 bits")
    v = F.col(vec_col)
    good = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.where(F.col(id_col).isNotNull() & v.isNotNull()).where(good)
    rows = written(rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).distinct(), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "dim").first()
    if most is None:
        return spark.createDataFrame([], schema)
    dim = most["dim"]
    rows, half = rows.where(F.size("v") == dim), dim // 2
    # The greatest norm, by way of logarithms: no square overflows.
    largest = F.array_max(F.transform("v", lambda e: F.abs(e)))
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + (e / F.col("m")) * (e / F.col("m")))
    norm = rows.withColumn("m", largest).agg(F.max(F.log("m") + F.log(square) / 2)).first()[0]

    def filled(x: np.ndarray) -> np.ndarray:
        u = x * np.exp(min(-norm, 700.0))
        return np.hstack([u, np.sqrt(np.maximum(0.0, 1.0 - (u**2).sum(1)))[:, None]])

    def asked(x: np.ndarray) -> np.ndarray:
        u = x / np.abs(x).max(axis=1, keepdims=True)
        return np.hstack([u / np.linalg.norm(u, axis=1, keepdims=True), np.zeros((len(x), 1))])

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).collect()
    sample = np.array([r.v for r in sample])
    fit = filled(sample)
    c1, c2 = centroids(fit[:, :half], k), centroids(fit[:, half:], k)
    if share is None:
        probes = asked(sample[:PROBES])
        share = share_for(sample, _distances(probes[:, :half], c1), _distances(probes[:, half:], c2), _distances(fit[:, :half], c1).argmin(1), _distances(fit[:, half:], c2).argmin(1), n)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = filled(np.stack(pdf.v.to_numpy()) if len(pdf) else np.zeros((0, dim)))
            yield pdf.assign(first=_distances(x[:, :half], c1).argmin(1), second=_distances(x[:, half:], c2).argmin(1))

    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    entries = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= n + 1).select("vec_id", "v")
    entries = written(entries.mapInPandas(place, "vec_id long, v array<double>, first int, second int"), "entries")
    sizes = np.zeros((len(c1), len(c2)), np.int64)
    for r in entries.groupBy("first", "second").count().collect():  # k * k rows at most
        sizes[r["first"], r["second"]] = r["count"]
    want = max(least, int(np.ceil(share * sizes.sum())))
    # Runs of cells one after the other, each of ENTRY_BLOCK entries about; a larger cell is a run of several groups.
    starts, parts, held = [], [], 0
    for cell, m in enumerate(sizes.ravel().tolist()):
        if not starts or held + m > ENTRY_BLOCK:
            starts.append(cell)
            parts.append(max(1, -(-m // ENTRY_BLOCK)))
            held = 0
        held += m
    first_group = np.cumsum([0, *parts])
    run_of = np.searchsorted(starts, np.arange(sizes.size), "right") - 1
    cells = [(int(c // len(c2)), int(c % len(c2)), int(first_group[run_of[c]]), int(parts[run_of[c]])) for c in np.flatnonzero(sizes.ravel())]
    cells = spark.createDataFrame(cells, "first int, second int, base int, parts int")  # k * k rows at most

    # Cells of the sample's vectors, to tell which of them a query meets.
    at1, at2 = _distances(fit[:, :half], c1).argmin(1), _distances(fit[:, half:], c2).argmin(1)
    known = spark.sparkContext.broadcast((sample, at1, at2, np.linalg.norm(sample, axis=1).max()))

    def bounds(x: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
        """A number that the `n` nearest in the visited cells reach at least: the n-th best of the sample's there; a few
        places later, as one of these can be the query itself and one between two cells be indexed in the other."""
        vectors, first, second, longest = known.value
        with np.errstate(all="ignore"):
            s = x @ vectors.T
            for i, m in enumerate(masks):
                s[i, (m[first] >> second.astype(np.uint64) & np.uint64(1) == 0) | np.isnan(s[i])] = -np.inf
            low = np.partition(s, -n - 4, axis=1)[:, -n - 4] if s.shape[1] >= n + 4 else np.full(len(x), -np.inf)
            low = low - 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(x, axis=1) * longest
        return np.where(np.isfinite(low), low, -np.inf)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                x = asked(np.stack(part.v.to_numpy()))
                out: dict[str, list] = {"query_id": [], "v": [], "masks": [], "bound": [], "group": []}
                every_mask = [visited(a, b, sizes, want) for a, b in zip(_distances(x[:, :half], c1), _distances(x[:, half:], c2), strict=True)]
                for query, v, masks, low in zip(part.vec_id, part.v, every_mask, bounds(np.stack(part.v.to_numpy()).astype(float), every_mask), strict=True):
                    seen = (masks[:, None] >> np.arange(len(c2), dtype=np.uint64)[None] & np.uint64(1)).astype(bool).ravel() & (sizes.ravel() > 0)
                    for run in np.flatnonzero(np.logical_or.reduceat(seen, starts)):
                        for g in range(first_group[run], first_group[run + 1]):
                            for c, value in zip(out, (query, v, masks.view(np.int64), low, g), strict=True):
                                out[c].append(value)
                yield pd.DataFrame(out)

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    right = written(queries.mapInPandas(visit, "query_id long, v array<double>, masks array<long>, bound double, group int"), "visits")
    blocks = written(right.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks")), "blocks")
    if first_group[-1] <= MAX_BROADCAST_GROUPS:
        blocks = F.broadcast(blocks)
    left = entries.join(F.broadcast(cells), ["first", "second"]).withColumn("group", F.col("base") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    left = left.join(blocks, "group").select("group", "vec_id", "v", "first", "second", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = right.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return rerank(a, b, n)

    keys = ["group", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20)
