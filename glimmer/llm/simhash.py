"""SimHash near-duplicate search by anchor-point covering.

Fingerprints of 64 bits link at `bits` or fewer differing bits. The bits are cut
into `BLOCKS`; two linked fingerprints differ by at most bits // len(BLOCKS) in
one block at least. In each block the anchors are the words of a covering code:
the perfect [15, 11] Hamming code on 15 bits (covering radius 1) times all words
of the remaining bits (radius 0). Each point is at home at the one anchor within
the covering radius, and is copied to every anchor within radius plus threshold, so two points
that are close in a block meet at both their homes. Per anchor, those at home are
compared with all copies. Nothing is missed, and the anchors need no data.

Equal fingerprints are one point from the start. A group of anchors gives back a
spanning forest of its links, not all pairs; groups are of bounded size, and an
anchor with more points than `max_group` is cut into a grid of parts.

Defined results: a null or blank text has fingerprint zero, which links like any
other; a text of fewer words than a shingle is one shingle; repeated rows stay
as they are; a null doc_id gets the component of its fingerprint's group, and the
group's least doc_id ignores it; an empty table gives an empty result. Other
columns of the input are left alone and can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators.components import connected_components
from glimmer.session import table, written

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Width of each block: 15 bits of the Hamming code and the rest as they are.
BLOCKS = (21, 21, 22)
CODE_BITS = 15
RADIUS = 1
#: Rows that one group of anchors holds about, and points of one anchor in one group.
GROUP_ROWS = 150_000
MAX_GROUP = 20_000
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def simhash(data: bytes | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text. bytes.lower and bytes.split act on ASCII only."""
    words = data.lower().split() if data else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.empty(n, np.int64)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    sets = np.zeros((8, 256), np.int64)
    for i in range(0, len(lanes), 1 << 16):
        sets += np.bincount((lanes[i : i + (1 << 16)] + _LANES).ravel(), minlength=2048).reshape(8, 256)
    on = (2 * (sets @ _BITS_OF) > len(hashes)).ravel()
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint(text) -> F.Column:
    """The fingerprint of a string column as a signed long."""
    return _fingerprint(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


@cache
def _anchors() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word the words of the Hamming code within distance 2, and the distances (9: none)."""
    x = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(1 << CODE_BITS, np.int64)
    for i in range(CODE_BITS):
        syndrome ^= np.where(x >> i & 1, i + 1, 0)
    flips: dict[int, list[tuple[int, int]]] = {s: [] for s in range(16)}
    flips[0].append((0, 0))
    for i in range(CODE_BITS):
        flips[i + 1].append((1 << i, 1))
        for j in range(i):
            flips[(i + 1) ^ (j + 1)].append((1 << i | 1 << j, 2))
    words = np.zeros((1 << CODE_BITS, 8), np.int64)
    apart = np.full((1 << CODE_BITS, 8), 9, np.int64)
    for s, options in flips.items():
        at = syndrome == s
        for j, (flip, d) in enumerate(sorted(options, key=lambda o: o[1])):
            words[at, j], apart[at, j] = x[at] ^ flip, d
    return words, apart


@cache
def _rests(width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Flips of up to `reach` of `width` bits, and their number of bits."""
    v = np.arange(1 << width)
    d = np.bitwise_count(v).astype(np.int64)
    return v[d <= reach], d[d <= reach]


def _copies(fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, index into fps, anchor, is its home) for every anchor within reach, block by block."""
    words, apart = _anchors()
    shift = 0
    for b, width in enumerate(BLOCKS):
        part = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        shift += width
        code, rest = part & ((1 << CODE_BITS) - 1), part >> CODE_BITS
        flips, weights = _rests(width - CODE_BITS, reach)
        index = np.arange(len(fps))
        for j in range(words.shape[1]):
            c, d = words[code, j], apart[code, j]
            for flip, w in zip(flips.tolist(), weights.tolist(), strict=True):
                ok = d + w <= reach
                if ok.any():
                    yield b, index[ok], (c[ok] | (rest[ok] ^ flip) << CODE_BITS), (d[ok] <= RADIUS) & (w == 0)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the ends of the given links."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (label[a] == label[b]).all() and (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _links(pdf: pd.DataFrame, bits: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the anchors of one group."""
    pdf = pdf.sort_values(["cell", "fp"], kind="stable")
    cells, fps, home = pdf.cell.to_numpy(), pdf.fp.to_numpy(), pdf.home.to_numpy()
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    group = np.repeat(np.arange(len(starts)), sizes)
    homes = np.flatnonzero(home & (sizes[group] > 1))
    first, count = starts[group[homes]], sizes[group[homes]]
    us, vs, held = [], [], 0
    ends = np.cumsum(count)
    at = 0
    while at < len(homes):
        # A home with more partners than `step` is compared in one go: groups are bounded.
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        n = count[at:to]
        left = np.repeat(homes[at:to], n)
        right = np.repeat(first[at:to] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        d = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64))
        near = (d <= bits) & (d > 0)
        us.append(fps[left[near]])
        vs.append(fps[right[near]])
        held += int(near.sum())
        if held > step:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        at = to
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = _forest(np.concatenate(us), np.concatenate(vs))
    return u[u != v], v[u != v]


def links(points: DataFrame, bits: int = MAX_BITS, group_rows: int = GROUP_ROWS, max_group: int = MAX_GROUP) -> DataFrame:
    """Links (src, dst) that join exactly those of the distinct fingerprints `points.fp` (signed
    longs) that chains of links join; at most one for each fingerprint and group of anchors."""
    if bits // len(BLOCKS) > 1:
        raise ValueError("the blocks are made for at most 5 differing bits")
    reach = RADIUS + bits // len(BLOCKS)
    n = points.count()

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 20_000):
                fps = pdf.fp.to_numpy()[i : i + 20_000].astype(np.int64)
                for b, index, anchor, home in _copies(fps.view(np.uint64), reach):
                    yield pd.DataFrame({"cell": b << 32 | anchor, "fp": fps[index], "home": home})

    copies = points.select("fp").mapInPandas(copy, "cell long, fp long, home boolean")
    groups = max(3, n * 50 // group_rows)
    # Only an anchor that can be large is counted for: there are none among few points.
    if n > max_group:
        hot = copies.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("home"), 1)).alias("h")).where(F.col("m") > max_group)
        hot = written(hot.select("cell", F.ceil(F.col("m") / max_group).alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("h") / max_group)).alias("home_parts")), "hot")
        some = hot.count()
        # One anchor in max_group / 50 at most is hot; few are broadcast, many are joined.
        copies = copies.join(F.broadcast(hot) if some <= 100_000 else hot, "cell", "left") if some else copies.withColumns({"parts": F.lit(None).cast("long"), "home_parts": F.lit(None).cast("long")})
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        home_part = F.pmod(F.xxhash64("fp"), F.col("home_parts"))
        cold = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(True).alias("c"), F.col("home").alias("h")))
        # In the grid, a point stands in its column as a copy and, if at home, in its row.
        as_copy = F.transform(F.sequence(F.lit(0).cast("long"), F.col("home_parts") - 1), lambda q: F.struct(part.alias("p"), q.alias("q"), F.lit(True).alias("c"), F.lit(False).alias("h")))
        as_home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("p"), home_part.alias("q"), F.lit(False).alias("c"), F.lit(True).alias("h")))
        where = F.when(F.col("parts").isNull(), cold).when(F.col("home"), F.concat(as_copy, as_home)).otherwise(as_copy)
        copies = copies.select("cell", "fp", F.explode(where).alias("g")).select((F.col("cell") + F.shiftleft(F.col("g.p"), 40) + F.shiftleft(F.col("g.q"), 52)).alias("cell"), "fp", F.col("g.h").alias("home"))
    copies = copies.withColumn("slot", F.pmod(F.xxhash64("cell"), F.lit(groups)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = _links(pdf, bits)
        return pd.DataFrame({"src": u, "dst": v})

    return copies.groupBy("slot").applyInPandas(compare, "src long, dst long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """A row (doc_id, fp, component_id) for each row of `docs`."""
    marks = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col).alias("fp")), "simhash")
    points = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    joined = connected_components(links(points, bits))
    classes = (
        points.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
        .select("fp", "first_id", "component")
    )
    classes = written(classes, "nodes")
    # Written, so that both joins are of plain tables: a large component or a fingerprint of many copies is split where it is too large for a task.
    least = written(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    classes = written(classes.join(least, "component").select("fp", "component_id"), "classes")
    return marks.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near copies of others: of each component the row with the least
    doc_id stays (rows with equal or no doc_id: those that are all there is). A row goes by its own
    text and a row key, so another text of the same doc_id stays."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = components(rows.select("text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("_id")), "_id")
    gone = found.where("doc_id.doc_id <> component_id.doc_id").select("doc_id._row")
    return rows.join(gone, "_row", "left_anti").select(docs.columns)
