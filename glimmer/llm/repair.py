"""Conversation structure repair: the lightest derivation of an alternating conversation.

A conversation shall be an optional system turn, then pairs of a user's and an assistant's turn, or nothing. Its turns are read in order; each is
kept (K), given the other role (R) or deleted (D), and empty turns can be inserted (I) anywhere. An item says that the first i turns are
read and the part of the grammar that is reached; an item and an edit of the next turn derive the next item, a weighted hypergraph. An agenda
pops items by (cost, turns read, audit), the audit being the initials of the edits. Each rule raises cost or, at equal cost, the turns read, so it is
superior and a popped item is final (Knuth 1977). Two audits of one item and cost never begin with one another, since the longer one would have
more insertions and cost more; so the least audit stays least whatever follows, on both sides.

For that reason pieces of a conversation can be derived on their own, from each state to each state, and joined by a second agenda, whose items are
boundaries of pieces: a conversation with a third of all turns is many tasks of at most 512 turns. Only its audit, which is
one value of the result, and its small pieces' items meet in one task. Its repaired turns stream through one task in order, a batch at a time: a digest is sequential.

Defined results: turns are ordered by turn (nulls first), role, text; a null role or text is one space; repeated rows are turns of their own (and
duplicates); an empty role or one of other initials than s, u, a is never kept; a null conv_id is a conversation; other columns are left alone and
can have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import table, written

#: Costs of the edits, and of leaving a truncated turn.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What follows a state by an initial: 0 nothing yet, 1 after the system, 2 after a user, 3 after an assistant; 0 and 3 are complete.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
COMPLETE = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Turns of a piece: 1 << PIECE.
PIECE = 9
WHITE = " \t\n\x0b\x0c\r"
_FAULTS = ("blank", "duplicate", "truncated")

Item = tuple[int, int]


def lightest(start: Item, goals: set[Item], rules: Callable[[Item], Iterable[tuple[int, str, Item]]]) -> dict[Item, tuple[int, str]]:
    """The lightest (cost, audit) of each goal item that can be derived. rules(item): cost, audit and consequence of each rule; an item is (turns read, state)."""
    agenda, final = [(0, start[0], "", start)], {}
    while agenda and not goals <= final.keys():
        cost, _, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        for more, said, to in rules(item):
            if to not in final:
                heapq.heappush(agenda, (cost + more, to[0], audit + said, to))
    return {g: final[g] for g in goals if g in final}


def edit_rules(turns: list[tuple[str, str | None]]) -> Callable[[Item], Iterator[tuple[int, str, Item]]]:
    """The edits of turns given as (initial, fault)."""

    def rules(item: Item) -> Iterator[tuple[int, str, Item]]:
        at, state = item
        for new in "ua":
            if (state, new) in NEXT:
                yield INSERT, "I", (at, NEXT[state, new])
        if at < len(turns):
            initial, fault = turns[at]
            yield DELETE, "D", (at + 1, state)
            if fault not in ("blank", "duplicate"):
                left = TRUNCATED if fault == "truncated" else 0
                if (state, initial) in NEXT:
                    yield KEEP + left, "K", (at + 1, NEXT[state, initial])
                for new in "ua":
                    if (state, new) in NEXT:
                        yield REROLE + left, "R", (at + 1, NEXT[state, new])

    return rules


def piece_ways(turns: list[tuple[str, str | None]], starts: Iterable[int]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a piece between all states that can be joined."""
    rules, n = edit_rules(turns), len(turns)
    return [(p, q, *way) for p in starts for (_, q), way in lightest((0, p), {(n, q) for q in range(4)}, rules).items()]


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The lightest complete conversation of pieces that follow each other."""

    def rules(item: Item) -> Iterator[tuple[int, str, Item]]:
        at, state = item
        if at < len(pieces):
            yield from ((cost, audit, (at + 1, q)) for p, q, cost, audit in pieces[at] if p == state)

    return min(lightest((0, 0), {(len(pieces), q) for q in range(4)}, rules)[len(pieces), q] for q in COMPLETE)


def _shared(audit: str, sizes: list[int]) -> list[str]:
    """The audit's part for each piece of so many turns; insertions go before the turn that follows, the last ones to the last piece."""
    out, at = [], 0
    for k, n in enumerate(sizes):
        end = at
        while n and k + 1 < len(sizes):
            n -= audit[end] != "I"
            end += 1
        out.append(audit[at:end] if k + 1 < len(sizes) else audit[at:])
        at = end
    return out


def _ways(turns: pd.Series, first: pd.Series) -> pd.DataFrame:
    out = []
    for found, is_first in zip(turns, first, strict=True):
        plain = [(t["initial"], t["fault"]) for t in found]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
        out.append((illegal, [dict(zip(("p", "q", "cost", "audit"), w, strict=True)) for w in piece_ways(plain, (0,) if is_first else range(4))]))
    return pd.DataFrame(out, columns=["illegal", "ways"])


def _joined(pieces: pd.Series) -> pd.DataFrame:
    out = []
    for found in pieces:
        ends = [(p["head"], p["tail"]) for p in found]
        illegal = sum(p["illegal"] for p in found) + sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:], strict=False))
        cost, audit = joined([[(w["p"], w["q"], w["cost"], w["audit"]) for w in p["ways"]] for p in found])
        out.append((illegal, cost, audit, _shared(audit, [p["n"] for p in found])))
    return pd.DataFrame(out, columns=["illegal", "cost", "audit", "shares"])


def _key() -> Column:
    return F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def ordered(turns: DataFrame) -> DataFrame:
    """(k, turn, role, text, place, piece, initial, fault), written: the turns of a conversation k in order, with the first fault of each. Pieces are
    stretches of the sorted ranges, and equal rows are dealt to more ranges than one."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(_key().alias("k"), "turn", space("role"), space("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["k", "turn", "role", "text", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("place", F.monotonically_increasing_id())
    rows = written(rows, "turns").withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    seen = rows.groupBy("k", "digest").agg(F.min("place").alias("seen"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "digest", "seen")
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(end == "", "blank").when(F.col("place") > F.col("seen"), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.join(seen, ["k", "digest"], "left")
    return written(rows.select("k", "turn", "role", "text", "place", F.shiftright("place", PIECE).alias("piece"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "faults")


def derived(rows: DataFrame) -> DataFrame:
    """(k, illegal, cost, audit, pieces, shares), written: of what ordered() gives, the lightest repair and its parts by piece."""
    ways = F.pandas_udf(_ways, "struct<illegal long, ways array<struct<p int, q int, cost long, audit string>>>")
    join = F.pandas_udf(_joined, "struct<illegal long, cost long, audit string, shares array<string>>")
    pieces = rows.groupBy("k", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("turns"))
    heads = rows.groupBy("k").agg(F.min("piece").alias("piece")).withColumn("first", F.lit(True))
    pieces = pieces.join(heads, ["k", "piece"], "left").withColumn("way", ways(F.col("turns"), F.coalesce("first", F.lit(False))))
    end = lambda at: F.element_at("turns", at)["initial"]
    piece = F.struct("piece", F.size("turns").alias("n"), end(1).alias("head"), end(-1).alias("tail"), "way.illegal", "way.ways", F.element_at("turns", 1)["place"].alias("place"))
    whole = pieces.groupBy("k").agg(F.sort_array(F.collect_list(piece)).alias("pieces")).withColumn("found", join("pieces"))
    return written(whole.select("k", "found.illegal", "found.cost", "found.audit", F.col("pieces.place").alias("places"), "found.shares"), "repairs")


def _applied(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, str, str]]:
    """(k, edit, role, text) of the repaired turns, conversation by conversation. Frames are sorted; a row without text carries the edits of the rows after it."""
    k, state, edits = None, 0, iter("")

    def until_turn() -> Iterator[tuple[str, str, str, str]]:
        nonlocal state, letter
        for letter in edits:  # noqa: B007
            if letter != "I":
                return
            new = "a" if state == 2 else "u"
            state = NEXT[state, new]
            yield k, "I", ROLES[new], ""
        letter = ""

    letter = ""
    for frame in frames:
        for own, share, role, text in zip(frame["k"], frame["share"], frame["role"], frame["text"], strict=True):
            if own != k or share is not None:
                yield from until_turn()
            if own != k:
                k, state = own, 0
            if share is not None:
                edits = iter(share)
                continue
            yield from until_turn()
            if letter == "D":
                continue
            new = role[0] if letter == "K" else "a" if state == 2 else "u"
            state = NEXT[state, new]
            yield k, letter, role if letter == "K" else ROLES[new], text
    yield from until_turn()


def _turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list = []
    k, no = None, 0
    for own, edit, role, text in _applied(frames):
        k, no = own, no + 1 if own == k else 0
        held.append((own, no, edit, role, text))
        if len(held) == 1000:
            yield pd.DataFrame(held, columns=["k", "no", "edit", "role", "text"])
            held = []
    yield pd.DataFrame(held, columns=["k", "no", "edit", "role", "text"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, k, digest = [], None, None
    for own, _, role, text in _applied(frames):
        if own != k:
            if k is not None:
                held.append((k, digest.hexdigest()))
            k, digest = own, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode())
        if len(held) == 10_000:
            yield pd.DataFrame(held, columns=["k", "repaired_sha256"])
            held = []
    if k is not None:
        held.append((k, digest.hexdigest()))
    yield pd.DataFrame(held, columns=["k", "repaired_sha256"])


def _dealt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns and, before the first turn of each piece, its edits, sorted by conversation: one shuffle."""
    none = F.lit(None).cast("string")
    shares = found.select("k", F.explode(F.arrays_zip("places", "shares")).alias("x")).select("k", F.col("x.places").alias("place"), F.lit(0).alias("tag"), F.col("x.shares").alias("share"), none.alias("role"), none.alias("text"))
    both = rows.select("k", "place", F.lit(1).alias("tag"), none.alias("share"), "role", "text").unionByName(shares)
    return both.repartition("k").sortWithinPartitions("k", "place", "tag").select("k", "share", "role", "text")


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id as text, no, edit, role, text) of the repaired conversations, no from 0; conversations without any turn left have no row."""
    rows = ordered(turns)
    out = _dealt(rows, derived(rows)).mapInPandas(_turns, "k string, no long, edit string, role string, text string")
    return out.select(F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).alias("conv_id"), "no", "edit", "role", "text")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with turns lost, emptied, cut, repeated or given to the user, by a checksum of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(by == 1, "").when(by == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", F.when(by == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), by.alias("by")).where("by != 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("by") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the lightest repair of each damaged conversation, of all that there were before."""
    turns = table(spark, sf_dir, "conversations")
    rows = ordered(damaged(turns))
    found = derived(rows)
    digests = _dealt(rows, found).mapInPandas(_digests, "k string, repaired_sha256 string")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    faults = rows.groupBy("k").agg(gaps.alias("gaps"), *map(count, _FAULTS))
    every = turns.groupBy(_key().alias("k")).agg(F.first("conv_id").alias("conv_id"))
    every = every.join(faults, "k", "left").join(found.select("k", "illegal", "cost", "audit"), "k", "left").join(digests, "k", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select(
        "conv_id", *map(zero, ("gaps", *_FAULTS, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
