"""Repairs against a plain version: all derivations by dynamic programming over whole conversations, from the end."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from glimmer.llm import repair

GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(turns):
    """(cost, audit, repaired) of turns (role, text, fault)."""

    @lru_cache(None)
    def rest(i, state, inserted):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if inserted < 3:  # more in a row only come back to a state
            for new in "ua":
                if new in GRAMMAR[state]:
                    c, s, t = rest(i, GRAMMAR[state][new], inserted + 1)
                    ways.append((c + 2, "I" + s, ({"u": "user:", "a": "assistant:"}[new], *t)))
        if i < len(turns):
            role, text, fault = turns[i]
            c, s, t = rest(i + 1, state, 0)
            ways.append((c + 3, "D" + s, t))
            if fault not in ("blank", "duplicate"):
                for edit, cost, new, name in (("K", 0, role[:1], role), ("R", 2, "u", "user"), ("R", 2, "a", "assistant")):
                    if new in GRAMMAR[state]:
                        c, s, t = rest(i + 1, GRAMMAR[state][new], 0)
                        ways.append((c + cost + (fault == "truncated"), edit + s, (f"{name}:{text}", *t)))
        return min(ways, default=(1 << 40, "", ()))

    return rest(0, "", 0)


def plain(rows, damage):
    after = {}
    for conv, turn, role, text in rows:
        own = after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if by == 0:
            continue
        if by == 1:
            text = ""
        if by == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        if by == 4:
            role = "user"
        own += [(turn is not None, turn or 0, role, text)] * (2 if by == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns, seen, faults = [], set(), []
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            turns.append((role, text, fault))
        known = [r[1] for r in own if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, left = cheapest(tuple(turns))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made(n, seed):
    r, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why", "", " \n", None, "Same.", "Then?  ", "a.b", "é."]
    for conv in [None, *range(n)]:
        turn = r.choice([0, 5, -2])
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((conv, None if r.random() < 0.05 else turn, r.choice(roles), r.choice(texts)))
            turn += r.choice([1, 1, 1, 0, 2])
    return rows


@pytest.mark.parametrize("piece", [repair.PIECE, 1])
def test_made_conversations(spark, piece, monkeypatch, tmp_path):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = made(300, 7)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k string, place int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = repair.op13_repair(spark, str(tmp_path))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    want = plain(rows, True)
    assert got.keys() == want.keys() and len(got) == 301
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []
    assert any(not v[6] and not v[5] for v in want.values())  # some have lost all turns


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = repair.op13_repair(spark, "/root/testdata/sf0.01")
    assert {c: t for c, t in found.dtypes if c in COLUMNS} == dict.fromkeys(COLUMNS, "bigint") | {"audit": "string", "repaired_sha256": "string"}
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()} == plain([tuple(r) for r in rows], True)


def test_long_conversation_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    rows = [(1, i, r.choice(["user", "assistant", "assistant", "tool"]), r.choice(["Yes.", "Go on", f"Turn {i}.", f"Cut {i}"])) for i in range(200)]
    rows += [(2, 0, "user", "Again.")] * 150
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    monkeypatch.setattr(repair, "PIECE", 4)
    made_rows = repair.ordered(df)
    found = {x.k: x for x in repair.derived(made_rows).collect()}
    want = plain(rows, False)
    for conv in (1, 2):
        x = found[f"={conv}"]
        assert (x.illegal, x.cost, x.audit) == want[conv][4:7]
    assert len(found["=1"].shares) > 10 and "".join(found["=1"].shares) == found["=1"].audit
    left = [f"{t.role}:{t.text}" for t in sorted(repair.repaired(df).where("conv_id = '1'").collect(), key=lambda t: t.no)]
    assert hashlib.sha256("\n".join(left).encode()).hexdigest() == want[1][7]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op13_repair(spark, str(tmp_path)).count() == 0
