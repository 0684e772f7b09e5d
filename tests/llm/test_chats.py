from glimmer.llm import chats as C


def conv(i, *turns):
    return [(i, k, r, t) for k, (r, t) in enumerate(turns)]


A, B, D, E = ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)
ROWS = [
    *conv(1, A, B), *conv(2, A, B, D), *conv(3, A, B, D), *conv(4, A), *conv(5, A, ("assistant", "")), *conv(6, A, E), *conv(7, (None, "hi")), *conv(7, (None, "hi")), *conv(8, B, A), *conv(9, ("user", "hihello")),
    (None, 0, "user", "lost"), (10, None, "user", "q"), (10, None, "user", "q"), (11, 5, "user", "tie"), (11, 5, "user", "two"),
    *[(12, k, "user", f"turn {k}") for k in range(3000)], *[(13, k, "user", f"turn {k}") for k in range(2500)], (14, 0, "user", "x" * 500_000),
]


def brute(rows):
    convs = {}
    for i, k, r, t in set(rows):
        if i is not None:
            convs.setdefault(i, []).append((k, r, t))
    seqs = {i: [(r, t) for _, r, t in sorted(v, key=lambda x: [(y is not None, y or (0 if i == 0 else "")) for i, y in enumerate(x)])] for i, v in convs.items()}
    out = {}
    for i, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        same = min(j for j, o in seqs.items() if o == s)
        out[i] = (len(s), "prefix" if longer else "kept" if same == i else "copy")
    return out, seqs


def test_collapse(spark):
    turns = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, pos int")
    want, seqs = brute(ROWS)
    for chunk in (1024, 7):
        assert {r.conv_id: (r.n_turns, r.status) for r in C.collapse(turns, chunk).collect()} == want
    text = {}
    for r in sorted(C.render(turns, turns.select("conv_id").distinct()).collect(), key=lambda r: (r.conv_id, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    assert text == {i: "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in s) for i, s in seqs.items()}
    assert C.collapse(turns.limit(0)).count() == 0


def test_parts_are_by_position(spark):
    rows = [(1, k, "user", f"t{k}") for k in (254, 255, 256, 257)] + [(2, 7, "user", x) for x in "edcba"] + [(3, 10 * k, "user", str(k)) for k in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r.text for r in C.render(turns, turns.select("conv_id")).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (3, 1), (3, 2)}
    assert got[2, 0] == "".join(f"<|user|>\n{x}\n" for x in "abcde") and got[3, 1].startswith("<|user|>\n256\n") and got[3, 2].count("<|") == 88


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want, seqs = brute(rows)
    got = {r.conv_id: r.text for r in C.op2_chats(spark, sf).collect()}
    assert got == {i: "".join(f"<|{r}|>\n{t}\n" for r, t in seqs[i]) for i, (_, s) in want.items() if s == "kept"}
