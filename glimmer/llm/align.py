"""Cross-tokenizer alignment: divide and conquer at shared cuts.

Two tokenizers cut the bytes of one text at different places. A place where tokens of both end is a shared cut; tokens between two cuts that follow
each other are a group. Groups are found by halving: from the middle token of A, bisection in the ends of both finds the nearest shared cut,
first ahead and then back; both sides of it are divided again, and an interval without a cut inside is a leaf group. All intervals of
one depth of all texts of a block are divided at once, so the recursion is a few passes over arrays.

A link is a pair of token occurrences whose bytes overlap. For each pair of ids the documents that hold it linked are counted in the task that
tokenizes, then summed by a shuffle; links are scored by a second pass over the written ids. The counts are sent to the tasks in shards of
at most SHARD pairs, as many passes as there are shards, so what is sent has a fixed size and no key of the counts is joined.

Tokens never go on from a sign that is not white space to a space, so a text without white space beside a space is a list of words, and each
distinct word of a block is tokenized once; other texts are tokenized whole. That this is so is checked on the vocabulary of B.

Defined results: a text that is null or empty, or whose tokens of either vocabulary do not spell a space and the text, has no tokens (zeros and
''); repeated rows and rows of equal doc_id are documents of their own; other columns are left alone and can have any name; an empty table gives an
empty result. A very long text is one array of its tokens in a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import table, written

#: Where the vocabularies are, and their files: A is a byte-level one, B one of pieces.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text aligned at once, distinct words kept by a task, pairs counted before a task sends them, and pairs of a shard (13 bytes each).
BLOCK, WORDS, HELD, SHARD = 2_000_000, 200_000, 2_000_000, 4_000_000
_MIXED = re.compile(r"\s | \s|\s$")
_IDS = "kind int, row long, doc_id {}, a binary, b binary, n_groups long, groups_sha256 string, pairs array<long>, counts array<int>"


class Vocabularies:
    """Both tokenizers of a worker, the bytes of their tokens, and the words seen last."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, a_file), encoding="utf-8") as f:
            model = json.load(f)
        added = {x["content"] for x in model.get("added_tokens", [])}
        # The usual letters of byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100.
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip(map(chr, [*itself, *range(256, 256 + 256 - len(itself))]), [*itself, *(b for b in range(256) if b not in set(itself))], strict=True))
        spelled = {i: bytes(letters[c] for c in token) for token, i in model["model"]["vocab"].items() if token not in added}
        self.a = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # The ids are the ranks of the merges; this engine takes a third of the time of the file's own one, with the same ids (tested).
        self.bytewise = tiktoken.Encoding("a", pat_str=split, mergeable_ranks={b: i for i, b in spelled.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, b_file))
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.by_words = not any(re.search("[^▁]▁", x) for x in names)
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a, self.b))
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def ids(self, texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """The ids of A and B for each text (a space before it), 32 bits each, or None where they do not spell it."""
        for x, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            a, raw = self.bytewise.encode_ordinary(" " + x), b" " + x.encode()
            same = b"".join([self.a[k] for k in a]) == raw and b"".join([self.b[k] for k in b]) == raw
            yield (array("i", a).tobytes(), array("i", b).tobytes()) if same else None

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """As ids(), but texts that are lists of words are put together from the ids of their words."""
        out: list = [None] * len(texts)
        split = {i: x.split(" ") for i, x in enumerate(texts) if x and self.by_words and not _MIXED.search(x) and not x[0].isspace()}
        if len(self.words) > WORDS:
            self.words.clear()
        new = list({w for ws in split.values() for w in ws if w not in self.words})
        self.words.update(zip(new, self.ids(new), strict=True))
        for i, ws in split.items():
            try:
                a, b = zip(*map(self.words.__getitem__, ws), strict=True)
            except TypeError:  # a word that its tokens do not spell: the whole text decides
                continue
            out[i] = np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32)
        rest = [i for i, x in enumerate(texts) if x and out[i] is None]
        for i, found in zip(rest, self.ids([texts[i] for i in rest]), strict=True):
            out[i] = found and tuple(np.frombuffer(x, np.int32) for x in found)
        return out


@lru_cache(1)
def _vocabularies(folder: str, a_file: str, b_file: str) -> Vocabularies:
    return Vocabularies(folder, a_file, b_file)


def _nearest_cut(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval of A's tokens low..high (exclusive, its own end a cut) the token inside whose end is a cut nearest to the middle, first
    ahead and then back; -1 without any. Ends that are not shared are leapt over by bisection in the other's ends."""
    out = np.full(len(low), -1)
    for ahead in (True, False):
        todo = np.flatnonzero(out < 0)
        at = (low[todo] + high[todo] - 1) // 2
        if not ahead:
            at = at - 1
        while True:
            inside = at < high[todo] - 1 if ahead else at >= low[todo]
            todo, at = todo[inside], at[inside]
            if not len(todo):
                break
            end = a[at]
            j = np.searchsorted(b, end)
            hit = b[j] == end
            out[todo[hit]] = at[hit]
            miss = ~hit
            todo, at, j = todo[miss], at[miss], j[miss]
            if ahead:
                at = np.searchsorted(a, b[j])
            else:
                # Before the first end of B there is none: then no end of A is left either.
                at = np.where(j > 0, np.searchsorted(a, b[j - 1], side="right") - 1, -1)
    return out


def groups(a: np.ndarray, b: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of A and of B of each group, in order. a, b: growing ends of tokens in bytes, text after text; texts: the last token of A of each text."""
    high = texts + 1
    low = np.concatenate(([0], high[:-1]))
    leaves = []
    while len(low):
        cut = _nearest_cut(a, b, low, high)
        leaf = cut < 0
        leaves.append(high[leaf] - 1)
        left, right, cut = low[~leaf], high[~leaf], cut[~leaf] + 1
        low, high = np.concatenate((left, cut)), np.concatenate((cut, right))
    last = np.sort(np.concatenate(leaves)) if leaves else np.empty(0, np.int64)
    return last, np.searchsorted(b, a[last])


def _links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token of A and of B of each link: every stretch between two ends of either that follow each other is the overlap of one pair."""
    ends = np.sort(np.concatenate((a, b)))
    ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def _block(found: list[tuple[np.ndarray, np.ndarray]], v: Vocabularies):
    """Ids and ends of all texts of a block beside each other, and the number of tokens of each."""
    na, nb = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int32) for k in (0, 1))
    return a, b, np.cumsum(v.a_len[a]), np.cumsum(v.b_len[b]), na, nb


def _pair_runs(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, na: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, text) of each link, sorted; a pair is A's id in the upper and B's in the lower 24 bits."""
    ia, ib = _links(ea, eb)
    pair = a[ia].astype(np.int64) << 24 | b[ib]
    text = np.repeat(np.arange(len(na)), na)[ia]
    key = pair << 16 | text
    key.sort()
    return key >> 16, key & 0xFFFF


def _first(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    at = _first(pairs)
    return pairs[at], np.add.reduceat(counts, at) if len(at) else counts


class _Written:
    """The `a1,a2|b1;...` form of groups, from tables of ids with each mark."""

    def __init__(self, n: int):
        self.n, self.parts = n, [f"{i}{mark}" for mark in ",|;" for i in range(n)]

    def sha256(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        codes = np.empty(len(a) + len(b), np.int64)
        # Tokens of A stand after all of B's earlier groups, tokens of B after all of A up to their own group.
        ends_a, ends_b = last_a + 1, last_b + 1
        sa, sb = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        at_a = np.arange(len(a)) + np.repeat(ends_b - sb, sa)
        at_b = np.arange(len(b)) + np.repeat(ends_a, sb)
        codes[at_a], codes[at_b] = a, b
        codes[at_a[last_a]] += self.n
        codes[at_b[last_b]] += 2 * self.n
        return hashlib.sha256("".join(map(self.parts.__getitem__, codes.tolist()))[:-1].encode()).hexdigest()


def _blocks(frames: Iterator[pd.DataFrame], size) -> Iterator[pd.DataFrame]:
    """The frames in blocks of about BLOCK bytes by size(frame), or one row; each row counts 64 more, so a block has fewer than 1 << 16."""
    for frame in frames:
        no = np.cumsum(size(frame) + 64) // BLOCK
        for _, part in frame.groupby(no, sort=True):
            yield part


def _tokenized(folder: str, a_file: str, b_file: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, held, n_held = _vocabularies(folder, a_file, b_file), [], 0
        spell = _Written(max(len(v.a), len(v.b)))

        def sent(held) -> pd.DataFrame:
            pairs, counts = _summed(held)
            cut = range(0, len(pairs), 100_000)
            return pd.DataFrame({"kind": 1, "row": None, "doc_id": None, "a": None, "b": None, "n_groups": None, "groups_sha256": None, "pairs": [pairs[i : i + 100_000] for i in cut], "counts": [counts[i : i + 100_000].astype(np.int32) for i in cut]})

        for part in _blocks(frames, lambda f: f["text"].str.len().fillna(0).to_numpy()):
            found = v.encoded(part["text"].tolist())
            good = [i for i, x in enumerate(found) if x is not None]
            a, b, ea, eb, na, nb = _block([found[i] for i in good], v)
            last_a, last_b = groups(ea, eb, np.cumsum(na) - 1)
            to_a, to_b = np.cumsum(na), np.cumsum(nb)
            to_g = np.searchsorted(last_a, to_a - 1, side="right")
            out = {k: [None] * len(part) for k in ("a", "b")} | {"n_groups": [0] * len(part), "groups_sha256": [""] * len(part)}
            for k, i in enumerate(good):
                fa, fb, fg = (x[k - 1] if k else 0 for x in (to_a, to_b, to_g))
                own_a, own_b = a[fa : to_a[k]], b[fb : to_b[k]]
                g = slice(fg, to_g[k])
                out["a"][i], out["b"][i] = own_a.astype("<u2" if len(v.a) <= 1 << 16 else "<u4").tobytes(), own_b.astype("<u2" if len(v.b) <= 1 << 16 else "<u4").tobytes()
                out["n_groups"][i], out["groups_sha256"][i] = int(to_g[k] - fg), spell.sha256(own_a, own_b, last_a[g] - fa, last_b[g] - fb)
            yield pd.DataFrame({"kind": 0, "row": part["row"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), **out, "pairs": None, "counts": None})
            pair, text = _pair_runs(a, b, ea, eb, na)
            pair = pair[_first(pair << 16 | text)]  # once in a document
            at = _first(pair)
            held.append((pair[at], np.diff(at, append=len(pair))))
            n_held += len(at)
            if n_held > HELD:
                held = [_summed(held)]
                n_held = len(held[0][0])
                if n_held > HELD // 2:
                    yield sent(held)
                    held, n_held = [], 0
        if held:
            yield sent(held)

    return run


def tokenized(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A written table. Rows of kind 0 are the documents with the ids of their tokens (16 or 32 bits each) and their groups; rows of kind 1 hold counts of id pairs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return written(rows.mapInPandas(_tokenized(folder, a_file, b_file), _IDS.format(kind)), "tokens")


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(a, pair, n, best), written: in how many documents each pair of ids is linked, and whether no pair of the same A has more."""
    flat = tokens.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    n = written(flat.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")).withColumn("a", F.shiftright("pair", 24)), "pairs")
    most = n.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A has ids
    return n.join(F.broadcast(most), "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(counts, folder: str, a_file: str, b_file: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _vocabularies(folder, a_file, b_file)
        keys, n, best = counts.value
        for part in _blocks(frames, lambda f: f["a"].str.len().fillna(0).to_numpy()):
            good = np.flatnonzero(part["a"].notna().to_numpy())
            read = lambda x, ids: np.frombuffer(x, "<u2" if len(ids) <= 1 << 16 else "<u4")
            found = [(read(x, v.a), read(y, v.b)) for x, y in zip(part["a"].iloc[good], part["b"].iloc[good], strict=True)]
            a, b, ea, eb, na, nb = _block(found, v)
            pair, text = _pair_runs(a, b, ea, eb, na)
            at = _first(pair)
            one = pair[at]
            j = np.minimum(np.searchsorted(keys, one), max(len(keys) - 1, 0))
            there = keys[j] == one if len(keys) else np.zeros(len(one), bool)
            runs = np.diff(at, append=len(pair))
            out = {}
            for name, values in (("count_sum", n), ("n_best", best)):
                each = np.zeros(len(one), np.int64)
                each[there] = values[j[there]]
                total = np.zeros(len(good), np.int64)
                np.add.at(total, text, np.repeat(each, runs))
                out[name] = part[name].to_numpy().copy()
                out[name][good] += total
            tokens = {name: np.zeros(len(part), np.int64) for name in ("n_a", "n_b")}
            tokens["n_a"][good], tokens["n_b"][good] = na, nb
            yield part.assign(**tokens, **out)

    return run


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, shard: int = SHARD) -> DataFrame:
    """(row, doc_id, a, b, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; a, b: ids as packed integers, null without tokens."""
    spark = docs.sparkSession
    tokens = tokenized(docs, folder, a_file, b_file)
    counts = written(pair_counts(tokens), "counts")
    ids = sorted((r.a, r.n) for r in counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect())  # as many rows as A has ids
    cuts, size = [], shard
    for a, n in ids:
        if size + n > shard:
            cuts.append(a)
            size = 0
        size += n
    rows = tokens.where("kind = 0").select("row", "doc_id", "a", "b", "n_groups", "groups_sha256", *(F.lit(0).cast("long").alias(x) for x in ("n_a", "n_b", "count_sum", "n_best")))
    for k, low in enumerate(cuts or [0]):
        own = counts.where(F.col("a") >= low)
        own = (own.where(F.col("a") < cuts[k + 1]) if k + 1 < len(cuts) else own).select("pair", "n", F.col("best").cast("int").alias("best")).orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast((own["pair"].to_numpy(), own["n"].to_numpy(), own["best"].to_numpy().astype(np.int8)))
        rows = rows.mapInPandas(_scored(sent, folder, a_file, b_file), rows.schema)
        if k + 1 < len(cuts):
            rows = written(rows, "scored")
    links = F.when(F.col("a").isNull(), 0).otherwise(F.col("n_a") + F.col("n_b") - F.col("n_groups")).cast("long")
    return rows.withColumn("n_links", links)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents."""
    found = align(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
