"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs often hold a conversation again and again as it grows. Each turn has a digest of
its role and text; the rolling hash of a prefix is the running sum, position by position, of the digests' hashes with their
positions, in two independent 64-bit halves and without overflow. A conversation that
has the length and hash of a proper prefix of another goes by an anti-join, and of
equal conversations the least conv_id stays. Kept ones are rendered.

Everything is dealt by conversation and chunk: turns get their places within chunks of `chunk` turn numbers, and a
small table of the chunks carries positions and sums on, so a conversation with a third
of all turns is many tasks. For the same reason a rendered text comes in parts of `part` turns by
position: most conversations have one row, part 0, and a long one has its text in the order of its parts.

Defined results: turns are ordered by turn, role, text (nulls first) and repeated rows count once; a null role or
text is rendered as nothing and differs from an empty one; a null conv_id is no conversation and its rows are left
out; an empty table gives an empty result. Other columns of the input are left alone and can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.session import table, written

CHUNK = 1024
PART = 256
#: Tasks that copies of one conversation are dealt to, where each gets its status.
SALTS = 16


def _mark(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def dealt(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Distinct turns (conv_id, bucket, place, role, text), written, with the place in their chunk from 1; and the
    chunks (conv_id, bucket, skip, n_turns) with the number of turns before each and of all."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 40))))
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    rows = written(rows.select("conv_id", "bucket", F.row_number().over(inside).alias("place"), "role", "text"), "turns")
    own = Window.partitionBy("conv_id")
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "bucket").agg(F.max("place").alias("k"))
    chunks = chunks.select("conv_id", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"), F.sum("k").over(own).alias("n_turns"))
    return rows, written(chunks, "chunks")


def prefixes(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, h1, h2) with the rolling hashes of the first pos turns, pos from 1, of what dealt() gives."""
    digest = F.sha2(F.concat(F.sha2(_mark(F.col("role")), 256), _mark(F.col("text"))), 256)
    rows = rows.select("conv_id", "bucket", "place", digest.alias("digest")).join(chunks, ["conv_id", "bucket"]).withColumn("pos", F.col("skip") + F.col("place"))
    h = lambda seed: F.xxhash64("pos", "digest", F.lit(seed)).cast("decimal(20,0)")
    upto = Window.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": h("left"), "b": h("right")}).withColumns({"sa": F.sum("a").over(upto), "sb": F.sum("b").over(upto)})
    rows = written(rows.select("conv_id", "bucket", "pos", "n_turns", "sa", "sb"), "sums")
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    last = rows.groupBy("conv_id", "bucket").agg(F.max_by("sa", "pos").alias("ta"), F.max_by("sb", "pos").alias("tb"))
    last = last.select("conv_id", "bucket", F.coalesce(F.sum("ta").over(before), zero).alias("ba"), F.coalesce(F.sum("tb").over(before), zero).alias("bb"))
    h1, h2 = (F.col("ba") + F.col("sa")).cast("decimal(38,0)"), (F.col("bb") + F.col("sb")).cast("decimal(38,0)")
    return rows.join(last, ["conv_id", "bucket"]).select("conv_id", "pos", F.col("n_turns").cast("long").alias("n_turns"), h1.alias("h1"), h2.alias("h2"))


_KEY = ["n_turns", "h1", "h2"]


def _maximal(hashed: DataFrame) -> DataFrame:
    """(n_turns, h1, h2, kept_id) of the conversations that are no prefix of another; of equal ones the least id."""
    classes = hashed.where("pos = n_turns").groupBy(*_KEY).agg(F.min("conv_id").alias("kept_id"))
    proper = hashed.where("pos < n_turns").select(F.col("pos").cast("long").alias("n_turns"), "h1", "h2").distinct()
    return classes.join(proper, _KEY, "left_anti")


def collapse(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, n_turns, status, kept_id): status is kept, copy (kept_id has the same turns) or prefix (of a longer one)."""
    hashed = written(prefixes(*dealt(turns, chunk)), "prefixes")
    # Copies of one conversation meet at one key: they are dealt to SALTS tasks.
    whole = hashed.where("pos = n_turns").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    kept = _maximal(hashed).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = whole.join(kept, [*_KEY, "salt"], "left")
    status = F.when(F.col("kept_id").isNull(), "prefix").when(F.col("kept_id") == F.col("conv_id"), "kept").otherwise("copy")
    return found.select("conv_id", "n_turns", status.alias("status"), "kept_id")


def _rendered(rows: DataFrame, chunks: DataFrame, ids: DataFrame, part: int) -> DataFrame:
    chunks = chunks.join(ids.select("conv_id").distinct(), "conv_id")
    pos = F.col("skip") + F.col("place") - 1
    turn = F.struct(pos.alias("pos"), "role", "text")
    parts = rows.join(chunks, ["conv_id", "bucket"]).groupBy("conv_id", F.floor(pos / part).alias("part"), "n_turns").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    return parts.select("conv_id", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("t", line), "").alias("text"))


def render(turns: DataFrame, ids: DataFrame, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, part, text): the turns of the conversations in `ids`, `part` turns to a row by position."""
    return _rendered(*dealt(turns, chunk), ids, part).select("conv_id", "part", "text")


def op2_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    rows, chunks = dealt(table(spark, sf_dir, "conversations"))
    kept = _maximal(written(prefixes(rows, chunks), "prefixes"))
    return _rendered(rows, chunks, kept.select(F.col("kept_id").alias("conv_id")), PART)


OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  sha256(coalesce('s' || role, 'n')) || sha256(coalesce('s' || text, 'n')) AS d FROM t),
h AS (SELECT *, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY pos) AS h, count(*) OVER (PARTITION BY conv_id) AS n FROM p),
k AS (SELECT min(conv_id) AS conv_id, n, sha256(h) AS h FROM h WHERE pos = n GROUP BY n, sha256(h)),
kept AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos = k.n AND h.pos < h.n AND sha256(h.h) = k.h))
SELECT conv_id, ((pos - 1) // 256)::BIGINT AS part, kept.n::BIGINT AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS text
FROM kept JOIN p USING (conv_id) GROUP BY conv_id, part, kept.n
"""
