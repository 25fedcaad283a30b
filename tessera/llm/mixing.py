"""Mixes sources to target weights by a low-discrepancy schedule.

The schedule is a sequence of slots; slot i holds the point frac(i / golden ratio), which falls into the share of
one source on the unit interval. A source's slots are ranked, and its rank-th slot takes its rank-th block: the
source's documents, shuffled by a hash of their ids and laid end to end, cut every ``block_words`` words. After
the last block the source starts over. A source stops at the rank nearest its target.

Slots are made and ranked in chunks, documents are laid out in hash buckets, and only counts by chunk or bucket
run through a window by source, so a source with a third of all rows is never in one task. The totals by source
come to the driver: one row for each source.

Defined results: a null text has size 0; documents without words take no part and get 0; a null source is a
source of its own, last in order; a null id is shuffled by the text; repeated rows lie side by side and are each
counted; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tessera.llm import common

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
BLOCK_WORDS = 256
SEED = "mix-1"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GOLDEN = (math.sqrt(5) - 1) / 2
CHUNK = 1 << 16
MOST_SLOTS = 1 << 40
STRAY = lambda n: 2 * (3 + math.log(n) / math.log(1 / GOLDEN))
BUCKET_DIGITS = 3  # of a hexadecimal hash: 4096 buckets


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_EPOCHS) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess goes to the others by weight."""
    open_, left, found = set(range(len(sizes))), total, [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            found[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(most * sizes[i] for i in full)
        open_ -= full
    return found


def slots_wanted(size: int, target: float, block: int = BLOCK_WORDS) -> int:
    """Slots of a source whose blocks hold the number of words nearest the target."""
    if not size:
        return 0
    whole, rest = divmod(target, size)
    blocks = -(-size // block)
    return int(whole) * blocks + min(blocks, math.floor(rest / block + 0.5))


def points(first: int, n: int) -> np.ndarray:
    """frac(i * GOLDEN) for n numbers from first on, to 1e-9 up to 2**40."""
    i = np.arange(first, first + n, dtype=np.int64)
    return np.mod((i >> 20) * math.fmod((1 << 20) * GOLDEN, 1.0) + (i & 0xFFFFF) * GOLDEN, 1.0)


def schedule(spark: SparkSession, shares: list[float], wanted: list[int]) -> DataFrame:
    """slot, part, rank: the part (an index into shares) of each slot and its rank there, from 0.

    Slots are added until each part has the ranks wanted. At n slots a part of share p has n * p of them but for
    less than STRAY(n) (the discrepancy of the golden ratio, once for either edge); one that strays farther is an error.
    """
    total = sum(shares)
    if not total:
        return spark.createDataFrame([], "slot long, part int, rank long")
    edges = np.cumsum(shares) / total
    need = max((w * total / s for w, s in zip(wanted, shares, strict=True) if s), default=0)
    chunks = int(need) // CHUNK + 1

    def parts(chunk: int) -> np.ndarray:
        return np.minimum(np.searchsorted(edges, points(chunk * CHUNK, CHUNK), "right"), len(edges) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                n = np.bincount(parts(chunk), minlength=len(edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], ["chunk", "part", "n"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.array(wanted, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                here, before = parts(row["chunk"]), np.zeros(len(edges), np.int64)
                for x in row["before"]:
                    before[x["part"]] = x["n"]
                order = np.argsort(here, kind="stable")
                firsts = np.searchsorted(here[order], np.arange(len(edges)))
                ranks = np.empty(CHUNK, np.int64)
                ranks[order] = np.arange(CHUNK) - firsts[here[order]]
                ranks += before[here]
                keep = ranks < limit[here]
                slots = np.arange(CHUNK, dtype=np.int64)[keep] + row["chunk"] * CHUNK
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(here[keep].astype(np.int32)), pa.array(ranks[keep])], ["slot", "part", "rank"])

    while True:
        slots = chunks * CHUNK
        if slots > MOST_SLOTS:
            raise ValueError(f"{slots} slots are more than points() tells apart: a source's share is too small")
        counted = spark.range(chunks).mapInArrow(count, "chunk long, part int, n long")
        have = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each source
        short = [(i, w - have.get(i, 0)) for i, w in enumerate(wanted) if w > have.get(i, 0)]
        if not short:
            break
        if lost := [i for i, _ in short if not shares[i] or slots * shares[i] / total - wanted[i] > STRAY(slots)]:
            raise ValueError(f"of {slots} slots, parts {lost} have fewer than they want")
        chunks += max(int(missing * total / shares[i]) // CHUNK + 1 for i, missing in short)
    before = F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")
    bases = counted.withColumn("n", before).groupBy("chunk").agg(F.collect_list(F.struct("part", "n")).alias("before"))
    return bases.mapInArrow(rank, "slot long, part int, rank long")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        n = pa.array([len(x.split()) for x in common.texts_of(batch, "text")], pa.int64())
        names = ["id", "source", "key", "sum"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), n], [*names, "size"])


def laid_out(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """sized with at: the words of the source's documents before this one in the shuffled order."""
    keyed = sized.withColumn("h", F.md5(F.concat("key", F.lit(f":{seed}")).cast("binary")))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = keyed.groupBy("part", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("bucket")) - F.col("n")
    bases = sums.select("part", "bucket", before.alias("base"))
    inside = F.sum("size").over(Window.partitionBy("part", "bucket").orderBy("h", "id", "size", "sum").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return keyed.withColumn("inside", inside).join(bases.hint("merge"), ["part", "bucket"]).select("id", "sum", "part", "size", (F.col("base") + F.col("inside")).alias("at"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, block: int = BLOCK_WORDS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, draws). documents: id, source, sum (the text's hash), size, source_size, target, at, taken, one row for each given.
    draws: part, at, slot, epoch, block, words: what each slot of the schedule takes of which document."""
    spark = docs.sparkSession
    rows = common.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    key = F.coalesce(F.col("id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    rows = rows.withColumns({"key": key, "sum": F.xxhash64("text")})
    sized = common.written(rows.mapInArrow(_count_words, "id long, source string, key string, sum long, size long"), "mix-sizes")
    totals = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    amounts = [n for _, n in totals]
    goals = targets(amounts, [weights[i % len(weights)] for i in range(len(totals))], share * sum(amounts), most)
    wanted = [slots_wanted(n, goal, block) for n, goal in zip(amounts, goals, strict=True)]
    of = spark.createDataFrame([(s, i, n, g, -(-n // block)) for i, ((s, n), g) in enumerate(zip(totals, goals, strict=True))], "source string, part int, source_size long, target double, blocks long")
    # a row for each source, which the driver holds already, is all that is ever broadcast
    parted = sized.join(F.broadcast(of.select("source", "part")), sized["source"].eqNullSafe(of["source"])).select("id", "key", "sum", "part", "size")
    placed = common.written(laid_out(parted, seed), "mix-places")
    block_of = lambda x: F.floor(x / block).cast("long")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(block_of(F.col("at")), block_of(F.col("at") + F.col("size") - 1))))
    words = F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")) - F.greatest(F.col("block") * block, F.col("at"))
    cut = cut.select("part", "block", "at", words.alias("words"))
    slots = schedule(spark, goals, wanted).join(F.broadcast(of.select("part", "blocks")), "part")
    slots = slots.select("part", "slot", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).cast("int").alias("epoch"))
    draws = slots.join(cut.hint("merge"), ["part", "block"])  # both sides grow with the words: neither is ever broadcast
    taken = draws.groupBy("part", "at").agg(F.sum("words").alias("taken")).withColumn("has", F.lit(True))
    found = placed.withColumn("has", F.col("size") > 0).join(taken, ["part", "at", "has"], "left").join(F.broadcast(of), "part")
    return found.select("id", "source", "sum", "size", "source_size", "target", "at", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), draws


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: docs with a row for each time a document is taken, the last cut after its last word taken.

    Rows are told apart by id, source and text; those alike in all three are taken in the order of a hash of all their
    columns. Documents of which the mix takes nothing are not in it.
    """
    found, _ = mix(docs, id_col, text_col, source_col, **how)
    found = common.written(found.select("id", "source", "sum", "at", "taken"), "mix-taken")
    who, where, what, words, nth = (common.fresh(docs, x) for x in ("mix_id", "mix_source", "mix_sum", "mix_taken", "mix_nth"))
    plan = found.select(F.col("id").alias(who), F.col("source").alias(where), F.col("sum").alias(what), F.col("taken").alias(words), F.col("at").alias(nth))
    rows = common.bounded(docs).withColumn(common.fresh(docs, "mix_text"), F.xxhash64(text_col))
    own = rows.columns[-1]
    same = F.col(id_col).cast("long").eqNullSafe(F.col(who)) & F.col(source_col).cast("string").eqNullSafe(F.col(where)) & (F.col(own) == F.col(what))
    if found.groupBy("id", "source", "sum").count().where("count > 1").head(1):
        plan = plan.withColumn(nth, F.row_number().over(Window.partitionBy(who, where, what).orderBy(nth)))
        plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
        mine = common.fresh(docs, "mix_mine")
        rows = rows.withColumn(mine, F.row_number().over(Window.partitionBy(id_col, source_col, own).orderBy(F.xxhash64(*plain))))
        same &= F.col(mine) == F.col(nth)
    rows = rows.join(plan.where(F.col(words) > 0), same).select(*docs.columns, words)
    names, at = docs.columns, docs.columns.index(text_col)

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            take, out = [], []
            for i, (text, words) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                whole, rest = divmod(words, max(len(text.split()), 1))
                take += [i] * (whole + (rest > 0))
                out += [text] * whole
                if rest:
                    out.append(text[: next(islice(WORD.finditer(text), rest - 1, None)).end()])
            columns = list(batch.take(pa.array(take, pa.int64())).columns[:-1])
            columns[at] = pa.array([x.decode("utf-8", "replace") for x in out], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(repeat, docs.schema)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    found, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP10_SQL = f"""
WITH sized AS (SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN md5(text) END AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS n, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::DOUBLE AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, {MOST_EPOCHS} * n / w AS full_at, coalesce(sum({MOST_EPOCHS} * n) OVER before, 0)::DOUBLE AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w
  FROM totals WINDOW before AS (ORDER BY {MOST_EPOCHS} * n / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(({SHARE} * (SELECT sum(n) FROM totals) - capped) / open_w, full_at) AS unit FROM filled WHERE ({SHARE} * (SELECT sum(n) FROM totals) - capped) / open_w <= full_at),
goals AS (SELECT source, n, least(w * unit, {MOST_EPOCHS} * n)::DOUBLE AS target FROM totals, level),
wanted AS (
  SELECT *, floor(target / greatest(n, 1))::BIGINT AS whole, ceil(n / {float(BLOCK_WORDS)})::BIGINT AS blocks FROM goals),
rested AS (SELECT *, least(n, least(blocks, floor((target - whole * n) / {float(BLOCK_WORDS)} + 0.5)::BIGINT) * {BLOCK_WORDS}) AS rest FROM wanted),
placed AS (
  SELECT doc_id, source, size,
    sum(size) OVER (PARTITION BY source ORDER BY md5(concat(coalesce(CAST(doc_id AS VARCHAR), h, ''), ':{SEED}')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS pos FROM sized)
SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(pos + size, rest) - pos))::BIGINT AS taken
FROM placed JOIN rested ON placed.source IS NOT DISTINCT FROM rested.source
"""
