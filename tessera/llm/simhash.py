"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join, exact verification.

A document's fingerprint has a bit set where more than half of the hashes of its word shingles have it. Cut into
segments of two bits, a fingerprint becomes a vector of bit counts, and the Manhattan distance of two vectors is
never more than the Hamming distance of the fingerprints. Fingerprints at 4 or fewer differing bits are within 2
in the left or in the right half of the vector. So each distinct fingerprint is put into the grid cells within 1
of either half; two that are within 2 there share a cell, and those that share one are compared bit by bit.

Copies fall together as one fingerprint before the grid. A cell with many fingerprints is mostly one dense group;
there, fingerprints at most two bits apart are first linked through the centres of their one-bit balls (a star for
each centre, no pairs), and then the members of a cell's largest group so found are compared only with the rest
of the cell. No pairs of a group are made, no cell is cut, no link between groups is lost.

Defined results: a null text, or one without words, has fingerprint zero and is linked like any other; rows with
equal ids are each returned; a null id is never a component_id unless no id in the component is known; an empty
table gives no rows. Extra columns are ignored. Costs grow with the square of the number of unrelated
fingerprints times 7e-5 comparisons of two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tessera.llm import common
from tessera.llm.components import components

SHINGLE_WORDS, MOST_BITS, SEED = 4, 4, 42
#: Of the pipeline's stage: words of a shingle; bits of its hash; common shingles that workers know and slots of texts
#: that are asked for, which bear on speed alone.
SET_WORDS, HASH_BITS, COMMON_HELD, SLOTS = 5, 58, 200_000, 1 << 22
#: Fingerprints in a cell beyond which it is taken for dense; either way is exact.
DENSE_CELL = 64
#: A half's count vector that so many fingerprints share makes every cell within 1 of it crowded, without the cell being
#: counted; or so many that there are at most CROWDED such vectors. Either way is exact; the rest of a cell is bounded.
CROWD, CROWDED = 1000, 50_000
#: Hashes whose bits are counted at once: bounded memory on very long texts.
AT_ONCE = 51_000
#: Rounds in which a shingle's sets are compared with one of them alone.
STARS = 2
HALF_ONES = 0x5555555555555555


def _ones(hashes: bytes) -> np.ndarray:
    """How many of the hashes, eight bytes each, have each bit."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return counts + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if whole else counts


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, the highest bits first."""
    words = text.lower().split()  # both are of ASCII alone
    if not words:
        return bytes(8)
    joined, size = b" ".join(words), min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    firsts, lasts = starts[: len(words) - size + 1].tolist(), (starts + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    n, counts = len(firsts), np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        counts += _ones(b"".join([digest(joined[s:e], SEED) for s, e in zip(firsts[at : at + AT_ONCE], lasts[at : at + AT_ONCE], strict=True)]))
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        found = b"".join(map(fingerprint, common.texts_of(batch, "text")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.frombuffer(found, ">u8").astype(np.uint64).view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    rows = common.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The counts of all 32 segments, two bits each, in one number."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(HALF_ONES))


def half_codes(counts: np.ndarray) -> list[np.ndarray]:
    """The grid cells that both halves of the count vectors lie in; bit 40 tells the halves apart."""
    return [(counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF) | np.uint64(half << 40) for half in (0, 1)]


def within_one(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of the grid cells within 1 of half count vectors."""
    places = np.uint64(2) * np.arange(16, dtype=np.uint64)
    each = (code[:, None] >> places) & np.uint64(3)
    cells, rows = [code], [np.arange(len(code))]
    for step, ok in ((np.uint64(1), each < 2), (np.uint64(2**64 - 1), each > 0)):
        r, s = np.nonzero(ok)
        cells.append(code[r] + (step << places[s]))
        rows.append(r)
    return np.concatenate(cells), np.concatenate(rows)


def half_cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of the grid cells within 1 of each half of the count vectors."""
    low, high = map(within_one, half_codes(counts))
    return np.concatenate([low[0], high[0]]), np.concatenate([low[1], high[1]])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, 4096):
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        codes = np.concatenate(half_codes(segment_counts(fp.view(np.uint64))))
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64))], ["code"])


def crowded_cells(distinct: DataFrame) -> np.ndarray:
    """Sorted: the cells within 1 of a half count vector that very many fingerprints share, 33 at most for each of
    fewer than CROWDED vectors. Any other cell has at most 33 times as many fingerprints as make a crowd."""
    crowd = max(CROWD, 2 * distinct.count() // CROWDED)
    shared = distinct.mapInArrow(_codes, "code long").groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    codes = shared.select("code").toArrow().column("code").to_numpy().astype(np.int64).view(np.uint64)
    return np.unique(within_one(codes)[0])


def _cells(distinct: DataFrame, crowded: np.ndarray, wanted: bool) -> DataFrame:
    """cell, fp: every fingerprint in its cells, those that are crowded or those that aren't."""
    known = distinct.sparkSession.sparkContext.broadcast(crowded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 4096):
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            cells, rows = half_cells(segment_counts(fp.view(np.uint64)))
            own = np.isin(cells, known.value) == wanted
            yield pa.RecordBatch.from_arrays([pa.array(cells[own].view(np.int64)), pa.array(fp[rows[own]])], ["cell", "fp"])

    return distinct.mapInArrow(work, "cell long, fp long")


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in common.chunks(batches, 4096):
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        centres = (fp.view(np.uint64)[:, None] ^ flips).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(centres.view(np.int64)), pa.array(np.repeat(fp, 65))], ["centre", "fp"])


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links that connect the fingerprints of ``fp`` as all pairs at MOST_BITS or fewer would."""
    crowded = crowded_cells(distinct)
    in_cell = F.count("*").over(Window.partitionBy("cell"))
    cells = common.written(_cells(distinct, crowded, False).withColumn("n", in_cell).where("n > 1"), "simhash-cells")
    few = cells.where(F.col("n") <= DENSE_CELL).select("cell", "fp")
    plain = few.select("cell", F.col("fp").alias("u")).join(few.select("cell", F.col("fp").alias("v")), "cell").where(F.col("u") < F.col("v")).where(_near("u", "v"))
    found = plain.select("u", "v").distinct()
    many = cells.where(F.col("n") > DENSE_CELL).select("cell", "fp")
    if len(crowded):
        many = common.written(many.union(_cells(distinct, crowded, True)), "simhash-many")
    if not many.head(1):
        return found
    balls = many.select("fp").distinct().mapInArrow(_balls, "centre long, fp long")
    least = balls.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("centre", "v")
    stars = common.written(balls.join(least, "centre").select(F.col("fp").alias("u"), "v").where("u <> v").distinct(), "simhash-stars")
    group = components(stars).withColumnRenamed("node", "fp")
    named = many.join(group, "fp", "left").select("cell", "fp", F.coalesce("root", "fp").alias("g"))
    named = common.written(named, "simhash-dense")
    sizes = named.groupBy("cell", "g").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("cell").agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    others = named.join(mains, "cell").where("g <> main").select("cell", F.col("fp").alias("u"), F.col("g").alias("gu"))
    across = others.join(named.select("cell", F.col("fp").alias("v"), F.col("g").alias("gv")), "cell").where("gu <> gv").where(_near("u", "v"))
    return found.union(stars).union(across.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id: of every row its fingerprint and the smallest id linked to it, itself included."""
    prints = common.written(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = common.written(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-named")
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(firsts, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "fp", "component_id")


def shingle_hashes(text: bytes, size: int = SET_WORDS) -> np.ndarray:
    """The hashes of the distinct word shingles, sorted."""
    words = text.lower().split()
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    firsts, lasts = starts[: len(words) - size + 1].tolist(), (starts + lengths)[size - 1 :].tolist()
    found = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(firsts, lasts, strict=True)])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles, as a signed number; of none: zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        counts += _ones(hashes[at : at + AT_ONCE].astype(">u8").tobytes())
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def shingle_set(found: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of these hashes, sorted: 58 bits of each, and above them a class of frequency, so that common ones
    come last. often: sorted hashes of common shingles, and their classes; all others are of class 0."""
    hashes = np.unique(found >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    known, classes = often
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = np.sort(hashes | (np.where(known[at] == hashes, classes[at], 0) << HASH_BITS))
    return hashes


def prefix(hashes: np.ndarray) -> np.ndarray:
    """The first of a sorted set: sets of Jaccard similarity 4/5 or more share one of them."""
    return hashes[: len(hashes) + (-4 * len(hashes) // 5) + 1] if len(hashes) else hashes


NONE_OFTEN = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _often(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and their classes (1 + log2 of a count), as a part of the documents shows. Which these are has
    no effect on what is linked, only on how much is compared."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            sets = [shingle_set(shingle_hashes(x), NONE_OFTEN) for x in common.texts_of(batch, "text")]
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["h", "n"])

    part = rows.where(common.id_crc(F.col("id"), 8) == 0).select("text")
    often = part.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n")).limit(COMMON_HELD)
    found = often.select("h", (F.least(F.floor(F.log2("n")), F.lit(30)) + 1).alias("class")).toArrow().sort_by("h")
    return found.column("h").to_numpy().astype(np.int64), found.column("class").to_numpy().astype(np.int64)


def _least_overlap(a: str, b: str):
    """9 times the shingles that sets of these sizes must share to be alike to 4/5."""
    return 4 * (F.col(a) + F.col(b))


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """u, v: sets (fp, bits) whose fingerprints the grid links, one set for each fingerprint; and the others of a
    fingerprint with that one."""
    firsts = common.written(sets.groupBy("bits").agg(F.min("fp").alias("first")), "simhash-first")
    linked = common.written(links(firsts.select(F.col("bits").alias("fp"))), "simhash-links")
    for end in ("u", "v"):
        linked = linked.join(firsts.select(F.col("bits").alias(end), F.col("first").alias(f"first_{end}")), end)
    near = linked.select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    same = sets.join(firsts, "bits").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    return near.union(same).distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sum (the text's hash), root, component_id: rows linked by sets of five-word shingles alike to 4/5 or more
    have the same root, and the smallest of their ids as component_id.

    Equal sets fall together. The others get fingerprints, segment counts and grid cells as in near_duplicates, and
    the sets that these link are compared. That is the method; but at a similarity of 4/5 fingerprints differ by ten
    bits of 64, a distance at which the grid would compare all with all. So an exact join looks for the links that
    fingerprints don't show, among sets that aren't linked yet. Every such pair of sets shares a shingle of both
    prefixes; at the first that it shares, enough of both sets must be left. Pairs of either kind are first held
    against each other by prefix (a shingle of one prefix that the other's order passes over isn't in the other set),
    and what that can't exclude is compared whole. Where several share a shingle, each is first compared with the most
    typical, then with a few others, unless they are linked by then; then those
    outside the largest group so linked with the rest. Among many that share a shingle of their prefixes and aren't
    alike, that is every pair: shingles are ordered so that a prefix has the rarest.
    """
    rows = common.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("sum", F.xxhash64("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_often(rows))

    def listed(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def sets_of(found: list[np.ndarray]) -> tuple[list[np.ndarray], pa.Array]:
        sets = [shingle_set(x, shared.value) for x in found]
        return sets, pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [shingle_hashes(x) for x in common.texts_of(batch, "text")]
            sets, fp = sets_of(found)
            bits, sizes = pa.array(map(set_fingerprint, found), pa.int64()), pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sum"), fp, bits, sizes, listed([prefix(x) for x in sets])], ["id", "sum", "fp", "bits", "size", "prefix"])
        common.trim()

    prints = common.written(rows.mapInArrow(prefixes, "id long, sum long, fp long, bits long, size int, prefix array<long>"), "sets-prints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sum")).alias("least")
    firsts = [F.first(x).alias(x) for x in ("bits", "size", "prefix")]
    distinct = common.written(prints.groupBy("fp").agg(least, *firsts), "sets-distinct")
    cells = distinct.select("fp", "size", F.posexplode("prefix").alias("at", "cell"))
    several = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    cells = common.written(cells.join(several, "cell"), "sets-shared")
    # the more of its prefix others have too, the better a set stands for a group of near copies
    typical = cells.groupBy("fp").agg((F.count("*") / F.first("size")).alias("typical"))
    cells = common.written(cells.join(typical, "fp"), "sets-typical")
    best = F.max_by(F.struct("fp", "size", "at"), F.struct("typical", "fp")).alias("best")
    cells = common.written(cells.join(cells.groupBy("cell").agg(best), "cell"), "sets-cells")

    def fits(one: str, other: str):
        """Whether sets that first share the shingle at these places can be alike."""
        left = F.least(*[F.col(f"{x}size") - F.col(f"{x}at") for x in (one, other)])
        return 9 * left >= 4 * (F.col(f"{one}size") + F.col(f"{other}size"))

    def both(pairs: DataFrame, table: DataFrame, *names: str) -> DataFrame:
        """pairs (u, v) with these columns of both."""
        for end in ("u", "v"):
            pairs = pairs.join(table.select(F.col("fp").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in names]), end)
        return pairs

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (u, v) that prefixes don't exclude."""
        found = both(pairs, distinct, "size", "prefix")
        only = lambda a, b: 9 * F.size(F.filter(F.array_except(f"prefix_{a}", f"prefix_{b}"), lambda x: x < F.array_max(f"prefix_{b}")))
        may = lambda a: 9 * F.col(f"size_{a}") - _least_overlap("size_u", "size_v")
        return common.written(found.where((only("u", "v") <= may("u")) & (only("v", "u") <= may("v"))).select("u", "v"), name)

    slot = lambda one, sum_: F.pmod(F.xxhash64(one, sum_), F.lit(SLOTS))

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (u, v) that are similar; the sets that it takes are made anew from their texts."""
        asked = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct().join(distinct.select("fp", "least"), "fp")
        marked = np.zeros(SLOTS, bool)  # a row whose slot isn't marked is in no pair
        marked[asked.select(slot(F.col("least.id"), F.col("least.sum")).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
        slots = docs.sparkSession.sparkContext.broadcast(marked)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices([batch.filter(pa.array(slots.value[batch.column("slot").to_numpy()]))], "text"):
                    sets, fp = sets_of([shingle_hashes(x) for x in common.texts_of(part, "text")])
                    yield pa.RecordBatch.from_arrays([fp, listed(sets)], ["fp", "hashes"])
            common.trim()

        sets = rows.withColumn("slot", slot("id", "sum")).select("text", "slot").mapInArrow(whole, "fp long, hashes array<long>")
        sets = common.written(sets.groupBy("fp").agg(F.first("hashes").alias("hashes")), f"{name}-whole")
        found = both(pairs, sets.withColumn("n", F.size("hashes")), "n", "hashes")
        found = common.written(found.where(9 * F.size(F.array_intersect("hashes_u", "hashes_v")) >= _least_overlap("n_u", "n_v")).select("u", "v"), name)
        common.discard(sets)
        return found

    pairs = possible(fingerprint_pairs(distinct.select("fp", "bits")), "simhash-pairs")
    found = alike(pairs, "simhash-alike") if pairs.head(1) else pairs
    roots = common.written(components(found), "simhash-roots")
    stars = cells.where(F.col("fp") != F.col("best.fp")).where(fits("", "best.")).select(F.least("best.fp", "fp").alias("u"), F.greatest("best.fp", "fp").alias("v")).distinct()
    for end in ("u", "v"):
        stars = stars.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    rest = possible(stars.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v"), "sets-pairs")
    if rest.head(1):
        found = found.union(alike(rest, "sets-links"))
    ends = [F.least("x.fp", "fp").alias("u"), F.greatest("x.fp", "fp").alias("v")]
    members = cells.where((F.col("n") > 2) & (F.col("fp") != F.col("best.fp"))).select("cell", "fp", "size", "at", "typical")

    def groups(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of cells with their group so far, and those outside the largest group of their cell. Cells of two,
        and the best of each, have nothing left to compare."""
        named = members.join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
        grouped = common.written(named.withColumn("g", F.coalesce("root", "fp")).drop("root"), "sets-grouped")
        sizes = grouped.groupBy("cell", "g").agg(F.count("*").alias("n"))
        mains = sizes.groupBy("cell").agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
        return grouped, grouped.join(mains, "cell").where("g <> main").select("cell", F.struct("fp", "size", "at", "g", "typical").alias("x"))

    for _ in range(1, STARS):
        grouped, others = groups(found)
        centres = others.groupBy("cell").agg(F.max_by("x", F.struct("x.typical", "x.fp")).alias("x"))
        stars = grouped.join(centres, "cell").where((F.col("g") != F.col("x.g")) & fits("", "x.")).select(*ends)
        near = possible(stars.distinct(), "sets-pairs")
        common.discard(grouped)
        if not near.head(1):
            break
        found = found.union(alike(near, "sets-links"))
    grouped, others = groups(found)
    across = others.join(grouped, "cell").where((F.col("g") != F.col("x.g")) & fits("", "x."))
    near = possible(across.select(*ends).distinct(), "sets-near")
    if near.head(1):
        found = found.union(alike(near, "sets-across"))
    common.discard(cells, grouped)
    named = distinct.select("fp", "least").join(components(found).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = common.written(named, "sets-named")
    firsts = named.groupBy("root").agg(F.min("least.id").alias("component_id"))
    found = common.written(prints.select("id", "sum", "fp").join(named.join(firsts, "root").select("fp", "root", "component_id"), "fp").select("id", "sum", "root", "component_id"), "sets-components")
    common.discard(prints, distinct, named)
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar(): that with the smallest id, then text hash.

    Rows are told apart by id and text, so rows that share an id and not a text are judged one by one; a null id comes
    last. Of rows with the same id and text that with the least hash of all its columns stays.
    """
    found = similar(docs, id_col, text_col)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sum")).alias("least")
    of_id, of_sum, place = (common.fresh(docs, x) for x in ("kept_id", "kept_sum", "kept_place"))
    kept = common.written(found.groupBy("root").agg(least).select(F.col("least.id").alias(of_id), F.col("least.sum").alias(of_sum)), "sets-kept")
    twice = found.groupBy("id", "sum").count().where("count > 1").head(1)
    own = docs.withColumn(place, F.xxhash64(text_col))
    stays = own.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(of_id)) & (F.col(place) == F.col(of_sum)), "left_semi")
    if twice:
        plain = [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]
        order = Window.partitionBy(id_col, place).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
        stays = stays.withColumn(of_id, F.row_number().over(order)).where(F.col(of_id) == 1)
    return stays.select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
