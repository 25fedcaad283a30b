"""Exact top-k by inner product, through M-trees searched best first.

Vectors become whole numbers, floor(64 x). A further coordinate makes them all equally long, and then the largest
inner product with a query is the smallest Euclidean distance to it (the query's own further coordinate is 0):
d(q, v)^2 = |q|^2 + L^2 - 2 q.v. Rows go to the nearest of a bounded number of pivots (data vectors, picked from a
bounded sample), and a pivot's rows to as many trees as keep a tree's size bounded, so one vector that is most of the
table, or one cluster, is many trees. A tree's nodes are pages: a leaf holds vectors, an inner node routing vectors
with the covering radius of what lies below; every entry has its distance to its parent's routing vector. A query
visits pages by the smallest distance that they can hold, from a queue, until none can better its k-th score; within
a page, |d(q, parent) - d(entry, parent)| already excludes entries whose distances then needn't be computed.

Each query first goes to the tree of its nearest pivot. With the k-th score that it has there, it then goes only to
trees whose pivot and covering radius leave room for a better one. Pivot, radius and size of each tree, MOST_TREES
rows, are all that comes to the driver or is broadcast. Queries meet a tree in blocks; pages are a table of the
shared folder. Scores are exact: sums below 2**53 in doubles, others in whole numbers of any size where bounds don't
exclude them; bounds give way by a slack.

Defined results: vectors that are null or hold a null or non-finite component take no part; without candidates a
query has no rows; vectors shorter than the longest are filled with zeros; a score beyond 64 bits is the nearest that
fits, and so is a component's 64-fold beyond a double; rows with equal ids are each found, but never by a query of their own id; equal rows are one query, rows with
equal ids and other vectors are queries of their own. Extra columns are ignored. On vectors without clusters, in many
dimensions, nothing can be excluded, and every distance is computed.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

SCALE, TOP, QUERY_EVERY = 64, 20, 20
TREE_ROWS, QUERY_ROWS, PAGE = 8192, 1024, 256
MOST_PIVOTS, MOST_TREES, SAMPLE, MEETINGS_EACH = 1024, 16_384, 8192, 4
LOWEST, HIGHEST, LARGEST = -(2**63), 2**63 - 1, sys.float_info.max
PAGES = "tree int, node int, parent int, leaf boolean, ids binary, vectors binary, radii binary, near binary, children binary, width int"


def _floor(x: Column) -> Column:
    """Doubles from 2**52 on are whole, and may not fit a long."""
    return F.when(F.abs(x) < 2.0**52, F.floor(F.when(F.abs(x) < 2.0**52, x).otherwise(0.0)).cast("double")).otherwise(x)


def slack(length: float, norm: float) -> float:
    """What a computed distance may be off."""
    return 1e-3 + 1e-7 * math.sqrt(length + norm)


def whole(vectors: Column) -> Column:
    """floor(64 x) of each component, as double; null for vectors that take no part."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vectors.isNotNull() & F.coalesce(finite, F.lit(False)), F.transform(vectors, lambda x: _floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST)))))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(axis=1), 0.0))


class Tree:
    """Pages built from the leaves up; nodes[0] is the root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, length: float) -> None:
        self.ids, self.raw, self.nodes = ids, vectors, []
        self.points = lifted(vectors, length)
        self.dice = np.random.default_rng(0)
        self._page(np.arange(len(ids)), None, -1)

    def _page(self, rows: np.ndarray, centre: np.ndarray | None, parent: int) -> int:
        """Makes the page for rows, whose routing vector is centre; returns its number."""
        number = len(self.nodes)
        node = {"parent": parent, "leaf": len(rows) <= PAGE}
        self.nodes.append(node)
        if node["leaf"]:
            node["rows"], own = rows, self.points[rows]
            node["radii"], node["children"] = np.zeros(len(rows)), np.full(len(rows), -1)
        else:
            own, groups = self._split(rows)
            node["rows"] = np.full(len(own), -1)
            node["radii"] = np.array([_distances(self.points[g], c).max() for g, c in zip(groups, own, strict=True)])
            node["children"] = np.array([self._page(g, c, number) for g, c in zip(groups, own, strict=True)])
        node["points"] = own
        node["near"] = np.zeros(len(own)) if centre is None else _distances(own, centre)
        return number

    def _split(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Routing vectors, and the rows nearest each: chosen far apart in a sample; copies are cut by number."""
        sample = self.points[self.dice.choice(rows, min(len(rows), 512), replace=False)]
        wanted = int(min(PAGE, max(2, -(-len(rows) // (PAGE // 2)))))
        picked, far = [0], _distances(sample, sample[0])
        while len(picked) < wanted and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, _distances(sample, sample[picked[-1]]))
        centres = sample[picked]
        if len(centres) > 1:
            squares = (centres**2).sum(axis=1)
            owner = np.argmin(squares - 2 * self.points[rows] @ centres.T, axis=1)
            groups = [rows[owner == i] for i in range(len(centres))]
            full = [i for i, g in enumerate(groups) if len(g)]
            if len(full) > 1:
                return centres[full], [groups[i] for i in full]
        parts = np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))
        return self.points[[p[0] for p in parts]], parts

    def pages(self, tree: int) -> pd.DataFrame:
        width = self.points.shape[1]
        return pd.DataFrame([
            {"tree": tree, "node": i, "parent": n["parent"], "leaf": n["leaf"], "ids": (self.ids[n["rows"]] if n["leaf"] else n["rows"]).astype(np.int64).tobytes(),
             "vectors": n["points"].astype(np.float64).tobytes(), "radii": n["radii"].astype(np.float64).tobytes(), "near": n["near"].tobytes(),
             "children": n["children"].astype(np.int64).tobytes(), "width": width}
            for i, n in enumerate(self.nodes)
        ])


class Page:
    def __init__(self, row) -> None:
        self.leaf, self.width = row.leaf, row.width
        self.ids, self.children = np.frombuffer(row.ids, np.int64), np.frombuffer(row.children, np.int64)
        self.vectors = np.ascontiguousarray(np.frombuffer(row.vectors, np.float64).reshape(-1, row.width)[:, :-1])  # a query's last is 0
        self.radii, self.near = np.frombuffer(row.radii), np.frombuffer(row.near)


def _exact(page: Page, rows: np.ndarray, query: np.ndarray) -> list[int]:
    q = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(q, page.vectors[r], strict=True)) for r in rows]


def search(pages: list[Page], length: float, query_id: int, query: np.ndarray, top: int, count: list[int] | None = None, least_score: int | None = None, wide: bool = False) -> list[tuple[int, int]]:
    """(score, id) of the best candidates below the root, pages[0].

    least_score: what a candidate must reach to matter. wide: sums may need more than 53 bits. count: gets the distances
    computed.
    """
    norm = float(query @ query)
    off = slack(length, norm)
    best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
    queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]  # least distance, page, distance to its routing vector

    def within(score: int) -> float:
        return math.sqrt(max(norm + length - 2.0 * score, 0.0)) + off if math.isfinite(length + norm) and score > LOWEST else np.inf

    reach = np.inf if least_score is None else within(least_score)  # no candidate farther than this can still matter
    while queue:
        least, number, to_parent = heapq.heappop(queue)
        if least > reach:
            break
        page = pages[number]
        left = np.arange(len(page.near))
        if to_parent >= 0 and np.isfinite(reach):
            left = np.flatnonzero(np.abs(to_parent - page.near) - page.radii <= reach + off)
            if not len(left):
                continue
        with np.errstate(over="ignore", invalid="ignore"):
            inner = page.vectors[left] @ query
        if count is not None:
            count[0] += len(inner)
        if page.leaf:
            floor = best[0][0] if len(best) == top else least_score
            if floor is not None:
                room = 1e-12 * math.sqrt(max(length, 1.0) * max(norm, 1.0)) * len(query) if wide else 0.0
                ok = ~(inner < floor - room)  # not a number: may be
                left, inner = left[ok], inner[ok]
            scores = [min(max(x, LOWEST), HIGHEST) for x in _exact(page, left, query)] if wide else np.rint(inner).astype(np.int64).tolist()
            for s, i in zip(scores, page.ids[left].tolist(), strict=True):
                if i != query_id:
                    if len(best) < top:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            if len(best) == top:
                reach = min(reach, within(best[0][0]))
        else:
            with np.errstate(over="ignore", invalid="ignore"):
                away = np.nan_to_num(np.sqrt(np.maximum(norm + length - 2 * inner, 0.0)), nan=0.0, posinf=0.0)
            for least, child, d in zip(np.maximum(away - page.radii[left] - off, 0.0).tolist(), page.children[left].tolist(), away.tolist(), strict=True):
                if not least > reach:
                    heapq.heappush(queue, (least, child, d))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _matrix(arrays: list, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for row, x in zip(out, arrays, strict=True):
        row[: len(x)] = x
    return out


def lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """With the coordinate that makes all equally long."""
    return np.column_stack([vectors, np.sqrt(np.maximum(length - (vectors**2).sum(axis=1), 0.0))])


def pivots_of(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Members of the sample near the centres of as many clusters."""
    dice = np.random.default_rng(0)
    centres = np.unique(sample, axis=0)
    centres = centres[dice.permutation(len(centres))[:wanted]]
    for _ in range(5):
        owner = np.argmin((centres**2).sum(axis=1) - 2 * sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        n = np.bincount(owner, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    nearest = np.argmin((sample**2).sum(axis=1) - 2 * centres @ sample.T, axis=1)
    return np.unique(sample[nearest], axis=0)


def build(vectors: DataFrame, length: float, width: int) -> DataFrame:
    """The pages of all trees over (id, v, tree)."""

    def grow(key, rows):
        made = Tree(rows.column("id").to_numpy(), _matrix(rows.column("v").to_pylist(), width), length)
        return pa.Table.from_pandas(made.pages(key[0].as_py()), schema=SCHEMA, preserve_index=False)

    return vectors.select("id", "v", "tree").groupBy("tree").applyInArrow(grow, PAGES)


SCHEMA = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()), *((n, pa.binary()) for n in ("ids", "vectors", "radii", "near", "children")), ("width", pa.int32())])
OUT = "query_id long, query long, vec_id long, score long"


def _met(pages: DataFrame, asked: DataFrame, length: float, width: int, top: int, wide: bool) -> DataFrame:
    """What queries (id, query, v, floor) find in the tree that each row names."""
    sizes = asked.groupBy("tree").count().withColumn("blocks", F.ceil(F.col("count") / QUERY_ROWS).cast("int")).drop("count")
    meetings = sizes.agg(F.sum("blocks")).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-meetings // MEETINGS_EACH))
    left = pages.join(F.broadcast(sizes), "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = asked.join(F.broadcast(sizes), "tree").withColumn("block", F.pmod(F.xxhash64("id", "query"), F.col("blocks")).cast("int")).drop("blocks")

    def meet(pages_, asked_):
        found: list[tuple[int, int, int, int]] = []
        if pages_.num_rows and asked_.num_rows:
            own = [Page(r) for r in pages_.to_pandas().sort_values("node").itertuples(index=False)]
            keys = zip(*(asked_.column(c).to_pylist() for c in ("id", "query", "floor")), strict=True)
            for (i, k, floor), q in zip(keys, _matrix(asked_.column("v").to_pylist(), width), strict=True):
                found += [(i, k, v, s) for s, v in search(own, length, i, q, top, None, floor, wide)]
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "query", "vec_id", "score"), columns, strict=True)})

    return left.repartition(parts, "tree", "block").groupBy("tree", "block").cogroup(right.repartition(parts, "tree", "block").groupBy("tree", "block")).applyInArrow(meet, OUT)


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, tree_rows: int = TREE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row its best other rows by inner product."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col)).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    rows = common.written(common.bounded(rows), "mtree-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("length"), F.max(F.size("v")).alias("width"), F.count_if("q").alias("queries")).first()
    if not facts["n"] or not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length, width = float(facts["length"]), int(facts["width"])
    wide = not length < 2.0**52
    tree_rows = max(tree_rows, -(-2 * facts["n"] // MOST_TREES))
    sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow().column("v").to_pylist()
    pivots = pivots_of(lifted(_matrix(sample, width), length), min(MOST_PIVOTS, -(-facts["n"] // tree_rows))) if math.isfinite(length) else np.zeros((1, width + 1))
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (shared.value**2).sum(axis=1)
        for batch in batches:
            points = lifted(_matrix(batch.column("v").to_pylist(), width), length)
            with np.errstate(over="ignore", invalid="ignore"):
                owner = np.argmin(np.nan_to_num(squares - 2 * points @ shared.value.T), axis=1)
                away = _distances(points, shared.value[owner])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owner.astype(np.int32)), pa.array(away)], [*batch.schema.names, "pivot", "away"])

    dealt = common.written(rows.mapInArrow(deal, "id long, v array<double>, q boolean, pivot int, away double"), "mtree-dealt")
    cells = sorted((r["pivot"], r["n"]) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect())  # MOST_PIVOTS rows
    trees = [-(-n // tree_rows) for _, n in cells]
    places = [(p, int(first), k) for (p, _), first, k in zip(cells, np.cumsum([0, *trees]), trees, strict=False)]
    place = F.broadcast(spark.createDataFrame(places, "pivot int, first int, trees int"))
    dealt = dealt.join(place, "pivot").withColumn("tree", F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("trees")).cast("int")).drop("first", "trees")
    pages = common.written(build(dealt, length, width), "mtree-pages")
    spread = sorted((r["tree"], r["pivot"], r["radius"]) for r in dealt.groupBy("tree", "pivot").agg(F.max("away").alias("radius")).collect())  # MOST_TREES rows
    known = spark.sparkContext.broadcast((np.array([t for t, _, _ in spread]), pivots[[p for _, p, _ in spread]], np.array([r for _, _, r in spread])))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without a floor to the home tree; with one to all others that can reach it."""
        number, centres, radii = known.value
        for batch in common.chunks(batches, 256):
            q = _matrix(batch.column("v").to_pylist(), width)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = (q**2).sum(axis=1)
                inner = np.nan_to_num(q @ centres[:, :-1].T)
                near = np.sqrt(np.maximum(norm[:, None] + length - 2 * inner, 0.0)) - radii
            floors, homes = batch.column("floor").to_pylist(), np.argmax(inner, axis=1)
            at, to = [], []
            for i, floor in enumerate(floors):
                if batch.column("again")[i].as_py():
                    sure = floor is not None and floor > LOWEST and math.isfinite(length + norm[i])
                    reach = math.sqrt(max(norm[i] + length - 2.0 * floor, 0.0)) + 2 * slack(length, norm[i]) if sure else np.inf
                    own = np.flatnonzero(~(near[i] > reach))
                    own = own[own != homes[i]]
                else:
                    own = homes[i : i + 1]
                at += [i] * len(own)
                to += number[own].tolist()
            sent = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(to, pa.int32())], [*batch.schema.names, "tree"])

    asking = "id long, v array<double>, query long, floor long, again boolean, tree int"
    queries = rows.where("q").select("id", "v").distinct().withColumn("query", F.xxhash64("v"))
    home = queries.withColumns({"floor": F.lit(None).cast("long"), "again": F.lit(False)}).mapInArrow(send, asking)
    first = common.written(_met(pages, common.written(home, "mtree-home"), length, width, top, wide), "mtree-first")
    if len(spread) > 1:
        floors = first.groupBy(F.col("query_id").alias("id"), "query").agg(F.when(F.count("*") >= top, F.min("score")).alias("floor"))
        further = queries.join(floors, ["id", "query"], "left").select("id", "v", "query", "floor", F.lit(True).alias("again")).mapInArrow(send, asking)
        first = first.union(_met(pages, common.written(further, "mtree-further"), length, width, top, wide))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_mtree_top_k(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, F.col("vec_id") % QUERY_EVERY == 0)


OP4_SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= {TOP}
"""
