"""Language-model scores by a weighted backoff automaton of order three.

Training counts every word, pair and triple of the training texts, each text between a start and an end. The
automaton's states are the start, each word, and each pair of neighbours of the training texts, and a root. A state
has an arc for each token that follows it there, weighted by its smoothed probability; a failure arc leads from a
pair to its second word, and from a word or the start to the root, which has an arc for every token. With c a count,
h a state, h' where its failure arc leads, and K the strength of its order (Dirichlet smoothing):

    root     p(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    arc      p(w|h) = (c(hw) + K p(w|h')) / (c(h) + K)
    failure           K / (c(h) + K)

so that every state's probabilities add up to one. Reading a token takes the state's arc, or failure arcs until a
state has one; the state carried on is the longest of the last two tokens that the automaton has.

No model fits one machine, and none is held. Texts are written in blocks. A block asks for the counts of the distinct
n-grams that it has, by 64-bit hashes, and says how often its own training texts have them; hash ranges add these up
over all blocks and answer each. With the answers a block has every state and arc that its texts can meet, and its
texts are traversed. An n-gram goes to its range once a block, however often it occurs, so no word, pair or passage is
ever dense. Nothing is cut off or left out: words seen once are states, triples seen once are arcs.

Defined results: a null or blank text is the end alone; a null id hashes as empty text; rows with equal ids are
scored one by one; without training texts every token has probability one. Extra columns are ignored. Different
n-grams whose hashes are equal count as one: of 10^8 that happens with a chance of 3 in 10,000.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

ORDER = 3
#: Strengths of the pairs' and triples' smoothing.
STRENGTH = (200.0, 10.0)
#: Bytes of text in a block, and for each range of hashes: memory of one task, with no bearing on results.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
PART_BYTES, RANGES_EACH = 1 << 20, 4

_DICE = np.random.default_rng(9)
_PLACE = _DICE.integers(1, 2**63, 64 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
START, END, *_ORDERS = _DICE.integers(1, 2**63, 2 + ORDER + 1, dtype=np.uint64)
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(before: np.ndarray, after: np.ndarray, order: int) -> np.ndarray:
    """The hash of an n-gram from that of its first tokens and that of its last."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + after + _ORDERS[order])


def _words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each begins."""
    data = np.frombuffer(raw, np.uint8)
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = np.flatnonzero(first)
    if not len(heads):
        return np.zeros(0, np.uint64), heads
    place = np.arange(heads[0], len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
    data, solid = data[heads[0] :], solid[heads[0] :]
    value = _PLACE[((place & 63) << 8) + data]
    if int(place.max()) > 63:
        value *= (place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    value[~solid] = 0
    return mixed(np.add.reduceat(value, heads - heads[0])), heads


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, in order; and the number of words of each text."""
    raw = b"\n".join(texts).lower()
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    found, at = [], 0
    counts = np.zeros(len(texts), np.int64)
    while at < len(raw):  # in parts that end at a blank, for bounded memory
        end = at + PART_BYTES
        cut = _BLANK.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        hashes, heads = _words_of(raw[at:end])
        found.append(hashes)
        counts += np.bincount(np.searchsorted(starts, heads + at, "right") - 1, minlength=len(texts) + 1)[: len(texts)]
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *found]), counts


@dataclass
class Grams:
    """The n-grams that end at each token of several texts; ends are tokens."""

    counts: np.ndarray  # tokens of each text, the end included
    keys: list[np.ndarray]  # by order, of each token; 0 where the text has none
    first: np.ndarray  # whether a token is its text's first


def grams_of(texts: list[bytes], orders: tuple[int, ...] = (1, 2, 3)) -> Grams:
    words, n = word_hashes(texts)
    size = n + 1
    ends = np.cumsum(size) - 1
    token = np.full(int(size.sum()), END, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word] = words
    first = np.zeros(len(token), bool)
    first[ends + 1 - size] = True
    before = np.concatenate([token[:1], token[:-1]])
    before[first] = START
    pair = joined(before, token, 2)
    keys = [token, pair, np.zeros(0, np.uint64)]
    if 3 in orders:
        keys[2] = np.zeros(len(token), np.uint64)
        later = np.flatnonzero(~first)
        keys[2][later] = joined(pair[later - 1], token[later], 3)
    return Grams(size, keys, first)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel().astype(np.uint64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    one = F.col(id_col).cast("long")
    return common.bounded(docs).select(one.alias("id"), (common.id_crc(one, 5) == 1).alias("held_out"), F.col(text_col).alias("text"))


BLOCKS = "block long, bytes long, tokens long, texts long, ids array<long>, held array<boolean>, text array<binary>"


def blocks_of(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts in blocks of a bounded size (a longer text alone), written, so that all later steps see the same ones.

    tokens and texts count those of the training texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            learned = [x for x, h in zip(texts, held, strict=True) if not h]
            row = {"block": block, "bytes": size, "tokens": sum(len(x.split()) + 1 for x in learned), "texts": len(learned), "ids": ids, "held": held, "text": texts}
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for i, h, x in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), common.texts_of(batch, "text"), strict=True):
                if texts and size + len(x) > block_bytes:
                    yield flush()
                    block, ids, held, texts, size = block + 1, [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(x)
                size += len(x)
        if texts:
            yield flush()

    return common.written(rows.mapInArrow(work, BLOCKS), "lm-blocks", **common.LONG_ROWS)


def _parts(blocks: DataFrame, ranges: int) -> int:
    """Partitions that hold a few ranges, or a few blocks, each."""
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranges // RANGES_EACH))


def answered(blocks: DataFrame, orders: tuple[int, ...], ranges: int) -> DataFrame:
    """block, order, span, n, counts: how often the training texts have the block's distinct n-grams, in order of hash.

    block -1 has, for words, how many of the range the training texts have.
    """
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, texts in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = grams_of(texts, orders)
                learned = np.repeat(~np.array(held, bool), found.counts)
                out = []
                for order in orders:
                    use = ~found.first if order == 3 else slice(None)
                    key, at = np.unique(found.keys[order - 1][use], return_inverse=True)
                    n = np.bincount(at[learned[use]], minlength=len(key))
                    edges = np.flatnonzero(np.diff((key >> shift).astype(np.int64), prepend=-1)) if shift is not None else np.zeros(min(1, len(key)), np.int64)
                    for a, b in zip(edges, [*edges[1:], len(key)][: len(edges)], strict=True):
                        out.append((block, order, int(key[a] >> shift) if shift is not None else 0, int(b - a), _narrow(np.diff(key[a:b], prepend=key[a])), int(key[a].view(np.int64)), _narrow(n[a:b])))
                if not out:  # texts without a pair of words have no triples
                    continue
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "order", "span", "n", "steps", "least", "counts"])

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        order, n = key[0].as_py(), rows.column("n").to_pylist()
        steps, least, counts = (rows.column(c).to_pylist() for c in ("steps", "least", "counts"))
        keys = np.concatenate([np.cumsum(_wide(s, k)) + np.int64(x).view(np.uint64) for s, x, k in zip(steps, least, n, strict=True)])
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, np.concatenate([_wide(c, k) for c, k in zip(counts, n, strict=True)]).astype(np.float64), len(distinct)).astype(np.int64)
        edges = np.cumsum([0, *n])
        back = [_narrow(total[at[a:b]]) for a, b in zip(edges, edges[1:])]
        blocks, spans = rows.column("block").to_pylist(), rows.column("span").to_pylist()
        if order == 1:
            blocks, spans, n, back = [*blocks, -1], [*spans, spans[0]], [*n, int((total > 0).sum())], [*back, b""]
        return pa.table({"block": pa.array(blocks, pa.int64()), "order": pa.array([order] * len(n), pa.int32()), "span": pa.array(spans, pa.int64()), "n": pa.array(n, pa.int64()), "counts": pa.array(back, pa.binary())})

    asked = blocks.select("block", "held", "text").mapInArrow(ask, "block long, order int, span long, n long, steps binary, least long, counts binary")
    asked = asked.repartition(_parts(blocks, ranges), "order", "span")
    return common.written(asked.groupBy("order", "span").applyInArrow(answer, "block long, order int, span long, n long, counts binary"), "lm-answers")


@dataclass
class Automaton:
    """The part of the automaton that some texts can meet: by token, what the n-grams that end there count.

    A state's number is 0 for the root, 1 for the state of the last token, 2 for that of the last two.
    """

    counts: list[np.ndarray]  # by order, of the n-gram that ends at each token
    first: np.ndarray
    texts: float  # training texts
    unit: float  # N + 0.5 (V + 1)
    strength: tuple[float, float] = STRENGTH

    def __post_init__(self) -> None:
        c1, c2, c3 = (c.astype(np.float64) for c in self.counts)
        at = [np.where(self.first, self.texts, np.concatenate([c1[:1], c1[:-1]])), np.concatenate([c2[:1], c2[:-1]])]  # of the states before
        k2, k3 = self.strength
        root = (c1 + 0.5) / self.unit
        two = (c2 + k2 * root) / (at[0] + k2)
        three = (c3 + k3 * two) / (at[1] + k3)
        with np.errstate(divide="ignore"):
            #: by state, then token: the arc's weight, nan where there is none; and the failure arc's
            self.arcs = [np.log10(root), np.where(c2 > 0, np.log10(two), np.nan), np.where((c3 > 0) & ~self.first, np.log10(three), np.nan)]
            self.failure = [np.full(len(c1), np.nan), np.log10(k2 / (at[0] + k2)), np.log10(k3 / (at[1] + k3))]
        #: the state that reading each token leads to
        self.goto = np.where((c2 > 0), 2, np.where(c1 > 0, 1, 0))
        self.begin = 1 if self.texts else 0

    def traverse(self) -> np.ndarray:
        """The weight of reading each token, left to right, with the state carried on from the token before.

        Where a token's arc leads depends on the last two tokens alone, so all steps are taken at once: first each from
        the state that the step before leads to, then those that found no arc from where the failure arc leads.
        """
        state = np.concatenate([self.goto[:1], self.goto[:-1]])
        state[self.first] = self.begin
        weight, left = np.zeros(len(state)), np.arange(len(state))
        for here in (2, 1, 0):
            at = left[state[left] == here]
            arc = self.arcs[here][at]
            found = ~np.isnan(arc)
            weight[at[found]] += arc[found]
            missed = at[~found]
            weight[missed] += self.failure[here][missed]
            state[missed] = here - 1
            state[at[found]] = -1
        return weight


@dataclass
class Trained:
    blocks: DataFrame
    answers: DataFrame
    total: int  # N
    distinct: int  # V
    texts: int
    parts: int  # to deal the blocks to


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> Trained:
    blocks = blocks_of(_rows(docs, id_col, text_col), block_bytes)
    facts = blocks.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    ranges = max(1, -(-(facts["bytes"] or 0) // range_bytes))
    answers = [answered(blocks, orders, ranges) for orders in ((1, 2), (3,))]  # one after the other: half the disk
    distinct = answers[0].where("block = -1").agg(F.sum("n")).first()[0] or 0
    return Trained(blocks, answers[0].union(answers[1]).where("block >= 0"), facts["tokens"] or 0, distinct, facts["texts"] or 0, _parts(blocks, ranges))


def score(model: Trained, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    total, texts, unit = model.total, model.texts, model.total + 0.5 * (model.distinct + 1)

    def work(block: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        for ids, held, raw in zip(block.column("ids").to_pylist(), block.column("held").to_pylist(), block.column("text").to_pylist(), strict=True):
            found = grams_of(raw)
            spans: dict[int, list] = {1: [], 2: [], 3: []}
            for row in sorted(zip(*(answers.column(c).to_pylist() for c in ("order", "span", "n", "counts")), strict=True)):
                spans[row[0]].append(_wide(row[3], row[2]))
            counts = []
            for order in (1, 2, 3):
                use = ~found.first if order == 3 else slice(None)
                known = np.concatenate([np.zeros(0, np.uint64), *spans[order]]).astype(np.int64)
                key, at = np.unique(found.keys[order - 1][use], return_inverse=True)
                if len(key) != len(known):
                    raise ValueError(f"{len(known)} answers for {len(key)} n-grams")
                own = np.zeros(len(found.first), np.int64)
                own[use] = known[at]
                counts.append(own)
            made = Automaton(counts, found.first, float(texts), unit, strength)
            heads = np.flatnonzero(found.first)
            parts = (found.counts, np.add.reduceat(counts[0] > 0, heads, dtype=np.int64), np.full(len(heads), total), np.add.reduceat(made.arcs[0], heads), np.add.reduceat(made.traverse(), heads))
            for column, values in zip(columns, (ids, held, *(p.tolist() for p in parts)), strict=True):
                column += values
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table({name: pa.array(x, t) for name, x, t in zip(names, columns, kinds, strict=True)})

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    blocks, answers = (x.repartition(model.parts, "block") for x in (model.blocks.select("block", "ids", "held", "text"), model.answers))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: tuple[float, float] = STRENGTH, **how) -> DataFrame:
    return score(train(docs, id_col, text_col, **how), strength)


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
