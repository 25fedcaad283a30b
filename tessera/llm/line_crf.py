"""Quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its features are counts of byte classes, words, and repeats, with those of
the lines before and after it; a chain of two states with learned transitions links neighbours. Forward-backward
gives each line's probability of being good; weighted by the lines' lengths they make a document's share of good
text, which a logistic curve turns into the probability of label 1.

Training takes a bounded sample of labelled documents, SAMPLE_EACH of either label, by the hash of their ids.
Lines start with their document's label; then lines of bad documents that look good are called good (the worst
line of each stays bad), and the field is fitted again. Only the text is an input.

Defined results: a text without words (null, empty, blank) has no chain and gets the training share of label 1
among such texts, smoothed; with no usable labels every score is 0.5; a label given twice counts as its smaller
one; of labelled rows with equal ids one teaches; rows with equal or null ids are scored one by one (a null id hashes as empty text). No text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import common

SAMPLE_EACH = 3000
ROUNDS, STEPS, RATE, RIDGE = 2, 120, 0.08, 1e-4
KEEP_FROM = 0.3

CLASSES = ("other", "upper", "lower", "digit", "space", "symbol", "exclaim", "stop", "high", "pipe")
_CLASS = np.zeros(256, np.uint8)
for _i, _bytes in enumerate((b"", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\r\x0b\x0c", b"#*$%&<>", b"!", b".,;:?", bytes(range(128, 256)), b"|")):
    _CLASS[list(_bytes)] = _i
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
LAGS = (1, 2, 3, 4)
OWN = len(CLASSES) - 1 + 4 + len(LAGS) + 2
FEATURES = 3 * OWN + 1


@dataclass
class Lines:
    """Lines with a word, in order, of several texts."""

    features: np.ndarray  # lines x OWN
    lengths: np.ndarray  # bytes of each line
    counts: np.ndarray  # lines of each text


def lines_of(texts: list[bytes]) -> Lines:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    line_of = np.repeat(np.arange(len(ends), dtype=np.int64), size + 1)
    kinds = _CLASS[raw]
    kinds[ends] = 4
    k = len(CLASSES)
    tally = np.bincount(line_of * k + kinds, minlength=len(ends) * k).reshape(-1, k).astype(np.float64)
    tally[:, 4] -= 1
    solid = kinds != 4
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = np.flatnonzero(first)
    word_line = line_of[heads]
    words = np.bincount(word_line, minlength=len(ends)).astype(np.float64)
    # a word's hash adds up its bytes by place; white space adds nothing
    if len(heads):
        place = (np.arange(len(raw)) - heads[np.maximum(np.cumsum(first) - 1, 0)]) & 63
        hashes = np.add.reduceat(np.where(solid, _MIX[raw] * _PLACE[place], np.uint64(0)), heads)
    else:
        hashes = np.zeros(0, np.uint64)
    repeats = []
    for lag in LAGS:
        same = np.zeros(len(hashes), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (word_line[lag:] == word_line[:-lag])
        repeats.append(np.bincount(word_line[same], minlength=len(ends)))
    whole = np.bincount(word_line, hashes.astype(np.float64) * (1 + (np.arange(len(hashes)) - np.searchsorted(word_line, word_line)) % 97), minlength=len(ends))
    kept = np.flatnonzero(words > 0)
    text_of = np.searchsorted(text_ends, ends[kept])
    tally, words, size, whole = tally[kept], words[kept], size[kept], whole[kept]
    twin = np.zeros(len(kept), bool)  # the same line elsewhere in the text
    order = np.lexsort((whole, text_of))
    equal = (whole[order][1:] == whole[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    twin[order[1:]] |= equal
    twin[order[:-1]] |= equal
    chars = np.maximum(size - tally[:, 4], 1)
    last = kinds[ends[kept] - 1]
    features = np.column_stack([
        *(np.sqrt(tally[:, c] / chars) for c in range(k) if c != 4), np.log1p(size), np.log1p(words), np.minimum(chars / words, 40) / 10,
        np.sqrt((tally[:, 5] + tally[:, 6] + tally[:, 9]) / words), *(np.sqrt(r[kept] / words) for r in repeats), twin, last == 7,
    ])
    return Lines(features, size.astype(np.float64), np.bincount(text_of, minlength=len(texts)))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, those of the line before and after in the same text (0: none), and 1."""
    x = lines.features
    text = np.repeat(np.arange(len(lines.counts)), lines.counts)
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (text[1:] == text[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.hstack([x, before, after, np.ones((len(x), 1))])


class Packed:
    """Chains of different lengths laid out step by step, the longest first."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        lengths = counts[order]
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), "left") if self.steps else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        line_step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.place = self.at[line_step] + np.repeat(rank, counts) if len(line_step) else np.zeros(0, np.int64)

    def marginals(self, score: np.ndarray, a: np.ndarray, want_pairs: bool = False):
        """Probability of good of each line; with want_pairs also the summed 2 x 2 pair probabilities."""
        good = np.empty(len(score))
        good[self.place] = np.exp(np.clip(score, -30, 30))
        t = np.exp(a)
        f, b1, b0 = np.empty(len(score)), np.full(len(score), 0.5), np.full(len(score), 0.5)
        for s in range(self.steps):
            g = good[self.at[s] : self.at[s + 1]]
            if s:
                p = f[self.at[s - 1] : self.at[s - 1] + self.active[s]]
                g = g * (p * t[1, 1] + (1 - p) * t[0, 1])
                f[self.at[s] : self.at[s + 1]] = g / (g + p * t[1, 0] + (1 - p) * t[0, 0])
            else:
                f[: self.at[1]] = g / (g + 1)
        pairs = np.zeros((2, 2))
        for s in range(self.steps - 1, 0, -1):
            n, here = self.active[s], slice(self.at[s], self.at[s + 1])
            v1, v0 = good[here] * b1[here], b0[here]
            prev = slice(self.at[s - 1], self.at[s - 1] + n)
            u1, u0 = t[1, 1] * v1 + t[1, 0] * v0, t[0, 1] * v1 + t[0, 0] * v0
            b1[prev], b0[prev] = u1 / (u1 + u0), u0 / (u1 + u0)
            if want_pairs:
                p = f[prev]
                z = p * u1 + (1 - p) * u0
                pairs += [[((1 - p) * t[0, 0] * v0 / z).sum(), ((1 - p) * t[0, 1] * v1 / z).sum()], [(p * t[1, 0] * v0 / z).sum(), (p * t[1, 1] * v1 / z).sum()]]
        m = (f * b1 / (f * b1 + (1 - f) * b0))[self.place]
        return (m, pairs) if want_pairs else m


@dataclass
class Model:
    weights: np.ndarray  # on raw features
    transitions: np.ndarray
    curve: tuple[float, float]
    blank: float

    def shares(self, lines: Lines) -> np.ndarray:
        """Of each text the share of its length in good lines; nan without lines."""
        m = Packed(lines.counts).marginals(with_neighbours(lines) @ self.weights, self.transitions)
        return share(m, lines)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        got = self.shares(lines_of(texts)) if texts else np.zeros(0)
        return np.where(np.isnan(got), self.blank, curve(np.nan_to_num(got, nan=0.5), *self.curve))


def share(marginals: np.ndarray, lines: Lines) -> np.ndarray:
    text = np.repeat(np.arange(len(lines.counts)), lines.counts)
    total = np.bincount(text, lines.lengths, len(lines.counts))
    good = np.bincount(text, lines.lengths * marginals, len(lines.counts))
    return np.where(total > 0, good / np.maximum(total, 1), np.nan)


def curve(x: np.ndarray, a: float, b: float) -> np.ndarray:
    x = np.clip(x, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.clip(a + b * np.log(x / (1 - x)), -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    x = np.clip(x, 1e-6, 1 - 1e-6)
    z = np.column_stack([np.ones(len(x)), np.log(x / (1 - x))])
    c = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-2]) * w.sum() * 0.01
        c = c + np.clip(np.linalg.solve(h, z.T @ (w * (y - p)) - np.array([1e-3, 1e-2]) * w.sum() * 0.01 * (c - [0, 1])), -1, 1)
    return float(c[0]), float(c[1])


def train(lines: Lines, labels: np.ndarray, rates: tuple[float, float]) -> Model:
    """labels: 0 or 1 of each text; rates: how often either occurs among all training rows."""
    full = lines.counts > 0
    empty = labels[~full]
    blank = (empty.sum() + 1) / (len(empty) + 2)
    if len(set(labels[full])) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), (0.0, 0.0), 0.5 if not len(labels) else blank)
    x = with_neighbours(lines)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], sd[-1] = 0, 1
    x = (x - mean) / sd
    text = np.repeat(np.arange(len(lines.counts)), lines.counts)
    y = labels[text].astype(np.float64)
    packed, inner = Packed(lines.counts), text[1:] == text[:-1]
    for again in range(ROUNDS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
        w, a = np.zeros(x.shape[1]), np.zeros((2, 2))
        first, second = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        for step in range(1, STEPS + 1):  # Adam
            m, pairs = packed.marginals(x @ w, a, want_pairs=True)
            grad = np.concatenate([x.T @ (y - m), (seen - pairs).ravel()]) / len(x) - RIDGE * np.concatenate([w, a.ravel()])
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w, a = w + move[:-4], a + move[-4:].reshape(2, 2)
        m = packed.marginals(x @ w, a)
        if again < ROUNDS - 1:
            worst = np.full(len(lines.counts), np.inf)
            np.minimum.at(worst, text, m)
            y = np.where((labels[text] == 1) | ((m > 0.5) & (m > worst[text])), 1.0, 0.0)
    weights = w / sd
    weights[-1] -= (w * mean / sd).sum()
    of = np.array([rates[i] / max((labels[full] == i).sum(), 1) for i in (0, 1)]) * full.sum()
    return Model(weights, a, fit_curve(share(m, lines)[full], labels[full].astype(float), of[labels[full]]), blank)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, 256):
        for raw, quality in zip(common.texts_of(batch, "text"), batch.column("quality").to_pylist(), strict=True):
            lines = lines_of([raw])
            yield pa.RecordBatch.from_arrays(
                [pa.array([quality], pa.int32()), pa.array([lines.features.astype(np.float32).tobytes()], pa.binary()), pa.array([lines.lengths.tobytes()], pa.binary())],
                ["quality", "features", "lengths"],
            )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", each: int = SAMPLE_EACH) -> Model:
    """Fits on labelled rows that aren't held out; the sample's lines, as numbers, come to the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(quality_col).cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    known = known.where(common.id_crc(F.col("id"), 5) != 0).groupBy("id").agg(F.min("quality").alias("quality"))
    rates = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = F.md5(F.col("id").cast("string").cast("binary"))
    sample = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(order, "id").limit(each).collect()]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r["id"], r["quality"]) for r in sample], "id long, quality int"))  # 2 * each rows
    rows = common.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "quality").agg(F.min("text").alias("text")).select("quality", "text")  # of rows with one id, the first text
    got = rows.mapInArrow(_measured, "quality int, features binary, lengths binary").collect()
    got.sort(key=lambda r: (r["quality"], len(r["features"]), bytes(r["features"])))
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, OWN) for r in got]
    lines = Lines(
        np.concatenate([np.zeros((0, OWN)), *features]).astype(np.float64),
        np.concatenate([np.zeros(0), *(np.frombuffer(r["lengths"], np.float64) for r in got)]),
        np.array([len(x) for x in features], np.int64),
    )
    total = max(sum(rates.values()), 1)
    return train(lines, np.array([r["quality"] for r in got], np.int64), (rates.get(0, 0) / total, rates.get(1, 0) / total))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with every row's score as a further column."""
    names = [*docs.columns, score_col]
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 256):
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts), pa.float64())], names)
        common.trim()

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return common.bounded(docs).mapInArrow(work, schema)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = KEEP_FROM) -> DataFrame:
    """docs that score least or more."""
    own = common.fresh(docs, "quality_score")
    scored = score(docs, learn(docs, labels, id_col, text_col), text_col, own)
    return scored.where(F.col(own) >= least).select(*docs.columns)


def op6_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (common.id_crc(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
