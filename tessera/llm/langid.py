"""Language by hierarchical discrimination.

Languages fall into families by a fixed table; a code that it doesn't know is a family of its own. Linear support
vector machines over hashed character n-grams first tell families apart, one against one; then, within the winning
family, machines for each pair of its languages vote, and margins break ties. A text's value for a machine is the
mean weight of its n-grams; a logistic curve of the margins gives the score.

Training takes a bounded sample of labelled documents, SAMPLE_EACH of a language by the hash of their ids, and of
each its n-gram counts, by dual coordinate descent. Every n-gram of the whole text counts in a prediction.

Defined results: a null text, or one without a letter, is 'und' with score 0; so is every text if no language is
known; with one language known all others are it with score 1; a null lang teaches nothing; rows with equal or null
ids are judged one by one (a null id hashes as empty text). Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Fixed families of language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ca ro gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS, SIZES = 14, (1, 2, 3)
SAMPLE_EACH = 400
COST, PASSES, SCALE = 10.0, 15, 20.0


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point whether it is a letter, and its lower case where that is one code point."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            letter[cp] = True
            if len(low := c.lower()) == 1:
                lower[cp] = ord(low)
    return letter, lower


def grams(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(hashes, text of each) by n-gram size, and whether a text has a letter. Runs of other characters are a blank."""
    letter, lower = letters()
    points = [np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for x in texts]
    blank = np.array([32], np.uint32)
    flat = np.concatenate([x for p in points for x in (blank, p, blank)])
    text = np.repeat(np.arange(len(points), dtype=np.int32), [len(p) + 2 for p in points])
    real = letter[flat]
    has = np.bincount(text, real, len(points)) > 0
    keep = real.copy()
    keep[1:] |= real[:-1]
    keep[:-1] |= real[1:]  # of a longer run two stay, at either end
    flat, text = np.where(real, lower[flat], np.uint32(32))[keep], text[keep]
    found = []
    for n in SIZES:
        m = max(len(flat) - n + 1, 0)
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ flat[i : m + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        same = text[:m] == text[n - 1 :] if m else np.zeros(0, bool)
        found.append((((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))[same], text[:m][same]))
    return found, has


def profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text, each once, and their shares."""
    found, _ = grams([text])
    h, c = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
    return h.astype(np.int32), (c / max(c.sum(), 1)).astype(np.float32)


def machine(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge); y: -1 or 1. Dual coordinate descent.

    x: of each row its columns and their values; all others are zero."""
    w, b, alpha = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(x))
    cost = COST * np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    diag = np.array([float(v @ v) for _, v in x]) + 1 + 0.5 / cost
    dice = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in dice.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (float(x[i][1] @ w[x[i][0]]) + b) - 1 + alpha[i] * 0.5 / cost[i]) / diag[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[x[i][0]] += np.float32(step * y[i]) * x[i][1]
                b += step * y[i]
    return w, b


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]  # the numbers of each family's languages
    pairs: list[tuple[int, int, int]]  # of each machine its level (-1: families, else a family), and its classes
    tables: np.ndarray  # a machine's weights in each row
    bias: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not n:
            return [], np.zeros(0)
        found, has = grams(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        total = np.zeros((len(self.pairs), n))
        for h, owner in found:
            for j, table in enumerate(self.tables):
                total[j] += np.bincount(owner, table[h], n)
        size = sum(np.bincount(owner, minlength=n) for _, owner in found)
        margins = SCALE * total / np.maximum(size, 1) + self.bias[:, None]
        family, sure = self.winner(margins, -1, len(self.families))
        best = np.zeros(n, np.int64)
        for f, members in enumerate(self.families):
            here = np.flatnonzero(family == f)
            inner, inner_sure = self.winner(margins[:, here], f, len(members))
            best[here] = np.array(members)[inner]
            sure[here] *= inner_sure
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], np.where(has, sure, 0.0)

    def winner(self, margins: np.ndarray, level: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """The class with most votes, then margin, then the first; and the logistic of its smallest margin."""
        votes, sums = np.zeros((2, margins.shape[1], classes))
        least = np.full((margins.shape[1], classes), np.inf)
        for (own, a, b), m in zip(self.pairs, margins, strict=True):
            if own == level:
                for c, side in ((a, m), (b, -m)):
                    votes[:, c] += side > 0
                    sums[:, c] += side
                    least[:, c] = np.minimum(least[:, c], side)
        best = np.argmax(votes + 0.4 * np.tanh(sums), axis=1)
        m = least[np.arange(len(best)), best]
        return best, 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """samples: language, hashes and shares of each text."""
    languages = sorted({lang for lang, _, _ in samples})
    named = [FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang) for lang in languages]
    families = [[i for i, f in enumerate(named) if f == family] for family in sorted(set(named))]
    family_of = {i: f for f, members in enumerate(families) for i in members}
    x = [(h, SCALE * share) for _, h, share in samples]
    y = np.array([languages.index(lang) for lang, _, _ in samples], np.int64)
    z = np.array([family_of[i] for i in y], np.int64)
    pairs, tables, bias = [], [], []
    plan = [(-1, a, b, z, a, b) for a in range(len(families)) for b in range(a + 1, len(families))]
    plan += [(f, i, j, y, m[i], m[j]) for f, m in enumerate(families) for i in range(len(m)) for j in range(i + 1, len(m))]
    for level, a, b, of, first, second in plan:
        rows = np.flatnonzero((of == first) | (of == second))
        w, c = machine([x[i] for i in rows], np.where(of[rows] == first, 1, -1))
        pairs.append((level, a, b))
        tables.append(w)
        bias.append(c)
    return Model(languages, families, pairs, np.array(tables, np.float32).reshape(-1, 1 << BITS), np.array(bias))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = SAMPLE_EACH) -> Model:
    """Fits on rows with a language that aren't held out; the sample's n-gram shares come to the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (common.id_crc(F.col("id"), 5) != 0))
    hashed = rows.select("id", "lang", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    below = F.lit(None).cast("long")
    for lang, n in counts.items():  # about four times as many as are wanted, so that no language meets in one task
        below = F.when(F.col("lang") == lang, F.lit(int(min(1.0, (4 * each + 100) / n) * 2**32))).otherwise(below)
    hashed = hashed.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") <= below)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = hashed.withColumn("k", rank).where(F.col("k") <= each).select("id", "lang").distinct().collect()
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([(r["id"], r["lang"]) for r in chosen], "id long, lang string"))  # `each` rows a language

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 256):
            got = [profile(x) for x in common.texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), pa.array([h.tobytes() for h, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())],
                ["id", "lang", "hashes", "shares"],
            )

    taken = common.bounded(rows).join(sample, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # one text an id
    got = sorted(taken.mapInArrow(measure, "id long, lang string, hashes binary, shares binary").collect(), key=lambda r: (r["lang"], r["id"], bytes(r["hashes"])))
    samples = [(r["lang"], np.frombuffer(r["hashes"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got]
    return fit([s for s in samples if len(s[1])])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 256):
            langs, scores = shared.value.predict(common.texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = common.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select(F.col("id").alias("doc_id"), (common.id_crc(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")
