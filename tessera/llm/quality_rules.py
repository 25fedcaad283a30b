"""Quality rules whose cutoffs are certified on labelled holdouts.

Every rule rejects a document whose statistic exceeds a cutoff. For each stratum and rule the candidate
cutoffs are tested from the most lenient to the strictest on labelled good holdout documents: an exact
binomial test must show, at level ``delta / (strata * rules)`` (Bonferroni over the chains; within a chain the
fixed sequence needs no further correction), that the rule rejects less than ``alpha / rules`` of the stratum's
good documents. Testing stops at the first failure. Among the certified cutoffs, the one that rejects most bad
over good documents on the other labelled fold is taken. So with probability ``1 - delta`` all rules together
reject at most ``alpha`` of the good documents of every stratum at once.

Defined results: a null or empty text has zeros everywhere and fails the base rule; rows with equal or null ids
are judged one by one; a label given twice counts as its smaller quality; strata without enough labels, or an
empty ``labels`` table, get no cutoffs and lose nothing beyond the base rule. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATISTICS = "id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    """Reject where floor(1000 * part / whole) > cutoff; cutoffs run from lenient to strict."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (800, 600, 500, 400, 300, 250, 200, 150, 100, 80, 60, 40, 30, 20, 15, 10)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100)),
    Rule("repeats", "n_repeat_words", "n_words", (480, 450, 400, 350, 300, 250, 200, 150, 100)),
    Rule("word_length", "word_chars", "n_words", (40000, 30000, 20000, 15000, 12000, 10000, 9000, 8500, 8000, 7500)),
)
ALPHA, DELTA = 0.05, 0.05


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def text_statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    points = len(text.decode("utf-8", "replace"))
    word_chars = points - sum(text.count(SPACES[i : i + 1]) for i in range(len(SPACES)))
    symbols = sum(text.count(s.encode()) for s in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), word_chars, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        found = [text_statistics(x) for x in common.texts_of(batch, "text")]
        columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * 6)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("stratum"), *columns],
            ["id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
        )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row of counts for each document; the stratum of a null is 'none'."""
    rows = common.bounded(docs).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("none")).alias("stratum"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(_measure, STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def per_mille(rule: Rule) -> Column:
    return F.floor(1000 * F.col(rule.part) / F.greatest(F.col(rule.whole), F.lit(1))).cast("long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, logs))


def certified(counts: dict[tuple[str, str], dict[tuple[bool, int, int], int]], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """Cutoffs by (stratum, rule). counts: of each, documents by (holdout, quality, number of cutoffs that reject)."""
    chains = len({s for s, _ in counts}) * len(RULES)
    chosen = {}
    for (stratum, name), seen in counts.items():
        rule = next(r for r in RULES if r.name == name)
        of = lambda hold, quality, least: sum(n for (h, q, c), n in seen.items() if (h, q) == (hold, quality) and c >= least)
        good, best = of(True, 1, 0), (0.0, None)
        fit = {q: max(of(False, q, 0), 1) for q in (0, 1)}
        for i, cutoff in enumerate(rule.cutoffs):
            i = len(rule.cutoffs) - i  # a document beyond this cutoff is beyond all the stricter ones
            if not good or binomial_tail(of(True, 1, i), good, alpha / len(RULES)) > delta / chains:
                break
            gain = of(False, 0, i) / fit[0] - of(False, 1, i) / fit[1]
            if gain > best[0] + 1e-12:
                best = (gain, cutoff)
        if best[1] is not None:
            chosen[stratum, name] = best[1]
    return chosen


def label_counts(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> dict:
    """Labelled documents that pass the base rule, counted by stratum, rule, fold, quality and cutoffs exceeded.

    The table has at most strata x rules x cutoffs x 4 rows, whatever the corpus.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(quality_col).cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    hold = F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 1) >= "8"
    steps = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), sum((per_mille(r) > c).cast("int") for c in r.cutoffs).alias("exceeded")) for r in RULES]
    )
    rows = (
        measured.where(~base_failed()).join(known, "id").select("stratum", "quality", hold.alias("hold"), F.explode(steps).alias("s"))
        .groupBy("stratum", "s.rule", "hold", "quality", "s.exceeded").count().collect()
    )
    counts: dict = {}
    for r in rows:
        counts.setdefault((r["stratum"], r["rule"]), {})[r["hold"], r["quality"], r["exceeded"]] = r["count"]
    return counts


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """id, stratum, the counts, base_failed, the certified cutoffs (null: none), kept."""
    measured = common.written(statistics(docs, id_col, text_col, stratum_col), "quality-statistics")
    chosen = certified(label_counts(measured, labels, id_col), alpha, delta)
    cuts = {r.name: F.lit(None).cast("long") for r in RULES}
    for rule in RULES:
        strata = [(s, c) for (s, name), c in chosen.items() if name == rule.name]
        if strata:
            table = F.create_map(*[F.lit(x) for pair in strata for x in pair])
            cuts[rule.name] = F.try_element_at(table, F.col("stratum")).cast("long")
    judged = measured.withColumn("base_failed", base_failed()).withColumns({f"cutoff_{name}": c for name, c in cuts.items()})
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(per_mille(rule) > F.col(f"cutoff_{rule.name}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _values(rule: Rule) -> str:
    return ", ".join(f"('{rule.name}', {i}, {c})" for i, c in enumerate(rule.cutoffs, 1))


def _statistic(rule: Rule) -> str:
    return f"floor(1000.0 * {rule.part} / greatest({rule.whole}, 1))"


OP1_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
wins AS (SELECT rid, unnest(generate_series(1, len(w) - 2)) AS i, w FROM words WHERE len(w) > 2),
grams AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM wins),
repeated AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts),
line_counts AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
stats AS (
  SELECT words.rid, doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN covered ON words.rid = covered.rid LEFT JOIN line_counts ON words.rid = line_counts.rid),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
tested AS (
  SELECT stratum, quality, substr(md5(CAST(j.doc_id AS VARCHAR)), 1, 1) >= '8' AS hold,
    unnest([{", ".join(f"{{'rule': '{r.name}', 'v': {_statistic(r)}}}" for r in RULES)}]) AS s
  FROM judged j JOIN known k ON j.doc_id = k.doc_id WHERE NOT base_failed),
cutoffs(rule, step, cutoff) AS (VALUES {", ".join(_values(r) for r in RULES)}),
strata AS (SELECT count(DISTINCT stratum) AS n FROM tested),
tallies AS (
  SELECT stratum, cutoffs.rule, step, cutoff,
    count(*) FILTER (hold AND quality = 1) AS good, count(*) FILTER (hold AND quality = 1 AND s.v > cutoff) AS lost,
    count(*) FILTER (NOT hold AND quality = 0) AS fit_bad, count(*) FILTER (NOT hold AND quality = 0 AND s.v > cutoff) AS caught,
    count(*) FILTER (NOT hold AND quality = 1) AS fit_good, count(*) FILTER (NOT hold AND quality = 1 AND s.v > cutoff) AS fit_lost
  FROM tested JOIN cutoffs ON s.rule = cutoffs.rule GROUP BY ALL),
proved AS (
  SELECT *, good > 0 AND list_sum(list_transform(generate_series(0, lost), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1)
      + i * ln({ALPHA / len(RULES)!r}::DOUBLE) + (good - i) * ln(1 - {ALPHA / len(RULES)!r}::DOUBLE)))) <= {DELTA!r}::DOUBLE / (n * {len(RULES)}) AS ok
  FROM tallies, strata),
chained AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed FROM proved),
ranked AS (
  SELECT *, caught::DOUBLE / greatest(fit_bad, 1) - fit_lost::DOUBLE / greatest(fit_good, 1) AS gain FROM chained WHERE passed),
chosen AS (SELECT stratum, rule, cutoff FROM ranked WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY round(gain, 12) DESC, step) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed {" ".join(f"AND NOT coalesce({_statistic(r)} > (SELECT cutoff FROM chosen WHERE chosen.stratum = judged.stratum AND rule = '{r.name}'), false)" for r in RULES)} AS kept
FROM judged
"""
