"""Personal data by weak supervision, in DataFrame functions alone.

Base spans come from fixed patterns with their checks and always stay. Looser patterns propose further spans
(obfuscated addresses, numbers that a neighbour ran into); on each, labelers vote for, against, or not: the shape,
a gazetteer (top-level domains, issuer and country prefixes, reserved networks), the words before it, and what it
touches. Votes over the whole corpus are counted by pattern, a table bounded by the number of patterns. On it,
expectation-maximisation estimates each labeler's reliability by kind, and its posteriors train a logistic span
classifier over votes and shape, whose weights become a column expression. Spans it takes with SURE or more, and
that overlap no base span and no earlier one, are added.

Patterns start only where a match can begin and never backtrack over a run, so long runs cost linear time; text
without '@', or without digits, is searched for neither. Defined results: a null text is empty; rows with equal or
null ids are searched one by one; offsets count code points. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
BEFORE = 24  # characters of context
PART = 256  # items of an array that grow together

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The fixed patterns. A match may begin at the end of the last one or where a run begins.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
OCTETS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

SPANS = "array<struct<start:int,end:int,m:string>>"
TAKEN = "array<struct<start:int,kind:int,end:int>>"
VOTES = ("shape", "gazetteer", "context", "edges")


def once(value: Column, make) -> Column:
    """make(value), with the value worked out once however often make names it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def before(items: Column, move) -> Column:
    """Where a position that starts at 0, and that each item moves on, stands before each item: an array of int.

    An array grows by copying, so many items are gone through in parts of PART: first the position before each part.
    """
    start = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    merge = lambda a, x: F.struct(move(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    plain = lambda part, at: F.aggregate(part, start(at), merge, lambda a: a["out"])
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda k: F.slice(x, k * PART + 1, F.lit(PART)))
    over = lambda at, part: F.aggregate(part, at, move)
    step = lambda a, part: F.struct(over(a["at"], part).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    firsts = lambda parts: F.aggregate(parts, start(F.lit(0)), step, lambda a: a["out"])
    many = lambda x: once(cut(x), lambda parts: F.flatten(F.zip_with(parts, firsts(parts), plain)))
    return once(items, lambda x: F.when(F.size(x) <= PART, plain(x, F.lit(0))).otherwise(many(x)))


def matches(text: Column, pattern: str) -> Column:
    """start, end (exclusive) and text of each match, left to right: gaps and matches are measured in turn."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    past = lambda at, x: at + x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))

    def span(x: Column, at: Column) -> Column:
        first = at + x["g"]
        return F.struct(first.alias("start"), (first + F.length(x["m"])).alias("end"), x["m"].alias("m"))

    return F.filter(once(pairs, lambda p: F.zip_with(p, before(p, past), span)), lambda s: s["m"].isNotNull())


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m, 19 at most, pass the check sum."""
    back = F.reverse(digits(m))

    def step(a: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), step) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return m.rlike(OCTETS) if kind == "ip" else F.lit(True)


#: Fixed gazetteers.
DOMAINS = "com org net edu gov mil int info biz io ai app dev co uk us de fr es it nl be ch at eu pl se no dk fi pt ie ca au nz jp cn in br mx ar cl ru"
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421"
CUES = {
    "email": (r"(?:e-?mail|mail|contact|write|correo|courriel|address|adresse)", r"(?:example|noreply|user)\s*$"),
    "ip": (r"(?:\bip\b|host|server|addr|from|client|login)", r"(?:version|release|\bv|section|chapter|build)\s*$"),
    "card": (r"(?:card|visa|credit|debit|karte|tarjeta|carte|payment)", r"(?:isbn|order|serial|tracking|invoice|#)\s*$"),
    "phone": (r"(?:phone|tel|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono)", r"(?:isbn|order|serial|part|invoice|#)\s*$"),
}


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def votes(kind: str, text: Column, s: Column) -> Column:
    """What each labeler says of a proposed span, and its length class."""
    m, n = s["m"], F.length(digits(s["m"]))
    before = F.lower(F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))))
    touch = F.concat(F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(" "), F.substring(text, s["end"] + 1, F.lit(1)))
    if kind == "email":
        shape = _vote(m.rlike(rf"^{_LOCAL}+(?:@|\x20?[(\[]at[)\]]\x20?){_HOST}+"), ~m.rlike(r"[(\[@]"))
        listed = _vote(m.rlike(rf"(?i)[^A-Za-z](?:{DOMAINS.replace(' ', '|')})$"), m.rlike(r"[0-9]$"))
    elif kind == "ip":
        shape = _vote(m.rlike(OCTETS) | m.contains(":"), ~m.contains(":"))
        listed = _vote(m.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.") & ~m.rlike(r"^127\."), m.rlike(r"^(?:0|127|2[3-5][0-9])\."))
    elif kind == "card":
        shape = _vote(F.when(n.between(13, 19), luhn(m)).otherwise(F.lit(False)), F.lit(True))
        listed = _vote(m.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))"), m.rlike(r"^[01789]"))
    else:
        shape = _vote(n.between(10, 15) & m.rlike(r"^(?:\+|\()"), n < 10)
        listed = _vote(m.rlike(rf"^\+(?:{COUNTRIES.replace(' ', '|')})[^0-9]"), m.rlike(r"^\(?[01]"))
    for_, against = CUES[kind]
    context = _vote(before.rlike(for_), before.rlike(against))
    edges = _vote(touch.rlike(r"^[\s,;:(\[<\"'][\s,;:.)\]>\"']?$"), touch.rlike(r"^[\p{L}\p{N}]|[\p{L}\p{N}]$"))
    size = F.least(F.floor((s["end"] - s["start"]) / 4), F.lit(9)).cast("int")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), shape.alias("shape"), listed.alias("gazetteer"), context.alias("context"), edges.alias("edges"), size.alias("size")
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def searched(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """keep and base (the base spans in order), proposals (start, kind, end and votes of spans that overlap none)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    none = F.array().cast(SPANS)
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    rows = rows.withColumns({"_at": F.coalesce(F.instr("_text", "@") > 0, F.lit(False)), "_digit": text.rlike("[0-9]")})
    rows = rows.withColumns({"_plus": F.col("_digit") & (F.instr(text, "+") > 0), "_mail": F.col("_at") | text.rlike(_AT)})
    when = {"email": F.col("_at"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": F.col("_plus")}
    rows = rows.withColumns({f"_{k}": F.when(when[k], matches(text, BASE[k])).otherwise(none) for k in KINDS})
    span = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    ok = lambda k: lambda s: passes(k, s["m"])
    rows = rows.withColumns({f"_{k}": F.transform(F.filter(f"_{k}", ok(k)), span(i)) for i, k in enumerate(KINDS)})
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    loose = {"email": F.col("_mail"), "ip": F.col("_digit") | text.contains(":"), "card": F.col("_digit"), "phone": F.col("_digit")}
    rows = rows.withColumns({f"_{k}": F.when(loose[k], matches(text, LOOSE[k])).otherwise(none) for k in KINDS})
    # most are base spans, and known as such by a set of places; only others are held against every base span
    place = lambda s: s["start"].cast("long") * (1 << 32) + s["end"]
    rows = rows.withColumn("_taken", F.transform("base", place))
    rows = rows.withColumns({f"_new_{k}": F.array_except(F.transform(f"_{k}", place), "_taken") for k in KINDS})
    new = lambda k: lambda s: F.array_contains(f"_new_{k}", place(s))
    rows = rows.withColumns({f"_{k}": F.when(F.size(f"_new_{k}") > 0, F.filter(f"_{k}", new(k))).otherwise(none) for k in KINDS})
    free = lambda s: ~F.exists(F.col("base"), lambda b: overlaps(s, b))
    rows = rows.withColumns({f"_{k}": F.filter(f"_{k}", free) for k in KINDS})
    said = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), votes(k, text, s).alias("v"))
    rows = rows.withColumn("proposals", F.concat(*[F.transform(f"_{k}", said(k)) for k in KINDS]))
    return rows.select(*keep, "base", "proposals")


class Model:
    """The span classifier: log-odds by kind, vote and length class. terms: of (kind, feature, value)."""

    def __init__(self, bias: dict[int, float], terms: dict[tuple[int, str, int], float]) -> None:
        self.bias, self.terms = bias, terms

    def odds(self, v: Column) -> Column:
        total = F.lit(0.0)
        for k in sorted(self.bias):
            own = F.lit(self.bias[k])
            for feature in (*VOTES, "size"):
                values = [(x, w) for (kind, f, x), w in sorted(self.terms.items()) if kind == k and f == feature]
                part = F.lit(0.0)
                for x, w in values:
                    part = F.when(v[feature] == x, F.lit(w)).otherwise(part)
                own = own + part
            total = F.when(v["kind"] == k, own).otherwise(total)
        return total


def fit(counted: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> Model:
    """counted: (kind, the four votes, length class) and how often. Expectation-maximisation, then the classifier."""
    bias, terms = {}, {}
    for k in sorted({key[0] for key, _ in counted}):
        own = [(key, n) for key, n in counted if key[0] == k]
        votes_, n = np.array([key[1:5] for key, _ in own]), np.array([c for _, c in own], float)
        # p[y, labeler, vote + 1]: votes are right twice as often as wrong at first, with ten imagined spans behind it
        start = np.array([[0.5, 0.25, 0.25], [0.25, 0.25, 0.5]])[:, None, :].repeat(4, axis=1)
        p, prior = start.copy(), 0.5
        for _ in range(rounds):
            logs = np.array([[sum(math.log(p[y, j, v + 1]) for j, v in enumerate(row)) for row in votes_] for y in (0, 1)])
            odds = logs[1] - logs[0] + math.log(prior / (1 - prior))
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            for y, share in ((0, 1 - post), (1, post)):
                for j in range(4):
                    seen = np.array([(n * share)[votes_[:, j] == v].sum() for v in (-1, 0, 1)]) + 10 * start[y, j]
                    p[y, j] = seen / seen.sum()
            prior = (float((n * post).sum()) + 5) / (n.sum() + 10)
        names = [(f, x) for f, i in (*((f, i) for i, f in enumerate(VOTES, 1)), ("size", 5)) for x in sorted({key[i] for key, _ in own})]
        where = {"size": 5} | {f: i for i, f in enumerate(VOTES, 1)}
        x = np.array([[1.0, *(float(key[where[f]] == v) for f, v in names)] for key, _ in own])
        first = np.array([0.0, *(v * math.log(2) if f != "size" else 0.0 for f, v in names)])  # as at the start above
        w = first.copy()
        for _ in range(40):  # Newton's method on soft labels
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)) * 0.5
            w = w + np.clip(np.linalg.solve(h, x.T @ (n * (post - q)) - 0.5 * (w - first)), -2, 2)
        bias[k] = float(w[0])
        terms |= {(k, f, v): float(c) for (f, v), c in zip(names, w[1:], strict=True)}
    return Model(bias, terms)


def learn(found: DataFrame) -> Model:
    keys = ("kind", *VOTES, "size")
    counted = found.select(F.explode("proposals").alias("p")).groupBy(*[F.col(f"p.v.{k}").alias(k) for k in keys]).count().collect()
    return fit(sorted((tuple(r[k] for k in keys), r["count"]) for r in counted))


def all_spans(model: Model) -> Column:
    """base and the proposals taken, in order, over the columns of searched()."""
    sure = math.log(SURE / (1 - SURE))
    taken = F.filter("proposals", lambda s: model.odds(s["v"]) >= sure)
    as_span = lambda s: F.struct(s["start"].alias("start"), s["v"]["kind"].alias("kind"), s["end"].alias("end"))
    added = F.aggregate(
        taken, F.array().cast(TAKEN), lambda a, s: F.when(F.exists(a, lambda b: overlaps(s, b)), a).otherwise(F.concat(a, F.array(as_span(s))))
    )
    return F.array_sort(F.concat("base", added))


def shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(name[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, spans: arrays of (start, kind, end)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = common.written(searched(rows, "text", ("id",)), "pii-proposals")
    return found.select("id", "base", all_spans(learn(found)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text, base or added, replaced by its kind in brackets."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col(text_col).alias("_whole"))  # names of ours can't clash
    rows = common.written(searched(rows, "_whole", ("_row",)), "pii-searched")
    rows = rows.withColumn("_whole", F.col("_row")[text_col]).withColumn("_spans", all_spans(learn(rows)))
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("_whole")
    ends = before(F.col("_spans"), lambda at, s: F.greatest(at, s["end"]))
    apart = F.filter(F.zip_with("_spans", ends, lambda s, at: F.struct(s.alias("s"), at.alias("at"))), lambda x: x["s"]["start"] >= x["at"])
    pieces = F.transform(apart, lambda x: F.concat(F.substring(text, x["at"] + 1, x["s"]["start"] - x["at"]), mark[x["s"]["kind"]]))
    rest = F.substring(text, F.array_max(F.transform("_spans", lambda s: s["end"])) + 1, F.length(text))
    whole = F.concat(F.array_join(pieces, ""), rest)
    clean = F.when(F.size("_spans") > 0, whole).otherwise(text)
    return rows.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
