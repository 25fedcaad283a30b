"""Base spans against Python's re on awkward texts, the added spans, and redaction."""

import hashlib
import random
import re

import pytest

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def awkward():
    rng = random.Random(3)
    bits = ["a@b.c", "_d@e.f", "@", ".", "..", "1.2.3.4", "999.1.2.3", "256", "0255.1.1.001", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111111", "+1 (269) 555-3296",
            "+", "+49 30 1234567890", " ", "é", "日本", "😀", "x", "-", "%", "4524132264652876", "\n", ",", "12", "a.b+c%d@host-1.example.com.", "((", "+1-", "@a.b@c.d"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]


def test_base_spans_match_plain_patterns(spark):
    texts = ["", *awkward()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["id"]: r["b"] for r in pii.find(docs).select("id", pii.shown(pii.F.col("base")).alias("b")).collect()}
    wrong = [(t, got[i], slow_base(t)) for i, t in enumerate(texts) if got[i] != slow_base(t)]
    assert not wrong, wrong[:3]


def test_long_runs_stay_linear(spark):
    texts = ["a" * 300_000 + "@", "1" * 300_000, "1 " * 100_000, "a@" + "b." * 100_000, "+1" + "(" * 200_000, "a.b-" * 40_000, "1.2." * 8_000, ("x@y.zz " * 3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["b"] for r in pii.find(docs).select("id", pii.shown(pii.F.col("base")).alias("b")).collect()}
    assert got[0] == "" and got[1] == "" and got[3] == slow_base(texts[3]) and got[7] == slow_base(texts[7]) and got[6] == slow_base(texts[6])


def test_added_spans_and_redaction(spark):
    rows = [(i, f"she was the of +1 (269) 555-{3000 + i} 4524132264652876 in there") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "clean words and 12 numbers, 3.5 of them at best dot"), (None, "mail a@b.org"), (None, "mail a@b.org"), (103, "write to joe.doe [at] mail [dot] com now")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = [(r["id"], r["s"]) for r in pii.find(docs).select("id", pii.shown(pii.F.col("spans")).alias("s")).collect()]
    of = dict(got)
    assert of[0] == "phone:15:32,card:33:49"
    assert of[100] == of[101] == of[102] == ""
    assert of[103] == "email:9:36"
    assert [s for i, s in got if i is None] == ["email:5:12"] * 2
    clean = {(r["doc_id"], r["text"], r["base"]) for r in pii.redact(docs).collect()}
    assert (0, "she was the of [PHONE] [CARD] in there", "x") in clean and (100, None, "x") in clean and (None, "mail [EMAIL]", "x") in clean
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_over_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in pii.op5_pii(spark, d).collect():
        base = slow_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert sum(r[f"n_{k}"] for k in PATTERNS) == len(list(filter(None, base.split(","))))


@pytest.mark.parametrize("mail", ["jane [at] example.com", "jane(at)example.com", "jane at example.com", "jane at example dot com"])
def test_proposals_need_nothing_elsewhere_in_the_text(spark, mail):
    docs = spark.createDataFrame([(1, f"write {mail} now"), (2, f"write {mail} now, a @ b")], "doc_id long, text string")
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["proposals"]] for r in pii.searched(docs, "text", ("doc_id",)).collect()}
    assert found[1] == found[2] and len(found[1]) == 1
