"""Quality rules, archives, M-trees, line chains, tokens, languages, mixing and the pipeline, against plain versions."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, common, langid, line_crf, mixing, mtree, quality_rules, simhash, warc

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def crc(k):
    return zlib.crc32(("" if k is None else str(k)).encode())


def by_sql(sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.execute(sql)


def same(spark_df, sql):
    found = by_sql(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    plain = lambda v: round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key(found.fetchall()) == key(map(tuple, spark_df.select(*names).collect()))


@pytest.mark.parametrize("query,sql", [(quality_rules.op1_quality_rules, quality_rules.OP1_SQL), (warc.op3_warc_index, warc.OP3_SQL), (mtree.op4_mtree_top_k, mtree.OP4_SQL), (mixing.op10_mix, mixing.OP10_SQL)])
def test_query_is_its_sql(spark, query, sql):
    same(query(spark, SF), sql)


# ---- quality rules


def test_statistics_and_edge_rows(spark):
    assert quality_rules.text_statistics("a b c d a b c\n\n # x\n# x\n # x".encode()) == (13, 13, 3, 4, 1, 12)
    assert quality_rules.text_statistics("é é\x1cq".encode()) == (1, 5, 0, 1, 0, 0)
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 2), (1, "w " * 60, "en", 3), (2, " ".join(f"w{i}" for i in range(60)), None, 4)], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (9, 7)], "doc_id long, quality int")
    got = sorted((str(r["id"]), r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(docs, labels).collect())
    assert got == [("1", 0, True, False), ("1", 60, True, False), ("2", 60, False, True), ("None", 0, True, False)]
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_certified_cutoffs_hold_the_risk():
    assert quality_rules.binomial_tail(2, 10, 0.3) == pytest.approx(sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    rule = quality_rules.RULES[0]
    n = len(rule.cutoffs)
    seen = {(h, 1, 0): 2000 for h in (True, False)} | {(h, 0, n - 3): 200 for h in (True, False)} | {(True, 1, 2): 60, (False, 1, 2): 60}
    got = quality_rules.certified({("en", rule.name): seen})["en", rule.name]
    assert got == rule.cutoffs[3]  # the most lenient of those that catch all bad ones
    few = {k: v // 50 for k, v in seen.items()}
    assert not quality_rules.certified({("en", rule.name): few})


def rule_documents():
    """Two strata in which every rule tells good documents from bad ones, and one with too few labels."""
    rng = random.Random(8)
    rows, labels = [], []

    def plain(n):
        return [f"{rng.choice('bcdfgh')}{rng.randrange(10**5)}" for _ in range(n)]

    def bad(kind):
        w = plain(90)
        if kind == 0:
            return " ".join(x + "##$$" * 2 for x in w)
        if kind == 1:
            lines = [" ".join(w[i : i + 3]) for i in range(0, 90, 3)]
            return "\n".join(lines + [" ".join(w[:1])] * 25)
        if kind == 2:
            return " ".join(w + w[:30])
        return " ".join(x * 3 for x in w)

    for lang, n in (("en", 1500), ("de", 1500), ("fr", 40), (None, 40)):
        for i in range(n):
            k, quality = len(rows) + 1, int(i % 5 > 0)
            rows.append((k, " ".join(plain(90)) if quality else bad(i // 5 % 4), lang))
            if i % 10 < 9:
                labels.append((k, quality))
    return rows, labels


def test_rules_certify_and_reject(spark, tmp_path):
    rows, labels = rule_documents()
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(4)
    labelled = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    measured = quality_rules.statistics(docs, "doc_id", "text", "lang")
    chosen = quality_rules.certified(quality_rules.label_counts(measured, labelled))
    assert {s for s, _ in chosen} == {"en", "de"} and {r for _, r in chosen} == {r.name for r in quality_rules.RULES}
    found = quality_rules.op1_quality_rules(spark, str(tmp_path))
    kept = {r.doc_id: r.kept for r in found.collect()}
    quality = {k: int(i) for k, i in labels}
    assert sum(not kept[k] for k, q in quality.items() if q == 0) > 400 and sum(kept[k] for k, q in quality.items() if q == 1) > 0.9 * sum(quality.values())
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(quality_rules.OP1_SQL)
    names = [x[0] for x in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in found.select(*names).collect())


# ---- archives


def test_archive_edges_and_lookup(spark):
    rows = [(1, "https://b.Example.org:443/x?y#z", "<p>é</p>"), (2, "http://b.example.org/x?y", "<p>é</p>"), (3, None, None), (4, "http://a.org/", ""), (None, "no host", "q"), (5, "http://a.org/" + "p" * 3000, "z" * 300_000), (5, "http://a.org/", "<p>é</p>")]
    rows += [(100 + i, f"http://h{i % 7}.net/{i}", f"page {i % 50}") for i in range(1200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string").repartition(3)
    catalogue, folder = warc.archive(spark, pages)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.look_up(pages, catalogue, folder).collect())
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        own = first.get(h or "")
        response = own is None or own == k
        want.append((str(k), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else own))
    assert got == sorted(want)
    index = warc.opened(catalogue, folder)
    assert sorted(r.page_id for r in index.find("http://B.example.org/x?y")) == [1, 2] and [r.page_id for r in index.find("http://h3.net/3")] == [103]
    assert index.find("http://h3.net/4") == [] and sorted(r.page_id for r in index.find("http://a.org/")) == [4, 5]
    index = warc.opened(catalogue, folder)
    index.find("http://h5.net/5")
    assert len(index.read) == 1  # one block of several
    assert [r.page_id for r in warc.look_up(pages.where("page_id = 3"), catalogue, folder).collect()] == [3]
    assert warc.look_up(pages.limit(0), *warc.archive(spark, pages.limit(0))).count() == 0
    assert warc.look_up(pages, *warc.archive(spark, pages.limit(0))).count() == 0
    raw = warc.record(4, "http://a.org/", b"x", 1, False, "2024-01-01T00:00:00Z", "t-1")
    head = zlib.decompress(raw, 31).decode()
    assert "WARC-Date: 2024-01-01T00:00:00Z" in head and warc.parse(raw).page_id == 4 and warc.parse(raw).refers_to == 1


def test_lookups_of_one_hot_url_read_their_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    pages = spark.createDataFrame([(i, "http://hot.org/x" if i % 3 else f"http://h{i}.org/", f"p{i % 90}") for i in range(900)], "page_id long, url string, html string").repartition(4)
    catalogue, folder = warc.archive(spark, pages)
    index = warc.opened(catalogue, folder)
    key = warc.url_key("http://hot.org/x")
    for i in (1, 449, 899):
        index.read.clear()
        assert [r.page_id for r in index.records(index.places((key, i), (key, i)))] == [i] and len(index.read) <= 1
    assert len(index.find("http://hot.org/x")) == 600 and sorted(r.page_id for r in warc.look_up(pages, catalogue, folder).collect()) == list(range(900))
    assert warc.url_key("https://b.Example.org:8080/x y#z") == "org,example,b:8080)/x%20y" and warc.url_key("http://[bad") == "http://[bad"


# ---- exact top-k


def test_top_k_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(400)]  # one vector, often
    rows += [(900, None), (920, [1.0, None]), (940, [float("nan")] * 6), (960, [float("inf")] * 6), (980, [2.0]), (None, [1.0] * 6), (20, [0.25] * 6)]
    table = spark.createDataFrame([(k, v, "q") for k, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in mtree.top_k(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    ok = [(k, np.floor(64 * np.array(v + [0.0] * (6 - len(v))))) for k, v in rows if k is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    for k in (0, 400, 420, 980):
        q = next(v for i, v in ok if i == k)
        assert got[k] == sorted(((int(q @ v), i) for i, v in ok if i != k), key=lambda x: (-x[0], x[1]))[:20]
    assert not {900, 920, 940, 960} & set(got) and len(got[20]) == 40
    assert mtree.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert mtree.top_k(table.where("vec_id = 0"), F.lit(True)).count() == 0


def plain_top(rows, k, width, top=20):
    """(score, id) of the best of a query's vectors, by whole numbers of any size."""
    whole = {i: [math.floor(64 * x) for x in v] + [0] * (width - len(v)) for i, v in rows}
    score = lambda i: min(max(sum(a * b for a, b in zip(whole[k], whole[i], strict=True)), -(2**63)), 2**63 - 1)
    return sorted(((score(i), i) for i in whole if i != k), key=lambda x: (-x[0], x[1]))[:top]


def found_top(table, **how):
    got = {}
    for r in mtree.top_k(table, F.col("vec_id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=2) * 10.0 ** int(rng.integers(0, 12))]) for i in range(120)]
    rows += [(200, [1e10, 1.0]), (201, [1e10, 1.0]), (220, [3e38, -3e38]), (240, [1e200, 1.0]), (221, [2.0**60, 3.0])]
    got = found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for k in (0, 20, 100, 200, 220, 240):
        assert got[k] == plain_top(rows, k, 2)
    huge = [*rows[:60], (300, [1e306, 1e306])]  # squares overflow
    assert found_top(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))[300] == plain_top(huge, 300, 2)


def test_top_k_skips_trees_of_other_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=16) * 0.02]) for i in range(3000)]
    sent = {}
    written = common.written

    def counting(df, name, **options):
        out = written(df, name, **options)
        if name in ("mtree-home", "mtree-further"):
            sent[name] = out.count()
        return out

    monkeypatch.setattr(common, "written", counting)
    got = found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tree_rows=100)
    assert all(got[k] == plain_top(rows, k, 16) for k in range(0, 3000, 300)) and len(got) == 150
    assert sent["mtree-home"] == 150 and sent["mtree-further"] < 150 * 15  # of about 30 trees each


def test_tree_prunes_clusters():
    rng = np.random.default_rng(2)
    v = np.floor(64 * (rng.normal(size=(64, 1, 16)) * 3 + rng.normal(size=(64, 64, 16)) * 0.02)).reshape(-1, 16)
    length = float((v**2).sum(axis=1).max())
    tree = mtree.Tree(np.arange(len(v)), v, length)
    pages = [mtree.Page(r) for r in tree.pages(0).itertuples(index=False)]
    count = [0]
    for i in range(0, len(v), 97):
        want = sorted(((int(s), j) for j, s in enumerate(v @ v[i]) if j != i), key=lambda x: (-x[0], x[1]))[:20]
        assert mtree.search(pages, length, i, v[i], 20, count) == want
    assert count[0] < 0.5 * len(v) * len(range(0, len(v), 97))


# ---- line chains


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 4])
    score, a = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs = line_crf.Packed(counts).marginals(score, a, want_pairs=True)
    want, want_pairs, at = np.zeros(8), np.zeros((2, 2)), 0
    for n in counts:
        weights = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weights[tuple(y)] = math.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(a[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(weights.values())
        for y, w in weights.items():
            for i in range(n):
                want[at + i] += y[i] * w / z
                if i + 1 < n:
                    want_pairs[y[i], y[i + 1]] += w / z
        at += n
    assert got == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"  \n\n", b"One two.\nOne two.\n### x", "é é é!!".encode(), b"q " * 500]
    whole = line_crf.lines_of(texts)
    alone = [line_crf.lines_of([t]) for t in texts]
    assert list(whole.counts) == [0, 0, 3, 1, 1]
    assert np.concatenate([x.features for x in alone]) == pytest.approx(whole.features)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    found = line_crf.op6_line_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in found)
    assert len(found) > 500 and right / len(found) > 0.98
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in found)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "Fine words stand here.\nAnd more.", 1.0), (2, "### $$$ !!!\n" * 40, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["s"] for r in line_crf.score(docs, line_crf.learn(docs, none), "text", "s").collect()] == [0.5] * 4
    assert line_crf.accepted(docs, none).columns == docs.columns
    assert line_crf.score(docs.limit(0), line_crf.learn(docs, none), "text", "s").count() == 0


# ---- tokens


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.vocabulary()
    import tiktoken

    ranks = bpe.read_ranks(path)
    return bpe.Codec(bpe.library_json(ranks), pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_the_other_library(codec):
    own, other = codec
    rng = random.Random(5)
    texts = ["", " ", "a  b\n c", "日本語 😀é", "aaaaaaa" * 30, "<|endoftext|> x", " x  y", "don't  stop\t\t\nNOW "]
    texts += ["".join(rng.choice("ab Éß日😀 \n\t.,'19-=") for _ in range(rng.randrange(80))) for _ in range(1500)]
    for text in texts:
        ids = own.encode(text)
        assert list(ids) == other.encode_ordinary(text) and own.decode(ids) == text and "".join(own.decode_stream(ids)) == text
        starts, ends = own.offsets(text, ids)
        raw = np.cumsum([0, *map(len, map(other.decode_single_token_bytes, ids))])
        sizes = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert list(starts) == [int(np.searchsorted(sizes, b, "right")) - 1 for b in raw[:-1]] and list(ends) == [int(np.searchsorted(sizes, b, "left")) for b in raw[1:]]


def test_token_tables(spark, codec):
    docs = spark.createDataFrame([(None, None, 1), (1, "x y", 2), (1, "x y", 3), (2, "né " * 30000, 4)], "doc_id long, text string, n_tokens int")
    path, pattern = bpe.vocabulary()
    got = sorted((str(r["id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, path, pattern).collect())
    want = []
    for k, t, _ in docs.collect():
        ids = codec[1].encode_ordinary(t or "")
        want.append((str(k), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode(docs, path, pattern)
    assert sorted(str(r["text"]) for r in bpe.decode(encoded, path, pattern).collect()) == sorted(t or "" for _, t, _ in docs.collect())
    assert bpe.round_trip(docs.limit(0), path, pattern).count() == 0


# ---- languages


def test_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    found = langid.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.99 and all(0 <= r.score <= 1 for r in found)


def test_language_edges(spark):
    docs = spark.createDataFrame([(None, None, "en"), (1, "12 !!", "en"), (2, "the words", None), (3, "die Wörter", "de"), (4, "the words and", "en"), (4, "the words and", "en")], "doc_id long, text string, lang string")
    got = sorted((str(r["id"]), r["lang_pred"]) for r in langid.identify(docs, langid.learn(docs)).collect())
    assert got[-1] == ("None", "und") and got[0] == ("1", "und")
    nothing = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), nothing).count() == 0


def plain_prediction(model, text):
    """One text's language and score, n-gram by n-gram and vote by vote."""
    import unicodedata

    chars, out = list(text or ""), []
    is_letter = lambda c: unicodedata.category(c)[0] == "L"
    if not any(map(is_letter, chars)):
        return "und", 0.0
    low = [(c.lower() if len(c.lower()) == 1 else c) if is_letter(c) else " " for c in [" ", *chars, " "]]
    for i, c in enumerate(low):  # of a run of blanks those beside a letter stay
        if c != " " or (i and low[i - 1] != " ") or (i + 1 < len(low) and low[i + 1] != " "):
            out.append(ord(c))
    weights, total = [0.0] * len(model.pairs), 0
    for n in langid.SIZES:
        for i in range(len(out) - n + 1):
            h = n
            for x in out[i : i + n]:
                h = ((h ^ x) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            h = ((h * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - langid.BITS)
            total += 1
            for j, table in enumerate(model.tables):
                weights[j] += float(table[h])
    margins = [langid.SCALE * w / total + float(b) for w, b in zip(weights, model.bias, strict=True)]

    def winner(level, classes):
        votes, sums, least = [0] * classes, [0.0] * classes, [math.inf] * classes
        for (own, a, b), m in zip(model.pairs, margins, strict=True):
            if own == level:
                for c, side in ((a, m), (b, -m)):
                    votes[c] += side > 0
                    sums[c] += side
                    least[c] = min(least[c], side)
        best = max(range(classes), key=lambda c: (votes[c] + 0.4 * math.tanh(sums[c]), -c))
        return best, 1 / (1 + math.exp(-3 * min(max(least[best], -20), 20)))

    family, sure = winner(-1, len(model.families))
    inner, more = winner(family, len(model.families[family]))
    return model.languages[model.families[family][inner]], sure * more


def test_language_is_that_of_a_plain_reading(spark):
    rng = random.Random(6)
    words = {"en": "the of and water house going", "de": "der und Wasser Häuser gehen nicht", "nl": "het van en water huizen gaan", "es": "el agua casas yendo señor", "it": "il acqua case andando città", "ru": "вода дом идти и не"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang, "x") for i, lang in enumerate(rng.choice(list(words)) for _ in range(400))]
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "12 -- 34", "de", "x"), (1003, "DER  Water, İ 12 señor!" * 3, None, "x"), (1004, "water " * 30_000, None, "x"), (None, "agua", "es", "x"), (7, "и вода", "ru", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = langid.learn(docs)
    assert model.languages == sorted(words) and max(map(len, model.families)) >= 2
    got = sorted((str(r["id"]), r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect())
    want = sorted((str(k), *plain_prediction(model, t)) for k, t, _, _ in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-5)
    held = [(g[1], lang) for g, (k, t, lang, _) in zip(sorted(got), sorted(rows, key=lambda r: str(r[0])), strict=True) if k is not None and k < 400 and crc(k) % 5 == 0]
    assert sum(a == b for a, b in held) > 0.9 * len(held) > 30


def test_votes_that_tie_go_to_margins_then_the_first():
    model = langid.Model(["a", "b", "c"], [[0, 1, 2]], [(0, 0, 1), (0, 1, 2), (0, 0, 2)], np.zeros((3, 4), np.float32), np.zeros(3))
    margins = np.array([[1.0, 0.0], [2.0, 0.0], [-0.5, 0.0]])  # a beats b beats c beats a; no votes at all
    best, _ = model.winner(margins, 0, 3)
    assert best.tolist() == [1, 0]


# ---- mixing


def test_targets_fill_up():
    assert mixing.targets([10, 10], [5, 1], 30) == [20.0, 10.0]
    got = mixing.targets([100, 1, 50], [1, 5, 2], 1.5 * 151)
    assert sum(got) == pytest.approx(226.5) and got[1] == 2.0
    assert mixing.targets([0, 0], [5, 2], 0) == [0.0, 0.0] and mixing.targets([], [], 0) == []


def test_points_are_even():
    x = np.sort(mixing.points(0, 10_000))
    assert np.abs(x - (np.arange(10_000) + 0.5) / 10_000).max() < 0.001
    assert mixing.points(2**30 + 7, 3) == pytest.approx([math.fmod(i * mixing.GOLDEN, 1) for i in range(2**30 + 7, 2**30 + 10)], abs=1e-6)


def test_mix_edges(spark):
    rows = [(i, f"w{i} " * (i % 90), ("a", "b", None)[i % 3]) for i in range(300)] + [(7, "x y", "a"), (7, "x y", "a"), (None, "q " * 50, "b"), (8, None, "a"), (9, "", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    found, draws = mixing.mix(docs, block=16)
    got = found.collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sum(r["size"] for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 16
    slots = [r.slot for r in draws.select("slot").distinct().collect()]
    assert len(slots) == sum(mixing.slots_wanted(*x, 16) for x in {(r.source_size, r.target) for r in got})
    again = mixing.mix(docs.repartition(5), block=16)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.drawn(docs, block=16)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    taken = Counter()
    for r in got:
        taken[r["id"]] += r.taken
    assert words == {k: v for k, v in taken.items() if v}
    assert mixing.mix(docs.limit(0))[0].count() == 0 and mixing.drawn(docs.limit(0)).count() == 0


# ---- pipeline


def one_of_each_plainly(rows):
    """Smallest ids of the classes that sets of five-word shingles alike to 4/5 or more link."""

    def shingles(text):
        w = text.lower().split()
        size = min(5, len(w))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sorted((len(sets[i]), len(sets[j])))
            if 5 * a >= 4 * b and 9 * len(sets[i] & sets[j]) >= 4 * (a + b):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {k for i, (k, _) in enumerate(rows) if root[i] == i}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.written(stage(spark, seen[-1], SF), "stage"))
    raw, good, single, clean, mix, tokens = seen
    assert all(df.columns == columns for df in seen[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    model = line_crf.learn(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in raw.collect() if model.scores([r.text.encode()])[0] >= 0.3}
    rows = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())
    assert ids[2] == one_of_each_plainly(rows)
    assert ids[3] == ids[2] and clean.where("text rlike '[0-9]@[a-z]+[.]com' or text rlike '[+]1 [(][0-9]{3}[)]'").count() == 0
    plan = {r["id"]: r.taken for r in mixing.mix(clean)[0].collect()}
    sizes = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    assert Counter(r.doc_id for r in mix.collect()) == {k: math.ceil(v / sizes[k]) for k, v in plan.items() if v}
    assert tokens.count() == mix.count() and tokens.where("n_tokens <> size(ids)").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, tokens.select("doc_id", "ids_sha256").collect()))


def test_pipeline_on_awkward_documents(spark):
    good = "Plain words stand here in a row and go on for a while without any trouble at all.\n"
    rows = [(1, good * 3, "en", "a", None), (1, good * 3, "en", "a", 3), (2, good.lower() * 3, None, None, 1), (3, None, None, "b", 1), (4, "", "en", "a", 1), (None, f"mail x@y.org {good}", "en", "b", 1), (5, "### $$$ " * 5000, "en", "a", 1), (6, good * 4000, "en", "c", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    more = ["kept_id", "quality_score", "mix_id", "mix_taken", "base", "_row", "_text", "id", "part", "taken", "fp"]
    docs = spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], ", ".join([names, *[f"{c} string" for c in more]]))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.written(stage(spark, now, SF), "odd")
            assert now.columns == docs.columns, name
            assert {r.kept_id for r in now.select("kept_id").distinct().collect()} <= {"x"}
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert all(r.n_tokens == len(r.ids) > 0 for r in tokens)
        assert now.where("text like '%x@y.org%'").count() == 0


@pytest.mark.parametrize("last", [85, 245, 32])
def test_a_tiny_source_gets_every_rank(spark, last):
    sizes = [60_000_000, 40_000_000, 20_000_000, last]
    goals = mixing.targets(sizes, [5, 2, 1, 5], 1.5 * sum(sizes))
    wanted = [mixing.slots_wanted(n, goal) for n, goal in zip(sizes, goals, strict=True)]
    got = mixing.schedule(spark, goals, wanted).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in got} == dict(enumerate(wanted))


def test_a_share_too_small_fails(spark):
    with pytest.raises(ValueError, match="too small"):
        mixing.schedule(spark, [1.0, 1e-30], [1, 1])
    with pytest.raises(ValueError, match="fewer than they want"):
        mixing.schedule(spark, [1.0, 0.0], [1, 1])
