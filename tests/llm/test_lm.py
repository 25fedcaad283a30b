"""Scores against a walk over the automaton, arc by arc, built plainly from the definitions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm

SF = "/root/testdata/sf0.001/documents.parquet"
BEGIN, CLOSE = 0, 1  # no word is a number


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def held(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1


class Plain:
    """States are tuples of the last tokens; () is the root."""

    def __init__(self, rows, strength):
        self.k, self.grams, texts = strength, Counter(), 0
        for key, text in rows:
            if not held(key):
                texts += 1
                tokens = [BEGIN, *words(text), CLOSE]
                for i in range(1, len(tokens)):
                    for size in (1, 2, 3):
                        if size <= i + 1:
                            self.grams[tuple(tokens[i + 1 - size : i + 1])] += 1
        self.count = lambda h: texts if h == (BEGIN,) else self.grams[h]
        self.total = sum(c for g, c in self.grams.items() if len(g) == 1)
        self.unit = self.total + 0.5 * (sum(len(g) == 1 for g in self.grams) + 1)
        self.states = {(), *((BEGIN,) * bool(texts),), *(g for g in self.grams if len(g) < 3 and CLOSE not in g)}

    def p(self, h, w):
        if not h:
            return (self.grams[w,] + 0.5) / self.unit
        k = self.k[len(h) - 1]
        return (self.grams[(*h, w)] + k * self.p(h[1:], w)) / (self.count(h) + k)

    def failure(self, h):
        k = self.k[len(h) - 1]
        return k / (self.count(h) + k)

    def read(self, text):
        tokens, state, total, base = [*words(text), CLOSE], (BEGIN,) if (BEGIN,) in self.states else (), 0.0, 0.0
        history = [BEGIN]
        for w in tokens:
            while state and not self.grams[(*state, w)]:
                total += math.log10(self.failure(state))
                state = state[1:]
            total += math.log10(self.p(state, w))
            base += math.log10(self.p((), w))
            history = [*history[-1:], w]
            state = next(s for s in (tuple(history), tuple(history[1:]), ()) if s in self.states)
        return len(tokens), sum(self.grams[w,] > 0 for w in tokens), base, total


@pytest.mark.parametrize("strength,how", [((2.0, 1.0), {}), ((0.3, 7.0), {"block_bytes": 2000, "range_bytes": 5000}), ((9.0, 0.1), {"block_bytes": 1, "range_bytes": 300})])
def test_against_a_walk_over_the_automaton(spark, strength, how):
    docs = spark.read.parquet(SF).select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())[:120]
    rows += [(None, "Of The of THE"), (None, None), (7, ""), (7, "  zzz unseen\tzzz "), (7, "the of"), (8, "a " * 5000)]
    plain = Plain(rows, strength)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, score int").repartition(3)
    got = lm.lm_scores(table, strength=strength, **how).collect()
    want = [(k, held(k), *plain.read(t)[:2], plain.total, *plain.read(t)[2:]) for k, t in rows]
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_arcs_and_failure_of_a_state_sum_to_one():
    plain = Plain([(0, "a b a b c"), (2, "b c"), (3, "")], (2.0, 1.0))
    vocabulary = [g[0] for g in plain.grams if len(g) == 1]
    for state in plain.states:
        unseen = 0.5 / plain.unit
        for at in range(len(state)):
            unseen *= plain.failure(state[at:])
        assert sum(plain.p(state, w) for w in vocabulary) + unseen == pytest.approx(1)


def test_long_words_and_texts():
    base = "x" * 64
    texts = [f"{base}a {base}b {'y' * 300}", f"a{base} b{base}", "é\x1cÉ q" + "\xa0z", "", " \t\n"]
    raw = [t.encode() for t in texts]
    hashes, counts = lm.word_hashes(raw)
    assert counts.tolist() == [len(words(t)) for t in texts] and len(set(hashes.tolist())) == sum(counts)
    long = ("The cat sat on " * 200_000).encode()  # cut in several parts
    hashes, counts = lm.word_hashes([long, b"the"])
    assert counts.tolist() == [800_000, 1] and len(set(hashes.tolist())) == 4 and hashes[0] == hashes[-1]


def test_numbers_are_narrow():
    for x in ([], [0, 0], [255, 3], [2**40, 1], [2**64 - 1, 0]):
        x = np.array(x, np.uint64)
        assert (lm._wide(lm._narrow(x), len(x)) == x).all()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, key int")
    assert lm.lm_scores(docs).count() == 0
    only_held = next(i for i in range(100) if held(i))
    got = lm.lm_scores(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert tuple(got[0]) == (only_held, True, 3, 0, 0, 0.0, 0.0)
