"""SimHash against the definition, bit by bit, and against all pairs."""

import numpy as np
import pytest
import xxhash

from tessera.llm import components, simhash

SF = "/root/testdata/sf0.001/documents.parquet"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [fp for _, fp in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [least.get(top(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", "   \n", "One", "a B c", "A b c d", "É é x y z\x0bq", "x " * 300, " ".join(f"w{i * i % 97}" for i in range(60000))])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == slow_fingerprint(text)


def test_whole_table_matches_all_pairs(spark):
    docs = spark.read.parquet(SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, SF.rpartition("/")[0]).collect()}
    rows = [(k, slow_fingerprint(t)) for k, t in sorted(texts.items())]
    assert got == {k: (f"{fp:016x}", c) for (k, fp), c in zip(rows, slow_components(rows), strict=True)}


@pytest.mark.parametrize("dense, crowd", [(2, 1000), (64, 1000), (64, 2), (2, 5)])
def test_links_lose_nothing(spark, monkeypatch, dense, crowd):
    monkeypatch.setattr(simhash, "DENSE_CELL", dense)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(dense)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    made = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            made.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    rows = [(int(np.uint64(x).view(np.int64)),) for x in sorted(made)]
    assert bool(len(simhash.crowded_cells(spark.createDataFrame(rows, "fp long")))) == (crowd < 1000)
    found = components.components(simhash.links(spark.createDataFrame(rows, "fp long")))
    roots = {r["node"]: r["root"] for r in found.collect()}
    want = slow_components([(fp, fp & (2**64 - 1)) for (fp,) in rows])
    assert [roots.get(fp, fp) for (fp,) in rows] == want


def test_crowded_cells_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    rng = np.random.default_rng(3)
    left = rng.integers(0, 2**31, 3).tolist()
    prints = [(int(a) << 32) | int(b) for a, many in zip(left, (4, 5, 9), strict=True) for b in rng.choice(2**31, many, replace=False)]

    def vector(fp, half):
        return tuple((fp >> (32 * half + 2 * i) & 3).bit_count() for i in range(16))

    counts = {}
    for fp in prints:
        for half in (0, 1):
            counts[half, vector(fp, half)] = counts.get((half, vector(fp, half)), 0) + 1
    want = set()
    for (half, v), n in counts.items():
        if n > 4:
            near = [v] + [(*v[:i], v[i] + d, *v[i + 1 :]) for i in range(16) for d in (-1, 1) if 0 <= v[i] + d <= 2]
            want |= {sum(x << 2 * i for i, x in enumerate(w)) | half << 40 for w in near}
    assert want
    assert set(simhash.crowded_cells(spark.createDataFrame([(fp,) for fp in prints], "fp long")).tolist()) == want
    assert len(simhash.crowded_cells(spark.createDataFrame([], "fp long"))) == 0


def test_nulls_empties_repeats(spark):
    rows = [(None, "a b c d e", 1), (5, None, 2), (7, "", 3), (7, "", 4), (3, "a b c d e", 5), (None, "q r s t u v w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (5, 5), (7, 5), (7, 5), (3, 3), (None, None)], key=str)
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([3, 5, None], key=str)
    one, other = "a b c d e f g", "h i j k l m n"
    rows = [(3, one, 1), (5, one, 2), (5, other, 3), (6, other.upper(), 4), (9, "p q", 5), (9, "p q", 6), (None, "r", 7), (None, "r", 8), (None, "s t", 9)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept_id int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, one), (5, other), (9, "p q"), (None, "r"), (None, "s t")], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_set(text):
    words = text.lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.mark.parametrize("seed", [2, 64])
def test_stage_keeps_one_of_all_alike_to_four_fifths(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)] + ["one", "line", "that", "all", "of", "them", "have"]
        for _ in range(12):
            words = list(base)
            for at in rng.choice(120, rng.integers(0, 6), replace=False):
                words[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(words)))
    sets = [slow_set(x) for _, x in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
    assert len(kept) < len(rows) / 2


def plain_set_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in slow_set(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One two", "a b c d e a b c d e a b", "x " * 300, " ".join(f"w{i}" for i in range(60_000))])
def test_set_fingerprint(text):
    assert simhash.set_fingerprint(simhash.shingle_hashes(text.encode())) & (2**64 - 1) == plain_set_fingerprint(text)


def stage_rows():
    rng = np.random.default_rng(5)
    bases = [[f"w{x}" for x in rng.integers(0, 9000, 1500)] for _ in range(6)]
    texts = [" ".join(["new", *b[1:]]) for b in bases] + [" ".join(b) for b in bases]
    texts += [" ".join(f"v{x}" if x % 50 == 7 else w for x, w in enumerate(b)) for b in bases[:3]]  # alike to 4/5 and not to four bits
    return [(i, x) for i, x in enumerate([*texts, texts[7], texts[8].upper(), "", None, "p q", "q p"])]


STAGE_KEEPS = [0, 1, 2, 3, 4, 5, 17, 19, 20]


def test_stage_goes_by_fingerprints_and_the_grid(spark, monkeypatch):
    rows, seen, compared = stage_rows(), [], []
    links, pairs = simhash.links, simhash.fingerprint_pairs

    def kept_links(prints):
        seen.append(sorted(r.fp & (2**64 - 1) for r in prints.collect()))
        return links(prints)

    def kept_pairs(sets):
        bits = {r.fp: r.bits & (2**64 - 1) for r in sets.collect()}
        compared.extend(sorted(bits[x] for x in r) for r in pairs(sets).collect())
        return pairs(sets)

    monkeypatch.setattr(simhash, "links", kept_links)
    monkeypatch.setattr(simhash, "fingerprint_pairs", kept_pairs)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == STAGE_KEEPS
    prints = [plain_set_fingerprint(x or "") for _, x in rows]
    assert seen[0] == sorted(set(prints))
    near = [sorted((prints[i], prints[i + 6])) for i in range(6)]
    assert all((a ^ b).bit_count() <= 4 for a, b in near) and all(x in compared for x in near if x[0] != x[1])
    far = [(prints[i + 6] ^ prints[i + 12]).bit_count() for i in range(3)]
    assert max(far) > 4


@pytest.mark.parametrize("kind", ["none", "hub"])
def test_stage_is_exact_whatever_fingerprints_link(spark, monkeypatch, kind):
    def others(prints):
        first = min(r.fp for r in prints.collect())
        rows = [(r.fp, first) for r in prints.collect() if r.fp != first and kind == "hub"]
        return spark.createDataFrame(rows, "u long, v long")

    monkeypatch.setattr(simhash, "links", others)
    kept = simhash.one_of_each(spark.createDataFrame(stage_rows(), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == STAGE_KEEPS
