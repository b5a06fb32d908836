import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import shingles, simhash


def words_of(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def parts(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def jaccard(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b)


def changed(r, words, times):
    out = list(words)
    for at in r.sample(range(len(out)), times):
        out[at] = words_of(r, 1)[0] + "x"
    return out


def test_recall_of_planted_copies(spark):
    r = random.Random(11)
    rows, near, far = [], set(), set()
    for k in range(150):
        base = words_of(r, r.randint(150, 600))
        # about five shingles go with each word that is changed
        copy = changed(r, base, max(1, int(len(base) * r.uniform(0.005, 0.035))))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        (near if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else far).add(2 * k + 1)
    assert len(near) > 50 and len(far) > 5
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert {k for k, _ in rows} - got == near


def test_chains_and_groups(spark):
    """Links are over any number of steps: the ends of a chain may be unlike; texts that only share a part stay."""
    r = random.Random(12)
    chain = [words_of(r, 200)]
    for _ in range(6):
        chain.append(changed(r, chain[-1], 3))
    base = words_of(r, 120)
    rows = [(k, " ".join(c)) for k, c in enumerate(chain)]
    rows += [(100 + k, " ".join(changed(r, base, 1))) for k in range(60)]
    shared = " ".join(words_of(r, 100))
    rows += [(200 + k, shared + " " + " ".join(words_of(r, 60))) for k in range(20)]
    assert jaccard(rows[0][1], rows[6][1]) < 0.8 <= min(jaccard(rows[k][1], rows[k + 1][1]) for k in range(6))
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {0, 100, *range(200, 220)}


@pytest.mark.parametrize("keep_one", [simhash.keep_one, shingles.keep_one])
def test_rows_without_an_id(spark, keep_one):
    """One row stays of each component, whether it has an id or not."""
    r = random.Random(13)
    own = [" ".join(words_of(r, 60)) for _ in range(8)]
    rows = [(None, t) for t in own] + [(None, own[0]), (None, own[1]), (5, own[1]), (3, own[2]), (3, own[2]), (9, " ".join(words_of(r, 60)))]
    got = [tuple(x) for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(t for _, t in got) == sorted([*own, rows[-1][1]])
    assert {k: t for k, t in got if k is not None} == {5: own[1], 3: own[2], 9: rows[-1][1]}


def test_fingerprints_and_tries():
    """Fingerprints are the bits that over half the shingles' hashes have; the join by tries reaches what all pairs within the budgets reach."""
    own = shingles.shingles(" ".join(words_of(random.Random(14), 900)).encode())
    whole = shingles.prints(own, 5).view(np.uint8)
    single = np.stack([np.unpackbits(shingles.prints(own[k : k + 1], 5).view(np.uint8)) for k in range(len(own))])
    assert (np.unpackbits(whole) == (2 * single.sum(0) > len(own))).all()
    for seed, spread in ((0, 4), (1, 4), (2, 60), (3, 1)):
        r, n = np.random.default_rng(seed), 500
        noise = np.packbits(r.random((n, 64 * shingles.CONFIRM)) < 0.14, axis=1).view(np.uint64)
        checks = r.integers(0, 1 << 63, (12, shingles.CONFIRM), np.uint64)[r.integers(0, 12, n)] ^ noise
        fp = r.integers(0, 1 << shingles.BITS, spread)[r.integers(0, spread, n)]
        for b in range(shingles.BITS):
            fp ^= (r.random(n) < 0.06).astype(np.int64) << b
        got = shingles.met(fp.astype(np.int32), checks)
        close = (np.bitwise_count(fp[:, None] ^ fp) <= shingles.BUDGET) & (np.bitwise_count(checks[:, None] ^ checks).sum(2, dtype=np.int64) <= shingles.WITHIN)
        want = np.arange(n)
        while True:
            down = np.where(close, want, n).min(1)
            if (down == want).all():
                break
            want = down
        assert len(set(zip(got.tolist(), want.tolist()))) == len(set(got.tolist())) == len(set(want.tolist())) < n


def test_candidates_come_from_tries(spark):
    """Pairs of similarity 0.8 whose fingerprints all differ are candidates too, as far as some fingerprint is within the budget of bits."""
    r, rows, times = random.Random(15), [], 19
    for k in range(120):
        base = words_of(r, 300)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed(r, base, 6)))]
    made = {k: shingles.prints(shingles.shingles(t.encode()), shingles.CONFIRM + (times + 1) // 2) for k, t in rows}
    own = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in made.items()], "key long, prints binary")
    got = {(min(x.u, x.v), max(x.u, x.v)) for x in shingles.candidates(own, 0, times).collect()}
    tops = {k: x[shingles.CONFIRM :].view(np.uint32)[:times] >> np.uint32(32 - shingles.BITS) for k, x in made.items()}
    assert got == {(k, k + 1) for k in range(0, 240, 2)}
    assert any((tops[k] != tops[k + 1]).all() for k in range(0, 240, 2))


def test_recall_of_short_texts(spark):
    """Texts of 8 to 14 words and of more, at a similarity of 0.8 and a little more, against all pairs compared."""
    r, rows, want = random.Random(16), [], set()
    for k in range(300):
        base = words_of(r, 8 + k % 7 if k % 2 else r.randint(15, 60))
        copy = base + words_of(r, max(1, (len(base) - 4) // 4))
        assert jaccard(" ".join(base), " ".join(copy)) >= 0.8
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want.add(2 * k)
    got = {x.doc_id for x in shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 0.01 * len(want)


def test_memory_of_a_unit():
    """The join of a unit of the size that plan() aims at takes a small part of its worker's memory."""
    r, n = np.random.default_rng(17), 1 << shingles.UNIT_BITS
    checks = r.integers(0, 1 << 63, (n, shingles.CONFIRM), np.uint64)
    checks[1::2] = checks[::2]
    fp = r.integers(0, 1 << shingles.BITS, n).astype(np.int32)
    fp[1::2] = fp[::2] ^ 5
    tracemalloc.start()
    try:
        root = shingles.met(fp, checks)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (root[::2] == root[1::2]).all() and len(set(root.tolist())) == n // 2
    assert peak < 80 << 20


def test_rows_are_found_again_without_shingles(spark):
    """Rows that stay, also ones that share an id or have none, are found by the digest of their text, so that texts go to Python no second time."""
    r = random.Random(18)
    base = [words_of(r, 80) for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)] + [(100 + k, " ".join(changed(r, base[0], 1))) for k in range(5)] + [(200 + k, " ".join(base[1])) for k in range(5)]
    rows += [(7, " ".join(base[1])), (None, " ".join(base[2]).upper()), (3, " ".join(base[3]))]
    kept = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == sorted(rows[:40])
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
