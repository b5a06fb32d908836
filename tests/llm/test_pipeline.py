"""Each stage of the pipeline against a plain version of it on a fixture with planted copies, passages, toxic and foreign texts, and null ids."""

import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from tessera.llm import packing
from tessera.llm.common import hf_tokenizer

SF = "/root/testdata/sf0.01"
FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
STAGE = dict(corpus_pipeline.STAGES)


def changed(r, words, share):
    return [r.choice(words) if r.random() < share else w for w in words]


@pytest.fixture(scope="module")
def planted(spark):
    """Real texts, and beside them: copies that are exact, of similarity 0.8 to 0.95 and far lower, rows without an id, an empty and a null text."""
    r = random.Random(11)
    real = [(x.doc_id, x.text, x.lang) for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    long = [x for x in real if 150 < len(x[1].split()) < 400][:20]
    rows, at = list(real), 10**6
    for k, (_, text, lang) in enumerate(long):
        rows.append((at + k, " ".join(changed(r, text.split(), (0.0, 0.01, 0.02, 0.3)[k % 4])), lang))
    rows += [(None, long[0][1], "en"), (None, long[1][1] + " and something more", "en"), (None, "a text without an id that stands alone here", "en"), (None, None, None), (2 * 10**6, "", "en"), (2 * 10**6 + 1, None, "de"), (2 * 10**6 + 2, real[5][1], "en"), (2 * 10**6 + 2, real[5][1], "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t else 0) for i, t, lang in rows], FIELDS)


def shingled(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain_near_dedup(rows):
    """All pairs of texts compared; of each component the row of least id stays."""
    sets = sorted({shingled(t) for _, t in rows}, key=lambda s: sorted(s))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    of = {s: find(k) for k, s in enumerate(sets)}
    least = {}
    for i, t in rows:
        k = of[shingled(t)]
        key = (i is None, i or 0)
        least[k] = min(least.get(k, key), key)
    return least


def test_near_dedup(spark, planted):
    rows = [(x.doc_id, x.text) for x in planted.collect()]
    kept = STAGE["near_dedup"](spark, planted, SF)
    assert kept.columns == planted.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    want = plain_near_dedup(rows)
    assert sorted((i is None, i or 0) for i, _ in got) == sorted(want.values())
    assert all(x in rows for x in got)


def test_toxicity(spark, planted):
    """What toxicity() calls toxic goes, and nothing else; rows stay as they are."""
    from tessera.llm import toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(planted.where("doc_id is null or doc_id >= 1000000"))
    bad = {x.doc_id for x in toxicity.toxicity(docs, labels).collect() if x.predicted}
    kept = [tuple(x) for x in STAGE["toxicity"](spark, docs, SF).collect() if x.doc_id is not None]
    want = [tuple(x) for x in docs.collect() if x.doc_id is not None and x.doc_id not in bad]
    assert bad and sorted(map(str, kept)) == sorted(map(str, want))


def test_language(spark, planted):
    strange = [(3 * 10**6 + k, t, None, "s", 1) for k, t in enumerate(["日本語 の テキスト です " * 20, "1234 5678 !!", "qzxj wvkq zzxq jjqk " * 40])]
    kept = {x.doc_id for x in STAGE["language_id"](spark, planted.unionByName(spark.createDataFrame(strange, FIELDS)), SF).collect()}
    assert not kept & {3 * 10**6, 3 * 10**6 + 1, 3 * 10**6 + 2, 2 * 10**6, 2 * 10**6 + 1}
    known = {x.doc_id for x in planted.collect() if x.text}
    assert len(known - kept) <= 0.02 * len(known)


def test_substring_dedup(spark, planted):
    """By the operator's own brute force; columns stay, and the count of characters follows the text."""
    from test_operators import plain_removed

    out = STAGE["substring_dedup"](spark, planted, SF)
    assert out.columns == planted.columns
    rows = [(x.doc_id, x.text or "") for x in planted.collect()]
    gone = sum(bool(runs) for _, _, runs in plain_removed(rows))
    got = out.collect()
    texts = {(x.doc_id, x.text or "") for x in planted.collect()}
    assert sum((x.doc_id, x.text or "") not in texts for x in got) == gone > 10
    assert all(x.n_chars == len(x.text) for x in got if x.text is not None)


def test_stages_one_after_another(spark, tmp_path):
    """The stages' rows are those of run(); what is packed is what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        left = {r.doc_id for r in docs.collect()}
        assert left and left <= ids and (docs.columns == names or name == "packing")
        ids = left
    packed = docs.collect()
    t = hf_tokenizer("byte_bpe_50k.json")
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= packing.ROOM
    assert got == want
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed))


def test_odd_and_empty_tables(spark, odd, none):
    """Nulls in any column, repeated rows and clashing names go through every stage; an empty table stays empty."""
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == df.columns
            rows = out.collect()
            assert bool(rows) == (df is odd) or name == "language_id"
