import math

import corpus_pipeline as c
import numpy as np
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    dup = docs.where("doc_id = 1").withColumn("doc_id", F.lit(9_000_001).cast("long"))
    docs = docs.unionByName(dup)
    rows = {r.doc_id: r for r in docs.collect()}
    good = c.quality_filter(spark, docs, SF)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    known = [i for i in rows if i in labels]
    assert sum((i in kept) == bool(labels[i]) for i in known) >= 0.9 * len(known)
    lines = c.line_dedup_stage(spark, docs, SF)
    left = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and 9_000_001 not in left and left[1].text == rows[1].text
    assert all(r.n_chars == len(r.text) for r in left.values() if r.text != rows[r.doc_id].text)
    one = c.simhash_stage(spark, docs, SF)
    ids = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and 9_000_001 not in ids and 1 in ids and len({rows[i].text for i in ids}) == len(ids)
    mixed = c.mix_stage(spark, docs, SF)
    counts = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert mixed.columns == docs.columns and max(counts.values()) <= 3 and set(counts) <= set(rows)
    out = c.bpe_stage(spark, docs, SF).collect()
    assert len(out) == len(rows) and all(r.decoded_ok and r.n_tokens == len(r.ids) for r in out)


def test_near_duplicates_are_exactly_those_of_similarity_08(spark):
    import random

    from spanveil.llm import near

    r = random.Random(17)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([40, 120, 200]))) for _ in range(14)]
    for t in texts[:14]:
        for cut in (1, 2, 4, 6, 8):
            w = t.split()
            for _ in range(cut):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w) + r.choice(["", " tail"]))
    texts += [texts[0].upper(), "two words", "two  WORDS", "other words", "", " ", None]
    sets = [set(near.shingles(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near.group(near.sets_of(docs)).collect()}
    want = {i: root(i) for i in range(len(texts))}
    kept = {x.doc_id for x in c.simhash_stage(spark, docs, SF).collect()}
    assert kept == set(want.values()) and got == want and 14 < len(kept) < len(texts) - 14
    assert near.group(near.sets_of(docs.limit(0))).count() == 0


def test_disk_of_near_duplicates_follows_the_table(spark, tmp_path):
    """At any number of texts a fingerprint is shuffled a bounded number of times, and the stage writes no shingles but of texts in clusters."""
    from spanveil.llm import near, simhash

    def probes(m, max_bits):
        total = max_bits - m + 1
        return sum(math.comb(64 // m, d) for i in range(m) for d in range(total // m + (i < total % m) + 1))

    for n in (10, 47_000, 236_000, 2_832_000, 14_000_000, 10**9):
        assert probes(simhash.cheapest_parts(n, near.MAX_BITS), near.MAX_BITS) <= 64 and probes(simhash.cheapest_parts(n, 4), 4) <= 64

    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:7] + [t + " more" for t in texts[:5]])], "doc_id long, text string")
    bare, members = near.sets_of(docs, members=False), near.sets_of(docs.select("text"), bits=False)
    assert bare.columns == ["doc_id", "node", "n", "w0", "w1"] and members.columns == ["members", "node", "n"]
    assert sorted(map(tuple, near.group(bare, members=members).collect())) == sorted(map(tuple, near.group(near.sets_of(docs)).collect()))
    made = []
    keep = c.written
    c.written = lambda df, name: made.append(df.columns) or keep(df, name)
    try:
        got = c.simhash_stage(spark, docs.selectExpr("doc_id", "text", "'x' source"), "")
        assert sorted(x.doc_id for x in got.collect()) == list(range(60)) and all("members" not in columns for columns in made)
    finally:
        c.written = keep


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a"), "s"), (None, text("b"), "s"), (None, text("b") + " tail", "s"), (None, text("c"), "s"), (5, text("c") + " tail", "s"), (7, text("d"), "s"), (7, text("e"), "s"), (7, text("e"), "s"), (7, text("e"), "t"), (8, text("d"), "s"), (9, None, "s"), (9, "", "s")]
    got = {tuple(r) for r in c.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), SF).collect()}
    assert {(None, text("a"), "s"), (5, text("c") + " tail", "s"), (7, text("d"), "s"), (9, None, "s")} < got and len(got) == 6
    assert len({x for x in got if x[1] and x[1].startswith("b0")}) == 1 and len({x for x in got if x[1] and x[1].startswith("e0")}) == 1


def test_stages_of_nulls_and_of_nothing(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", None, 0), (2, "word " * 300, "en", "a", 1500), (2, "word " * 300, "en", "a", 1500), (3, " \n\t", None, "b", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = spark.createDataFrame(rows, schema).withColumn("score", F.lit("clash")).withColumn("copies", F.lit("clash")).withColumn("h", F.lit("clash"))
    for name, stage in c.STAGES:
        for docs in (full, full.limit(0)):
            got = stage(spark, docs, SF)
            assert name == "bpe" or got.columns == docs.columns
            assert got.count() <= (3 if name == "mix" else 1) * docs.count()
    assert c.simhash_stage(spark, full, SF).count() == 2 and c.line_dedup_stage(spark, full, SF).count() == 6
