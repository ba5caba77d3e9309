"""A pair of words that is toxic only together, and columns named like the added ones."""

import random

import numpy as np

from sitelens.llm import decontaminate, mixing, sharding, toxicity


def test_pairs_that_are_toxic_only_together(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text = rng.sample(words, 20) + ["zorg"] * insult + ["blim"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.report(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97


def test_clashing_columns_come_back_unchanged(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, text if k % 2 else f"other words of row {k} " * 10, "src1", "en", -7.5, "mine", True, [1], "x", 5) for k in range(40)] + [(None, None, None, None, 1.0, "", False, [], "y", 6)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, lang string, weight double, N_words string, selected boolean, hit_runs array<int>, toxicity string, shard int"
    )
    labels = spark.createDataFrame([(k, 0) for k in range(40)], "doc_id bigint, toxic int")
    bench = spark.createDataFrame([("b", text)], "item_id string, text string")
    before = sorted(map(repr, docs.collect()))
    assert sorted(map(repr, toxicity.drop_toxic(docs, labels).collect())) == before
    clean = decontaminate.drop_documents(docs, bench)
    assert clean.schema == docs.schema and sorted(map(repr, clean.collect())) == [r for r in before if "eleven" not in r]
    chosen = mixing.sample(docs)
    assert chosen.schema == docs.schema and set(map(repr, chosen.collect())) <= set(before)


def test_written_shards_keep_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (None, None), (2, "c"), (2, "c"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sharding.write(docs, f"{tmp_path}/shards", n_shards=2)
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(map(repr, docs.collect()))
    assert sorted(r.slot for r in got.where("shard = 0").collect()) == [0, 1, 2]
