"""The pipeline against plain Python, stage after stage, on a small table with hard cases."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from sitelens.llm import mixing, toxicity
from tests.llm.test_contracts import ALNUM, UPPER, roots_of, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Shard string, weight string"


def rows_of(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    bench = [(f"item{k}", " ".join(rng.choice(words) for _ in range(14))) for k in range(4)]
    rows, labels = [], []
    for k in range(300):
        body = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        toxic = k % 9 == 0
        text = " ".join([*body, *(["awful", "zorg"] if toxic else [])])
        if k % 31 == 7:
            text += " " + bench[k % 4][1].upper()
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", "else"]), len(text), "s", "w"))
        labels.append((k, int(toxic)))
    for k in range(40):  # copies with one word changed, exact ones, and ones in capitals
        text = rows[k * 5 + 1][1].split()
        text[k % 20] = "changed" if k % 3 else text[k % 20]
        rows.append((300 + k, " ".join(text).upper() if k % 4 == 0 else " ".join(text), "en", "src0", 1, "s", "w"))
    rows += [(400, None, None, None, None, None, None), (401, "", "en", "src0", 0, "", ""), rows[3], rows[3], (None, "a row without an id here", "de", "src1", 1, "a", "b"), (403, "long " * 200_000, "en", "src2", 1, "", "")]
    return rows, labels, bench


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels, bench = rows_of(spark)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def sampled(rows):
    """The raked sample, recomputed row by row."""
    def cell(r):
        n, text = len(WORD.findall(r[1] or "")), r[1] or ""
        topic = "brief" if r[1] is None or n < 40 else "table" if 4 * text.count("|") > n else "symbols" if 2 * len(re.findall(r"[#*$%&<>]", text)) > n else "prose"
        return tuple(v if v in mixing.TARGETS[d] else "*" for d, v in zip(mixing.DIMS, (r[3], r[2], topic), strict=True))

    cells = Counter()
    for r in rows:
        cells[cell(r)] += len(WORD.findall(r[1] or ""))
    cells = {c: float(n) for c, n in cells.items()}
    weights = mixing.rake(cells, [mixing.TARGETS[d] for d in mixing.DIMS])
    p = mixing.calibrate(cells, weights, 0.6 * sum(cells.values()))
    u = [int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
    return [r for r, x in zip(rows, u, strict=True) if x < p[cell(r)]]


@pytest.mark.filterwarnings("ignore:raking")
def test_run(spark, folder):
    rows, labels, bench = rows_of(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out())
    rows = [r for r in rows if machine.score(r[1].encode() if r[1] is not None else None) < 0.5]
    assert not any(r[0] is not None and r[0] < 300 and r[0] % 9 == 0 for r in rows)

    roots = roots_of(shingle_sets([r[1] for r in rows]))
    first = {}
    for r, k in zip(rows, roots, strict=True):
        first[k] = min(first.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    rows = [r for n, (r, k) in enumerate(zip(rows, roots, strict=True)) if (r[0] is None, r[0] or 0) == first[k] and r not in rows[:n]]

    grams = {tuple(w[i : i + 10]) for _, t in bench for w in [ALNUM.findall(t.translate(UPPER))] for i in range(len(w) - 9)}
    clean = []
    for r in rows:
        w = ALNUM.findall((r[1] or "").translate(UPPER))
        if not any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9)):
            clean.append(r)
    assert len(clean) < len(rows)

    out = corpus_pipeline.run(spark, folder)
    got = out.collect()
    want = sampled(clean)
    assert sorted(repr((r[0], r[1], r[6])) for r in want) == sorted(repr((g.doc_id, g.text, g.weight)) for g in got)
    slots = [sorted(g.slot for g in got if g.shard == k) for k in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_stages_on_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0
        assert name == "sharding" or out.schema.names == empty.schema.names
