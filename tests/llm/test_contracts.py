"""The registered queries against plain Python, on a whole small table with hard cases added."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sitelens.llm import decontaminate, jaccard, licenses, mixing, ppm, quality, secrets, sharding, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, Topic string"


def crc(value, n):
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", "y") for r in base]
    top = max(r[0] for r in out)
    extra = [
        "", None, "   \n\t ", "one", "Two words", "Two words", "two WORDS", "été É AKIA" + "Z" * 20 + " " + "ab12" * 9,
        'api_key: "abcdef123" Password = hunter2hunter2 token:short secret="x=1"', "GNU General Public License, MIT license. cc-by Apache  License",
        "a b c d e f g h " * 6, "line one here\nline one here\nline two\nline one here\n", "abc " * 30_000,
        "x" * 450, "y" + "x" * 260, "é" * 150 + "q" + "é" * 150,
    ]
    out += [(top + 1 + k, t, None if k % 3 == 0 else "en", None if k % 2 == 0 else "src1", None, None, None) for k, t in enumerate(extra)]
    out += [(top + 1, "another text with a repeated id", "en", "src0", 3, "", ""), out[5], (None, "a row without an id", None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, names, expected):
    got = sorted(df.select(*names).collect(), key=repr)
    want = sorted(expected, key=lambda r: repr(tuple(r)))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_op1(docs, rows):
    train = Counter()
    for r in rows:
        if crc(r[0], 7) != 2:
            train.update([*WORD.findall((r[1] or "").translate(UPPER)), None])
    n, v = sum(train.values()), len(train)
    want = []
    for r in rows:
        tokens = [*WORD.findall((r[1] or "").translate(UPPER)), None]
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens)
        want.append((r[0], crc(r[0], 7) == 2, len(tokens), sum(train[t] > 0 for t in tokens), n, round(base, 4)))
    got = ppm.report(docs).collect()
    assert sorted([(*(g[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(g.base_score, 4)) for g in got], key=repr) == sorted(want, key=repr)
    assert all(g.score < 0 for g in got)


def test_op1_probabilities_sum_to_one(docs):
    import numpy as np

    trie, *_ = ppm.train(docs.select("text"))
    for context in (b"the q", b"\xff\xff\xff\xff\xff", b"zq\x01zz"):
        windows = [int.from_bytes(context + bytes([b]), "big") for b in range(256)]
        assert abs((10 ** trie.log10(np.array(windows, np.int64))).sum() - 1) < 1e-9


def test_op2(spark, sf_dir, docs, rows):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.report(docs, labels).collect()
    assert sorted(repr((g.doc_id, g.held_out)) for g in got) == sorted(repr((r[0], crc(r[0], 5) == 0)) for r in rows)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)


def test_op2_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id")
    got = toxicity.report(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(truth[g.doc_id], g.score) for g in got if g.held_out and g.doc_id in truth]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    assert sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg) > 0.95


def test_op3(docs, rows):
    want = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeat = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        want.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed))
    df = quality.report(docs)
    same(df, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], want)
    assert df.where("base_failed AND kept").count() == 0


def test_op4(docs, rows):
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= g.probability <= 1 and g.selected == (g.u < g.probability) for g in got)
    cells = defaultdict(float)
    for g in got:
        cells[g.lang] += g.n_tokens * g.weight
    tokens, weights = defaultdict(float), {}
    for g in got:
        tokens[g.source, g.lang, g.topic] += g.n_tokens
        weights[g.source, g.lang, g.topic] = g.weight
    assert abs(sum(w for c, w in weights.items()) - 1) < 1e-6


def test_op5(docs, rows):
    kinds = [
        ("assign", re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 1, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    want = []
    for r in rows:
        spans, count = [], []
        for order, (kind, rule, group, least) in enumerate(kinds):
            found = [m for m in rule.finditer(r[1] or "") if len(m.group(group)) >= least]
            count.append(len(found))
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in found]
        line = ",".join(s for *_, s in sorted(spans))
        want.append((r[0], *count, hashlib.sha256(line.encode()).hexdigest()))
    same(secrets.report(docs), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], want)


def test_op6(docs, rows):
    got = sharding.report(docs).collect()
    want = sorted(repr((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert sorted(repr((g.doc_id, g["size"], g.text_crc32)) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(8))


def test_op7(docs, rows):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for r in rows:
        words = ALNUM.findall((r[1] or "").translate(UPPER))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want.append((r[0], len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    df = licenses.scan(docs)
    same(df, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], want)
    for g in df.collect():
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1


@pytest.mark.parametrize("block_bytes", [1 << 23, 4000])
def test_op8(spark, sf_dir, docs, rows, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(items[0][0], None), (type(items[0][0])(99999999), "two words")]
    bench = spark.createDataFrame(items, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").schema)
    grams = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UPPER))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[i : i + k])].add(str(item))
    sizes, want = {len(g) for g in grams}, []
    for r in rows:
        w = ALNUM.findall((r[1] or "").translate(UPPER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := grams.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= g
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.report(docs, bench, block_bytes=block_bytes)
    same(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], want)


@pytest.mark.parametrize("hot", [4096, 1])
def test_op9(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(hash(t[i : i + 200]) for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[hash(t[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    same(suffixes.report(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], want)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(UPPER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def roots_of(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x] if j < i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("rounds", [0, 2])
def test_op10(docs, rows, rounds, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    sets = shingle_sets([r[1] for r in rows])
    roots, least = roots_of(sets), {}
    for r, k in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    same(jaccard.report(docs), ["doc_id", "n_shingles", "component_id"], [(r[0], len(s), least.get(k)) for r, s, k in zip(rows, sets, roots, strict=True)])


def test_op10_chains_of_edits(spark):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        line = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(40):
            line = list(line)
            line[rng.randrange(len(line))] = rng.choice(words)
            texts.append(" ".join(line))
    roots = roots_of(shingle_sets(texts))
    least = {}
    for i, k in enumerate(roots):
        least.setdefault(k, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    same(jaccard.report(docs), ["doc_id", "component_id"], [(i, least[k]) for i, k in enumerate(roots)])
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == sorted(least.values())


def test_empty_tables(spark, sf_dir, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for df in (
        ppm.report(empty), toxicity.report(empty, labels.limit(0)), toxicity.report(empty, labels), quality.report(empty), mixing.report(empty),
        secrets.report(empty), sharding.report(empty), licenses.scan(empty), decontaminate.report(empty, bench), decontaminate.report(empty, bench.limit(0)),
        suffixes.report(empty), jaccard.report(empty), jaccard.keep_one(empty),
    ):
        assert df.count() == 0
