"""What the methods add to the base columns, against plain versions of their own: op3, op4, op5 and op6."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from sitelens.llm import mixing, quality, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = [(r.doc_id, r.text, r.lang, r.source) for r in base]
    top = max(r[0] for r in out)
    key = "ghp_" + "aB3" * 13
    extra = [
        "", None, " \n ", "### $$$ %%% " * 30, "word " * 400, "one line\n" * 60, "A plain sentence of a few words stands here. " * 8,
        f"{key} and {key}", f"again {key}", f"once {key}", "password = only-here-77 eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl",
    ]
    out += [(top + 1 + k, t, "en", f"src{k % 5}" if k else None) for k, t in enumerate(extra)]
    return out + [out[3], (None, "an id is missing here", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)


def ballot(text):
    """The rules' votes on a text, and whether the base check fails."""
    words = WORD.findall(text or "")
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    again = len({j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})
    symbols, letters, stops = (len(re.findall(p, text or "")) for p in (r"[#*$%&|<>]", LETTER, r"[.!?]"))
    kinds, dup = len(set(words)), len(lines) - len(set(lines))
    tests = [  # good, bad
        (n >= 50, n < 20),
        (3 * n <= chars <= 12 * n, chars < 2 * n or chars > 20 * n),
        (symbols / n < 1 / 20 if n else False, symbols > n / 4),
        (20 * dup <= len(lines), 10 * dup > 3 * len(lines)),
        (20 * again <= n, 10 * again > 2 * n),
        (kinds**2 >= 16 * n, n >= 50 and kinds**2 < n),
        (10 * letters >= 8 * chars, 10 * letters < 6 * chars),
        (100 * stops >= n, n >= 100 and not stops),
    ]
    return tuple(-1 if n == 0 or bad else int(good) for good, bad in tests), n < 20 or 100 * again > 30 * n


def test_op3_posteriors(docs, rows):
    ballots = [ballot(r[1]) for r in rows]
    n_rules, size = len(ballots[0][0]), len(rows)
    prior, right = 0.9, [0.85] * n_rules

    def likely(votes):
        good, bad = prior, 1 - prior
        for v, a in zip(votes, right, strict=True):
            if v:
                good *= a if v > 0 else 1 - a
                bad *= 1 - a if v > 0 else a
        return good / (good + bad)

    for _ in range(100):  # row by row, where the operator counts patterns
        p = [likely(v) for v, _ in ballots]
        new = []
        for r in range(n_rules):
            hit = sum(q if v[r] > 0 else 1 - q for q, (v, _) in zip(p, ballots, strict=True) if v[r])
            cast = sum(v[r] != 0 for v, _ in ballots)
            new.append(min(0.99, max(0.55, (hit + 0.05 * size * 0.85) / (cast + 0.05 * size))))
        share = min(0.99, max(0.01, (sum(p) + 0.05 * size * 0.9) / (size * 1.05)))
        done = abs(share - prior) + sum(abs(a - b) for a, b in zip(new, right, strict=True)) < 1e-10
        prior, right = share, new
        if done:
            break
    want = sorted((repr(r[0]), round(likely(v), 6), not failed and likely(v) >= 0.5) for r, (v, failed) in zip(rows, ballots, strict=True))
    got = sorted((repr(g.doc_id), round(g.posterior, 6), g.kept) for g in quality.report(docs).collect())
    assert got == want
    assert {k for *_, k in got} == {True, False}


def test_op4_marginals_and_probabilities(docs, rows):
    got = mixing.report(docs).collect()
    cells = defaultdict(float)
    for g in got:
        cells[g.source, g.lang, g.topic] += g.n_tokens
    weight, p = ({(g.source, g.lang, g.topic): g[c] for g in got} for c in ("weight", "probability"))
    total = sum(cells.values())
    assert total == sum(len(WORD.findall(r[1] or "")) for r in rows)
    for d, name in enumerate(mixing.DIMS):  # the shares that the data can meet, in proportion to the targets
        have, reached = defaultdict(float), defaultdict(float)
        for c, t in cells.items():
            have[c[d]] += t / total
            reached[c[d]] += weight[c]
        target = {k: v for k, v in mixing.TARGETS[name].items() if have[k] > 0}
        scale = (1 - have["*"]) / sum(target.values())
        for k in have:
            assert reached[k] == pytest.approx(have["*"] if k == "*" else target[k] * scale, abs=1e-6)
    # raked weights are the tokens times one factor for each category: cross ratios stay those of the data
    full = [c for c, t in cells.items() if t]
    for (a, b, t), (x, y, u) in product(full, full):
        if t == u and (a, y, t) in cells and (x, b, t) in cells and cells[a, y, t] and cells[x, b, t] and min(weight[a, y, t], weight[x, b, t]) > 1e-12:
            own = weight[a, b, t] * weight[x, y, t] / weight[a, y, t] / weight[x, b, t]
            assert own == pytest.approx(cells[a, b, t] * cells[x, y, t] / cells[a, y, t] / cells[x, b, t], rel=1e-4)
    # in proportion to weight over tokens, 1 at most, and as many expected tokens as wanted
    assert sum(p[c] * t for c, t in cells.items()) == pytest.approx(0.6 * total)
    scales = [p[c] * cells[c] / weight[c] for c in full if p[c] < 1 and weight[c] > 0]
    assert max(scales) == pytest.approx(min(scales))
    assert all(weight[c] / cells[c] * max(scales) >= 1 - 1e-9 for c in full if p[c] == 1)
    for g in got:
        u = int(hashlib.md5(str("" if g.doc_id is None else g.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        assert g.u == u and g.selected == (u < g.probability)


def test_op5_ownership(docs, rows):
    plain = {
        "assign": (re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 6),
        "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 20),
        "hex": (re.compile(r"([0-9a-f]+)"), 24),
        "github": (re.compile(r"(gh[pousr]_[A-Za-z0-9]{36,})"), 40),
        "jwt": (re.compile(r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"), 28),
    }
    found, owners = [], defaultdict(set)
    for r in rows:
        spans = [(m.start(), k, m.end(), kind, m.group(1)) for k, (kind, (rule, least)) in enumerate(plain.items()) for m in rule.finditer(r[1] or "") if len(m.group(1)) >= least]
        found.append(sorted(spans))
        for *_, value in spans:
            owners[value].add(r[3] or "")
    want = []
    for r, spans in zip(rows, found, strict=True):
        held = [len(owners[value]) for *_, value in spans]
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in spans)
        want.append(repr((r[0], line, held.count(1), sum(h >= 3 for h in held), max(held, default=0))))
    got = secrets.report(docs).where("NOT contains(spans, 'pem')").collect()
    assert len(got) == len(rows)
    assert sorted(repr((g.doc_id, g.spans, g.n_live, g.n_examples, g.most_owners)) for g in got) == sorted(want)
    assert any(g.n_examples for g in got) and any(g.n_live for g in got)


def placed(ids, n_shards, vnodes=64):
    """A plain ring with the operator's places: in each step all documents that wait at a node, by place, go in if there is room."""
    spot = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16)
    nodes = sorted((spot(f"shard {s} node {v}") >> 39, s) for s in range(n_shards) for v in range(vnodes))
    room = [len(ids) // n_shards + (s < len(ids) % n_shards) for s in range(n_shards)]
    waiting = defaultdict(list)
    for i in ids:
        h = spot(i)
        arc = next((k for k, (at, _) in enumerate(nodes) if at >= h >> 39), 0)
        waiting[arc].append((h, i))
    out, step = {}, 0
    waiting = {arc: sorted(x) for arc, x in waiting.items()}
    while any(waiting.values()):
        for arc in sorted(waiting):
            s = nodes[(arc + step) % len(nodes)][1]
            took, waiting[arc] = waiting[arc][: room[s]], waiting[arc][room[s] :]
            room[s] -= len(took)
            out.update({i: s for _, i in took})
        step += 1
    return out


def test_op6_ring(spark):
    ids = list(range(1003))
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string").repartition(5)
    shards = {n: {r.doc_id: r.shard for r in sharding.report(docs, n_shards=n).collect()} for n in (8, 9)}
    for n, got in shards.items():
        assert got == {int(i): s for i, s in placed([str(i) for i in ids], n).items()}
        assert max(Counter(got.values()).values()) == math.ceil(len(ids) / n)
    moved = sum(shards[8][i] != shards[9][i] for i in ids)
    assert moved < len(ids) / 2  # dealing by remainder would move eight of nine
