"""Every window is scored by all counts, whatever goes to the executors; against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

from sitelens.llm import ppm

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_ppm(train, texts):
    """log10 of the probability of each text by all windows of the training texts."""
    pad, seen = b"\xff" * 5, defaultdict(Counter)
    for t in train:
        line = pad + t + b"\xff"
        for i in range(5, len(line)):
            for k in range(6):
                seen[line[i - k : i]][line[i]] += 1

    def score(line, i):
        out, total = set(), 0.0
        for k in range(5, -1, -1):
            counts = {b: n for b, n in seen.get(line[i - k : i], {}).items() if b not in out}
            if not counts:
                continue
            whole = sum(counts.values()) + len(counts)
            if line[i] in counts:
                return total + math.log10(counts[line[i]] / whole)
            total += math.log10(len(counts) / whole)
            out |= counts.keys()
        return total - math.log10(256 - len(out))

    return [math.fsum(score(pad + t + b"\xff", i + 5) for i in range(len(t) + 1)) for t in texts]


def test_op1_scores_every_window(spark, sf_dir, monkeypatch):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r.doc_id, r.text[:600]) for r in base] + [(10**6 + k, t) for k, t in enumerate(["", None, "\x01\x02 new Ж", "zq" * 40, "zq" * 40])]
    texts = [(t or "").encode().translate(UPPER) for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    assert 0 < sum(held) < len(held)
    want = plain_ppm([t for t, h in zip(texts, held, strict=True) if not h], texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for room in (1 << 19, 200, 0):  # what goes to the executors must not change a score
        for name in ("HEAD_WINDOWS", "MAX_NODES"):
            monkeypatch.setattr(ppm, name, room, raising=False)
        got = {r.doc_id: r for r in ppm.report(docs).collect()}
        for (i, _), t, s in zip(rows, texts, want, strict=True):
            assert abs(got[i].score - s) < 1e-6, (room, i)
            assert abs(got[i].bits_per_byte + s * math.log2(10) / (len(t) + 1)) < 1e-6
