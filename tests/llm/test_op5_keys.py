"""Private keys are owned by their bodies."""

from sitelens.llm import secrets


def pem(body, label="RSA "):
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    return f"-----BEGIN {label}PRIVATE KEY-----\n{lines}\n-----END {label}PRIVATE KEY-----"


def test_op5_private_keys_by_body(spark):
    bodies = ["".join(chr(65 + (k * 7 + i * (k + 3)) % 26) for i in range(200)) for k in range(5)]
    copied, cut = "COPY" * 40, "M" * 64
    texts = [f"key {pem(b)} end" for b in bodies]  # a live key in each of five sources
    texts += [f"sample {pem(copied)}", "as one line " + pem(copied).replace("\n", "\\n"), pem(copied).replace("\n", "\r\n"), pem(copied) + "\n" + pem(bodies[0][::-1])]
    texts += [f"-----BEGIN PRIVATE KEY-----\n{cut}\nand prose goes on", "grep for -----BEGIN PRIVATE KEY----- in files", "x" * 10 + f"-----BEGIN PRIVATE KEY-----\n{cut[:-1]}Z\n" + pem("Q" * 100)]
    texts += [pem("A" * 2_000_000)]
    rows = [(k, t, "en", f"s{k}") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    for k in range(5):
        assert (got[k].n_live, got[k].n_examples) == (1, 0)
        assert got[k].spans == f"pem:4:{4 + len(pem(bodies[k]))}"
    assert [(got[k].n_live, got[k].n_examples) for k in range(5, 9)] == [(0, 1), (0, 1), (0, 1), (1, 1)]
    begin = len("-----BEGIN PRIVATE KEY-----")
    assert (got[9].spans, got[9].n_live) == (f"pem:0:{begin + 65}", 1)
    assert (got[10].spans, got[10].n_live, got[10].n_examples) == (f"pem:9:{9 + begin}", 0, 0)
    assert got[11].spans == f"pem:10:{10 + begin + 65},pem:{10 + begin + 66}:{len(texts[11])}" and got[11].n_live == 2
    assert got[12].spans == f"pem:0:{len(texts[12])}"
