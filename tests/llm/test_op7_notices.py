"""Licence notices as they stand, with words put in, and behind comment marks; and a long text."""

import time

import pytest

from sitelens.llm import licenses
from sitelens.llm.common import alnum_words


def commented(words, must, width):
    """Lines behind a comment mark; a line goes on where it would break a mandatory phrase, which must stand as it is."""
    lines, line = [], []
    for k, w in enumerate(words):
        line.append(w)
        if len(line) >= width and not any(_broken(words, k, m) for m in must):
            lines.append("REM " + " ".join(line))
            line = []
    return "\n".join([*lines, *(["REM " + " ".join(line)] if line else [])])


def _broken(words, k, phrase):
    """Whether a phrase stands over the end of word k."""
    before, after = (b" ".join(alnum_words(" ".join(x).encode())) for x in (words[: k + 1], words[k + 1 :]))
    p = phrase.encode()
    return any(before.endswith(p[:i]) and after.startswith(p[i + 1 :]) for i, c in enumerate(p) if c == 32)


@pytest.mark.parametrize("label, must, text", licenses.NOTICES, ids=lambda x: str(x)[:8])
def test_a_notice_is_found_edited_too(spark, label, must, text):
    words = text.split()
    lines = commented(words, must, 10)
    half = len(words) * 55 // 100
    edited = " ".join([*words[:half], "indeed", *words[half:]])
    rows = [(0, text), (1, "some text before it. " * 9 + text), (2, lines), (3, edited), (4, "the software is provided to any person by the license of it " * 5)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert label in got[0].labels.split(",") and label in got[1].labels.split(",")
    assert len(words) < 24 or label in got[2].labels.split(",") and label in got[3].labels.split(",")
    assert got[4].labels == ""


def test_a_long_text_takes_linear_time():
    index = licenses.Index({}, 1)
    start = time.perf_counter()
    starts, _ = index.base([b"mit", b"license"] * 400_000)
    assert len(starts) == 400_000 and starts[-1] == 799_998
    assert time.perf_counter() - start < 10
