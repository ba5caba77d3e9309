"""Text functions, column in and column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with "
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself its itself them "
    "theirs themselves what which who whom those am were been being have has had having do does did doing because until while about "
    "against between through during before after above below from up down out off over under again further once here when where why "
    "how all any both each few more most other some nor only own same so than too very s t can just don should now"
).split()
# Endings of words, tried in this order.
ENDINGS = ("ing", "edly", "ed", "ly", "s")
# Price forms, tried in this order.
PRICES = [r"\d[\d\s]*[.,]\d{2}\s*(?:DT|TND|\$)", r"(?:DT|TND|€|\$)\s*\d[\d\s]*[.,]?\d*", r"\d+[.,]?\d*\s*(?:DT|TND|€|\$)"]
# Endings of file names that look like addresses.
NOT_EMAIL = [".png", ".jpg", ".gif", ".svg", ".css", ".js"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The search intents' words, by strength.
INTENTS = {
    "transactional": {
        3: [
            "buy|purchase|order|checkout|cart|payment", "book|booking|reserve|subscription", "price|pricing|cost|quote|estimate",
            "download|install|get|acquire", "trial|demo|signup|sign up|register", "hire|employ|engage|contract",
        ],
        2: ["deal|offer|discount|coupon|sale", "free|cheap|affordable|budget", "shop|store|market|vendor"],
        1: ["get started|begin|start", "contact|call|phone"],
    },
    "commercial": {
        3: [
            "best|top|leading|premier", "vs|versus|compare|comparison", "review|reviews|rating|ratings", "alternative|alternatives|options",
        ],
        2: [
            "features|benefits|advantages", "pros|cons|disadvantages", "recommendation|recommend", "evaluation|assess|analysis",
        ],
        1: ["quality|performance|reliability", "popular|trending|latest"],
    },
    "informational": {
        3: [
            "how|what|why|when|where|which", "guide|tutorial|instruction|manual", "learn|study|understand|explain", "definition|meaning|concept",
        ],
        2: [
            "tips|advice|help|assistance", "examples|samples|instances", "strategy|method|approach|technique", "steps|process|procedure",
        ],
        1: ["information|info|details|facts", "overview|introduction|basics", "faq|questions|answers"],
    },
    "navigational": {
        3: ["login|log in|sign in|signin", "dashboard|account|profile", "homepage|home|main page", "contact|about|support"],
        2: [
            "help center|customer service", "terms|privacy|policy", "location|address|directions", "career|jobs|employment",
        ],
        1: ["site|website|portal|platform", "official|main|primary"],
    },
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def plain_tokens(text: Column, least: int = 3, stopwords: bool = False) -> Column:
    """Words of a-z and 0-9 only, of some length, without stop words unless asked for."""
    keep = F.filter(words(text), lambda w: w.rlike("^[a-z0-9]+$") & (F.length(w) >= least))
    return keep if stopwords else F.filter(keep, lambda w: ~w.isin(*STOPWORDS))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens; joined by shifts, so that the tokens are made n times and not once for every run."""
    out = tokens
    for k in range(1, n):
        shifted = F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1)))
        pairs = F.zip_with(out, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.filter(pairs, lambda x: x.isNotNull())
    return out


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.when(w.endswith("e") & ~w.endswith("le"), F.regexp_replace(w, "e$", "")).otherwise(w)
    return F.when(word == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]+"))))


def stem(word: Column) -> Column:
    out = None
    for end in ENDINGS:
        test = word.endswith(end) & (F.length(word) > len(end) + 2)
        cut = F.regexp_replace(word, f"{end}$", "")
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(word)


# Letters, digits and _; with a letter beyond 16 bits in the pattern, what is looked back at is read by code points.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_𝒳]%s)", r"(?![\p{L}\p{N}_])"


def _of_stem(word: str) -> str:
    """A pattern for the whole words that may have the stem of a word; it looks back only where a root stands."""
    roots = sorted({re.escape(word[: len(word) - len(end)]) for end in ("", *ENDINGS) if word.endswith(end)})
    return f"(?:{'|'.join(r + _BEFORE % r for r in roots)})(?:{'|'.join(ENDINGS)})?{_AFTER}"


def _any_word(found: list[str]) -> str:
    """A pattern for whole words, told apart by their first letters, so that few are tried at a place."""
    first = sorted({w[0] for w in found})
    return r"\b(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in found if w[0] == c)})" for c in first) + r")\b"


def intent_scores(text: Column) -> Column:
    """The points of every intent, as a struct: the words of all intents are found in one pass, their phrases in another."""
    points: dict[str, list[int]] = {}
    for k, strengths in enumerate(INTENTS.values()):
        for weight, groups in strengths.items():
            for word in "|".join(groups).split("|"):
                points.setdefault(word, [0] * len(INTENTS))[k] += weight
    low = F.lower(F.coalesce(text, F.lit("")))
    phrases = [w for w in points if " " in w]  # their words may count for themselves too
    hits = F.concat(*[F.regexp_extract_all(low, F.lit(_any_word(ws)), F.lit(0)) for ws in ([w for w in points if " " not in w], phrases)])
    table = F.create_map(*[x for w, p in points.items() for x in (F.lit(w), F.array(*map(F.lit, p)))])
    found = F.transform(hits, lambda h: F.element_at(table, h))

    def summed(rows: Column) -> Column:
        total = lambda k: F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, p: a + F.get(p, F.lit(k)))
        return F.struct(*[total(k).alias(name) for k, name in enumerate(INTENTS)])

    return F.element_at(F.transform(F.array(found), summed), 1)


def intent_score(text: Column, intent: str) -> Column:
    return intent_scores(text)[intent]


def price_matches(text: Column) -> Column:
    out = F.lit(0)
    for p in PRICES:
        out = out + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return out


def first_price(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in PRICES])


def times_in(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlaps, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(part.lower()), F.lit("")))) / len(part)).cast("int")


def keyword_usage(text: Column, keywords: list[str], most: int = 8) -> Column:
    """Per target keyword: its count, its share of all words in percent, and words of the same stem, as an array of structs.

    Words are found in the text by patterns, without an array of all of them: those of one stem are the stem with an ending or none.
    """
    every = lambda low: F.regexp_count(low, F.lit(f"{_BEFORE % ''}[a-z0-9]++{_AFTER}"))

    def one(keyword: str, x: Column) -> Column:
        low = keyword.lower()
        n = ((F.length(x["low"]) - F.length(F.replace(x["low"], F.lit(low), F.lit("")))) / len(keyword)).cast("int")
        root = stem(F.lit(low.split()[0]))
        found = F.array_distinct(F.regexp_extract_all(x["low"], F.lit(_of_stem(low.split()[0])), F.lit(0)))
        kin = F.filter(found, lambda w: (F.length(w) >= 4) & w.rlike("^[a-z0-9]+$") & ~w.isin(*STOPWORDS) & (stem(w) == root) & (w != low))
        return F.struct(
            F.lit(keyword).alias("keyword"), n.alias("n"), F.round(n / F.greatest(x["every"], F.lit(1)) * 100, 2).alias("percent"),
            F.slice(F.array_sort(kin), 1, most).alias("variants"),
        )

    lowered = F.array(F.lower(F.coalesce(text, F.lit(""))))  # made once, and the words counted once, for all keywords
    counted = F.transform(lowered, lambda low: F.struct(low.alias("low"), every(low).alias("every")))
    return F.element_at(F.transform(counted, lambda x: F.array(*[one(k, x) for k in keywords])), 1)


def emails(text: Column) -> Column:
    """The distinct e-mail addresses in a text, in order, without names of files."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)))
    return F.filter(found, lambda e: ~F.lower(e).rlike("|".join(x.replace(".", r"\.") for x in NOT_EMAIL)))


def collapsed(text: Column) -> Column:
    """White space run together and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flesch(text: Column) -> Column:
    """n_words, n_sentences, score (null under 100 words or 3 sentences), band, grade and averages, as a struct."""
    value = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"), F.lit(0))
    sentences = F.size(F.filter(F.split(value, r"[.!?]+"), lambda s: F.trim(s) != ""))
    beats = F.aggregate(F.transform(found, lambda w: syllables(w).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    made = F.struct(F.size(found).alias("w"), sentences.alias("s"), beats.alias("b"))

    def scored(x: Column) -> Column:
        enough = (x["w"] >= 100) & (x["s"] >= 3)
        long, heavy = x["w"] / x["s"], x["b"] / x["w"]
        score = F.when(enough, F.round(206.835 - 1.015 * long - 84.6 * heavy, 2))
        band = (
            F.when(score >= 90, "very_easy").when(score >= 70, "easy").when(score >= 60, "plain").when(score >= 50, "fairly_difficult")
            .when(score >= 30, "difficult").when(score.isNotNull(), "very_difficult")
        )
        return F.struct(
            x["w"].alias("n_words"), x["s"].alias("n_sentences"), score.alias("score"), band.alias("band"),
            F.when(enough, F.round(0.39 * long + 11.8 * heavy - 15.59, 2)).alias("grade"),
            F.when(enough, F.round(long, 2)).alias("sentence_length"), F.when(enough, F.round(heavy, 2)).alias("syllables_per_word"),
        )

    return F.element_at(F.transform(F.array(made), scored), 1)


def text_html_ratio(text: Column, html: Column) -> Column:
    """percent and status, as a struct."""
    percent = F.when(F.length(html) == 0, 0.0).otherwise(F.round(F.length(text) / F.length(html) * 100, 2))
    return F.struct(percent.alias("percent"), F.when(percent < 15, "low_ratio").when(percent > 70, "high_ratio").otherwise("calculated").alias("status"))


def passive_ratio(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.size(F.filter(F.split(low, r"\s+"), lambda x: x != ""))
    return F.round(F.regexp_count(low, F.lit(r"\b(was|were|be|been|being)\b\s+\b(\w+ed)\b")) / F.greatest(F.lit(1), tokens), 3)


def minification(content: Column) -> Column:
    """Whether a script or style sheet looks minified, and what tells so, as a struct."""
    lines = F.size(F.split(F.regexp_replace(content, r"\r?\n$", ""), r"\r\n|\r|\n"))
    chars = F.length(content)
    blank = F.regexp_count(content, F.lit(r"\s")) / chars
    long = chars / lines
    tight = ((lines == 1) & (chars > 500)) | ((lines > 1) & ((blank < 0.15) | (long > 200)))
    none = F.coalesce(content, F.lit("")) == ""
    zero = F.lit(0.0)
    return F.struct(
        F.when(none, False).otherwise(tight).alias("is_minified"),
        F.when(none, zero).otherwise(F.round(blank, 3)).alias("whitespace_ratio"),
        F.when(none, zero).otherwise(F.round(long, 1)).alias("avg_line_length"),
        F.when(none, 0).otherwise(lines).alias("line_count"),
        F.coalesce(chars, F.lit(0)).alias("char_count"),
    )
