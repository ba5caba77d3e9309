"""Checks of single pages.  Each takes the columns of parsed_pages() and adds plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms, text

# Pixel widths of characters, and marketing words.
CHAR_PX = {
    "i": 4, "l": 4, "j": 5, "t": 6, "f": 6, "r": 6, " ": 3, "I": 6, "J": 7, "1": 7, "s": 7, "z": 7, "a": 7, "c": 7, "e": 7, "o": 8,
    "u": 8, "k": 8, "v": 8, "x": 8, "y": 8, "A": 9, "B": 10, "C": 10, "D": 10, "E": 9, "F": 9, "G": 10, "H": 10, "K": 10, "L": 9,
    "M": 12, "N": 10, "O": 10, "P": 10, "Q": 10, "R": 10, "S": 9, "T": 9, "U": 10, "V": 10, "W": 12, "X": 10, "Y": 10, "Z": 9,
}
POWER_WORDS = [
    "ultimate", "proven", "best", "top", "essential", "secret", "exclusive", "easy", "quick", "simple", "step-by-step", "definitive",
    "complete", "powerful", "effective", "free", "instant", "guaranteed", "new", "now", "today",
]
CTA_PHRASES = [
    "learn more", "read more", "buy now", "shop now", "get started", "try now", "sign up", "contact us", "book now", "download", "discover",
    "find out", "see how", "start now", "join now", "request a quote", "subscribe",
]

def pixels(value: Column) -> Column:
    """The estimated width; one count for each width keeps it inside generated code."""
    by_width: dict[int, str] = {}
    for ch, px in CHAR_PX.items():
        by_width[px] = by_width.get(px, "") + ch
    known = "".join(CHAR_PX)
    out = (F.length(value) - F.regexp_count(value, F.lit(f"[{known}]"))) * 9
    for px, chars in by_width.items():
        out = out + F.regexp_count(value, F.lit(f"[{chars}]")) * px
    return out


def tag_counts(pages: DataFrame) -> DataFrame:
    """explode() would have Spark ask first for pages with nodes, and parse every page twice."""
    tags = pages.select("page_id", F.explode_outer("nodes.tag").alias("tag")).where("tag IS NOT NULL")
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def top_terms(docs: DataFrame, n: int = 1, k: int = 10, text_col: str = "text") -> DataFrame:
    """The k most frequent n-grams of every document, ties by first position; counted within the row, without a shuffle."""
    made = docs.select("doc_id", terms.top(F.col(text_col), n, k, 4 if n == 1 else 3).alias("top"))  # single words are longer
    top = made.select("doc_id", F.posexplode("top").alias("rank", "r"))
    return top.select("doc_id", F.col("r.term").alias("term"), F.col("r.n").alias("n"), (F.col("rank") + 1).alias("rank"))


def readability(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Words, sentences, syllables and the Flesch score (null under 100 words or 3 sentences)."""
    value = F.coalesce(F.col(text_col), F.lit(""))
    found = F.regexp_extract_all(value, F.lit(r"[A-Za-z]+"), F.lit(0))
    sentences = F.size(F.filter(F.split(value, r"[.!?]+"), lambda s: s.rlike(r"[A-Za-z]")))
    out = docs.select(
        "doc_id",
        F.size(found).cast("bigint").alias("n_words"),
        sentences.cast("bigint").alias("n_sentences"),
        F.aggregate(F.transform(found, lambda w: text.syllables(w).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_syllables"),
    )
    enough = (F.col("n_words") >= 100) & (F.col("n_sentences") >= 3)
    flesch = 206.835 - 1.015 * F.col("n_words") / F.col("n_sentences") - 84.6 * F.col("n_syllables") / F.col("n_words")
    return out.withColumn("flesch", F.when(enough, flesch))


def intents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    best = F.greatest(*text.INTENTS)
    primary = F.lit("informational")
    for k in reversed(["transactional", "commercial", "informational", "navigational"]):
        primary = F.when((F.col(k) == best) & (best > 0), k).otherwise(primary)
    return docs.select("doc_id", text.intent_scores(F.col(text_col)).alias("s")).select("doc_id", "s.*").withColumn("primary_intent", primary)


def duplicate_content(docs: DataFrame, text_col: str = "text", head: int = 1500) -> DataFrame:
    """Groups of documents whose first characters are the same.  Null texts count as no document: a filter on a text made in Python would make it twice."""
    return (
        docs.groupBy(F.md5(F.substring(F.col(text_col), 1, head).cast("binary")).alias("content_hash"))
        .agg(F.count(text_col).alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .where("n_docs > 1")
    )
