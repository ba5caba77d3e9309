"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates and their places.  The candidates' hashes are then counted over the whole corpus by
distinct owners and repositories: a value that many owners hold is a widely copied example, one that a single
owner holds looks like a live credential.  Besides the base kinds, the scan finds GitHub tokens, JSON web
tokens and private keys.

A private key goes from its BEGIN line through its END line, and its value is what stands between them, without
white space and escaped line ends.  If the END line is missing before the next BEGIN line or the end of the text,
the key is the BEGIN line and the lines of 16 or more base64 characters right after it.  A key without a body is
listed, but has no value and so counts neither as live nor as an example.

Places come from matching ``(.*?)(pattern)`` over the whole text: the lengths of what lies between matches and
of the matches add up.  The texts are read once and never shuffled; the spans are written to the shared folder.
Candidates are aggregated by hash and owner before they are shuffled, and a hash that a third of all rows hold
is left to the splitting of skewed joins.

Defined cases: a null or empty text has no spans; a null owner or repository counts as one of its own; repeated
rows are reported once per row and count as one owner; spans of different kinds that start at the same place stand in
the order of the kinds; a very long text is matched as a whole in one task; columns other than the text,
the id, the owner and the language are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin

_ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
)
_VALUE = r"[A-Za-z0-9+/_.=-]"
_BEGIN, _END = (rf"-----{side} [A-Z ]{{0,40}}PRIVATE KEY-----" for side in ("BEGIN", "END"))
_BREAK = r"(?:\s|\\[nr])"
_CUT = rf"{_BEGIN}(?:{_BREAK}++[A-Za-z0-9+/=]{{16,}}+)*+"  # possessive, as Java's other loops over groups recurse
#: kind -> (pattern, what stands before the secret value in a match, least length of the value)
KINDS = {
    "assign": (rf"{_ASSIGN}{_VALUE}+", _ASSIGN, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", "", 20),
    "hex": (r"[0-9a-f]{24,}", "", 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", "", 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "", 28),
    "pem": (rf"{_BEGIN}.*?(?:{_END}|(?=-----BEGIN )|\z)", "", 0),
}
BASE = ("assign", "access", "hex")
#: What a text must contain for a kind to be worth a look with the pattern.
HINTS = {"access": "AKIA", "github": "gh", "jwt": "eyJ", "pem": "PRIVATE KEY-----"}
#: From so many distinct owners on, a value is a widely copied example.
WIDE = 3
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,hash:string>>"


def _key(hit: Column) -> Column:
    """The private key in what the pattern found: all of it with an END line, else the BEGIN line and the body after it."""
    return F.when(hit.rlike(rf"{_END}\z"), hit).otherwise(F.regexp_extract(hit, _CUT, 0))


def _body(key: Column) -> Column:
    """What stands between a key's BEGIN and END, without white space and escaped line ends; null if nothing does."""
    return F.nullif(F.regexp_replace(key, rf"^{_BEGIN}|{_END}\z|{_BREAK}", ""), F.lit(""))


def _spans(text: Column, kind: str, rank: int) -> Column:
    """The kind's matches in a text as structs (start, rank, stop, kind, hash of the value)."""
    pattern, before, least = KINDS[kind]
    both = F.lit(rf"(?s)(.*?)({pattern}|\z)")  # the end of the text matches too, else the search of the tail is quadratic
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, both, F.lit(1)).alias("gap"), F.regexp_extract_all(text, both, F.lit(2)).alias("hit")
    )
    empty = F.array().cast(_SPAN)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        hit = _key(pair["hit"]) if kind == "pem" else pair["hit"]
        stop = start + F.length(hit)
        value = _body(hit) if kind == "pem" else F.regexp_replace(hit, f"^{before}", "") if before else hit
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), F.sha2(value, 256).alias("hash")
        )
        kept = F.when(F.length(hit if kind == "pem" else value) >= (least or 1), F.array(span)).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(state["spans"], kept).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    found = F.aggregate(pairs, start, step, lambda s: s["spans"])
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(pattern)
    return F.when(hint, found).otherwise(empty)


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner: str = "source", repo: Column | None = None) -> DataFrame:
    """One row a document, pinned: rid, doc_id, owner, repo and its spans in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(*[_spans(text, k, r) for r, k in enumerate(KINDS)])
    repo = F.concat_ws("/", F.col(owner), F.col("lang")) if repo is None else repo
    return pin(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
            F.sort_array(spans).alias("spans"),
        ),
        "secrets",
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_places over the whole corpus."""
    each = found.where(F.size("spans") > 0).select("owner", "repo", F.explode("spans.hash").alias("hash")).where("hash IS NOT NULL")
    return (
        each.groupBy("hash", "owner", "repo")
        .agg(F.count("*").alias("n"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
        .groupBy("hash")
        .agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places"))
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how many of them are live or examples."""
    found = find(docs, **options)
    counts = ownership(found)
    classed = (
        found.where(F.size("spans") > 0)
        .select("rid", F.explode("spans.hash").alias("hash"))
        .join(counts, "hash")
        .groupBy("rid")
        .agg(
            F.count_if(F.col("n_owners") == 1).alias("n_live"),
            F.count_if(F.col("n_owners") >= WIDE).alias("n_examples"),
            F.max("n_owners").alias("most_owners"),
        )
    )
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    zero = F.lit(0).cast("bigint")
    return found.join(classed, "rid", "left").select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_examples", "most_owners")],
    )
