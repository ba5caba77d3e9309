"""What a page loads and where it leads, by stored answers: caching, minification, broken targets, speed audits; and a page's whole report.

assets is an array of (url, status_code, headers, resource_type, text) beside the page, a missing answer has no status; probes
are rows (url, status), where the status is a number or what went wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, terms, text, urls
from . import checks, site
from .checks import _attr, _has, _no

ASSETS = "array<struct<url:string,status_code:int,headers:map<string,string>,resource_type:string,text:string>>"
# How many are looked at, the largest sizes, and the elements and audits by their names.
MOST_ASSETS, MOST_INLINE, MOST_PROBES = 10, 3, 10
MOST_CHARS, MOST_INLINE_CHARS = 1024 * 1024, 100 * 1024
ELEMENTS = {"javascript": "script", "css": "style"}
AUDITS = ["first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index"]
CATEGORIES = {"performance": "performance_score", "accessibility": "accessibility_score", "best-practices": "best_practices_score", "seo": "seo_score", "pwa": "pwa_score"}


def _of_kind(kind: str) -> Column:
    return F.slice(F.filter(F.coalesce(F.col("assets"), F.array().cast(ASSETS)), lambda a: a["resource_type"] == kind), 1, MOST_ASSETS)


def caching(kind: str) -> Column:
    """status, n_checked and, per asset, which cache headers it has, as a struct; kind: image, javascript or css."""
    said = lambda a, name: F.coalesce(site.header(a["headers"], name), F.lit(""))

    def one(a: Column) -> Column:
        return F.struct(
            a["url"].alias("url"), F.when(a["status_code"].isNull(), "error_fetching").otherwise("ok").alias("status"), a["status_code"].alias("status_code"),
            *[(said(a, h) != "").alias(f"has_{h.lower().replace('-', '_')}") for h in ("Cache-Control", "Expires", "ETag")],
        )

    found = _of_kind(kind)
    return F.struct(F.when(F.size(found) > 0, "completed").otherwise(f"no_{kind}_found").alias("status"), F.size(found).alias("n_checked"), F.transform(found, one).alias("details"))


def minification(kind: str) -> Column:
    """status, how many of the page's loaded and own scripts (or styles) were checked, are minified or failed, as a struct."""
    loaded, tag = _of_kind(kind), ELEMENTS[kind]
    own = F.filter(F.col("nodes"), lambda n: (n["tag"] == tag) & (F.lit(tag == "style") | ~_has(n, "src")) & _no(F.trim(n["text"]) != ""))
    size = lambda a: F.coalesce(site.header(a["headers"], "Content-Length").try_cast("bigint"), F.lit(0))
    texts = F.concat(
        F.transform(F.filter(loaded, lambda a: a["status_code"].isNotNull() & a["text"].isNotNull() & (size(a) <= MOST_CHARS)), lambda a: a["text"]),
        F.filter(F.transform(F.slice(own, 1, MOST_INLINE), lambda n: F.trim(n["text"])), lambda t: F.length(t) <= MOST_INLINE_CHARS),
    )
    failed = F.size(F.filter(loaded, lambda a: a["status_code"].isNull() | a["text"].isNull()))
    n, tight = F.size(texts), F.size(F.filter(texts, lambda t: text.minification(t)["is_minified"]))
    status = (
        F.when((F.size(loaded) == 0) & (F.size(own) == 0), f"no_{kind}_found_or_analyzed")
        .when((failed > 0) & (n == 0), "error_all_failed").when(failed > 0, "completed_with_errors").otherwise("completed")
    )
    return F.struct(status.alias("status"), n.alias("n_checked"), tight.alias("n_minified"), failed.alias("n_failed"))


def image_urls() -> Column:
    """The addresses of all images, of img and of the candidates of source, each once."""
    at = lambda src: F.when(~src.startswith("data:") & ~src.startswith("blob:") & (src != ""), urls.resolve(F.col("url"), src))
    of_img = F.transform(F.filter(F.col("nodes"), lambda n: (n["tag"] == "img") & _has(n, "src")), lambda n: at(_attr(n, "src")))
    sets = F.filter(F.col("nodes"), lambda n: (n["tag"] == "source") & _has(n, "srcset"))
    of_source = F.flatten(F.transform(sets, lambda n: F.transform(F.split(_attr(n, "srcset"), ","), lambda c: at(F.substring_index(F.trim(c), " ", 1)))))
    return F.array_distinct(F.array_compact(F.concat(of_img, of_source)))


def broken(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """page_id, broken_links, broken_images: of each page's first links and images, those whose probe failed or answered 400 or more.

    A target without a probe isn't broken.  Only the failed probes are joined, each URL once.
    """
    made = checks.check(pages, "all_links", "images_to_probe", of=(checks.with_links, checks.images))
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), F.slice(c, 1, MOST_PROBES).alias("urls")) for kind, c in (("links", "all_links"), ("images", "images_to_probe"))])
    each = made.select("page_id", F.explode(both).alias("b")).select("page_id", "b.kind", F.posexplode("b.urls").alias("pos", "url"))
    bad = probes.where(F.coalesce(F.col("status").try_cast("int") >= 400, F.col("status").isNotNull())).groupBy("url").agg(F.min("status").alias("status"))
    found = each.join(bad, "url").groupBy("page_id").agg(*[  # at most MOST_PROBES of a kind for each row of the page
        F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "url", "status")))).alias(k) for k in ("links", "images")])
    none = F.array().cast("array<struct<pos:int,url:string,status:string>>")
    plain = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: F.struct(x["url"].alias("url"), x["status"].alias("status")))
    return made.select("page_id").join(found, "page_id", "left").select("page_id", plain("links").alias("broken_links"), plain("images").alias("broken_images"))


def with_responses(pages: DataFrame, responses: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """pages with the response that scores() asks for: the page's own answer, and what its site's files and its links' probes show."""
    own = responses.groupBy("url").agg(F.max_by(F.struct("status", "headers"), "status").alias("own"))
    facts = site.site_checks(responses).select("origin", "has_sitemap", "custom_404")
    files = site.robots(responses).groupBy("origin").agg(F.bool_or(F.col("robots_status") == "found").alias("robots_found"))
    out = pages.withColumn("origin", site.origin_of(F.col("url"))).join(own, "url", "left").join(facts, "origin", "left").join(files, "origin", "left")
    broken_links = F.lit(0)
    if probes is not None:
        counts = broken(pages, probes).select("page_id", F.size("broken_links").alias("n_broken")).groupBy("page_id").agg(F.max("n_broken").alias("n_broken"))
        out, broken_links = out.join(counts, "page_id", "left"), F.coalesce("n_broken", F.lit(0))
    made = F.struct(
        F.col("own.status").cast("int").alias("status"), F.col("own.headers").alias("headers"), F.lit(None).cast("string").alias("http_version"), F.lit(0).alias("redirects"),
        _no(F.col("robots_found")).alias("robots_found"), _no(F.col("has_sitemap")).alias("sitemap_found"), _no(F.col("custom_404")).alias("custom_404"), broken_links.alias("broken_links"),
    )
    return out.withColumn("response", made).select(*pages.columns, "response")


def speed(answer: Column) -> Column:
    """The scores, audits and field data of a stored speed report in JSON, as a struct; psi_status is error where it can't be read."""
    at = lambda path: F.get_json_object(answer, path)
    score = lambda name: F.round(at(f"$.lighthouseResult.categories['{name}'].score").try_cast("double") * 100).cast("int")
    audit = lambda name: F.coalesce(F.nullif(at(f"$.lighthouseResult.audits['{name}'].displayValue"), F.lit("")), at(f"$.lighthouseResult.audits['{name}'].numericValue"))
    return F.struct(
        F.when(F.try_parse_json(answer).isNotNull(), "ok").otherwise("error").alias("psi_status"), *[score(k).alias(v) for k, v in CATEGORIES.items()],
        *[audit(k).alias(k.replace("-", "_")) for k in AUDITS],
        at("$.loadingExperience.overall_category").alias("field_category"), at("$.originLoadingExperience.overall_category").alias("origin_field_category"),
        at("$.loadingExperience.metrics").alias("field_metrics"),
    )


def related_terms(value: Column, keywords: list[str], k: int = 20) -> Column:
    """The k most frequent longer words of a text but for the keywords; ties by first position."""
    return F.transform(terms.top(value, 1, k, 4, tuple(w.lower() for w in keywords)), lambda r: r["term"])


def misspelled(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20) -> DataFrame:
    """id, n_misspelled and a sample of the words of a-z, three letters or more, that the dictionary (word) doesn't have.

    Words are made distinct within a row before they meet the dictionary; all words of a text count.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"), F.lit(0)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), words.alias("words"))
    each = rows.select("row", F.col(id_col), F.explode_outer("words").alias("word"))
    known = dictionary.select(F.lower("word").alias("word")).distinct().withColumn("known", F.lit(True))
    bad = F.when(F.col("known").isNull(), F.col("word"))
    out = each.join(known, "word", "left").groupBy("row", id_col).agg(F.count(bad).alias("n_misspelled"), F.sort_array(F.collect_list(bad)).alias("all"))
    return out.select(id_col, "n_misspelled", F.slice("all", 1, sample).alias("sample"))


def report(pages: DataFrame, now: Column) -> DataFrame:
    """page_id, analysis_timestamp, target_url, domain and seo_attributes: a struct a module, made in one select over the parsed page.

    A module that a page can't feed, as it has no parsed tree, is null and named in errors.
    """
    groups = {
        "on_page": checks.title() | checks.description() | checks.headings() | checks.images() | checks.with_links() | checks.social() | checks.markup() | checks.dates(),
        "technical": checks.technical() | checks.structured(),
        "content": checks.content(),
    }
    parsed = F.col("nodes").isNotNull()
    modules = [F.when(parsed, F.struct(*[c.alias(n) for n, c in group.items()])).alias(name) for name, group in groups.items()]
    target = urls.with_scheme(F.col("url"))
    added = {
        "analysis_timestamp": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), "target_url": target, "domain": urls.netloc(target), "seo_attributes": F.struct(*modules),
        "errors": F.when(parsed, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, groups))),
    }
    made = pages.withColumn("links", checks.page_links()).withColumns(added)
    scored = ("on_page", "technical", "content", "overall")
    return checks.scores(made, keep=tuple(added)).select("page_id", *added, F.struct(*scored).alias("scoring"))
