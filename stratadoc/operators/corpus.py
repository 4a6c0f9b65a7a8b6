"""Corpus selection: which pages, under which names, rendered how."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions.html import (
    article_html,
    article_html_nested,
    article_title,
    needs_nesting,
    plain_text,
)
from stratadoc.functions.text import col, section, slug, strip, title_rule, url_path
from stratadoc.operators.numbering import dense_index
from stratadoc.session import durable

#: Attempts of a corpus that are taken by an ordered limit.
MOST_AT_ONCE = 10_000


def clean_url(url) -> Column:
    return F.regexp_replace(F.substring_index(strip(url), '"', 1), "/+$", "")


def admit_urls(
    df: DataFrame,
    url: str = "url",
    *,
    must_contain: str = "/docs/",
    reject: tuple[str, ...] = ("_print", "/docs/contribute/"),
    gated: str = fv.API_SECTION,
    gate: tuple[str, ...] = fv.API_ALLOWED,
    prefix: str = fv.SITE + "/docs",
) -> DataFrame:
    """Cleaned URLs that pass every rule; those in the gated section need an allowed name."""
    u = F.col(url)
    keep = u.contains(must_contain) & u.startswith(prefix)
    for part in reject:
        keep &= ~u.contains(part)
    if gated:
        allowed = F.lit(False)
        for part in gate:
            allowed |= u.contains(part)
        keep &= ~u.contains(gated) | allowed
    return df.withColumn(url, clean_url(url)).where(keep)


def unique_urls(df: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """First place of each URL; copies are merged before the shuffle."""
    return df.groupBy(url).agg(F.min(pos).alias(pos)).select(pos, url)


def section_urls(df: DataFrame, sections=fv.SECTIONS, url: str = "url", default: str = "other") -> DataFrame:
    path = url_path(url)
    return df.withColumn("bucket", section(F.when(path == "", F.lit("/")).otherwise(path), sections, default))


def section_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket").agg(F.count("*").alias("urls"), F.min("url").alias("first_url"))


def select_by_quota(
    urls: DataFrame,
    n: int,
    *,
    quotas=fv.QUOTAS,
    sections=fv.SECTIONS,
    home: str | None = fv.SITE + "/docs/home/",
    home_path: str = "/docs/home",
    default: str = "other",
) -> DataFrame:
    """``place, url, bucket`` of at most ``n`` URLs out of ``pos, url``.

    Sections give their first URLs by name up to their quotas, then any URLs follow by position. The
    home page comes first; if no chosen URL is a home page it is put in. No step ranks the whole
    table: quotas are cut within every task, the rest is an ordered limit.
    """
    labelled = section_urls(urls, sections, default=default)
    spark = urls.sparkSession
    bare = (home or "").rstrip("/")
    has_home = bool(home) and not urls.where(F.regexp_replace("url", "/+$", "") == bare).isEmpty()
    taken = {name: want - (name == "home" and has_home) for name, want in quotas}
    order = F.lit(len(quotas))
    want = F.lit(0)
    for i, (name, _) in enumerate(quotas):
        order = F.when(F.col("bucket") == name, F.lit(i)).otherwise(order)
        want = F.when(F.col("bucket") == name, F.lit(max(0, taken[name]))).otherwise(want)
    pool = labelled.where(F.col("bucket").isin(*taken) & (F.col("url") != F.lit(home or "")))
    by_name = Window.partitionBy("bucket").orderBy("url")
    largest = max([max(0, q) for q in taken.values()] or [0])
    quota_rows = (
        pool.withColumn("_n", F.row_number().over(by_name))
        .where(F.col("_n") <= largest)
        .where(F.col("_n") <= want)
        .select(F.lit(1).alias("_part"), order.alias("_o"), F.col("_n").cast("long").alias("_i"), "url", "bucket")
    )
    # At most sum(quotas) rows, so this broadcast cannot grow with the table.
    chosen = F.broadcast(quota_rows.select("url"))
    rest = (
        labelled.where(F.col("url") != F.lit(home or ""))
        .join(chosen, "url", "left_anti")
        .orderBy("pos")
        .limit(n)
        .select(F.lit(2).alias("_part"), F.lit(0).alias("_o"), F.col("pos").cast("long").alias("_i"), "url", "bucket")
    )
    picked = quota_rows.unionByName(rest)
    home_row = spark.range(1).select(
        F.lit(0).alias("_part"),
        F.lit(0).alias("_o"),
        F.lit(0).cast("long").alias("_i"),
        F.lit(home).alias("url"),
    )
    home_row = section_urls(home_row, sections, default=default)
    place = ["_part", "_o", "_i"]
    if has_home:
        picked = picked.unionByName(home_row)
    picked = picked.orderBy(*place).limit(n)
    if home and not has_home:
        # At most n rows are looked at.
        known = picked.agg(F.coalesce(F.bool_or(F.col("url").contains(home_path)), F.lit(False)).alias("k"))
        forced = known.where(~F.col("k")).select(F.lit(home).alias("url"))
        forced = section_urls(forced, sections, default=default).select(
            F.lit(0).alias("_part"), F.lit(0).alias("_o"), F.lit(0).cast("long").alias("_i"), "url", "bucket"
        )
        picked = picked.unionByName(forced).orderBy(*place).limit(n)
    return picked.select(
        F.row_number().over(Window.orderBy(*place)).alias("place"), "url", "bucket"
    )


def attempts(picked: DataFrame, urls: DataFrame) -> DataFrame:
    """``seq, url``: the picked URLs, then all others by position, to be tried until enough succeed."""
    # A selection has at most its n rows; written once, it is not worked out again by every step.
    picked = durable(picked)
    tried = picked.select(F.col("place").cast("long").alias("seq"), "url")
    n = picked.count()
    others = urls.join(F.broadcast(picked.select("url")), "url", "left_anti")
    return tried.unionByName(dense_index(others, ["pos"], "seq", first=n + 1).select("seq", "url"))


def first_attempts(picked: DataFrame, urls: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of :func:`attempts`; an ordered limit instead of numbers for the whole table."""
    picked = durable(picked)
    known = picked.count()
    tried = picked.select(F.col("place").cast("long").alias("seq"), "url")
    others = urls.join(F.broadcast(picked.select("url")), "url", "left_anti").orderBy("pos").limit(max(n - known, 0))
    # At most n rows are numbered.
    numbered = others.select((F.row_number().over(Window.orderBy("pos")) + known).cast("long").alias("seq"), "url")
    return tried.unionByName(numbered).where(F.col("seq") <= n)


def number_slugs(df: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """Add ``slug``; a slug met before gets ``_<seq>`` appended.

    A slug counts as met if an earlier row has it by nature, or was given it by this very rule. Only
    the first place per slug is aggregated, so a slug shared by a third of all rows costs one row per
    task. The second case needs a row named like ``<other slug>_<number>``; those few are resolved
    level by level until none changes.
    """
    base = df.withColumn("_slug", slug(url))
    first = base.groupBy("_slug").agg(F.min(seq).alias("_first"))
    marked = durable(base.join(first, "_slug").withColumn("_met", F.col(seq) > F.col("_first")))
    # Rows that could meet a generated name: the numbered row must exist, be earlier and be renamed.
    suffix = r"^(.*)_([0-9]{1,18})$"
    suspects = marked.where(~F.col("_met") & F.regexp_like("_slug", F.lit(suffix))).select(
        F.col(seq).alias("_seq"),
        F.regexp_extract("_slug", suffix, 1).alias("_from"),
        F.regexp_extract("_slug", suffix, 2).cast("long").alias("_by"),
    )
    extra = None
    renamed = marked.where("_met").select(F.col("_slug").alias("_from"), F.col(seq).cast("long").alias("_by"))
    while extra is not None or not suspects.isEmpty():
        hit = durable(suspects.join(renamed, ["_from", "_by"]).where(F.col("_by") < F.col("_seq")).select("_seq"))
        if hit.isEmpty():
            break
        extra = hit if extra is None else extra.unionByName(hit)
        renamed = marked.join(hit, marked[seq] == hit["_seq"]).select(
            F.col("_slug").alias("_from"), F.col(seq).cast("long").alias("_by")
        )
    if extra is not None:
        extra = extra.distinct().withColumn("_late", F.lit(True))
        marked = marked.join(extra, marked[seq] == extra["_seq"], "left").withColumn(
            "_met", F.col("_met") | F.coalesce("_late", F.lit(False))
        )
    named = F.when(F.col("_met"), F.concat_ws("_", "_slug", F.col(seq).cast("string"))).otherwise(F.col("_slug"))
    return marked.withColumn("slug", named).select(*df.columns, "slug")


def extract_articles(pages: DataFrame, html: str = "html", default_title: str = fv.DEFAULT_TITLE) -> DataFrame:
    """Add ``title`` and ``article``.

    Looks first whether any page has nested candidates; a table without one, as most are, gets a plan
    without a Python stage. With some, the stage sees null instead of the simple pages.
    """
    titled = pages.withColumn("title", article_title(html, default_title))
    nested = F.coalesce(needs_nesting(html), F.lit(False))
    if pages.where(nested).select(F.lit(1)).isEmpty():
        return titled.withColumn("article", article_html(html))
    hard = article_html_nested(F.when(nested, F.col(html)))
    return titled.withColumn("article", F.when(nested, hard).otherwise(article_html(html)))


def rendered(title="title", url="url", body="body") -> Column:
    """Text file of a page."""
    return F.concat(
        col(title), F.lit("\n"), title_rule(title), F.lit("\nSource: "), col(url), F.lit("\n\n"), col(body), F.lit("\n")
    )


def rendered_markdown(title="title", url="url", body="body") -> Column:
    return F.concat(
        F.lit("# "), col(title), F.lit("\n\n**Source:** "), col(url), F.lit("\n\n"), col(body), F.lit("\n")
    )


def build_corpus(picked: DataFrame, urls: DataFrame, pages: DataFrame, n: int = fv.TARGET_PAGES) -> DataFrame:
    """``seq, slug, url, title, text`` of the first ``n`` attempts whose page has an article.

    Attempts are taken, named and parsed in rounds of growing size until ``n`` have an article, so that no
    more than a few times the pages that are wanted are touched unless most of them fail. A name depends on
    earlier attempts alone, so it is the same in every round. Beyond ``MOST_AT_ONCE`` attempts, all of them are numbered.
    """
    picked = durable(picked)
    done, bound, count, rounds = 0, 2 * n, 0, []
    while not rounds or count < n:
        if bound <= MOST_AT_ONCE:
            tried = durable(first_attempts(picked, urls, bound))
        else:
            tried = durable(attempts(picked, urls))
        named = durable(number_slugs(tried).where(F.col("seq") > done))
        found = extract_articles(named.join(pages.select("url", "html"), "url"))
        body = found.where(F.col("article").isNotNull()).withColumn("body", plain_text("article"))
        rounds.append(durable(body.select("seq", "slug", "url", "title", rendered().alias("text"))))
        count += rounds[-1].count()
        if bound > MOST_AT_ONCE or tried.count() < bound:
            break
        done, bound = bound, 4 * bound
    return reduce(DataFrame.unionByName, rounds).orderBy("seq").limit(n)
