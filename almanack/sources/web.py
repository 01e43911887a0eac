"""Readers of pages and services through a fetch function: paged, with retries, by categories and by links.

Whatever reaches the network is a function the caller gives; these operators decide what to ask for, and when.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Fetch = Callable[[str], tuple[int, object]]


@dataclass
class Patience:
    """How often a service is asked: a pause between requests, longer after each failure, longest after a refusal (429)."""

    tries: int = 6
    pause: float = 0.1
    cool_down: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def get(self, fetch: Fetch, url: str) -> object | None:
        """The answer, or None once all tries failed; 404 is asked once."""
        for n in range(self.tries):
            status, body = fetch(url)
            if status == 200:
                self.sleep(self.pause)
                return body
            if status == 404:
                return None
            self.sleep(self.cool_down if status == 429 else self.pause * 2**n)
        return None


def paged(fetch: Fetch, url: Callable[[object], str], patience: Patience, most: int = 40) -> Iterator[object]:
    """The answers of a paged service: the token `continue` of one asks for the next, at most `most` times."""
    token = None
    for _ in range(most):
        body = patience.get(fetch, url(token))
        if body is None:
            return
        yield body
        token = body.get("continue")
        if token is None:
            return


def fetch_all(urls: DataFrame, column: str, fetch: Fetch, patience: Patience | None = None) -> DataFrame:
    """urls with body, null where nothing came: a few requests at once, one after the other in each partition."""
    schema = T.StructType([*urls.schema.fields, T.StructField("body", T.StringType())])

    def run(batches):
        calm = patience or Patience()
        for pdf in batches:
            bodies = [calm.get(fetch, u) for u in pdf[column]]
            yield pdf.assign(body=[None if b is None else str(b) for b in bodies])

    return urls.mapInPandas(run, schema)


def crawl(edges: DataFrame, roots: DataFrame, depth: int, limit: int, skip: Column | None = None) -> DataFrame:
    """(page, depth) of the pages that categories lead to: edges (category, member, is_category) are followed from roots (category)
    for `depth` levels, each category once; at most `limit` pages, nearest first. skip drops categories, such as those by date."""
    from almanack.session import cut

    level = roots.select("category").distinct()
    seen = cut(level.withColumn("depth", F.lit(0)))
    out = None
    for d in range(depth + 1):
        found = edges.join(level, "category")
        pages = found.where("NOT is_category").select(F.col("member").alias("page"), F.lit(d).alias("depth"))
        out = pages if out is None else out.unionByName(pages)
        if d == depth:
            break
        below = found.where("is_category").select(F.col("member").alias("category")).distinct()
        if skip is not None:
            below = below.where(~skip)
        level = cut(below.join(seen.select("category"), "category", "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level.withColumn("depth", F.lit(d + 1))))
    return out.groupBy("page").agg(F.min("depth").alias("depth")).orderBy("depth", "page").limit(limit)


def typed_query(kind: str, lo: int, hi: int, limit: int, least_links: int = 3) -> str:
    """The question to a knowledge base for things of a kind dated in [lo, hi], best known first."""
    return (
        f"SELECT ?item ?when ?links WHERE {{ ?item wdt:P31 wd:{kind}; wdt:P585|wdt:P580|wdt:P571 ?when; wikibase:sitelinks ?links. "
        f"FILTER(?links >= {least_links} && YEAR(?when) >= {lo} && YEAR(?when) <= {hi}) }} ORDER BY DESC(?links) LIMIT {limit}"
    )


def typed_items(fetch: Fetch, kind: str, lo: int, hi: int, limit: int, patience: Patience, fallback: Callable[[int], list] | None = None) -> list:
    """The answers of typed_query, or those of the decades' categories where the service gives none."""
    body = patience.get(fetch, typed_query(kind, lo, hi, limit))
    if body:
        return list(body)[:limit]
    found = [x for decade in range(lo // 10 * 10, hi + 1, 10) for x in (fallback(decade) if fallback else [])]
    return found[:limit]


def read_crawl_list(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """(source, domain, depth, limit) of lines `source | domain | depth | limit`, without comments and sources that are done."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|\z)"))
    p = F.split(F.regexp_replace("value", r"#.*\z", ""), r"\s*\|\s*")
    at = lambda i, default: F.coalesce(F.when(F.trim(F.get(p, F.lit(i))) != "", F.trim(F.get(p, F.lit(i)))), F.lit(default))
    jobs = lines.select(F.trim(p[0]).alias("source"), at(1, "").alias("domain"), at(2, "2").cast("int").alias("depth"), at(3, "500").cast("int").alias("limit"))
    return jobs if done is None else jobs.join(done.select("source"), "source", "left_anti")


def discover(titles: DataFrame, pages: DataFrame, listed: DataFrame, template: str | None = None, match: str | None = None, least_bytes: int = 40_000, limit: int = 50) -> DataFrame:
    """(title, size): candidates from titles (title), written into a template such as "History of {}", that exist among pages (title,
    target, size) after redirects, are large enough, keep the template's shape and aren't listed; the largest first."""
    t = titles.select("title").distinct()
    if match:
        t = t.where(F.col("title").rlike(f"(?i){match}"))
    if template:
        t = t.select(F.replace(F.lit(template), F.lit("{}"), F.col("title")).alias("title"))
    led = t.join(pages, "title").select(F.coalesce("target", "title").alias("title"), "size").distinct()
    led = led.where((F.col("size") >= least_bytes) & ~F.col("title").rlike(r"(?i)^(?:list|index|outline|timeline) of\b"))
    if template:
        led = led.where(F.col("title").rlike("(?i)^" + ".+".join(re.escape(x) for x in template.split("{}")) + r"\z"))
    fresh = led.join(listed.select(F.lower("title").alias("_k")), F.lower("title") == F.col("_k"), "left_anti")
    return fresh.orderBy(F.desc("size"), "title").limit(limit)


_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"' >#]+)"""


def links_of(html: Column) -> Column:
    """Distinct addresses that a page links, without places in it."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)))


def read_site(pages: DataFrame, index: str, levels: int = 2, most: int = 500) -> DataFrame:
    """(url, level) of a site's pages (url, html): its index, what that links below its own folder, what those link, each page once,
    the cap reached in order of level and address."""
    folder = index.rsplit("/", 1)[0] + "/"
    level = pages.where(F.col("url") == index).select("url", "html").withColumn("level", F.lit(0))
    out, known = level.select("url", "level"), level.select("url")
    for n in range(1, levels + 1):
        to = level.select(F.explode(links_of(F.col("html"))).alias("href")).select(F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(folder), F.regexp_replace("href", r"^\./", ""))).alias("url")).distinct()
        to = to.where(F.startswith("url", F.lit(folder))).join(known, "url", "left_anti")
        level = pages.join(to, "url").select("url", "html", F.lit(n).alias("level"))
        out, known = out.unionByName(level.select("url", "level")), known.unionByName(level.select("url"))
    return out.orderBy("level", "url").limit(most)


def bounded_map(rows: DataFrame, call: Callable[[object], object], column: str, workers: int = 4) -> DataFrame:
    """rows with `result`, by at most `workers` calls at once in each task; rows keep their order."""
    schema = T.StructType([*rows.schema.fields, T.StructField("result", T.StringType())])

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                yield pdf.assign(result=pd.Series([None if r is None else str(r) for r in pool.map(call, pdf[column])], index=pdf.index, dtype=object))

    return rows.mapInPandas(run, schema)
