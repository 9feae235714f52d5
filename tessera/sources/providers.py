"""Search providers: what answers a query with hits (url, title, snippet, engine)."""

from __future__ import annotations

import contextlib
import html as html_escapes
import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import scalar as S
from ..operators.rank import lexical_scorer, merge_providers
from .html import extract, title_column

HIT = "query_id long, rank int, url string, title string, snippet string, engine string"


class TableProvider:
    """Answers from a table of pages (url, html): those that share words with the query's text, best first. Needs no network."""

    def __init__(self, pages: DataFrame, name: str = "table"):
        self.pages, self.name = pages, name

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        pages = self.pages.select("url", title_column(F.col("html")).alias("title"))
        words = lambda c: F.array_distinct(F.transform(S.words(c), F.lower))
        asked = queries.select("query_id", "query", F.explode(words(F.col("query"))).alias("w"))
        met = asked.join(pages.select("url", "title", F.explode(words(F.col("title"))).alias("w")), "w").select("query_id", "query", "url", "title").distinct()
        scored = met.withColumn("score", lexical_scorer(F.col("query"), F.col("title")))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "url", "title", F.col("title").alias("snippet"), F.lit(self.name).alias("engine"))


class JsonProvider:
    """Asks instances of a metasearch service over HTTP; the first that answers is kept until it fails."""

    def __init__(self, instances: list[str], timeout: float = 10.0, get: Callable[[str, float], bytes] | None = None):
        self.instances, self.timeout, self.get = instances, timeout, get or http_get

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        instances, timeout, get = self.instances, self.timeout, self.get

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            working = None
            for part in parts:
                rows = []
                for query_id, query in zip(part["query_id"], part["query"], strict=True):
                    for instance in [working] if working else instances:
                        try:
                            answer = json.loads(get(f"{instance}/search?{urllib.parse.urlencode({'q': query, 'format': 'json'})}", timeout))
                        except (OSError, ValueError):
                            working = None
                            continue
                        working = instance
                        rows += [(query_id, i + 1, h.get("url", ""), h.get("title", ""), h.get("content", ""), h.get("engine", "")) for i, h in enumerate(answer.get("results", [])[:k]) if h.get("url")]
                        break
                yield pd.DataFrame(rows, columns=["query_id", "rank", "url", "title", "snippet", "engine"])

        return queries.select("query_id", "query").mapInPandas(run, HIT)


class HtmlProvider:
    """Asks a search site that answers with a page of links; what redirects through the site is taken at its target. Rows without a URL are left out."""

    def __init__(self, address: str = "https://html.duckduckgo.com/html/", name: str = "html", timeout: float = 10.0, get: Callable[[str, float], bytes] | None = None):
        self.address, self.name, self.timeout, self.get = address, name, timeout, get or http_get

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        address, name, timeout, get = self.address, self.name, self.timeout, self.get

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for query_id, query in zip(part["query_id"], part["query"], strict=True):
                    try:
                        page = get(f"{address}?{urllib.parse.urlencode({'q': query})}", timeout).decode("utf-8", "replace")
                    except (OSError, ValueError):
                        continue
                    links = [(target(u), " ".join(re.sub(r"<[^>]*>", " ", t).split())) for u, t in re.findall(r"""(?is)<a[^>]*class=["'][^"']*result__a[^"']*["'][^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", page)]
                    rows += [(query_id, i, u, html_escapes.unescape(t), "", name) for i, (u, t) in enumerate([x for x in links if x[0]][:k], 1)]
                yield pd.DataFrame(rows, columns=["query_id", "rank", "url", "title", "snippet", "engine"])

        return queries.select("query_id", "query").mapInPandas(run, HIT)


def target(link: str) -> str:
    """The URL that a result's link leads to, '' if it is none."""
    parts = urllib.parse.urlsplit(html_escapes.unescape(link))
    inner = urllib.parse.parse_qs(parts.query).get("uddg", [""])[0]
    found = inner or urllib.parse.urlunsplit(parts)
    return found if found.startswith(("http://", "https://")) else ""


#: What requests say they come from; each takes one by chance.
AGENTS = [f"Mozilla/5.0 ({system}) {engine}" for system in ("X11; Linux x86_64", "Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 10_15_7") for engine in ("Gecko/20100101 Firefox/128.0", "AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0 Safari/537.36")]


def browser_get(url: str, timeout: float) -> bytes:
    """The page as a browser renders it. Needs playwright."""
    try:
        from playwright.sync_api import sync_playwright
    except ImportError as e:
        raise TesseraError("playwright is needed to render pages", "dependency", url=url) from e
    with sync_playwright() as p, p.chromium.launch() as browser:
        page = browser.new_page()
        page.route("**/*", lambda r: r.abort() if r.request.resource_type in ("image", "media", "font", "stylesheet") else r.continue_())
        page.goto(url, timeout=timeout * 1000)
        page.wait_for_timeout(1500)
        return page.content().encode()


def http_get(url: str, timeout: float) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": random.choice(AGENTS), "Accept-Language": "en"})  # noqa: S310, S311
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def search(queries: DataFrame, providers: list, k: int = 12) -> DataFrame:
    """Hits of the providers in order of preference, merged (see merge_providers)."""
    found = None
    for priority, provider in enumerate(providers):
        hits = provider.search(queries, k if priority == 0 else k + 3).withColumn("priority", F.lit(priority))
        found = hits if found is None else found.unionByName(hits)
    return merge_providers(found, k)


FETCHED = "query_id long, url string, title string, content string, source string, timestamp string, author string, image string, domain string, attempt int, latency double, failed boolean, rate_limited boolean, content_empty boolean, status_code int"


def fetch(urls: DataFrame, max_chars: int = 2000, retries: int = 2, timeout: float = 10.0, get: Callable[[str, float], bytes] | None = None, wait: Callable[[float], None] = time.sleep, seed: int = 0, session_timeout: float = 45.0, render: Callable[[str, float], bytes] | None = None) -> DataFrame:
    """A row per attempt to fetch each URL (query_id, url): telemetry, and the document where it worked.

    URLs are dealt by domain, so one task speaks to a site. An HTTP error is tried again after
    1.5 ** attempt seconds and up to half a second more; other errors end the attempts. Requests to a site
    stand a moment apart. What isn't asked for within ``session_timeout`` seconds from now has failed.
    render (say browser_get) is tried where the last attempt failed.
    """
    get, until = get or http_get, time.time() + session_timeout

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = random.Random(seed)
        for part in parts:
            rows = []
            for query_id, url, domain in zip(part["query_id"], part["url"], part["domain"], strict=True):
                if rows and rows[-1]["domain"] == domain:
                    wait(rng.uniform(0.1, 0.4))
                for attempt in range(retries + 1):
                    late = time.time() > until
                    began, status, page, again = time.monotonic(), None, None, False
                    try:
                        if not late:
                            page, status = get(url, timeout).decode("utf-8", "replace"), 200
                    except urllib.error.HTTPError as e:
                        status, again = e.code, True
                    except (OSError, ValueError):
                        pass
                    if page is None and render and not late and (not again or attempt == retries):
                        with contextlib.suppress(OSError, ValueError):
                            page = render(url, timeout).decode("utf-8", "replace")
                    found = extract(page, max_chars) if page else None
                    own = found or {}
                    rows.append({"query_id": query_id, "url": url, "domain": domain, "attempt": attempt, "latency": time.monotonic() - began, "failed": page is None, "rate_limited": status == 429, "content_empty": page is not None and found is None, "status_code": status, "source": url, **{c: own.get(c) for c in ("title", "content", "timestamp", "author", "image")}})
                    if not again or late or attempt == retries:
                        break
                    wait(1.5**attempt + rng.random() / 2)
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in FETCHED.split(", ")])
            frame["status_code"] = frame["status_code"].astype("Int32")
            yield frame

    return urls.select("query_id", "url", S.domain(F.col("url")).alias("domain")).repartition("domain").mapInPandas(run, FETCHED)


def offline_get(pages: dict[str, str]) -> Callable[[str, float], bytes]:
    """A stand-in for the network."""
    def get(url: str, timeout: float) -> bytes:
        if url not in pages:
            raise OSError(url)
        return pages[url].encode()

    return get


def first_urls(hits: DataFrame, *order: str) -> DataFrame:
    """The first hit of each URL of a query, over its variants."""
    w = Window.partitionBy("query_id", "url").orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


