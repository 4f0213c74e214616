"""Raw pages: archive crawling, HTML extraction, and the content-addressed snapshot cache."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from colloquy.operators.order import shared_folder
from colloquy.sources.episodes import read_lines as lines

# The marks of titles, transcripts, question lists, footers and videos on pages.
EPISODE_TITLE = r"(?i)^AMA\s*(?:[|:—–-]\s*)?[A-Za-z]+\s+\d{4}$"
TRANSCRIPT = r"(?i)Click to Show (?:Full |Episode )?Transcript"
QUESTIONS = r"(?i)Click to Show AMA Q"
FOOTER = r"(?i)\n\s*(?:←\s*Previous Post|Leave a Comment|Related Posts)\b"
VIDEO = r"(?:youtu\.be/|youtube(?:-nocookie)?\.com/(?:watch\?v=|embed/))([A-Za-z0-9_-]{11})"
ENTRY, SNAPSHOT = "url string, sha string, at long", "sha string, html string"
FOUND = "title string, source_url string, publish_date date"


def without_hidden(html: Column) -> Column:
    """The page without style and script blocks, whose text may hold tags."""
    return F.regexp_replace(html, r"(?is)<(style|script)\b.*?</\1\s*>", "")


def visible_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(without_hidden(html), r"(?s)<[^>]*>", " "), r"\s+", " "))


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(without_hidden(html), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def video_of(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, VIDEO, 1), F.lit(""))


def audio_of(html: Column, url: Column) -> Column:
    """An audio element's source, else a source element's, else the first link to an .mp3, else the page itself."""
    tries = [r'(?i)<audio\b[^>]*?\ssrc="([^"]+)"', r'(?i)<source\b[^>]*?\ssrc="([^"]+)"', r'(?i)<a\s[^>]*?href="([^"]+\.mp3(?:\?[^"]*)?)"']
    found = F.coalesce(*(F.nullif(F.regexp_extract(html, t, 1), F.lit("")) for t in tries))
    return F.coalesce(absolute(found, url), url)


@F.pandas_udf(StringType())
def absolute(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for h, b in zip(href, base)])


class _Archive(HTMLParser):
    """Links with their text, the date of their article, and the link to the next page."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[tuple[str, str, int]] = []
        self.dates: dict[int, str] = {}
        self.next: str | None = None
        self._href, self._text, self._article, self._articles, self._nav = None, "", 0, 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if tag == "article":
            self._articles += 1
            self._article = self._articles
        if "nav-next" in names and tag != "a":
            self._nav += 1
        if tag == "time" and a.get("datetime"):
            self.dates.setdefault(self._article, a["datetime"])
        if tag == "a" and a.get("href"):
            self._href, self._text = a["href"], ""
            onward = "next" in (a.get("rel") or "").split() or self._nav or {"next", "page-numbers"} <= set(names)
            if onward and self.next is None:
                self.next = a["href"]

    def handle_data(self, data: str) -> None:
        if self._href is not None:
            self._text += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self._href is not None:
            self.links.append((" ".join(self._text.split()), self._href, self._article))
            self._href = None
        elif tag == "article":
            self._article = 0
        elif tag in ("nav", "div", "span", "li") and self._nav:
            self._nav -= 1


def parse_archive(html: str, url: str) -> tuple[list[tuple[str, str, str | None]], str | None]:
    """(title, address, date) of the episodes that an archive page links, and the next page."""
    page = _Archive()
    page.feed(re.sub(r"(?is)<(style|script)\b.*?</\1\s*>", "", html or ""))
    rows = {}
    for text, href, article in page.links:
        if re.match(EPISODE_TITLE, text):
            own = urljoin(url, href)
            date = (page.dates.get(article) or "")[:10]
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
                in_url = re.search(r"/(\d{4})/(\d{2})/(\d{2})(?:/|$)", own)
                date = "-".join(in_url.groups()) if in_url else None
            rows[own] = (text, own, date)
    return list(rows.values()), urljoin(url, page.next) if page.next else None


def discovered(archive: DataFrame) -> DataFrame:
    """title, source_url, publish_date of archive pages (page_no, url, html): by address the last page's entry, by date."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(n, *row) for n, url, html in zip(pdf.page_no, pdf.url, pdf.html) for row in parse_archive(html, url)[0]]
            yield pd.DataFrame(rows, columns=["page_no", "title", "source_url", "publish_date"])

    found = archive.select("page_no", "url", "html").mapInPandas(run, "page_no long, title string, source_url string, publish_date string")
    best = found.groupBy("source_url").agg(F.max_by(F.struct("title", "publish_date"), "page_no").alias("r"))
    return best.select("r.title", "source_url", F.col("r.publish_date").cast("date").alias("publish_date")).orderBy("publish_date", "source_url")


def next_pages(archive: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``next``: the archive page that each page (url, html) names next; null where there is none."""

    @F.pandas_udf(StringType())
    def named(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([parse_archive(h, u)[1] for h, u in zip(html, url)])

    return archive.select(*keep, named("html", "url").alias("next"))


def crawl(spark: SparkSession, fetch: Callable[[str], str], start: str, most: int | None = None, batch: int = 20) -> DataFrame:
    """page_no, url, html of all archive pages: each names the next, so this follows links one by one; cycles end it.

    ``most`` stops earlier, for manual debugging. Pages go to the shared folder ``batch`` at a time; the driver holds no
    more of them, and the addresses seen.
    """
    schema = "page_no long, url string, html string"
    folder = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    rows: list[tuple[int, str, str]] = []
    seen: set[str] = set()

    def put() -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        rows.clear()

    url = start
    while url and url not in seen and (most is None or len(seen) < most):
        html = fetch(url)
        rows.append((len(seen), url, html))
        seen.add(url)
        url = parse_archive(html, url)[1]
        if len(rows) == batch:
            put()
    if rows or not seen:
        put()
    return spark.read.schema(schema).parquet(folder)


def fetch_text(url: str, agent: str = "transcript-indexer/1.0", seconds: int = 60) -> str:
    """A page over HTTP; any status but success raises."""
    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetched(todo: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """url, html: pages fetched inside tasks, a partition at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"url": pdf.url, "html": [fetch(u) for u in pdf.url]})

    return todo.select("url").mapInPandas(run, "url string, html string")


def with_snapshots(todo: DataFrame, index: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The pages to read (url) with the cached html, null where there is none."""
    return todo.join(index, "url", "left").join(snapshots, "sha", "left").select("url", "html")


def new_snapshots(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """sha, html of the pages' contents that the cache lacks; equal contents are one snapshot."""
    return pages.select(F.sha2("html", 256).alias("sha"), "html").groupBy("sha").agg(F.min("html").alias("html")).join(snapshots.select("sha"), "sha", "left_anti")


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The cache's index (url, sha: the last entry of an address) and snapshots (sha, html)."""
    entries = lines(spark, f"{path}/index", ENTRY).groupBy("url").agg(F.max_by("sha", "at").alias("sha"))
    return entries, lines(spark, f"{path}/pages", SNAPSHOT).groupBy("sha").agg(F.min("html").alias("html"))


def append_cache(pages: DataFrame, path: str) -> None:
    """Add the pages (url, html) to the cache: contents that it lacks, then entries that are new or changed.

    Both are appended, so an address whose content is known keeps its own entry, and a repeated run adds nothing.
    """
    index, snapshots = read_cache(pages.sparkSession, path)
    new_snapshots(pages, snapshots).write.mode("append").json(f"{path}/pages")
    entries = pages.select("url", F.sha2("html", 256).alias("sha")).distinct().join(index, ["url", "sha"], "left_anti")
    entries.withColumn("at", F.unix_micros(F.current_timestamp())).write.mode("append").json(f"{path}/index")


def transcripts(pages: DataFrame) -> DataFrame:
    """url, transcript_text: the text between the transcript's marker and the page's footer; null without a marker."""
    body = F.regexp_replace(F.regexp_replace(without_hidden(F.col("html")), "\r", ""), r"(?s)<[^>]*>", "")
    after = F.regexp_extract(body, rf"(?s){TRANSCRIPT}\s*(.*)\z", 1)
    inside = F.element_at(F.split(after, FOOTER, 2), 1)
    return pages.select("url", F.when(body.rlike(TRANSCRIPT), inside).alias("transcript_text"))


def legacy_questions(pages: DataFrame) -> DataFrame:
    """url, ord, speaker, text of question-only pages: paragraphs behind the marker, the asker in the first line."""
    after = F.regexp_extract("html", rf"(?s){QUESTIONS}(.*?)(?:\[/accordion-item\]|{TRANSCRIPT}|\z)", 1)
    paragraphs = F.regexp_extract_all(F.regexp_replace(after, r"(?s)\A.*?</p>", ""), F.lit(r"(?is)<p[^>]*>(.*?)(?:</p>|\z)"), F.lit(1))
    rows = pages.where(F.col("html").rlike(QUESTIONS)).select("url", F.posexplode(paragraphs).alias("pos", "p"))
    lines = F.filter(F.transform(F.split("p", r"(?i)<br\s*/?\s*>"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))), lambda x: x != "")
    kept = rows.withColumn("lines", lines).where(F.size("lines") > 1)
    order = Window.partitionBy("url").orderBy("pos")
    return kept.select("url", (F.row_number().over(order) - 1).alias("ord"), F.regexp_replace(F.element_at("lines", 1), r"\.+$", "").alias("speaker"), F.array_join(F.slice("lines", 2, F.size("lines")), " ").alias("text"))
