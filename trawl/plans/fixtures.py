"""Inputs the registered queries derive from the driver's tables, identically in Spark and SQL.

The test tables carry no keywords, search-result pages or cross-page links, so each query
derives them from ``pages``/``part`` with plain column expressions. The SQL twins live next
to them (``*_SQL``) so the oracle builds exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Extra anchors appended to every page for the link queries (fixed fixture values).
EXTRA_ANCHORS = (
    '<a href="javascript:void(0)">j</a><a href="  ">s</a><a href="javascript/x.html">r</a>'
    '<a href="/files/report.PDF">f</a><a href="/x.php;v=1?y=2">g</a><a href="/up/a.pdf#p">h</a>'
    '<a href="mailto:a@b.example">m</a>'
)


def pages_with_extra_links(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", F.concat("html", F.lit(EXTRA_ANCHORS)))


PAGES_WITH_EXTRA_LINKS_SQL = f"""(select page_id, url, html || '{EXTRA_ANCHORS}' as html from pages)"""


def linked_pages(pages: DataFrame) -> DataFrame:
    """Crawl fixture: two links per page, to pages ``(7·id+1) mod N`` and ``(13·id+5) mod N``.

    ``page_id`` is dense in ``0..N-1``. Link targets are written verbatim with ``&`` escaped,
    so the parser gives back the stored URL. The targets come from a self-join on the
    computed id (a shuffle join; no side is collected).
    """
    n = pages.count()  # one scalar to the driver
    ids = pages.select("page_id").withColumn("n", F.lit(n))
    tgt = pages.select(F.col("page_id").alias("tid"), F.col("url").alias("turl"))
    t1 = tgt.select(F.col("tid").alias("t1"), F.col("turl").alias("u1"))
    t2 = tgt.select(F.col("tid").alias("t2"), F.col("turl").alias("u2"))
    with_ids = ids.withColumn("t1", (F.col("page_id") * 7 + 1) % F.col("n")).withColumn(
        "t2", (F.col("page_id") * 13 + 5) % F.col("n"))
    # ids meet URLs first (narrow), the wide pages are joined last
    joined = pages.select("page_id", "url", "html").join(with_ids.join(t1, "t1").join(t2, "t2").select("page_id", "u1", "u2"), "page_id")

    def esc(c):
        return F.replace(c, F.lit("&"), F.lit("&amp;"))

    html = F.concat(F.col("html"), F.lit('<a href="'), esc(F.col("u1")), F.lit('">'),
                    F.lit('<a href="'), esc(F.col("u2")), F.lit('">'))
    return joined.select("page_id", "url", html.alias("html"))


LINKED_PAGES_SQL = """(select p.page_id, p.url,
    p.html || '<a href="' || replace(a.url, '&', '&amp;') || '"><a href="' || replace(b.url, '&', '&amp;') || '">' as html
  from pages p, (select count(*) n from pages) c, pages a, pages b
  where a.page_id = (7 * p.page_id + 1) % c.n and b.page_id = (13 * p.page_id + 5) % c.n)"""


def host_keywords(pages: DataFrame) -> DataFrame:
    """Keyword = host of the page URL (a stand-in keyword table derived from ``pages``)."""
    return pages.withColumn("keyword", U.url_netloc("url"))


HOST_SQL = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
