"""Depth-bounded crawl over stored pages, as level-synchronous DataFrame BFS.

The reference walks from seed URLs, fetching, marking visited, gating on language and
following links up to a depth, with a page budget per keyword. Here the "web" is a store of
analysed pages ``(url, links, paragraphs)``, clustered by a URL hash. Levels are narrow tables
``(keyword, seq, url, depth, fetched, lang, accepted)``: hits are found on the ``url`` column of the
parts that hold requests, the budget ranks narrow rows, and a page's ``links`` and ``paragraphs`` are
read from the store once, when it is fetched; everything after reads the fetched pages.

Definitions (fixed so the result never depends on timing):

* Seeds are depth 0 and are fetched even when already visited (they are not checked).
* A link found on an accepted page at depth ``d <= max_depth`` becomes a request at
  ``d + 1`` unless its URL was already requested in this crawl or is in ``visited``.
  Pages are thus reached at depths ``0..max_depth+1``.
* ``crawl_in_sequence`` runs keywords one after another, as the reference does: a page
  belongs to the lowest ``(seq, depth)`` that reaches it. ``crawl`` walks all its seeds
  together; a URL belongs to the first level that reaches it, on a level to the lowest ``seq``.
* Budget: at most ``budget`` fetched pages per keyword (seeds included, never cut), the
  remaining allowance filled level by level in URL order; failed fetches cost nothing.
* A page is *visited* once fetched (found in the page table), before the language gate.
  Off-language pages give neither text nor links.

Each level cuts lineage with a parquet table written under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import is_blacklisted_extension
from ..session import cut, ensure_checkpoint_dir, scratch_dir
from ..sources.pagestore import PageStore, TablePages, as_pages
from ..sources.urlset import UrlSet
from .keywords import order_key
from .pages import followable

SALT_BUCKETS = 64
#: Budgets up to this are picked by salts (a task ranks at most SALT_BUCKETS times as many narrow rows),
#: larger ones by ranges.
SALTED_BUDGET = 10_000
# Input bytes that one bucket of a page table should hold.
BUCKET_BYTES = 128 << 20


def buckets_for(spark: SparkSession, n_bytes: int, at_least: int = 8) -> int:
    """Buckets for a table of about ``n_bytes``: a bucket is one task's work in later joins."""
    return max(at_least, -(-n_bytes // BUCKET_BYTES))


def has_catalog(spark: SparkSession) -> bool:
    """Whether bucketed tables can be made here (asked before any data is written)."""
    try:
        spark.catalog.listTables()
        return True
    except Exception as e:  # the metastore's own errors come in many classes
        if "Metastore" in str(e) or "catalog" in str(e).lower():
            return False
        raise


def write_page_table(analyzed: DataFrame, buckets: int = 256, name: str = "pages_info") -> DataFrame:
    """Write the crawl's page table ``(url, links, paragraphs, …)`` once, bucketed and sorted
    by ``url`` under the checkpoint root, and return it as a table.

    A frontier too large to broadcast is then joined by shuffling only the frontier into the
    table's buckets; the page table itself is never shuffled, whatever the crawl depth.
    """
    import uuid

    from ..session import scratch_dir

    spark = analyzed.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    # Repartitioned on the bucket hash first, so each task writes exactly one bucket file
    # (otherwise every task writes up to ``buckets`` files). One shuffle of the table, once.
    ranged = analyzed.repartition(buckets, "url")
    if not has_catalog(spark):  # a plain table works as well; its joins then shuffle both sides
        return cut(ranged, name)
    (ranged.write.bucketBy(buckets, "url").sortBy("url")
     .option("path", scratch_dir(spark, name)).saveAsTable(table))
    return spark.table(table)


def drop_visited(links: DataFrame, visited: DataFrame, col: str = "url", visited_col: str = "url") -> DataFrame:
    """``links`` whose ``col`` is not in ``visited`` (one anti-join; AQE picks the strategy)."""
    v = visited.select(F.col(visited_col).alias("__v")).distinct()
    return links.join(v, F.col(col) == F.col("__v"), "left_anti")


def top_per_group(df: DataFrame, group: str, order: list[str], allowance_col: str,
                  salt_buckets: int = SALT_BUCKETS, exempt: str | None = None) -> DataFrame:
    """Keep the first ``allowance_col`` rows per ``group`` in ``order``, skew-safe. Rank narrow
    rows; join wide columns afterwards.

    Phase 1 ranks inside ``(group, salt)`` buckets (salt = hash of the order key), so a hot
    group is spread over many tasks; at most ``allowance`` rows per bucket survive. Phase 2
    ranks the survivors per group, at most ``salt_buckets × allowance`` rows each. Exact.
    Rows where the boolean ``exempt`` column is true are never cut and stay salted in both
    phases (one pipeline, no second scan of the input).
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salt_buckets))
    ex = F.col(exempt) if exempt else F.lit(False)
    w1 = Window.partitionBy(group, "__ex", "__salt").orderBy(*order)
    w2 = Window.partitionBy(group, "__ex", F.when(F.col("__ex"), F.col("__salt")).otherwise(0)).orderBy(*order)
    keep = F.col("__ex") | (F.col("__rn") <= F.col(allowance_col))
    p1 = (df.withColumn("__ex", ex).withColumn("__salt", salt)
          .withColumn("__rn", F.row_number().over(w1)).where(keep))
    p2 = p1.withColumn("__rn", F.row_number().over(w2)).where(keep)
    return p2.drop("__salt", "__ex", "__rn")


@dataclass
class CrawlResult:
    reached: DataFrame  # keyword, seq, url, depth, fetched, lang, accepted
    corpus: DataFrame  # keyword, url, depth, para_idx, text
    visited: DataFrame  # url (initial visited ∪ fetched)


def _claim(cand: DataFrame) -> DataFrame:
    """One owner per URL: the lowest ``seq`` among same-level candidates."""
    best = F.min(F.struct("seq", "keyword")).alias("o")
    return cand.groupBy("url").agg(best).select(F.col("o.keyword").alias("keyword"),
                                                 F.col("o.seq").alias("seq"), "url")


class Tables:
    """Written tables of one schema, read together by one scan however many there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths, self.schema = spark, name, [], None

    def add(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


class FetchedPages:
    """Pages that a crawl has fetched: each is read from the store and judged by the gate once, however
    many keywords reach it, and later steps read these tables, not the store."""

    def __init__(self, spark: SparkSession, pages: PageStore | TablePages, gate: Callable[[DataFrame], DataFrame] | None):
        self.pages, self.gate = pages, gate
        self.wide = Tables(spark, "fetched-pages")
        self.verdicts = Tables(spark, "verdicts")

    def add(self, level: DataFrame) -> None:
        """Fetch the pages of a written level ``(keyword, seq, url, fetched)`` that aren't here yet."""
        found = level.where("fetched")
        parts = self.pages.parts_of(found)
        if not parts and self.wide.paths:
            return
        new = found.groupBy("url").agg(F.min_by("keyword", F.struct("seq", "keyword")).alias("keyword"))
        if self.wide.paths:
            new = new.join(self.wide.read().select("url"), "url", "left_anti")
        wide = self.wide.add(self.pages.fetch(new, ["links", "paragraphs"], parts))
        if self.gate is not None:
            self.verdicts.add(self.gate(wide.select("keyword", "url", "paragraphs")).select("url", "lang", "accepted"))

    def judge(self, level: DataFrame) -> DataFrame:
        """The level with ``lang`` and ``accepted``."""
        if self.gate is None:
            judged = level.withColumns({"lang": F.lit(None).cast("string"), "accepted": F.col("fetched")})
        else:
            judged = level.join(self.verdicts.read(), "url", "left").withColumn(
                "accepted", F.col("fetched") & F.coalesce("accepted", F.lit(False)))
        return judged.select("keyword", "seq", "url", "depth", "fetched", "lang", "accepted")

    def column(self, name: str) -> DataFrame:
        return self.wide.read().select("url", name)


def _unvisited(cand: DataFrame, visited: DataFrame | UrlSet | None) -> DataFrame:
    if visited is None:
        return cand
    if isinstance(visited, UrlSet):
        return visited.without(cut(cand, "candidates"))
    return drop_visited(cand, visited)


def ranked_per_group(df: DataFrame, group: str, order: list[str], allowance_col: str, exempt: str | None = None,
                     ranges: int | None = None) -> DataFrame:
    """As ``top_per_group``, for allowances of any size: no task holds a group.

    Rows are written once, range-partitioned by ``(group, *order)``, so a hot group lies over many
    ranges. A row's place is its place in its range plus the group's rows in earlier ranges (one row a
    range and group), and rows up to the allowance stay. ``(group, *order)`` must be unique.
    """
    rows = df.withColumn("__ex", F.col(exempt) if exempt else F.lit(False))
    ranged = rows.repartitionByRange(ranges, group, *order) if ranges else rows.repartitionByRange(group, *order)
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()), "ranked-ranges")
    counted = ranged.where(~F.col("__ex")).groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lift = counted.select(group, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__lift"))
    inside = Window.partitionBy(group, "__range", "__ex").orderBy(*order)
    placed = (ranged.withColumn("__place", F.row_number().over(inside)).join(lift, [group, "__range"], "left")
              .where(F.col("__ex") | (F.col("__place") + F.col("__lift") <= F.col(allowance_col))))
    return placed.select(*df.columns)


def _walk(spark: SparkSession, seeds: DataFrame, known: FetchedPages, visited: DataFrame | UrlSet | None, owners: DataFrame | None,
          each: bool, max_depth: int, budget: int | None, blacklist: bool) -> tuple[DataFrame, DataFrame | None]:
    """Level by level from ``seeds(keyword, seq, url)`` to ``(reached, blocked)``.

    ``each``: every keyword claims URLs for itself, as if it were alone; candidates that
    ``owners(url, owner)`` gives to an earlier ``(seq, keyword)`` are ``blocked``. Otherwise one walk
    shares its claims.
    """
    me = ["seq", "keyword", "url"] if each else ["url"]
    requests = cut(seeds.select("keyword", order_key(seeds), "url")
                   .dropDuplicates(["seq", "keyword", "url"] if each else ["keyword", "url"]), "seeds")
    levels, owned = Tables(spark, "level"), Tables(spark, "owned")
    reached = None
    for depth in range(0, max_depth + 2):
        parts = known.pages.parts_of(requests)
        if depth and not parts:
            break
        # Request → stored response; a URL missing from the store is a failed fetch
        level = known.pages.hits(requests, parts).select("keyword", "seq", "url", F.lit(depth).alias("depth"), "fetched")
        who = ["seq", "keyword"] if each else ["keyword"]
        if budget is not None and depth > 0:
            # fetched pages per keyword so far, read from the small written level tables
            used = levels.read().where("fetched").groupBy(*who).agg(F.count(F.lit(1)).alias("used"))
            level = (level.join(used, who, "left").withColumn("__allow", F.lit(budget) - F.coalesce("used", F.lit(0))).drop("used")
                     .withColumn("__free", ~F.col("fetched"))  # failed fetches cost nothing
                     .withColumn("__who", F.to_json(F.struct(*who))))
            pick = top_per_group if budget <= SALTED_BUDGET else ranked_per_group
            level = pick(level, "__who", ["url"], "__allow", exempt="__free").drop("__allow", "__free", "__who")
        level = levels.add(level)
        known.add(level)
        reached = known.judge(levels.read())
        if depth > max_depth:
            break
        cand = (known.judge(level).where("accepted").select("keyword", "seq", "url").join(known.column("links"), "url")
                .select("keyword", "seq", F.explode(F.array_distinct("links")).alias("url")).where(followable()))
        if blacklist:
            cand = cand.where(~is_blacklisted_extension("url"))
        # Claim first: the aggregate combines map-side, so a URL linked from a huge share of pages is
        # one row per task (and keyword) before any shuffle keyed on it.
        cand = cand.distinct() if each else _claim(cand)
        cand = _unvisited(cand.join(levels.read().select(*me).distinct(), me, "left_anti"), visited)
        if owners is None:
            requests = cut(cand.select("keyword", "seq", "url"), "requests")
        else:
            taken = F.coalesce(F.col("owner") < F.struct("seq", "keyword"), F.lit(False))
            level = owned.add(cand.join(owners, "url", "left").select("keyword", "seq", "url", taken.alias("taken")))
            requests = level.where("not taken").drop("taken")
    return cut(reached, "reached"), owned.read().where("taken").drop("taken") if owned.paths else None


def _result(reached: DataFrame, known: FetchedPages, visited: DataFrame | UrlSet | None) -> CrawlResult:
    accepted = reached.where("accepted").select("keyword", "url", "depth")
    corpus = (accepted.join(known.column("paragraphs"), "url")
              .select("keyword", "url", "depth", F.posexplode("paragraphs").alias("para_idx", "text")))
    fetched = reached.where("fetched").select("url")
    if visited is not None:
        fetched = (visited.urls() if isinstance(visited, UrlSet) else visited.select("url")).unionByName(fetched)
    return CrawlResult(reached=reached, corpus=corpus, visited=fetched.distinct())


def crawl(
    spark: SparkSession,
    seeds: DataFrame,
    pages_info: DataFrame | PageStore,
    visited: DataFrame | UrlSet | None = None,
    max_depth: int = 3,
    budget: int | None = 1000,
    gate: Callable[[DataFrame], DataFrame] | None = None,
    blacklist: bool = True,
) -> CrawlResult:
    """Seeds ``(keyword, seq, url)`` → reached pages, corpus rows and the new visited set.

    ``pages_info`` is a page store (``sources.pagestore``: only parts that hold requested pages are
    read) or a table ``(url, links, paragraphs)``, unique on ``url``. ``gate(df)`` gets fetched pages
    ``(keyword, url, paragraphs)``, each page once, and returns ``(keyword, url, lang, accepted)``; its
    cost follows the crawl, not the store. Without a gate every fetched page is accepted. The budget
    counts fetched pages per keyword (seeds included, never cut). All joins are left to the optimizer.
    """
    ensure_checkpoint_dir(spark)
    known = FetchedPages(spark, as_pages(pages_info), gate)
    reached, _ = _walk(spark, seeds, known, visited, None, False, max_depth, budget, blacklist)
    return _result(reached, known, visited)


def crawl_in_sequence(
    spark: SparkSession,
    seeds: DataFrame,
    pages_info: DataFrame | PageStore,
    visited: DataFrame | UrlSet | None = None,
    max_depth: int = 3,
    budget: int | None = 1000,
    gate: Callable[[DataFrame], DataFrame] | None = None,
    blacklist: bool = True,
) -> CrawlResult:
    """The reference's order, one keyword after another by ``seq``, each with what the earlier ones
    visited, without a job per keyword.

    All keywords are walked at once, each as if it were alone. A page then belongs to the first
    keyword that fetched it. Keywords that requested a page of an earlier one, or that held back from a
    page the earlier one no longer fetches, are walked again (together, with the owners known by now)
    until there are none. The first affected keyword is right after every wave, so the waves end; their
    number follows the chain of conflicts, not the number of keywords. Pages are fetched and judged once.
    """
    ensure_checkpoint_dir(spark)
    known = FetchedPages(spark, as_pages(pages_info), gate)
    seeds = cut(seeds.select("keyword", order_key(seeds), "url").distinct(), "all-seeds")
    how = (True, max_depth, budget, blacklist)
    reached, blocked = _walk(spark, seeds, known, visited, None, *how)
    mine = F.struct("seq", "keyword")
    while True:
        owners = cut(reached.where("fetched").groupBy("url").agg(F.min(mine).alias("owner")), "owners")
        taken = reached.where("depth > 0 and fetched").join(owners, "url").where(F.col("owner") < mine)
        wrong = taken.select("seq", "keyword")
        if blocked is not None:
            free = blocked.join(owners, "url", "left").where(F.col("owner").isNull() | (F.col("owner") >= mine))
            wrong = wrong.union(free.select("seq", "keyword"))
        wrong = cut(wrong.distinct(), "affected")
        if wrong.isEmpty():
            return _result(reached, known, visited)
        again, held = _walk(spark, seeds.join(wrong, ["seq", "keyword"], "left_semi"), known, visited, owners, *how)
        reached = cut(reached.join(wrong, ["seq", "keyword"], "left_anti").unionByName(again), "reached")
        if blocked is not None:
            kept = blocked.join(wrong, ["seq", "keyword"], "left_anti")
            held = kept if held is None else kept.unionByName(held)
        blocked = None if held is None else cut(held, "held-back")


def level_counts(reached: DataFrame) -> DataFrame:
    """Requests, fetched and accepted pages per keyword and depth (one partial aggregate)."""
    return reached.groupBy("keyword", "depth").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("fetched"), 1)).alias("fetched"),
        F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


def frontier_step(frontier: DataFrame, pages_info: DataFrame, visited: DataFrame,
                  max_depth: int = 3) -> DataFrame:
    """One BFS level as a plain query: fetch (J3), expand accepted pages' links (X4), drop
    blacklisted and visited targets (P3, J1), one owner per URL → next requests ``depth+1``."""
    fetched = frontier.join(pages_info.select("url", "links", "accepted"), "url")
    cand = (fetched.where(F.col("accepted") & (F.col("depth") <= max_depth))
            .select("keyword", "seq", "depth", F.explode(F.array_distinct("links")).alias("url"))
            .where(followable()).where(~is_blacklisted_extension("url")))
    best = F.min(F.struct("seq", "keyword", "depth")).alias("o")
    owned = cand.groupBy("url").agg(best)  # one row per URL before the anti-joins (skew-safe)
    fresh = drop_visited(drop_visited(owned, visited, "url"), frontier, "url")
    return fresh.select(F.col("o.keyword").alias("keyword"), F.col("o.seq").alias("seq"), "url",
                        (F.col("o.depth") + 1).alias("depth"))
