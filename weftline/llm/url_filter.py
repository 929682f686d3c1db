"""URL filters by a temporal list join.

Dated list entries (a pattern is added, a pattern is removed) become validity intervals, disjoint for each pattern.
Every capture's possible patterns meet the intervals by equality, and of those active when it was fetched the most
specific one decides. A pattern without a slash is a domain with its subdomains; one that ends with a slash is a host
and the start of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

#: The production list, fixed values: pattern, action, day.
ENTRIES = [
    ("adult-x.example.com", "add", "2024-01-01"),
    ("casino-y.example.net", "add", "2024-02-10"),
    ("example.org", "add", "2024-05-01"),
    ("example.org", "remove", "2024-06-15"),
    ("example.org", "add", "2024-11-01"),
    ("tionsh.example.net", "add", "2024-03-01"),
    ("tionsh.example.net", "remove", "2024-04-01"),
    ("tionsh.example.net", "add", "2024-08-01"),
    ("tionsh.example.net/de/", "add", "2024-04-15"),
    ("tionsh.example.net/es/", "add", "2024-01-20"),
    ("tionsh.example.net/es/", "remove", "2024-02-20"),
    ("m.example.com", "add", "2024-07-01"),
    ("ththth.example.com", "add", "2024-09-01"),
]
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def production_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "pattern string, action string, day string").withColumn("day", F.to_date("day"))


def fetch_day(page_id: Column) -> Column:
    """The production rule for captures without a date: day number ``page_id`` modulo 366 of 2024."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``pattern, since, until``: from an addition to the pattern's next entry (null: still active).

    Of entries for one pattern on one day a removal wins. Entries with a null are ignored.
    """
    day = entries.where("pattern is not null and day is not null and action is not null").groupBy(F.lower("pattern").alias("pattern"), "day")
    day = day.agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    after = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return day.select("pattern", F.col("day").alias("since"), after.alias("until"), "removed").where("removed = 0").drop("removed")


def patterns_of(url: Column, labels: list[int], depths: list[int]) -> Column:
    """The patterns that may match a url: its last so many labels of the host, and the host with so many path segments.

    ``labels`` and ``depths`` are those that listed patterns have: a url costs its length for each of them.
    """
    host, path = F.lower(F.regexp_extract(url, _HOST, 1)), F.regexp_extract(url, _PATH, 1)
    n_labels, n_parts = F.regexp_count(host, F.lit(r"\.")) + 1, F.regexp_count(path, F.lit("/"))
    domains = [F.when(n_labels >= n, F.substring_index(host, ".", -n)) for n in labels]
    starts = [F.when(n_parts >= n, F.concat(host, F.substring_index(path, "/", n), F.lit("/"))) for n in depths]
    bare = [F.when(n_parts == 0, F.concat(host, F.lit("/")))] if 1 in depths else []
    return F.when(host != "", F.array_compact(F.array(*domains, *starts, *bare).cast("array<string>")))


def listed_shapes(active: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels of listed domains, and of slashes of listed paths: few, however long the list is."""
    path = F.col("pattern").contains("/")
    size = F.when(path, F.regexp_count("pattern", F.lit("/"))).otherwise(F.regexp_count("pattern", F.lit(r"\.")) + 1)
    found = active.select(path.alias("path"), size.alias("size")).distinct().orderBy("size").collect()
    return [r["size"] for r in found if not r["path"]], [r["size"] for r in found if r["path"]]


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day: Column | None = None) -> DataFrame:
    """One row per row of ``captures``: ``page_id, url, fetched, blocked, pattern, since``.

    ``day`` is the day of the fetch (by default the production rule on the id). Null or hostless urls and null days are
    not blocked. Repeated rows are judged each by itself; of active patterns the longest decides. An empty list blocks
    nothing; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), (fetch_day(F.col(id_col)) if day is None else day).alias("fetched"))
    rows = scratch.put(rows.withColumn("capture", F.monotonically_increasing_id()), "captures")
    active = scratch.put(validity(entries), "validity")
    tried = patterns_of(F.col("url"), *listed_shapes(active))
    wanted = rows.where("fetched is not null").select("capture", "fetched", F.explode(tried).alias("pattern"))
    met = wanted.join(active, "pattern").where("since <= fetched and (until is null or fetched < until)")
    best = met.groupBy("capture").agg(F.max_by(F.struct("pattern", "since"), F.struct(F.length("pattern"), "pattern")).alias("entry"))
    return rows.join(best, "capture", "left").select(
        "page_id", "url", "fetched", F.col("entry").isNotNull().alias("blocked"), F.col("entry.pattern").alias("pattern"), F.col("entry.since").alias("since")
    )


def url_report(pages: DataFrame) -> DataFrame:
    found = filter_urls(pages, production_list(pages.sparkSession))
    return found.withColumns({"fetched": F.col("fetched").cast("string"), "since": F.col("since").cast("string")})


def url_sql() -> str:
    entries = ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in ENTRIES)
    return f"""
with entries(pattern, action, day) as (values {entries}),
days as (select pattern, day, max(case when action = 'remove' then 1 else 0 end) as removed from entries group by pattern, day),
active as (select * from (select pattern, day as since, lead(day) over (partition by pattern order by day) as until, removed from days) where removed = 0),
captures as (
  select page_id, url, date '2024-01-01' + (page_id % 366)::int as fetched, lower(regexp_extract(url, '{_HOST}', 1)) as host, regexp_extract(url, '{_PATH}', 1) as path from pages),
met as (
  select c.page_id, a.pattern, a.since, row_number() over (partition by c.page_id order by length(a.pattern) desc, a.pattern desc) as place
  from captures c join active a on since <= fetched and (until is null or fetched < until) and host != ''
    and (host = pattern or ends_with(host, '.' || pattern) or (ends_with(pattern, '/') and starts_with(host || path, pattern))))
select c.page_id, url, fetched::date::varchar as fetched, pattern is not null as blocked, pattern, since::varchar as since
from captures c left join (select * from met where place = 1) m on c.page_id = m.page_id"""
