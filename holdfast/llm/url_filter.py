"""Temporal URL filter: dated list entries become validity intervals, captures are judged as of their fetch time.

A list is a table of dated events: entry, action (``add`` or ``remove``), listed_at. An entry is a host (it covers its
subdomains) or a host with leading path segments and a closing slash (it covers everything below). Events of one entry
follow each other; each holds until the next one, so the ``add`` events with the date that ends them are the intervals in
which the entry is active: ``valid_from`` inclusive, ``valid_to`` exclusive, null while it still holds. Of events on the
same date ``remove`` comes last and so wins; repeated events count once. Hosts of entries and captures are compared, and
come back, in lower case and without a closing dot; an IPv6 address in brackets is one label. Paths stay as they are.

A capture has one candidate key per host suffix of two or more labels (or the host itself) and per leading path; the as-of
join is an equi-join on the key with the fetch time inside the interval. All rows come back, in DataFrame functions only.
A capture without host or fetch time matches nothing; so does a list event without entry, date or known action. Repeated
captures are judged each. Extra columns are ignored. The intervals are counted: up to ``BROADCAST_INTERVALS`` of them go to
the captures, which then are not shuffled by key; beyond that a key that a third of all captures share meets one list row
per interval, and adaptive execution splits its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import quoted, written

#: intervals of about 80 bytes each
BROADCAST_INTERVALS = 300_000
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.$", "")


def host(url: Column) -> Column:
    """Host in lower case, without a closing dot; null where the URL has none."""
    return F.nullif(_plain(F.regexp_extract(url, AUTHORITY, 1)), F.lit(""))


def normal_entry(entry: Column) -> Column:
    """A list entry with its host as ``host`` writes it."""
    return F.concat(_plain(F.regexp_extract(entry, r"^[^/]*", 0)), F.regexp_extract(entry, r"/[\s\S]*$", 0))


def _suffixes(name: Column) -> Column:
    labels = F.split(name, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(name.startswith("["), F.array(name)).otherwise(suffixes)


def _paths(name: Column, url: Column) -> Column:
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 0, below).otherwise(F.array().cast("array<string>"))


def candidate_keys(url: Column) -> Column:
    """Every list entry that could cover the URL."""
    return F.array_distinct(F.concat(_suffixes(host(url)), _paths(host(url), url)))


def intervals(events: DataFrame) -> DataFrame:
    """entry, valid_from, valid_to of every time span in which an entry is active."""
    known = events.filter(F.col("action").isin("add", "remove") & F.col("entry").isNotNull() & F.col("listed_at").isNotNull())
    known = known.withColumn("entry", normal_entry(F.col("entry")))
    # of one date remove wins; repeated events meet here before any window
    daily = known.groupBy("entry", "listed_at").agg(F.max("action").alias("action"))
    after = F.lead("listed_at").over(Window.partitionBy("entry").orderBy("listed_at"))
    spans = daily.select("entry", F.col("listed_at").alias("valid_from"), after.alias("valid_to"), "action")
    return spans.filter(F.col("action") == "add").drop("action")


def judge(captures: DataFrame, events: DataFrame, page_id: str = "page_id", url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """page_id, url, host, fetched_at of every capture with blocked, n_active (active entries that cover it) and the most
    specific of them: entry and listed_at. ``add`` after ``add`` restarts an interval without a gap."""
    numbered = written(captures.select(
        quoted(page_id).alias("page_id"), quoted(url).alias("url"), quoted(fetched_at).alias("fetched_at"),
        F.monotonically_increasing_id().alias("capture"),
    ), "captures")
    keyed = numbered.filter("fetched_at IS NOT NULL").select("capture", "fetched_at", F.explode(candidate_keys(F.col("url"))).alias("entry"))
    listed = written(intervals(events), "intervals")
    if listed.count() <= BROADCAST_INTERVALS:
        listed = F.broadcast(listed)
    active = keyed.join(listed, "entry").filter(
        (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    verdicts = active.groupBy("capture").agg(
        F.count("*").alias("n_active"), F.max(F.struct(F.length("entry").alias("l"), "entry", "valid_from")).alias("best"))
    return numbered.join(verdicts, "capture", "left").select(
        "page_id", "url", host(F.col("url")).alias("host"), "fetched_at",
        F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("best.entry").alias("entry"), F.col("best.valid_from").alias("listed_at"),
    )
