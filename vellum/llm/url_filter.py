"""URL filters: temporal list join.

A list is a history of dated changes: (list, pattern, action 'add' or 'remove', at), the pattern being a host or a
domain (of one label or more) that stands for all hosts below it. Addresses stand for themselves alone. Changes become validity intervals, from an ``add`` up to the next change of
the same list and pattern, and every capture (page_id, url, fetched_at) is judged by the entries that were active when it
was fetched. DataFrame functions only.

The join is an as-of join on (pattern, day): each capture asks for its host and every domain above it; a list's
intervals are brought to the days on which captures ask for their pattern, as one array for each pattern and day. A
host with a third of all captures so meets small arrays of a day, never its whole history; the day's row is one, so
the engine can split or broadcast it.

Defined cases: a null or malformed URL has no host and matches nothing; a null fetch time matches nothing; rows equal in
page_id, url and fetched_at are one capture; entries with a null pattern, action or time are no entries; of several
changes at one instant removals win; an add on top of an add goes on; an empty list leaves every capture unmatched; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scheme, optional user info, host (group 1); addresses.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
FOREVER = "9999-12-31 00:00:00"


def normalised(h: Column) -> Column:
    """A host or pattern in lower case without a final dot; null if nothing is left."""
    h = F.regexp_replace(F.lower(h), r"\.$", "")
    return F.when(h != "", h)


def host(url: Column) -> Column:
    """Host of a URL (an IPv6 address with its brackets); null if there is none."""
    return normalised(F.regexp_extract(url, HOST, 1))


def domains(h: Column) -> Column:
    """A host and every domain above it, the last label included; an address stands for itself alone."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(h.rlike(ADDRESS), F.array(h)).otherwise(F.when(h.isNotNull(), every))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until): validity intervals, until excluded."""
    e = entries.select("list", normalised(F.col("pattern")).alias("pattern"), F.lower("action").alias("action"),
                       F.col("at").cast("timestamp_ntz").alias("at"))
    e = e.where(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    # 'remove' sorts after 'add': of several changes at one instant the removal holds
    e = e.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    nxt = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    e = e.withColumn("until", F.coalesce(nxt, F.lit(FOREVER).cast("timestamp_ntz")))
    return e.where("action = 'add'").select("list", "pattern", F.col("at").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, blocked, n_entries, lists, pattern, listed_since), one row for each capture:
    the lists that held it at fetch time in order, the most specific pattern and since when that was listed."""
    c = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")).distinct()
    asked = c.select("page_id", "url", "fetched_at", F.to_date("fetched_at").alias("day"),
                     F.explode(domains(host(F.col("url")))).alias("pattern")).where("day IS NOT NULL")
    days = asked.select("pattern", "day").distinct()
    iv = intervals(entries)
    begins = F.col("day").cast("timestamp_ntz")
    on_day = days.join(iv, "pattern").where((F.col("until") > begins) & (F.col("since") < begins + F.expr("INTERVAL 1 DAY")))
    held = on_day.groupBy("pattern", "day").agg(F.collect_list(F.struct("since", "until", "list")).alias("held"))
    hit = asked.join(held, ["pattern", "day"])
    active = F.filter("held", lambda x: (x["since"] <= F.col("fetched_at")) & (F.col("fetched_at") < x["until"]))
    hit = hit.select("page_id", "url", "fetched_at", "pattern", F.explode(active).alias("x"))
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", F.col("x.since").alias("since")))
    found = hit.groupBy("page_id", "url", "fetched_at").agg(
        F.count(F.lit(1)).alias("n_entries"), F.array_join(F.array_sort(F.collect_set("x.list")), ",").alias("lists"), best.alias("best"))
    f = found.select(F.col("page_id").alias("k_page"), F.col("url").alias("k_url"), F.col("fetched_at").alias("k_at"), "n_entries", "lists", "best")
    on = F.col("page_id").eqNullSafe(F.col("k_page")) & (F.col("url") == F.col("k_url")) & (F.col("fetched_at") == F.col("k_at"))
    return c.join(f, on, "left").select(
        "page_id", "url", "fetched_at", F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("best.pattern").alias("pattern"), F.col("best.since").alias("listed_since"))
