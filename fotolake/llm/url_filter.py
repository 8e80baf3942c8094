"""URL filtering by a list that changes over time.

The list is a log: on a date an entry (a host, or a domain with all hosts below it) is added or removed. The log of
an entry becomes validity intervals [since, until): an addition opens one, the entry's next event closes it; an entry
added twice stays open, one removed while closed stays closed, and of several events on one date the removal counts.
A capture is judged by the intervals that hold at its fetch date, for its host and each parent domain.

Intervals are laid out by periods of `period` days and joined on entry and period, so one entry with a long history is
many keys and a capture meets only the few intervals of its own period. Captures of one host on one date are judged
once, whatever their number. Dates before an entry's first event and captures without a date meet no interval.

NULL and unreadable URLs have no host and are kept. Repeated captures get the same answer each; of several entries
that hold the longest wins. An empty list keeps everything. Columns named `host`, `blocked` or `entry` are replaced,
others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import LOWER, UPPER

FOREVER = "9999-12-31"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9._-]+)"


def host_of(url: Column) -> Column:
    """Host without port and `www.`, lower case; NULL if there is none."""
    host = F.regexp_replace(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), r"^www\.|\.$", "")
    return F.when(host != "", host)


def parents(host: Column) -> Column:
    """The host and the domains above it, down to two labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(log: DataFrame, entry: str = "entry", action: str = "action", at: str = "at") -> DataFrame:
    """entry, since, until of a log with actions 'add' and 'remove'."""
    days = log.select(F.col(entry).alias("entry"), F.col(at).cast("date").alias("since"), F.col(action).alias("action")).dropna().filter(F.col("action").isin("add", "remove"))
    # one state for each entry and date, combined before it is shuffled
    states = days.groupBy("entry", "since").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("entry").orderBy("since")
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).filter("on <> was")
    return changes.withColumn("until", F.coalesce(F.lead("since").over(w), F.lit(FOREVER).cast("date"))).filter("on").select("entry", "since", "until")


def judge(captures: DataFrame, log: DataFrame, url: str = "url", fetched: str = "fetched", *, period: int = 32) -> DataFrame:
    """captures with host, blocked, and the entry that blocks."""
    base = captures.drop(*(c for c in ("host", "blocked", "entry") if c not in (url, fetched))).withColumn("host", host_of(F.col(url)))
    day = F.col(fetched).cast("date")
    part = lambda d: F.floor(F.unix_date(d) / period)
    last = base.agg(F.max(day)).first()[0]
    held = intervals(log)
    if last is not None:
        # an open interval is laid out up to the last capture only
        held = held.filter(F.col("since") <= F.lit(last)).withColumn("part", F.explode(F.sequence(part(F.col("since")), part(F.least("until", F.lit(last))))))
    else:
        held = held.withColumn("part", F.lit(0).cast("long")).limit(0)
    asked = base.select("host", day.alias("day")).dropna().distinct()
    keys = asked.select("host", "day", F.explode(parents(F.col("host"))).alias("entry"), part(F.col("day")).alias("part"))
    hits = keys.join(held, ["entry", "part"]).filter((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")))
    found = hits.groupBy("host", "day").agg(F.max_by("entry", F.length("entry")).alias("entry")).withColumnRenamed("day", "__day").withColumnRenamed("host", "__host")
    joined = base.join(found, (F.col("host") == F.col("__host")) & (day == F.col("__day")), "left").drop("__host", "__day")
    return joined.withColumn("blocked", F.col("entry").isNotNull())
