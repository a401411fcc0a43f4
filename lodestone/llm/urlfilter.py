"""URL filters in time: dated list entries as validity intervals, joined to captures as of their fetch date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize

#: A host in brackets (an IPv6 address), or one up to its port or the end, without a dot behind it.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+?)\.?(?:[:/?#]|$)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"
ALLOW = "allow"


def host(url: Column) -> Column:
    """Lowered; a name's final dot is dropped, an IPv6 address keeps its brackets and has no parent domains."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys_of(url: Column) -> Column:
    """What an entry may name to match url: its host, parent domains of two labels or more, and host and first path segment."""
    labels = F.when(host(url).startswith("["), F.array(host(url))).otherwise(F.split(host(url), r"\."))
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    domains = F.when(n >= 2, suffixes).otherwise(F.array().cast("array<string>"))
    segment = F.regexp_extract(url, SEGMENT, 1)
    page = F.when((segment != "") & (host(url) != ""), F.array(F.concat(host(url), F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.concat(domains, page)


def validity(entries: DataFrame) -> DataFrame:
    """(key, list, since, until) of entries (key, list, action, day, seq): days from since up to, not including, until.

    An entry with action add puts key on the list from its day on, any other takes it off. The last one
    of a day by seq, then action, counts. until is null for what is still on the list. Rows with a null key,
    list or day are passed over. Days bound the rows of a key and list, however many entries it has.
    """
    daily = entries.where("key is not null and list is not null and day is not null").groupBy("key", "list", "day").agg(F.max(F.struct("seq", "action"))["action"].alias("action"))
    order = Window.partitionBy("key", "list").orderBy("day")
    on = F.coalesce(F.col("action") == "add", F.lit(False))
    turns = daily.select("key", "list", "day", on.alias("on")).withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    return turns.withColumn("until", F.lead("day").over(order)).where("on").select("key", "list", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """captures with n_active, lists, winner and blocked.

    entries: see validity(). An entry matches a capture if the capture's URL has its key (see keys_of) and
    its interval holds the fetch day. lists are the matching lists, sorted and comma-joined; winner is the
    longest key that matches, of equals the first. A capture is blocked if entries match and the list `allow` has
    none for the longest key, or for another one as long.

    Intervals are clipped at the first and the last fetch day, cut at months and joined by key and month, so that the captures of a busy host are spread
    over months and none meets intervals of other times; a verdict is found once for each URL and day. A capture
    with a null or unusable URL or a null day matches nothing. An IPv6 address matches entries for a path below it only. Repeated rows stay; columns of captures stay,
    in order, but for those of the four added names. Empty tables are fine.
    """
    month = lambda day: F.trunc(day, "month")
    days = captures.agg(F.struct(F.min(F.col(f"`{day_col}`")).alias("first"), F.max(F.col(f"`{day_col}`")).alias("last"))).scalar()
    spans = validity(entries).withColumn("days", days).select("*", "days.first", "days.last").where("since <= last and (until is null or until > first)")
    spans = spans.withColumn("month", F.explode(F.sequence(month(F.greatest("since", "first")), month(F.least(F.coalesce(F.date_sub("until", 1), "last"), "last")), F.expr("interval 1 month"))))
    spans = materialize(spans.select("key", "month", "list", "since", "until"), "spans")
    names = [c for c in captures.columns if c not in ("n_active", "lists", "winner", "blocked")]
    captures = captures.select(*(F.col(f"`{c}`") for c in names))
    url, day = F.col(f"`{url_col}`"), F.col(f"`{day_col}`")
    asked = captures.where(url.isNotNull() & day.isNotNull()).select(url.alias("__url"), day.alias("__day")).distinct()
    probes = asked.withColumn("key", F.explode(F.array_distinct(keys_of(F.col("__url"))))).withColumn("month", month("__day"))
    active = probes.join(spans, ["key", "month"]).where("since <= __day and (until is null or __day < until)")
    best = F.struct(F.length("key").alias("size"), (F.col("list") == ALLOW).alias("allowed"))
    verdicts = active.groupBy("__url", "__day").agg(
        F.count("*").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.min(F.struct((-F.length("key")).alias("size"), F.col("key")))["key"].alias("winner"),
        (~F.max(best)["allowed"]).alias("blocked"),
    )
    verdicts = materialize(verdicts, "verdicts")
    joined = captures.join(verdicts, (url == F.col("__url")) & (day == F.col("__day")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in names), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "winner", F.coalesce("blocked", F.lit(False)).alias("blocked"))
