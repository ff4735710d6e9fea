"""URL filters that change over time: dated list entries, joined as of the fetch day.

An entry is a pattern, a verdict, a day and whether it is added or removed that day. Entries of one
pattern and verdict become validity intervals [from, until). A capture is judged by the entries that
were active on the day it was fetched. Patterns are ``d:host`` (the host and all below it) or
``p:host/directories/`` (URLs below a directory). Directories beat domains, longer patterns beat
shorter ones, and for the same pattern 'allow' beats 'block'.

DataFrame functions only. Captures are reduced to distinct (url, day) before they are spread over
the patterns they could match, so a URL that is fetched again and again is judged once a day.

Defined results: entries without pattern, verdict or day are never active. Of entries for one
pattern, verdict and day a removal counts. Captures without URL, host or day have the verdict
'none'. Repeated captures each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
ENDLESS = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, valid_from, valid_until) of (pattern, verdict, day, added)."""
    known = entries.where("pattern is not null and verdict is not null and day is not null")
    daily = known.groupBy("pattern", "verdict", "day").agg(
        F.min(F.coalesce("added", F.lit(False))).alias("added"))
    following = F.lead("day").over(Window.partitionBy("pattern", "verdict").orderBy("day"))
    daily = daily.withColumn("valid_until", F.coalesce(following, F.lit(ENDLESS).cast("date")))
    return daily.where("added").select("pattern", "verdict", F.col("day").alias("valid_from"), "valid_until")


def patterns_of(url: Column, labels: int, depth: int) -> Column:
    """Every pattern a URL can match, with its rank: domains of up to ``labels`` labels and
    directories down to ``depth``."""
    host = host_of(url)
    parts = F.split(host, "\\.")
    most = F.least(F.size(parts), F.lit(labels))
    domains = F.transform(
        F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(parts, -k, k), ".")).alias("pattern"),
                           k.alias("rank")))
    path = F.regexp_extract(url, PATH, 1)
    slashes = F.least(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), F.lit(depth))
    directories = F.transform(
        F.when(slashes > 0, F.sequence(F.lit(1), slashes)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.concat(F.lit("p:"), host, F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")).alias("pattern"),
                           (k + 1_000_000).alias("rank")))
    return F.when(host != "", F.concat(domains, directories))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched, any other column) with verdict, pattern and valid_from added."""
    valid = intervals(entries)
    # No pattern has more labels or directories than these; longer ones of a URL match nothing.
    most = valid.agg(
        F.max(F.when(F.col("pattern").startswith("d:"), F.size(F.split("pattern", "\\.")))),
        F.max(F.when(F.col("pattern").startswith("p:"), F.size(F.split("pattern", "/")) - 1))).head()
    urls = captures.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    keys = urls.select("url", "fetched", F.explode(patterns_of(F.col("url"), most[0] or 0, most[1] or 0)).alias("k"))
    keys = keys.select("url", "fetched", F.col("k.pattern").alias("pattern"), F.col("k.rank").alias("rank"))
    met = keys.join(valid, (keys["pattern"] == valid["pattern"]) & (keys["fetched"] >= valid["valid_from"])
                    & (keys["fetched"] < valid["valid_until"])).drop(valid["pattern"])
    best = F.max(F.struct("rank", (F.col("verdict") == "allow").alias("allow"), "verdict", "pattern", "valid_from"))
    found = met.groupBy("url", "fetched").agg(best.alias("b")).select(
        F.col("url").alias("_url"), F.col("fetched").alias("_fetched"), "b.verdict", "b.pattern", "b.valid_from")
    out = captures.join(found, (captures["url"] == found["_url"]) & (captures["fetched"] == found["_fetched"]), "left")
    return out.drop("_url", "_fetched").withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def entries_of_hosts(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, for the registered query: whether and when a
    pattern is added and removed follows from a hash of it."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    code = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    hosts = hosts.select("host", code.alias("code"))
    start = F.to_date(F.lit("2024-01-01"))

    def entry(pattern: Column, verdict: str, after: Column, added: bool) -> Column:
        return F.struct(pattern.alias("pattern"), F.lit(verdict).alias("verdict"),
                        F.date_add(start, after.cast("int")).alias("day"), F.lit(added).alias("added"))

    domain = F.concat(F.lit("d:"), F.col("host"))
    parent = F.concat(F.lit("d:"), F.substring_index("host", ".", -3))
    folder = F.concat(F.lit("p:"), F.col("host"), F.lit("/en/"))
    first = F.col("code") % 180
    groups = [
        (F.col("code") % 3 == 0, [entry(domain, "block", first, True), entry(domain, "block", first + 60, False),
                                  entry(domain, "block", first + 120, True)]),
        (F.col("code") % 5 == 0, [entry(parent, "block", first + 30, True)]),
        (F.col("code") % 4 == 1, [entry(folder, "allow", first + 10, True), entry(folder, "allow", first + 200, False)]),
    ]
    none = F.array().cast("array<struct<pattern:string,verdict:string,day:date,added:boolean>>")
    every = F.concat(*[F.when(c, F.array(*e)).otherwise(none) for c, e in groups])
    return hosts.select(F.explode(every).alias("e")).select("e.*")
