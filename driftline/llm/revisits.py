"""Resolving not-modified revisits: a distributed as-of join by canonical URL.

A capture that says "not modified" (an HTTP 304 in a revisit record) stands for the latest full response of its
URL before it. Captures are dealt by URL and stretch of time. Within a stretch a window finds the last response
before each revisit; the last response of each stretch is an aggregate, and a window over one row per URL and stretch
hands it on to the later ones. So a URL with any number of captures is spread over as many tasks as it has stretches.

The validators of both must agree: entity tags by weak comparison if both have one, else the dates of last
modification if both have one. The headers of the response are then updated by those of the revisit, but for
the ones that belong to a connection or describe the stored content (RFC 9110 and 9111).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import written

#: The profiles of the WARC format, 1.0 and 1.1.
NOT_MODIFIED = (
    "http://netpreserve.org/warc/1.0/revisit/server-not-modified",
    "http://netpreserve.org/warc/1.1/revisit/server-not-modified",
)
#: Header fields that a not-modified response does not update.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Seconds of a stretch.
STRETCH = 6 * 3600
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without user, default port and fragment, the path at least a slash, the parts of
    the query in order. What does not look like a URL stays as it is, trimmed; null stays null."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), r"^.*@", "")
    port = F.when(scheme == "http", r":(80)?$").when(scheme == "https", r":(443)?$").otherwise(r":$")
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    query = F.array_join(F.array_sort(F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&"), lambda x: x != "")), "&")
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(host, port, F.lit("")), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.regexp_like(url, F.lit(_URL)), whole).otherwise(F.trim(url))


def header_map(block: Column) -> Column:
    """Names in lower case to values; the values of a repeated name are joined by commas. Null is an empty map."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.contains(":") & ~x.startswith(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


def header_text(headers: Column) -> Column:
    """A header map as lines in the order of the names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def _last_before(captures: DataFrame, stretch: int) -> DataFrame:
    """The revisits with ``found``, the struct of the latest response of their URL before their time, or null."""
    response = F.when(F.col("full"), F.struct("record_id", "captured_at", "headers"))
    rows = captures.withColumn("stretch", F.floor(F.col("captured_at").cast("long") / stretch)).withColumn("response", response)
    sums = rows.groupBy("canonical", "stretch").agg(F.max_by("response", F.when(F.col("full"), F.struct("captured_at", "record_id"))).alias("latest"))
    earlier = Window.partitionBy("canonical").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = sums.select("canonical", "stretch", F.last("latest", ignorenulls=True).over(earlier).alias("handed"))
    within = Window.partitionBy("canonical", "stretch").orderBy("captured_at", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.last("response", ignorenulls=True).over(within)).filter("not full")
    return own.join(handed, ["canonical", "stretch"], "left").withColumn("found", F.coalesce("own", "handed")).drop("own", "handed", "stretch", "response")


def resolve(captures: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per not-modified revisit of ``captures``.

    ``captures`` has record_id, warc_type, profile, url, captured_at (timestamp), status (of HTTP) and headers
    (a block of lines); other columns are not looked at. Full responses are response records of status 200. The
    result has record_id, canonical, captured_at, response_id, outcome and headers, merged, as a map: outcome is
    ``resolved``, ``unchecked`` (no validator in common), ``changed`` (validators differ), or ``missing`` (no
    earlier response, or no URL or time); only the first two have headers, ``missing`` has no response_id.
    A response at the same time as the revisit is not earlier; of responses at one time the greatest id counts. A
    revisit that occurs twice gives two rows. An empty table gives an empty result.
    """
    revisit = (F.col("warc_type") == "revisit") & F.col("profile").isin(*NOT_MODIFIED)
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    rows = captures.filter(F.coalesce(revisit | full, F.lit(False))).select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "captured_at", "headers", F.coalesce(full, F.lit(False)).alias("full")
    )
    lost = F.col("canonical").isNull() | F.col("captured_at").isNull()
    named = written(rows, "captures")
    found = _last_before(named.filter(~lost), stretch)
    nothing = named.filter(lost & ~F.col("full")).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    both = found.unionByName(nothing).withColumn("new", header_map(F.col("headers"))).withColumn("old", header_map(F.col("found.headers")))
    tag = lambda m: F.regexp_replace(F.col(m)["etag"], "^W/", "")
    date = lambda m: F.col(m)["last-modified"]
    same = F.coalesce(tag("new") == tag("old"), date("new") == date("old"))
    outcome = F.when(F.col("found").isNull(), "missing").when(same, "resolved").when(~same, "changed").otherwise("unchecked")
    updates = F.map_filter("new", lambda k, _: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.map_contains_key(updates, k)), updates)
    return both.withColumn("outcome", outcome).select(
        "record_id",
        "canonical",
        "captured_at",
        F.col("found.record_id").alias("response_id"),
        "outcome",
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).alias("headers"),
    )
