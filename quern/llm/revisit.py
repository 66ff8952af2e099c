"""WARC not-modified revisits: each is resolved to the latest earlier full response of its canonical URL.

Records: record_id, uri, at (capture time, any orderable type), kind ('response' or 'revisit'), status, headers
(map<string,string>, names in any case). Canonical URL: scheme, user, 'www.', default port, fragment, trailing slashes and
tracking parameters are dropped, the host is lower case, parameters are sorted.

The as-of join looks for the last response with status 200 before the revisit in order of time (at the same time: responses
count as earlier, the largest record_id wins). Its body stays where it is; the result refers to it. Records are parted by
ranges of (canonical URL, time), so that a hot URL is spread over many tasks; within a part a window finds the last response,
and what a part's first URL needs from before comes from a window over one row a part.
Validators: an ETag that both have decides (weak comparison); else Last-Modified that both have; else nothing contradicts.
Headers: those of the 304 replace the stored ones, except those that a 304 must not update (content-*, but content-location
and content-language, and hop-by-hop ones).

outcome: 'resolved', 'changed' (a validator differs) or 'missing' (no earlier full response, or no URL). Nulls and edge cases:
null headers are none, header names that differ by case only count once (the last in order of name wins); a null time is
before all others; a null or empty URL is missing; repeated records are resolved one by one; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import materialise

FIXED = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
TRACKING = "^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(authority, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(F.trim(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _lower_names(headers: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.map_from_entries(F.array(F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """(record_id, canonical, refers_to, outcome, headers) for each revisit with status 304; headers: sorted 'name: value' lines.

    parts: how many ranges; the session's number of shuffle partitions, if it isn't given."""
    rows = records.select("record_id", canonical_url(F.col("uri")).alias("canonical"), "at", "kind", "status", _lower_names(F.col("headers")).alias("h"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    wanted = (F.col("kind") == "revisit") & (F.col("status") == 304)
    rows = rows.where(full | wanted).withColumn("late", F.when(full, 0).otherwise(1))
    # a missing URL has no partition of its own: its record is its key
    key = F.coalesce(F.col("canonical"), F.concat(F.lit("\0"), F.col("record_id").cast("string")))
    order = [F.col("at").asc_nulls_first(), "late", "record_id"]
    ranged = rows.withColumn("key", key).repartitionByRange(*([parts] if parts else []), "key", *order).withColumn("part", F.spark_partition_id())
    rows = materialise(ranged)  # the ranges are drawn from a sample: drawn again they'd differ
    before = W.partitionBy("part", "key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    response = F.when(full & F.col("canonical").isNotNull(), F.struct("record_id", "h"))
    found = rows.withColumn("base", F.last(response, ignorenulls=True).over(before)).where(wanted)
    # one row a part, so as many as there are partitions: its first key, and its last one with that one's last response
    ends = rows.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("key"))
    last = rows.where(response.isNotNull()).join(F.broadcast(ends.select("part", "key")), ["part", "key"]).groupBy("part", "key").agg(F.max_by(F.struct("record_id", "h"), F.struct(F.col("at").isNotNull(), "at", "record_id")).alias("last"))
    since = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    steps = ends.join(F.broadcast(last), ["part", "key"], "left").select("part", "key", "last").unionByName(ends.where("first <> key").select("part", F.col("first").alias("key"), F.lit(None).alias("last")))
    brought = steps.withColumn("brought", F.last("last", ignorenulls=True).over(since)).where("brought is not null").select("part", "key", "brought")
    found = found.join(F.broadcast(brought), ["part", "key"], "left").withColumn("base", F.coalesce("base", "brought"))
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    old, new = F.col("base.h"), F.col("h")
    tag, when = [weak(m["etag"]) for m in (old, new)], [m["last-modified"] for m in (old, new)]
    agrees = F.when(tag[0].isNotNull() & tag[1].isNotNull(), tag[0] == tag[1]).when(when[0].isNotNull() & when[1].isNotNull(), when[0] == when[1]).otherwise(True)
    outcome = F.when(F.col("base").isNull(), "missing").when(agrees, "resolved").otherwise("changed")
    allowed = F.map_filter(new, lambda k, _: ~k.isin(FIXED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    out = found.withColumn("outcome", outcome)
    got = F.col("outcome") == "resolved"
    return out.select("record_id", "canonical", F.when(F.col("outcome") != "missing", F.col("base.record_id")).alias("refers_to"), "outcome", F.when(got, lines).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a page table: page_id, url, html. Each page is a full response and has a later revisit; every
    eleventh has one before it too, every fifth revisit comes with another validator."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    n = F.col("page_id")
    day = F.concat(F.lit("day "), (n - n % 7).cast("string"))
    base = pages.select("page_id", "url", F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"), tag.alias("tag"), day.alias("day"))
    response = base.select((n * 4).alias("record_id"), F.col("url").alias("uri"), (n * 60).alias("at"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("ETag"), "tag", F.lit("Last-Modified"), "day", F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), "size").alias("headers"))
    other = F.when(n % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    age = F.concat(F.lit("max-age="), (n % 100).cast("string"))
    reply = F.create_map(F.lit("etag"), other, F.lit("Cache-Control"), age, F.lit("Content-Length"), F.lit("0"), F.lit("Connection"), F.lit("close"))
    later = base.select((n * 4 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("uri"), (n * 60 + 30).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), reply.alias("headers"))
    early = base.where(n % 11 == 0).select((n * 4 + 2).alias("record_id"), F.col("url").alias("uri"), (n * 60 - 30).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), reply.alias("headers"))
    return response.unionByName(later).unionByName(early)
