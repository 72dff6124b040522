"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record (an answer 304) has no body: it refers to the latest earlier full response of the same
canonical URL. Records are cut into time buckets, and a bucket in which one URL has more than a fair share of all rows into
shorter ones for that URL, so that a URL with any share of all rows spreads over its buckets: within a bucket a window
finds the latest response, and what earlier buckets leave behind is carried over on one row for each URL and bucket. Only
records of one URL at one time are never parted. Bodies never move; results name the response record, its digest and
length, and the headers of the answer as the client would see them.

Validators: ETags if both sides have one (compared weakly), else Last-Modified if both have it, else payload
digests if both have one, else none. Headers: those that a 304 may update come from the revisit, all others
from the response.

status of a revisit: resolved; mismatch (the latest earlier response has other validators); unverified (no
validator on both sides); orphan (no earlier response). Only for `resolved` are headers merged.

Defined results: responses at the same time as a revisit are not earlier; of responses at one time the one with
the greatest record_id counts, null first; a null url or time makes a revisit an orphan; null headers count as
none; repeated revisits are resolved each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlake.llm.common import fair_share, sizes, table

#: Headers that RFC 9110 (15.4.5, 15.3.4) lets a 304 response bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Of time in a bucket, in the units of ts.
BUCKET = 100_000


def canonical_url(url: Column) -> Column:
    """Without scheme, www. or m., default port, fragment, tracking parameters, index file ending and final slash; host in lower case."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^(www|m)[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "([.]html|/)$", ""))


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The revisits among records: record_id, url_key, ts, status, refers_to, digest, length, headers.

    records: record_id long, url string, ts long, kind string (response or revisit), digest string, length long,
    headers map<string, string> with names in lower case.
    """
    named = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.floor(F.col("ts") / bucket).alias("bucket"),
        (F.col("kind") == "revisit").alias("asks"), "digest", "length", "headers",
    ).filter("asks IS NOT NULL")
    response = F.when(~F.col("asks"), F.struct("ts", "record_id", "digest", "length", "headers"))
    named = named.withColumn("response", response)
    known = _bucketed(named.filter("url_key IS NOT NULL AND ts IS NOT NULL"), bucket)

    # maps have no order: the latest is chosen by time and id
    left = known.groupBy("url_key", "bucket").agg(F.max_by("response", F.when(~F.col("asks"), F.struct("ts", "record_id"))).alias("left"))
    earlier = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.withColumn("carried", F.last("left", ignorenulls=True).over(earlier)).select("url_key", "bucket", "carried")
    so_far = Window.partitionBy("url_key", "bucket").orderBy("ts", F.col("asks").desc(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    within = known.withColumn("latest", F.last("response", ignorenulls=True).over(so_far)).filter("asks").drop("response")
    found = within.join(carried, ["url_key", "bucket"]).withColumn("r", F.coalesce("latest", "carried")).drop("latest", "carried")
    lost = named.filter("asks AND (url_key IS NULL OR ts IS NULL)").withColumn("r", F.col("response")).drop("response")
    return _answered(found.unionByName(lost))


def _bucketed(known: DataFrame, bucket: int) -> DataFrame:
    """known with `bucket` as the begin of each record's bucket in time; busy ones are parted evenly."""
    counts = sizes(known, "url_key", "bucket")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    begin = F.col("bucket") * bucket
    if not total or most <= fair_share(total):
        return known.withColumn("bucket", begin)
    share = fair_share(total)
    busy = counts.filter(F.col("n") > share).select("url_key", "bucket", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    length = F.greatest(F.ceil(F.lit(bucket) / F.coalesce("parts", F.lit(1))), F.lit(1))
    marked = known.join(F.broadcast(busy), ["url_key", "bucket"], "left")  # fair_share bounds them
    return marked.withColumn("bucket", begin + F.floor((F.col("ts") - begin) / length) * length).drop("parts")


def _answered(rows: DataFrame) -> DataFrame:
    own, full = (lambda name: F.element_at("headers", name)), (lambda name: F.element_at("r.headers", name))
    tag = lambda x: F.regexp_replace(x, "^W/", "")
    agree = F.lit(None).cast("boolean")
    for a, b in ((F.col("digest"), F.col("r.digest")), (own("last-modified"), full("last-modified")), (tag(own("etag")), tag(full("etag")))):
        agree = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(agree)
    status = F.when(F.col("r").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    none = F.expr("cast(map() as map<string, string>)")
    allowed = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("r.headers", none), lambda k, _: ~F.array_contains(F.map_keys("allowed"), k))
    rows = rows.withColumn("status", status).withColumn("allowed", allowed)
    resolved = F.col("status") == "resolved"
    return rows.select(
        "record_id", "url_key", "ts", "status",
        F.col("r.record_id").alias("refers_to"),
        F.when(resolved, F.col("r.digest")).alias("digest"),
        F.when(resolved, F.col("r.length")).alias("length"),
        F.when(resolved, F.map_concat(kept, F.col("allowed"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a crawl, by rule from pages: a page is a full response at time 100 * page_id, followed by
    a revisit with its own ETag; by every third page_id, one with an outdated ETag; by every fifth, one by
    Last-Modified alone just before it; by every seventh, one without validators."""
    html, i = F.coalesce("html", F.lit("")), F.col("page_id")
    at = i * 100
    digest = F.md5(html.cast("binary"))
    tag = F.concat(F.lit('"'), F.left(digest, F.lit(12)), F.lit('"'))
    text = lambda x: F.lit(x)
    headers = lambda *kv: F.create_map(*(x if isinstance(x, Column) else text(x) for x in kv))
    record = lambda n, ts, kind, dig, size, head: F.struct((i * 5 + n).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("kind"), dig.alias("digest"), size.alias("length"), head.alias("headers"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")
    day = F.concat(F.lit("day "), (i % 28).cast("string"))
    full = headers("content-type", "text/html", "etag", tag, "last-modified", day, "date", at.cast("string"), "server", "origin")
    made = [
        record(0, at, "response", digest, F.length(html).cast("long"), full),
        record(1, at + 10, "revisit", none, nothing, headers("etag", F.concat(F.lit("W/"), tag), "date", (at + 10).cast("string"), "server", "edge", "cache-control", "max-age=60")),
        F.when(i % 3 == 0, record(2, at + 20, "revisit", none, nothing, headers("etag", '"outdated"', "date", (at + 20).cast("string")))),
        F.when(i % 5 == 0, record(3, at - 10, "revisit", none, nothing, headers("last-modified", day, "date", (at - 10).cast("string")))),
        F.when(i % 7 == 0, record(4, at + 30, "revisit", none, nothing, headers("date", (at + 30).cast("string")))),
    ]
    return pages.select("url", F.explode(F.array(*made)).alias("c")).filter("c IS NOT NULL").select("url", "c.*")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k)))
    return found.select("record_id", "url_key", "ts", "status", "refers_to", "digest", "length", F.array_join(lines, "\n").alias("headers"))


SQL = r"""
with p as (
  select page_id i, coalesce(html, '') html, page_id * 100 as ts, md5(coalesce(html, '')) digest,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') u
  from pages
), k as (
  select *, '"' || substr(digest, 1, 12) || '"' tag, 'day ' || (i % 28) as d,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^(www|m)[.]', ''), ':(80|443)$', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''),
      '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '([.]html|/)$', '') as url_key
  from p
), asks as (
  select i * 5 + 1 record_id, url_key, ts + 10 ts, tag etag, null lm, true cc from k
  union all select i * 5 + 2, url_key, ts + 20, '"outdated"', null, false from k where i % 3 = 0
  union all select i * 5 + 3, url_key, ts - 10, null, d, false from k where i % 5 = 0
  union all select i * 5 + 4, url_key, ts + 30, null, null, false from k where i % 7 = 0
), found as (
  select a.*, k.i, k.tag, k.d, k.digest, k.html, k.ts rts,
    case when k.i is null then 'orphan' when a.etag is not null then case when a.etag = k.tag then 'resolved' else 'mismatch' end
         when a.lm is not null then case when a.lm = k.d then 'resolved' else 'mismatch' end else 'unverified' end status
  from asks a asof left join k on a.url_key = k.url_key and a.ts > k.ts
)
select record_id, url_key, ts, status, i * 5 refers_to,
  case when status = 'resolved' then digest end digest,
  case when status = 'resolved' then cast(length(html) as bigint) end "length",
  case when status = 'resolved' then
    case when cc then 'cache-control: max-age=60' || chr(10) else '' end || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) ||
    'etag: ' || case when cc then 'W/' else '' end || tag || chr(10) || 'last-modified: ' || d || chr(10) || 'server: origin' end headers
from found
"""
