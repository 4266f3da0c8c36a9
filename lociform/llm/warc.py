"""Not-modified revisits of web archives: an as-of join to the latest earlier full response.

URLs are brought to a canonical form; each revisit takes the latest response of the same
canonical URL with an earlier time, checks the validators and, if they agree, carries the
response's headers with the permitted ones of the revisit merged in. The join is a running
maximum inside spans of time and over the spans, so a URL with very many captures is dealt
over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociform.llm.common import table

#: Headers that describe the stored body or the connection; a 304 doesn't update them.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=.*)?$"
#: Rows for which one span of time is planned; spans hold equally many rows, so a burst has many.
SPAN_ROWS = 250_000
#: Spans at least and at most, powers of two; rows without a URL are dealt over as many parts.
SPANS, MOST_SPANS = 64, 4096


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, ``www.`` and a default port; path without a closing slash;
    query without tracking parameters, sorted; no scheme, no fragment. A null URL stays null."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    body = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    split = F.split(body, r"\?", 2)
    place = split[0]
    host = F.lower(F.regexp_extract(place, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(place, r"^[^/]*", ""), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.coalesce(F.get(split, F.lit(1)), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _span(rows: DataFrame, ts: Column) -> Column:
    """Which of the spans of equally many rows a time lies in; null times lie in none."""
    n = rows.count()
    k = SPANS
    while k < MOST_SPANS and k * SPAN_ROWS < n:
        k *= 2
    ends = rows.agg(F.percentile_approx("ts", [i / k for i in range(1, k)], 20 * k).alias("e")).first()["e"] or []
    if not ends:
        return F.when(ts.isNotNull(), F.lit(0).cast("long"))
    cuts = F.array(*(F.lit(x).cast("long") for x in ends))
    steps = F.array(*(F.lit(1 << i) for i in range(k.bit_length() - 2, -1, -1)))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(cuts, at + step - 1) <= ts, F.lit(False)), at + step).otherwise(at))
    return F.when(ts.isNotNull(), found.cast("long"))


def resolve(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", kind_col: str = "kind", status_col: str = "status", headers_col: str = "headers", digest_col: str = "digest") -> DataFrame:
    """(record_id, url_key, kind, outcome, resolved_id, digest, headers) of every record.

    ``kind`` is ``response`` or ``revisit``; ``headers`` is a map of lower-case names. Only
    responses of status 200 with an id and a time can be taken, the one of the largest id
    among equal times. outcome: ``response`` and ``other`` for rows that are no revisits,
    ``resolved``, ``no_earlier`` (none found, or the revisit has no URL or time) or
    ``mismatch``: an ETag (weak comparison) or else a Last-Modified that both carry differs,
    or neither is carried by both and the digests differ or are null. headers: sorted
    "name: value" lines; those of a resolved revisit are the response's with its own
    merged in. Repeated rows are kept; other columns are not read.
    """
    c = F.col
    rows = records.select(c(id_col).cast("long").alias("record_id"), canonical_url(c(url_col)).alias("url_key"), c(time_col).cast("long").alias("ts"), c(kind_col).alias("kind"), c(status_col).cast("int").alias("status"), F.coalesce(c(headers_col), F.create_map().cast("map<string,string>")).alias("h"), c(digest_col).alias("digest"))
    rows = rows.withColumn("span", _span(rows, c("ts")))
    full = (c("kind") == "response") & (c("status") == 200) & c("record_id").isNotNull() & c("ts").isNotNull() & c("url_key").isNotNull()
    offer = F.when(full, F.struct("ts", "record_id", F.map_entries("h").alias("entries"), "digest"))
    near = F.max(offer).over(W.partitionBy("url_key", "span", "part").orderBy("ts").rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("part", F.when(c("url_key").isNull(), F.pmod(F.xxhash64("record_id", "ts", "digest"), F.lit(MOST_SPANS)))).withColumn("near", near)
    last = rows.where(full).groupBy("url_key", "span").agg(F.max(offer).alias("last"))
    asked = rows.where("kind = 'revisit' AND near IS NULL AND url_key IS NOT NULL AND span IS NOT NULL").select("url_key", "span").distinct()
    line = asked.withColumn("last", F.lit(None).cast(last.schema["last"].dataType)).unionByName(last)
    far = F.max("last").over(W.partitionBy("url_key").orderBy("span").rangeBetween(W.unboundedPreceding, -1))
    carried = line.select("url_key", "span", far.alias("far")).groupBy("url_key", "span").agg(F.first("far").alias("far")).where("far IS NOT NULL")
    rows = rows.join(carried, ["url_key", "span"], "left")
    is_revisit = c("kind") == "revisit"
    found = F.when(is_revisit & c("ts").isNotNull(), F.coalesce("near", "far"))
    rows = rows.withColumn("found", found)
    old = F.map_from_entries(c("found.entries"))
    tag = lambda m: F.regexp_replace(F.element_at(m, F.lit("etag")), "^W/", "")
    when = lambda m: F.element_at(m, F.lit("last-modified"))
    agree = F.coalesce(tag(c("h")) == tag(old), when(c("h")) == when(old), c("digest") == c("found.digest"), F.lit(False))
    outcome = F.when(is_revisit, F.when(c("found").isNull(), "no_earlier").when(agree, "resolved").otherwise("mismatch")).when(full, "response").otherwise("other")
    rows = rows.withColumn("outcome", outcome)
    own = F.filter(F.map_entries("h"), lambda e: ~e["key"].isin(*NOT_MERGED))
    names = F.transform(own, lambda e: e["key"])
    merged = F.concat(F.filter(c("found.entries"), lambda e: ~F.array_contains(names, e["key"])), own)
    entries = F.when(c("outcome") == "resolved", merged).otherwise(F.map_entries("h"))
    text = F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    taken = c("outcome") == "resolved"
    return rows.select("record_id", "url_key", "kind", "outcome", F.when(taken, c("found.record_id")).alias("resolved_id"), F.when(taken, c("found.digest")).otherwise(c("digest")).alias("digest"), text.alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """Every page as a captured response, and a later revisit of each third page's URL.

    Page ids are the order of capture. Revisits of even pages carry the ETag of the page,
    weak for every fourth, those of the others a date; each seventh carries a stale tag.
    """
    c = F.col
    digest = F.md5(F.coalesce("html", F.lit("")))
    made = lambda **m: F.map_from_arrays(F.array(*(F.lit(k.replace("_", "-")) for k in m)), F.array(*m.values()))
    day = F.concat(F.lit("day "), (c("page_id") % 365).cast("string"))
    response = pages.select(
        (c("page_id") * 2).alias("record_id"), "url", (c("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        made(etag=F.concat(F.lit('"'), digest, F.lit('"')), last_modified=day, content_type=F.lit("text/html"), content_length=F.length(F.coalesce("html", F.lit(""))).cast("string"), date=day).alias("headers"), digest.alias("digest"),
    )
    tag = F.concat(F.when(c("page_id") % 4 == 0, "W/").otherwise(""), F.lit('"'), F.when(c("page_id") % 7 == 0, "stale").otherwise(digest), F.lit('"'))
    shared = {"date": F.concat(day, F.lit(" later")), "content_type": F.lit("text/plain"), "cache_control": F.lit("max-age=60")}
    headers = F.when(c("page_id") % 2 == 0, made(etag=tag, **shared)).otherwise(made(last_modified=day, **shared))
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    revisit = pages.where(c("page_id") % 3 == 0).select((c("page_id") * 2 + 1).alias("record_id"), again.alias("url"), (c("page_id") * 10 + 5005).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Every page's capture and every revisit, resolved where the validators agree."""
    return resolve(records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS d, length(coalesce(html, '')) AS n, 'day ' || (page_id % 365) AS day FROM pages
), records AS (
  SELECT page_id * 2 AS record_id, url, page_id * 10 AS ts, 'response' AS kind, '"' || d || '"' AS etag, day AS modified,
         'text/html' AS ctype, CAST(n AS VARCHAR) AS clen, day AS date, NULL AS cache, d AS digest FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '#.*$', '') || '#again', page_id * 10 + 5005, 'revisit',
         CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 'W/' ELSE '' END || '"' || CASE WHEN page_id % 7 = 0 THEN 'stale' ELSE d END || '"' END,
         CASE WHEN page_id % 2 <> 0 THEN day END, 'text/plain', NULL, day || ' later', 'max-age=60', NULL FROM p WHERE page_id % 3 = 0
), parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS body FROM records
), halves AS (
  SELECT *, regexp_extract(body, '^([^?]*)', 1) AS place, regexp_replace(body, '^[^?]*\??', '') AS q FROM parts
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '')
       || regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '')
       || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'),
            lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=.*)?$'))), '&'), ''), '') AS url_key
  FROM halves
), found AS (
  SELECT r.*, o.record_id AS o_id, o.etag AS o_etag, o.modified AS o_modified, o.ctype AS o_ctype, o.clen AS o_clen, o.digest AS o_digest
  FROM keyed r LEFT JOIN LATERAL (
    SELECT * FROM keyed k WHERE r.kind = 'revisit' AND k.kind = 'response' AND k.url_key = r.url_key AND k.ts < r.ts ORDER BY k.ts DESC, k.record_id DESC LIMIT 1
  ) o ON TRUE
), judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN o_id IS NULL THEN 'no_earlier'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(o_etag, '^W/', ''), modified = o_modified, digest = o_digest, FALSE) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM found
)
SELECT record_id, url_key, kind, outcome, CASE WHEN outcome = 'resolved' THEN o_id END AS resolved_id,
       CASE WHEN outcome = 'resolved' THEN o_digest ELSE digest END AS digest,
       concat_ws(chr(10), 'cache-control: ' || cache,
         'content-length: ' || CASE WHEN outcome = 'resolved' THEN o_clen ELSE clen END,
         'content-type: ' || CASE WHEN outcome = 'resolved' THEN o_ctype ELSE ctype END,
         'date: ' || date,
         'etag: ' || CASE WHEN outcome = 'resolved' THEN o_etag ELSE etag END,
         'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(modified, o_modified) ELSE modified END) AS headers
FROM judged
"""
