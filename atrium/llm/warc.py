"""Not-modified revisits of a web archive: each gets the latest earlier full response of its canonical URL.

Records: record_id, url, captured (integer time), kind (``response`` or ``revisit``), headers
(map of lower-case names), body (of responses).

The as-of join works on time ranges: the last response of each (URL, range) is one row of an
aggregate, a window over ranges carries it forward, and a window inside each range finds what is
nearer.  A URL that holds a third of all records is thereby spread over all ranges, and no body
moves before the match is known.

Defined results: a revisit without URL or time, or without an earlier response, has outcome ``no_response``;
equal times are not earlier; of responses at one time the greatest record_id counts; without a
validator on both sides the outcome is ``no_validator``, with a differing one ``mismatch``, and only
``resolved`` ones get headers and body.  Repeated rows give repeated results.  Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.session import cut_lineage

RANGES = 1024

#: Headers that a not-modified answer may renew.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, tracking parameters and closing slash; parameters sorted."""
    plain = F.regexp_replace(url, "#.*$", "")
    shape = r"^[A-Za-z]+://([^/?]*)([^?]*)(?:\?(.*))?$"
    part = [F.regexp_extract(plain, shape, i) for i in (1, 2, 3)]
    host = F.regexp_replace(F.regexp_replace(F.lower(part[0]), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(part[1], "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part[2], "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def latest_response(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Revisit records with ``prior``: id, time and headers of the latest earlier response of their URL (null if none)."""
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "captured", "kind", "headers")
    rows = cut_lineage(rows)
    limits = rows.agg(F.min("captured"), F.max("captured")).first()
    width = max(1, ((limits[1] or 0) - (limits[0] or 0)) // ranges + 1)
    known = rows.filter("canonical IS NOT NULL AND captured IS NOT NULL") \
        .withColumn("range", F.floor((F.col("captured") - F.lit(limits[0] or 0)) / width))
    response = F.when(F.col("kind") == "response", F.struct("record_id", "captured", "headers"))
    order = F.when(F.col("kind") == "response", F.struct("captured", F.coalesce("record_id", F.lit(-(1 << 62)))))
    last = known.groupBy("canonical", "range").agg(F.max_by(response, order).alias("last"))
    before = W.partitionBy("canonical").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("canonical", "range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # at equal times revisits stand before responses, so what precedes them is earlier
    within = W.partitionBy("canonical", "range").orderBy("captured", F.col("kind") == "response", "record_id")
    near = known.repartition("canonical", "range") \
        .withColumn("near", F.last(response, ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, -1)))
    found = near.filter("kind = 'revisit'").join(carried, ["canonical", "range"]) \
        .select("record_id", "canonical", "captured", "headers", F.coalesce("near", "carried").alias("prior"))
    rest = rows.filter("kind = 'revisit' AND (canonical IS NULL OR captured IS NULL)")
    return found.unionByName(rest.select("record_id", "canonical", "captured", "headers"), allowMissingColumns=True)


def outcome(headers: Column, prior: Column) -> Column:
    """Validators of the revisit against those of the response."""
    tests = []
    for name, change in (("etag", _weak), ("last-modified", lambda c: c)):
        tests.append((change(headers[name]), change(prior["headers"][name])))
    checked = F.lit(False)
    differs = F.lit(False)
    for own, its in tests:
        both = own.isNotNull() & its.isNotNull()
        checked, differs = checked | both, differs | (both & (own != its))
    return F.when(prior.isNull(), "no_response").when(differs, "mismatch").when(checked, "resolved").otherwise("no_validator")


def resolve_revisits(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Per revisit: record_id, canonical, response_id, outcome, headers (merged) and body (both of resolved ones)."""
    found = latest_response(records, ranges).withColumn("outcome", outcome(F.col("headers"), F.col("prior")))
    renewed = F.map_filter("headers", lambda name, _: name.isin(PERMITTED))
    kept = F.map_filter(F.col("prior.headers"), lambda name, _: ~F.map_contains_key(renewed, name))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(kept, renewed))
    found = found.select("record_id", "canonical", F.col("prior.record_id").alias("response_id"), F.col("prior.captured").alias("response_time"),
                         "outcome", merged.alias("merged"))
    bodies = records.filter("kind = 'response'").select(
        F.col("record_id").alias("its_id"), F.col("captured").alias("its_time"), "body").dropDuplicates(["its_id", "its_time"])
    same = F.col("response_id").eqNullSafe(F.col("its_id")) & (F.col("response_time") == F.col("its_time")) & (F.col("outcome") == "resolved")
    return found.join(bodies, same, "left").select("record_id", "canonical", "response_id", "outcome", F.col("merged").alias("headers"), "body")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records derived from a table of pages: each page is a full response and is asked for again later.

    The second request spells the URL differently.  Every seventh finds a changed page (another
    ETag), every eleventh stands before the response, every thirteenth carries no validator.
    """
    page = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    response = pages.select(
        (page * 2).alias("record_id"), "url", (page * 10).alias("captured"), F.lit("response").alias("kind"), F.create_map(
            F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (page * 10).cast("string")).alias("headers"),
        F.col("html").alias("body"))
    asked = F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again"))
    when = page * 10 + F.when(page % 11 == 0, -5).otherwise(5)
    sent = F.when(page % 13 == 0, F.create_map(F.lit("date"), when.cast("string"))).otherwise(F.create_map(
        F.lit("etag"), F.concat(F.lit("W/"), F.when(page % 7 == 0, F.lit('"changed"')).otherwise(etag)), F.lit("date"), when.cast("string"),
        F.lit("content-type"), F.lit("none")))
    revisit = pages.select((page * 2 + 1).alias("record_id"), asked.alias("url"), when.alias("captured"), F.lit("revisit").alias("kind"),
                           sent.alias("headers"), F.lit(None).cast("string").alias("body"))
    return response.unionByName(revisit)


def revisit_digest(pages: DataFrame) -> DataFrame:
    done = resolve_revisits(records_of_pages(pages))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k)))
    return done.select("record_id", F.col("canonical").alias("canonical_url"), "response_id", "outcome",
                       F.array_join(lines, "; ").alias("merged_headers"), F.md5("body").alias("body_md5"))


#: The same result in plain SQL.
ORACLE = r"""
WITH plain AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS p FROM pages),
parts AS (
  SELECT *, regexp_extract(p, '^[A-Za-z]+://([^/?]*)([^?]*)(?:\?(.*))?$', 1) AS h, regexp_extract(p, '^[A-Za-z]+://([^/?]*)([^?]*)(?:\?(.*))?$', 2) AS path,
    regexp_extract(p, '^[A-Za-z]+://([^/?]*)([^?]*)(?:\?(.*))?$', 3) AS q FROM plain),
canon AS (
  SELECT page_id, html, '"' || substr(md5(html), 1, 12) || '"' AS etag,
    regexp_replace(regexp_replace(lower(h), ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) > 0
       THEN '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') ELSE '' END AS u
  FROM parts),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, page_id, u, etag, page_id * 10 + CASE WHEN page_id % 11 = 0 THEN -5 ELSE 5 END AS asked FROM canon),
matched AS (
  SELECT r.record_id, r.page_id, r.u, r.asked, r.etag, c.page_id AS page, c.etag AS its, c.html,
    row_number() OVER (PARTITION BY r.record_id ORDER BY c.page_id DESC NULLS LAST) AS nth
  FROM revisits r LEFT JOIN canon c ON c.u = r.u AND c.page_id * 10 < r.asked),
judged AS (
  SELECT *, CASE WHEN page IS NULL THEN 'no_response' WHEN page_id % 13 = 0 THEN 'no_validator'
    WHEN page_id % 7 = 0 OR its <> etag THEN 'mismatch' ELSE 'resolved' END AS outcome
  FROM matched WHERE nth = 1)
SELECT record_id, u AS canonical_url, page * 2 AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html; date: ' || asked || '; etag: W/' || etag END AS merged_headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM judged
"""
