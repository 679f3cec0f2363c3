"""Resolution of WARC revisit records that say "not modified".

A revisit stands for the latest full response of its canonical URL captured before it. The validators must agree:
entity tags by weak comparison if both have one, else Last-Modified dates; a revisit that has neither in common with the
response is not resolved. The resolved record has the response's headers, with those that a 304 may update taken from
the revisit.

Header names are compared in lower case, as HTTP has them, and given back so; of names that differ in case only the first counts.

Defined results: a null URL, or a URL without an earlier response, is not resolved. Null headers are none. Of responses of one time the one of
largest record id counts. Repeated revisits give repeated rows. URLs and headers may be empty or of any length. Columns other than the four
named are not read, so their names cannot clash. No revisits give no rows; without responses all are missing. A URL that holds a third of
all records is split by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.operators.asof import asof

#: Headers that a 304 response updates, and URL parameters that do not name a page.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "utm_[^&=]*|ref|gclid|fbclid"


def canonical(url: Column) -> Column:
    """Without scheme, fragment, www. or m., default port, tracking parameters and last slash; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    rest = F.regexp_replace(rest, rf"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(host), "^(www|m)[.]", ""), ":(80|443)$", ""), F.regexp_replace(rest, "/$", ""))


def _lower(headers: Column) -> Column:
    """The headers with their names in lower case, the first of equal ones."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    made = F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]))
    return F.coalesce(made, F.create_map().cast("map<string,string>"))


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(revisits: DataFrame, responses: DataFrame, width: int | None = None) -> DataFrame:
    """For revisits and responses (record_id, url, ts long, headers map): record_id, url_key, ts, response_id, status, headers.

    status is resolved, changed (validators differ), unverified (no common validator) or missing (no earlier response).
    headers is null unless resolved.
    """
    left = revisits.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", _lower(F.col("headers")).alias("own"))
    right = responses.select(F.col("record_id").alias("response_id"), canonical(F.col("url")).alias("url_key"), "ts", _lower(F.col("headers")).alias("full"))
    found = asof(left, right.filter("url_key is not null"), ["url_key"], "ts", "response_id", ["response_id", "full"], width=width, inclusive=False)
    same = lambda name, f=lambda c: c: f(F.col("own")[name]) == f(F.col("full")[name])
    agrees = F.coalesce(same("etag", _tag), same("last-modified"))
    status = F.when(F.col("response_id").isNull(), "missing").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed")
    newer = F.map_filter("own", lambda k, _: k.isin(*UPDATED))
    older = F.map_filter("full", lambda k, _: ~F.map_contains_key(newer, k))
    merged = F.map_concat(older, newer)
    return found.select("record_id", "url_key", "ts", "response_id", status.alias("status"), F.when(status == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisits and responses made of raw pages: every page is a response at ten times its id, and is asked for again
    later, by when another capture of its canonical URL may have changed it."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    sent = F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), (F.col("page_id") * 10).cast("string"), F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("page_id") % 7).cast("string")))
    responses = pages.select(F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), sent.alias("headers"))
    later = F.col("page_id") * 10 + F.col("page_id") * 7919 % 50021 + 1
    asked = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("no-cache"))
    revisits = pages.select(F.col("page_id").alias("record_id"), "url", later.alias("ts"), asked.alias("headers"))
    return revisits, responses


def flat(headers: Column) -> Column:
    """Headers in order of their names, as name=value joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def oracle() -> str:
    bare = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return rf"""
        WITH a AS (SELECT page_id, md5(html) AS tag, strlen(html) AS size, {bare} AS bare FROM pages),
        b AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS host FROM a),
        c AS (SELECT *, regexp_replace(substr(bare, length(host) + 1), '([?&])({TRACKING})=[^&]*', '\1', 'g') AS rest FROM b),
        d AS (SELECT page_id, tag, size,
                     regexp_replace(regexp_replace(lower(host), '^(www|m)[.]', ''), ':(80|443)$', '')
                     || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/$', '') AS url_key
              FROM c),
        r AS (SELECT page_id AS record_id, tag, url_key, page_id * 10 + page_id * 7919 % 50021 + 1 AS ts FROM d),
        j AS (SELECT r.record_id, r.url_key, r.ts, r.tag AS own, d.page_id AS response_id, d.tag AS theirs, d.size
              FROM r LEFT JOIN d ON d.url_key = r.url_key AND d.page_id * 10 < r.ts
              QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY d.page_id DESC NULLS LAST) = 1)
        SELECT record_id, url_key, ts, response_id,
               CASE WHEN response_id IS NULL THEN 'missing' WHEN own = theirs THEN 'resolved' ELSE 'changed' END AS status,
               CASE WHEN own = theirs THEN 'cache-control=no-cache;content-length=' || size || ';content-type=text/html;date=' || ts || ';etag=W/"' || own || '"' END AS headers
        FROM j"""
