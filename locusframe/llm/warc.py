"""Web archive records: resolving not-modified revisits to the responses they stand for.

A revisit (status 304) is joined, as of its time, to the latest earlier full response
of the same canonical URL. Its validators are checked against the response's: entity
tags by weak comparison where both have one, else the modification times, else the
payload digests. A match gives the response's payload and its headers, with those
headers of the revisit laid over them that a not-modified answer may update.

The as-of join sorts all records by (canonical URL, time) over range partitions, so a
URL with a third of all records is spread over many tasks. Inside a partition a window
carries the last full response forward; across partitions only one row for each
(partition, URL) is carried. Payloads stay out of every shuffle.

Null URLs, empty ones and those without a host have no canonical form and stay unresolved (``no_url``). A response at the same second as
a revisit counts as earlier; of several responses at one second the largest record id
counts. Repeated records each get a row; null headers count as none. Without validators on either side a revisit
is taken to match (state ``unchecked``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import cut

# Headers that a 304 answer may carry to update a stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that name a visit, not a resource.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without index page and end slash, sorted query without
    tracking parameters; no scheme, no fragment. The scheme, or it and ``//``, may be missing: the host is the first part then. Null
    stays null; URLs without a host (empty ones, ``foo:bar``, ``http:///x``) have no canonical form either, and give null."""
    bare = F.regexp_replace(F.trim(url), "#.*", "")
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    rest = F.regexp_replace(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//", "")
    opaque = (rest == base) & rest.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~rest.rlike(r"^[^/:]+:[0-9]+(/|$)")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)", 1), r"/index\.html?$", "/"), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.when(url.isNotNull() & ~opaque & (host != ""), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``url_key, state, response_id, response_ts, merged_headers, merged_digest``.

    Needs ``record_id`` (string), ``url``, ``ts`` (seconds), ``status``, ``etag``, ``last_modified`` (seconds), ``digest``
    (null where unknown) and ``headers`` (map of lower-case names). Full responses (200) are their own response, state
    ``response``; revisits (304) are ``resolved``, ``unchecked``, ``mismatch``, ``no_response`` or ``no_url``; other records
    are ``other``. Only a resolved or unchecked revisit gets a response. Columns of these names are replaced; other
    columns are kept.
    """
    added = ("url_key", "state", "response_id", "response_ts", "merged_headers", "merged_digest")
    own = [c for c in records.columns if c not in added]
    full = F.col("status") == 200
    rank = F.when(full, 0).otherwise(1)
    keyed = records.select(*own, canonical_url(F.col("url")).alias("url_key"))
    ranged = keyed.repartitionByRange("url_key", "ts", rank, "record_id").withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    answer = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    here = Window.partitionBy("_part", "url_key").orderBy("ts", rank, "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_here", F.last(F.when(full, answer), ignorenulls=True).over(here))

    tails = ranged.where(full & F.col("url_key").isNotNull()).groupBy("_part", "url_key").agg(F.max_by(answer, F.struct("ts", "record_id")).alias("_tail"))
    spread = ranged.where(F.col("url_key").isNotNull()).groupBy("_part", "url_key").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.join(tails, ["_part", "url_key"], "left").withColumn("_before", F.last("_tail", ignorenulls=True).over(before))
    carried = cut(carried.where(F.col("_before").isNotNull()).select("_part", "url_key", "_before"))
    rows = rows.join(carried.hint("merge"), ["_part", "url_key"], "left")  # never broadcast: it grows with the URLs

    r = F.coalesce("_here", "_before")
    tag, theirs = _opaque(F.col("etag")), _opaque(r["etag"])
    match = (
        F.when(tag.isNotNull() & theirs.isNotNull(), tag == theirs)
        .when(F.col("last_modified").isNotNull() & r["last_modified"].isNotNull(), F.col("last_modified") >= r["last_modified"])
        .when(F.col("digest").isNotNull() & r["digest"].isNotNull(), F.col("digest") == r["digest"])
    )
    state = (
        F.when(full, "response")
        .when(F.coalesce(F.col("status"), F.lit(0)) != 304, "other")
        .when(F.col("url_key").isNull(), "no_url")
        .when(r.isNull(), "no_response")
        .when(match.isNull(), "unchecked")
        .when(match, "resolved")
        .otherwise("mismatch")
    )
    rows = rows.withColumn("state", state)
    found = F.col("state").isin("resolved", "unchecked")
    none = F.create_map().cast("map<string,string>")
    may = F.map_filter(F.coalesce(F.col("headers"), none), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(r["headers"], none), lambda k, v: ~F.array_contains(F.map_keys(may), k))
    return rows.select(
        *own, "url_key", "state",
        F.when(found, r["record_id"]).when(full, F.col("record_id")).alias("response_id"),
        F.when(found, r["ts"]).when(full, F.col("ts")).alias("response_ts"),
        F.when(found, F.map_concat(kept, may)).otherwise(F.col("headers")).alias("merged_headers"),
        F.when(found, r["digest"]).otherwise(F.col("digest")).alias("merged_digest"),
    )


RECORD = "record_id string, type string, url string, date string, headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, truncated boolean"


RECORD_NAMES = [x.strip().split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(",")]


def _fields(head: bytes) -> dict[str, str]:
    """Header lines as a map of lower-case names; of repeated ones the last counts, a folded line goes on."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _record(head: dict[str, str], body: bytes, whole: bool) -> tuple:
    status = http = None
    if body.startswith(b"HTTP/"):
        top, _, rest = body.partition(b"\r\n\r\n")
        words = top.split(b"\r\n", 1)[0].split()
        status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        http, body = _fields(top.partition(b"\r\n")[2]), rest
    return head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head, status, http, body, not whole


def read_warc(spark: SparkSession, path: str, version: str = "WARC/1.0") -> DataFrame:
    """Records of WARC files, plain or gzip: ``record_id, type, url, date, headers, http_status, http_headers, payload, truncated``.

    Files are split at the version lines, so one large plain file is read by many tasks; a body has the bytes that
    Content-Length says, and payloads are bytes as they stand in the file. A body that holds a version line itself is
    put together again from the pieces; one that ends before its length, as at the end of a cut file, or where
    a plain file is split right at such a line, is ``truncated``. Pieces without a header are left out.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = f"{version}\r\n".encode()
        head, body, size = None, b"", 0

        for batch in batches:
            out = []
            for piece in map(bytes, batch["piece"]):
                if head is not None:
                    body += mark + piece  # the line stood inside of the body
                else:
                    top, gap, body = piece.partition(b"\r\n\r\n")
                    if not gap:
                        continue
                    head = _fields(top)
                    length = head.get("content-length", "")
                    size = int(length) if length.isdigit() else len(body)
                if len(body) >= size:
                    out.append(_record(head, body[:size], True))
                    head = None
            yield pd.DataFrame(out, columns=RECORD_NAMES)
        if head is not None:
            yield pd.DataFrame([_record(head, body, False)], columns=RECORD_NAMES)

    pieces = spark.read.option("lineSep", f"{version}\r\n").text(path).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(parse, RECORD)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of pages: of every page a full response, a not-modified revisit an hour later, and one a minute
    earlier. By page id the later revisit has an equal, a weak, another or no entity tag, and an equal or older time."""
    p, i = pages.where(F.col("page_id").isNotNull()), F.col("page_id")
    at = F.lit(1_704_067_200) + (i * 7919) % 2_592_000
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    digest, none = F.sha1(F.coalesce("html", F.lit(""))), F.lit(None).cast("string")
    kind = i % 5
    seen = F.when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 2, F.lit('"another"')).when(kind >= 3, none).otherwise(tag)
    since = F.when(kind == 4, at - 90_000).otherwise(at - 86_400)

    def headers(**values: Column) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    def record(name: str, shift: int, status: int, etag: Column, modified: Column, body: Column, head: Column) -> DataFrame:
        return p.select(
            F.concat(F.lit(name), i.cast("string")).alias("record_id"), "url", (at + shift).alias("ts"), F.lit(status).alias("status"),
            etag.alias("etag"), modified.alias("last_modified"), body.alias("digest"), head.alias("headers"),
        )

    first = headers(date=at, content_type=F.lit("text/html"), content_length=F.length(F.coalesce("html", F.lit(""))), cache_control=F.lit("max-age=60"), etag=tag)
    again = headers(date=at + 3600, content_length=F.lit(0), cache_control=F.lit("max-age=600"), expires=at + 7200, etag=seen)
    early = headers(date=at - 60, content_length=F.lit(0))
    null_time = F.lit(None).cast("long")
    return (
        record("response-", 0, 200, tag, at - 86_400, digest, first)
        .unionByName(record("revisit-", 3600, 304, seen, since, none, again))
        .unionByName(record("early-", -60, 304, none, null_time, none, early))
    )
