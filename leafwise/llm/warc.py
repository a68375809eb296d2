"""Not-modified revisit resolution: an as-of join of each revisit to the latest earlier full response of its URL.

Captures are reduced to points, the distinct (canonical URL, time) pairs, first: all revisits of a point have the same
answer, so ties and a busy second cost nothing. Points are cut into blocks of time at approximate quantiles. Within a
(URL, block) a window finds the last full response before each point; the last one of each earlier block is carried on
through a table of at most ``blocks`` rows a URL. So a URL that holds a third of all captures is spread over all blocks,
and only keys, never payloads, are sorted.

The answer is then looked up by record id. Validators decide whether the revisit may use it: entity tags by weak
comparison where both have one, else the modification dates. Header fields of the revisit replace those of the full
response, except those that describe the stored message or a single connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafwise.llm.common import joined as spread, stored

#: Fields of a 304 that do not replace those of the stored response (RFC 9111 section 3.2, RFC 9110 section 7.6.1).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name a visit and no resource.
TRACKING = "^(?i)(utm_[a-z]*|fbclid|gclid|ref|sessionid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, user, default port and www; path without the last slash; sorted parameters
    without those that name a visit; no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "(?s)\\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def latest_before(points: DataFrame, blocks: int = 64) -> DataFrame:
    """(url, ts, full) points, each pair once, ``full`` null where no response is: the last ``full`` before each.

    ``before`` is strictly earlier. ``blocks`` bounds the rows that carry answers from block to block of a URL."""
    cuts = sorted(set(points.approxQuantile("ts", [k / blocks for k in range(1, blocks)], 0.2 / blocks)))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    placed = points.withColumn("block", block)
    entry = F.when(F.col("full").isNotNull(), F.struct("ts", "full"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    near = F.last(entry, ignorenulls=True).over(earlier(W.partitionBy("url", "block").orderBy("ts")))
    sums = placed.groupBy("url", "block").agg(F.max(entry).alias("latest"))
    carry = sums.withColumn("carried", F.last("latest", ignorenulls=True).over(earlier(W.partitionBy("url").orderBy("block"))))
    carry = carry.where("carried is not null").select(F.col("url").alias("u"), F.col("block").alias("b"), "carried")
    joined = placed.withColumn("near", near).join(carry, (F.col("url") == F.col("u")) & (F.col("block") == F.col("b")), "left")
    return joined.select("url", "ts", F.coalesce("near", "carried")["full"].alias("full"))


def _tag(headers: str) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def merged_headers(full: Column, fresh: Column) -> Column:
    """``full`` with the fields of ``fresh`` that may replace its own."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(full, lambda k, _: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)


def resolve_revisits(captures: DataFrame, blocks: int = 64) -> DataFrame:
    """Resolves captures of (record_id, url, ts, revisit, headers, digest) to (record_id, canonical_url, ts, outcome,
    resolved_id, headers, digest).

    ``headers`` maps lower-case names to values. ``outcome``: response (a full one, itself), resolved, unchecked (used,
    but no validator could be compared), mismatch (the latest earlier response is another version; not used) or missing
    (none earlier). Of several full responses of one URL and time, the one of the greatest id counts. A null URL or
    time has no earlier response; null headers are none; a null ``revisit`` is a full response. Repeated rows are
    resolved alike; of responses with one id the greatest digest counts. Columns beyond these are not read. An empty table gives
    an empty result."""
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("bigint").alias("ts"), F.coalesce("revisit", F.lit(False)).alias("revisit"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    rows = stored(rows)  # canonical once; read by each of the branches below
    full, asks = rows.where("not revisit"), rows.where("revisit")
    keyed = rows.where("url is not null and ts is not null")
    points = stored(keyed.groupBy("url", "ts").agg(F.max(F.when(~F.col("revisit"), F.col("record_id"))).alias("full")))
    answers = latest_before(points, blocks).where("full is not null").select(F.col("url").alias("u"), F.col("ts").alias("t"), "full")
    # rows without a key, or without an answer, join nothing: they go past the joins and meet in no task
    keyless = F.col("url").isNull() | F.col("ts").isNull()
    asked = asks.where(~keyless).join(answers, (F.col("url") == F.col("u")) & (F.col("ts") == F.col("t")), "left").drop("u", "t")
    asked = asked.unionByName(asks.where(keyless).withColumn("full", F.lit(None).cast(rows.schema["record_id"].dataType)))
    found = full.where("record_id is not null").groupBy("record_id").agg(F.max(F.struct("digest", F.array_sort(F.map_entries("headers")).alias("headers"))).alias("own"))
    found = found.select(F.col("record_id").alias("id"), F.map_from_entries("own.headers").alias("own_headers"), F.col("own.digest").alias("own_digest"))
    asked = stored(asked)
    used_by = stored(asked.where("full is not null").groupBy("full").agg(F.count(F.lit(1)).alias("uses")))
    payload = stored(found.join(used_by, F.col("id") == F.col("full")).select("full", "uses", "id", "own_headers", "own_digest"))
    none = [F.lit(None).cast(payload.schema[c].dataType).alias(c) for c in ("id", "own_headers", "own_digest")]
    joined = spread(asked.where("full is not null"), payload, "full", "uses").unionByName(asked.where("full is null").select("*", *none))
    same_tag = _tag("headers") == _tag("own_headers")
    same_date = F.element_at("headers", "last-modified") == F.element_at("own_headers", "last-modified")
    valid = F.coalesce(same_tag, same_date)
    outcome = F.when(F.col("full").isNull(), "missing").when(valid.isNull(), "unchecked").when(valid, "resolved").otherwise("mismatch")
    used = F.col("outcome").isin("resolved", "unchecked")
    resolved = joined.withColumn("outcome", outcome).select(
        "record_id", F.col("url").alias("canonical_url"), "ts", "outcome", F.when(used, F.col("full")).alias("resolved_id"),
        F.when(used, merged_headers(F.col("own_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), F.when(used, F.col("own_digest")).alias("digest"),
    )
    plain = full.select("record_id", F.col("url").alias("canonical_url"), "ts", F.lit("response").alias("outcome"), F.col("record_id").alias("resolved_id"), "headers", "digest")
    return plain.unionByName(resolved)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page fetched in full at time page_id and again later, or a little earlier, as not
    modified. One in seven pages had changed by then, one in five sends no entity tag, one in eleven no validator."""
    page = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tagged, dated = (page % 5 != 0) & (page % 11 != 0), page % 11 != 0
    tag = F.when(tagged, F.concat(F.lit('"'), F.when(F.col("revisit") & (page % 7 == 0), F.lit("new")).otherwise(digest), F.lit('"')))
    date = F.when(dated, (F.floor(page / 100) + F.when(F.col("revisit") & (page % 7 == 0), 1).otherwise(0)).cast("string"))
    fetched = F.col("ts").cast("string")
    names = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (
        ("content-length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.length(F.coalesce("html", F.lit(""))).cast("string"))), ("content-type", F.when(~F.col("revisit"), F.lit("text/html"))), ("date", fetched), ("etag", tag), ("last-modified", date), ("x-cache", F.when(F.col("revisit"), F.lit("hit"))),
    )])
    both = pages.select("page_id", "url", "html", F.explode(F.array(F.lit(False), F.lit(True))).alias("revisit"))
    timed = both.withColumn("ts", F.when(F.col("revisit"), page + page % 1000 - 20).otherwise(page))
    return timed.select((page * 2 + F.col("revisit").cast("int")).alias("record_id"), "url", "ts", "revisit", F.map_from_entries(F.filter(names, lambda x: x["v"].isNotNull())).alias("headers"), F.when(~F.col("revisit"), digest).alias("digest"))


def header_text(headers: Column) -> Column:
    """name: value pairs by name, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


#: DuckDB SQL of the query over ``pages``.
REVISITS_SQL = r"""
WITH fetches AS (
  SELECT page_id, html, revisit, CASE WHEN revisit THEN page_id + page_id % 1000 - 20 ELSE page_id END AS ts,
         regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages, (VALUES (false), (true)) v(revisit)
), parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1, 's'), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|fbclid|gclid|ref|sessionid|phpsessid|jsessionid)(=|$)', 'i'))), '&') AS query
  FROM fetches
), rows AS (
  SELECT page_id * 2 + revisit::int AS record_id, page_id, revisit, ts, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url,
         length(coalesce(html, ''))::varchar AS size, md5(coalesce(html, '')) AS digest,
         CASE WHEN page_id % 5 <> 0 AND page_id % 11 <> 0 THEN '"' || CASE WHEN revisit AND page_id % 7 = 0 THEN 'new' ELSE md5(coalesce(html, '')) END || '"' END AS tag,
         CASE WHEN page_id % 11 <> 0 THEN (page_id // 100 + CASE WHEN revisit AND page_id % 7 = 0 THEN 1 ELSE 0 END)::varchar END AS date
  FROM parts
), full_rows AS (SELECT * FROM rows WHERE NOT revisit
), latest AS (SELECT url, ts, max(record_id) AS id FROM full_rows GROUP BY ALL
), joined AS (
  SELECT r.*, f.record_id AS full_id, f.tag AS f_tag, f.date AS f_date, f.size AS f_size, f.digest AS f_digest,
         coalesce(r.tag = f.tag, r.date = f.date) AS valid
  FROM rows r ASOF LEFT JOIN latest l ON r.url = l.url AND r.ts > l.ts LEFT JOIN full_rows f ON f.record_id = l.id WHERE r.revisit
), resolved AS (
  SELECT *, CASE WHEN full_id IS NULL THEN 'missing' WHEN valid IS NULL THEN 'unchecked' WHEN valid THEN 'resolved' ELSE 'mismatch' END AS outcome FROM joined
), told AS (
  SELECT record_id, url AS canonical_url, ts, outcome, CASE WHEN outcome IN ('resolved', 'unchecked') THEN full_id END AS resolved_id,
         CASE WHEN outcome IN ('resolved', 'unchecked') THEN concat_ws('; ', 'content-length: ' || f_size, 'content-type: text/html', 'date: ' || ts, 'etag: ' || coalesce(tag, f_tag), 'last-modified: ' || coalesce(date, f_date), 'x-cache: hit')
              ELSE concat_ws('; ', 'content-length: 0', 'date: ' || ts, 'etag: ' || tag, 'last-modified: ' || date, 'x-cache: hit') END AS headers,
         CASE WHEN outcome IN ('resolved', 'unchecked') THEN f_digest END AS digest
  FROM resolved
  UNION ALL
  SELECT record_id, url, ts, 'response', record_id, concat_ws('; ', 'content-length: ' || size, 'content-type: text/html', 'date: ' || ts, 'etag: ' || tag, 'last-modified: ' || date), digest FROM full_rows
) SELECT * FROM told
"""
