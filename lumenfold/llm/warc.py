"""Web captures: not-modified revisits resolved to the response they stand for.

A capture archive holds full responses and revisit records that say "not modified
since". A revisit is resolved by an as-of join: the latest earlier full response of the same
canonical URL. Its validators (entity tag, modification date, payload digest) have to
agree; then the stored headers are kept and those that a not-modified answer may
update are taken from the revisit.

The as-of join works on one sorted order of (URL, time): rows are range-partitioned by
it, each task walks its stretch and remembers the last response, and what a task
needs from the stretches before it is one row a partition. So a URL with a third of all
captures is spread over tasks, no window gathers it, and payloads never move: only
digests and headers do.

Defined results
* null or empty URL: canonical form is empty; such revisits are ``unresolved``.
* null time: before all others. Ties: responses before revisits, then by record id.
* revisit before any response: ``unresolved``. Validators that differ: ``mismatch``,
  with the response named but nothing merged. A validator that one side lacks decides nothing;
  if no validator can be compared: ``unvalidated``, also not merged.
* rows that repeat: each has its own result. Header names are compared without case;
  null headers are none. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: Query parameters that name a visit, not a page.
TRACKING = ("utm_[a-z]+", "gclid", "fbclid", "ref", "sessionid", "sid", "phpsessionid", "jsessionid", "mc_cid", "mc_eid")
#: Headers that a not-modified answer may update in the stored response.
UPDATES = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")

FIELDS = "record_id long, url string, ts long, kind string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, default ports and fragment dropped, tracking parameters dropped, others sorted."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    bare = F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*:(?=//)", "")
    host = F.lower(F.regexp_extract(bare, r"^//(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_extract(bare, r"^//[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(F.regexp_replace(F.regexp_replace(path, r"/index\.(?:html?|php)$", "/"), "(?<=.)/$", ""))
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.lower(p).rlike("^(?:" + "|".join(TRACKING) + ")(?:=|$)")))
    query = F.array_join(kept, "&")
    return F.when(host == "", "").otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _lower_keys(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    # A header that is given twice under two spellings: the last one by name counts.
    pairs = F.transform(F.array_sort(entries), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"]))


_STATE = ("response_id", "response_ts", "response_digest", "response_headers")
_WALKED = "part int, url_key string, record_id long, ts long, kind string, digest string, headers map<string,string>, response_id long, response_ts long, response_digest string, response_headers map<string,string>, open boolean"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As-of over a sorted stretch. ``open``: no response of this URL was seen in the stretch yet."""
    key, last = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        ids, times, digests, headers, is_open = [], [], [], [], []
        for k, kind in enumerate(cols[4]):
            if cols[1][k] != key:
                key, last = cols[1][k], None
            if kind == "response":
                last = (cols[2][k], cols[3][k], cols[5][k], cols[6][k])
                ids.append(None)
                times.append(None)
                digests.append(None)
                headers.append(None)
                is_open.append(False)
            else:
                a, b, c, d = last or (None, None, None, None)
                ids.append(a)
                times.append(b)
                digests.append(c)
                headers.append(d)
                is_open.append(last is None)
        more = [pa.array(ids, pa.int64()), pa.array(times, pa.int64()), pa.array(digests, pa.string()), pa.array(headers, batch.schema.field(6).type), pa.array(is_open, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[x.split()[0] for x in _WALKED.replace("map<string,string>", "map").split(", ")])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url_key, ts, kind, status, response_id, digest, headers for every record.

    status: ``full`` for a response, ``resolved``, ``mismatch``, ``unvalidated`` or ``unresolved`` for a revisit.
    """
    order = ("url_key", "ts", "late", "record_id")
    rows = records.select(canonical_url(F.col("url")).alias("url_key"), F.col("record_id").cast("long").alias("record_id"), F.col("ts").cast("long").alias("ts"), F.when(F.col("kind") == "response", "response").otherwise("revisit").alias("kind"), F.col("digest").cast("string").alias("digest"), _lower_keys(F.col("headers")).alias("headers"))
    rows = rows.withColumn("late", F.col("kind") != "response")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = dealt.select(F.spark_partition_id().alias("part"), "url_key", "record_id", "ts", "kind", "digest", "headers")
    walked = keep(placed.mapInArrow(_walk, _WALKED), "captures")
    # The last response of each stretch, and the URL it belongs to: one row a partition.
    last = F.struct(F.col("ts").isNotNull().alias("_dated"), "ts", "record_id", "digest", "headers")
    ends = walked.groupBy("part").agg(F.max("url_key").alias("url_key"))
    tails = walked.filter("kind = 'response'").join(F.broadcast(ends), ["part", "url_key"])
    order_of = F.struct(F.col("ts").isNotNull().alias("dated"), "ts", "record_id")
    tails = tails.groupBy("part", "url_key").agg(F.max_by(last, order_of).alias("r"))
    # A stretch that begins inside a URL looks to the nearest earlier stretch that has a response of it.
    t = tails.select(F.col("part").alias("_p"), F.col("url_key").alias("_u"), "r")
    begun = walked.filter("open").select("part", "url_key").distinct()
    carried = begun.join(F.broadcast(t), (F.col("url_key") == F.col("_u")) & (F.col("_p") < F.col("part"))).groupBy("part", "url_key").agg(F.max_by("r", "_p").alias("carry"))
    full = walked.join(carried, ["part", "url_key"], "left")
    take = F.col("open") & F.col("carry").isNotNull()
    pick = lambda own, field: F.when(take, F.col(f"carry.{field}")).otherwise(F.col(own))
    full = full.select("url_key", "record_id", "ts", "kind", "digest", "headers", pick("response_id", "record_id").alias("response_id"), pick("response_digest", "digest").alias("response_digest"), pick("response_headers", "headers").alias("stored"))
    return _judge(full)


def _judge(full: DataFrame) -> DataFrame:
    same, differ = [], []
    for a, b in ((F.col("headers")["etag"], F.col("stored")["etag"]), (F.col("headers")["last-modified"], F.col("stored")["last-modified"]), (F.col("digest"), F.col("response_digest"))):
        plain = lambda x: F.regexp_replace(x, "^W/", "")
        same.append(F.coalesce(plain(a) == plain(b), F.lit(False)))
        differ.append(F.coalesce(plain(a) != plain(b), F.lit(False)))
    # An entity tag that agrees outweighs a modification date; a payload digest has to agree wherever both give one.
    strong = same[0] | same[2]
    clash = differ[2] | differ[0] | (differ[1] & ~strong)
    revisit = F.col("kind") == "revisit"
    status = F.when(~revisit, "full").when((F.col("url_key") == "") | F.col("response_id").isNull(), "unresolved").when(clash, "mismatch").when(same[0] | same[1] | same[2], "resolved").otherwise("unvalidated")
    out = full.withColumn("status", status)
    fine = F.col("status") == "resolved"
    updates = F.map_filter("headers", lambda k, v: k.isin(*UPDATES) & v.isNotNull())
    kept = F.map_filter(F.coalesce("stored", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(updates, k))
    return out.select(
        "record_id", "url_key", "ts", "kind", "status", F.when(F.col("status") != "unresolved", F.col("response_id")).alias("response_id"),
        F.when(fine, F.col("response_digest")).otherwise(F.col("digest")).alias("digest"), F.when(fine, F.map_concat(kept, updates)).otherwise(F.col("headers")).alias("headers"),
    )


# ------------------------------------------------------------------- records


def _unpacked(data: bytes) -> bytes:
    """Members of a gzip file one after the other, as far as they can be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of an archive file: response and revisit records with their HTTP headers; others are passed over.

    A file that breaks off is read as far as it goes. A record without a readable length is passed over up to the next record's first line.
    """
    if data[:2] == b"\x1f\x8b":
        data = _unpacked(data)
    at = 0
    while True:
        start = data.find(b"WARC/", at)
        head_end = data.find(b"\r\n\r\n", start)
        if start < 0 or head_end < 0:
            return
        head = _headers(data[start:head_end])
        at = head_end + 4
        if not (length := head.get("content-length", "")).isascii() or not length.isdigit():
            after = data.find(b"\r\n\r\nWARC/", head_end)
            if after < 0:
                return
            at = after + 4
            continue
        block = data[at : at + int(length)]
        at += int(length)
        kind = head.get("warc-type", "")
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            yield {"uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "kind": kind, "digest": head.get("warc-payload-digest"), "headers": _headers(http), "body": body}


def _headers(block: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).decode("latin-1").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """url, ts (seconds), kind, digest, headers, payload of the records of archive files; a file is decoded in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame.content:
                rows = [(r["uri"], r["date"], r["kind"], r["digest"], r["headers"], r["body"]) for r in parse_warc(bytes(data))]
                yield pd.DataFrame(rows, columns=["url", "date", "kind", "digest", "headers", "payload"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    got = raw.mapInPandas(run, "url string, date string, kind string, digest string, headers map<string,string>, payload binary")
    return got.withColumn("ts", F.unix_timestamp(F.try_to_timestamp("date"))).withColumn("record_id", F.xxhash64("url", "date", "kind", "digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: each page is a response, and is visited again later.

    A response of page p is taken at second 4 p. The visit after it, at 4 p + 401, says
    "not modified": with the page's entity tag, which by then belongs to another page if
    the URL was captured in between; every third without an entity tag, every third of those
    with a modification date only. Ids: 2 p and 2 p + 1.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("sha"), tag.alias("tag"), F.char_length(F.coalesce("html", F.lit(""))).alias("n"))
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    text = lambda c: c.cast("string")
    stored = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.col("n")), F.lit("ETag"), F.col("tag"), F.lit("Last-Modified"), date, F.lit("Date"), text(F.col("page_id") * 4))
    fresh = F.map_concat(
        F.create_map(F.lit("Date"), text(F.col("page_id") * 4 + 401), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")),
        F.when(F.col("page_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), F.col("tag")))),
        F.when(F.col("page_id") % 9 == 0, F.create_map(F.lit("Last-Modified"), date)).otherwise(F.create_map().cast("map<string,string>")),
    )
    # Both records of a page come from one scan.
    one = F.struct((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 4).alias("ts"), F.lit("response").alias("kind"), F.col("sha").alias("digest"), stored.alias("headers"))
    two = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 4 + 401).alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"), fresh.alias("headers"))
    return base.select(F.explode(F.array(one, two)).alias("r")).select("r.*")
