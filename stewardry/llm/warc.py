"""Not-modified revisits of a web archive, resolved to the full responses they stand for.

A revisit says that a URL's content had not changed. It is joined as of its time to the
latest earlier full response of the same canonical URL. If the validators agree, the
response's headers are merged with those that a not-modified answer may update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.frames import written

#: fixed values: headers that a 304 answer may update (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: time slots that a URL's records are spread over
SLOTS = 1024

RECORDS = "record_id long, url string, at long, kind string, headers map<string,string>, payload_sha256 string"


def canonical(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, trackers (``utm_...``) and last slash dropped,
    host in lower case. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), "(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the permitted headers of ``update`` put in their place."""
    may = F.map_filter(update, lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    names = F.transform(F.map_keys(may), lambda k: F.lower(k))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(names, F.lower(k)))
    lower = lambda m: F.transform_keys(m, lambda k, _: F.lower(k))
    return F.map_concat(lower(kept), lower(may))


def _slot(at: Column, cuts: list[int], width: int = 32) -> Column:
    """How many of the ascending ``cuts`` lie at or below ``at``, looked up in two steps."""
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not parts:
        return F.lit(0)
    numbers = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    upto = lambda values: F.size(F.filter(values, lambda c: c <= at))
    part = upto(numbers([p[0] for p in parts]))
    inner = upto(F.element_at(F.array(*[numbers(p) for p in parts]), F.greatest(part, F.lit(1))))
    return F.when(part == 0, 0).otherwise((part - 1) * width + inner)


def resolve_revisits(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``record_id, url_key, status, refers_to, refers_at, headers, payload_sha256`` per revisit.

    ``records``: as in RECORDS, kind ``response`` or ``revisit``; other columns are ignored.
    Earlier means a smaller ``at``; of responses at one time the largest id counts. The ETag
    decides if both records have one (weakly compared), else Last-Modified if both have it;
    without a common validator they do not agree. Status: ``resolved``; ``changed`` when the
    latest response has other validators (refers_to names it, headers are the revisit's);
    ``missing`` without an earlier response or with a null URL or time.

    A URL's records are spread over time slots of about as many records each. Within a slot the latest response before a
    record is a window's running maximum; across slots it is the running maximum of one row
    a slot. So one URL with most of the records fills many tasks, and a second window sees
    ``slots`` rows of it at most.
    """
    lower = F.transform_keys(
        F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)
    )
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("url_key"), F.col("at").cast("bigint").alias("at"), "kind",
        lower.alias("headers"), "payload_sha256",
    )
    rows = written(rows, "records")
    placed = rows.filter("url_key is not null and at is not null")
    shares = [i / slots for i in range(1, slots)]
    cuts = sorted(set(placed.approxQuantile("at", shares, 0.1 / slots))) if shares else []  # ``slots`` numbers
    placed = placed.withColumn("slot", _slot(F.col("at"), [int(c) for c in cuts]))
    full = F.when(
        F.col("kind") == "response",
        F.struct(
            "at", F.col("record_id").alias("id"), F.element_at("headers", "etag").alias("etag"),
            F.element_at("headers", "last-modified").alias("modified"), F.to_json("headers").alias("headers"),
            F.col("payload_sha256").alias("payload"),
        ),
    )
    placed = placed.withColumn("full", full)
    before = Window.partitionBy("url_key", "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.max("full").over(before)).filter("kind = 'revisit'").drop("full")
    by_slot = placed.groupBy("url_key", "slot").agg(F.max("full").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slot.select("url_key", "slot", F.max("last").over(earlier).alias("far"))
    found = near.join(carried, ["url_key", "slot"], "left").withColumn("hit", F.coalesce("near", "far"))
    lost = rows.filter("kind = 'revisit' and (url_key is null or at is null)")
    found = found.select("record_id", "url_key", "headers", "hit").unionByName(
        lost.select("record_id", "url_key", "headers"), allowMissingColumns=True
    )
    etag, modified = F.element_at("headers", "etag"), F.element_at("headers", "last-modified")
    same = (
        F.when(etag.isNotNull() & F.col("hit.etag").isNotNull(), _weak(etag) == _weak(F.col("hit.etag")))
        .when(modified.isNotNull() & F.col("hit.modified").isNotNull(), modified == F.col("hit.modified"))
        .otherwise(False)
    )
    status = F.when(F.col("hit").isNull(), "missing").when(same, "resolved").otherwise("changed")
    stored = F.from_json("hit.headers", "map<string,string>")
    found = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return found.select(
        "record_id", "url_key", "status", F.col("hit.id").alias("refers_to"), F.col("hit.at").alias("refers_at"),
        F.when(ok, merged_headers(stored, F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("hit.payload")).alias("payload_sha256"),
    )


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits with the ``payload`` of the response they refer to (``record_id, payload``)."""
    body = payloads.select(F.col("record_id").alias("refers_to"), "payload")
    return resolved.filter("status = 'resolved'").join(body, "refers_to", "left")


def header_text(headers: Column) -> Column:
    """Headers in order of their names, a line each."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def crawl_of(pages: DataFrame) -> DataFrame:
    """An archive's records made from ``pages``: every page is a response, every third one is
    fetched changed later on, and each is asked for again twice, under other spellings of
    its URL, with right, stale or missing validators and now and then too early."""
    p = F.col("page_id").cast("bigint")
    html = F.coalesce("html", F.lit(""))
    base = pages.select(p.alias("p"), "url", F.md5(html).alias("old"), F.md5(F.concat(html, F.lit("!"))).alias("new"),
                        F.sha2(html, 256).alias("old_sha"), F.sha2(F.concat(html, F.lit("!")), 256).alias("new_sha"))
    p = F.col("p")
    at = p * 10
    day = lambda x: F.concat(F.lit("day "), x.cast("string"))
    answer = lambda tag, when: F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.concat(F.lit('"'), tag, F.lit('"')),
        F.lit("Last-Modified"), day(when), F.lit("Date"), day(when), F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    again = F.when(p % 2 == 0, F.concat("url", F.when(F.instr("url", "?") > 0, F.lit("&utm_medium=x")).otherwise(F.lit("?utm_medium=x"))))
    again = again.otherwise(F.regexp_replace("url", "^https?://", "HTTPS://www."))
    asked = at + 1 + (p * 7919) % 4000
    early = at - 5 + (p * 31) % 300
    ask = lambda tag, when: F.map_filter(
        F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), F.when(p % 4 != 1, day(at)), F.lit("Date"), day(when),
            F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), day(when + 9),
        ),
        lambda _, v: v.isNotNull(),
    )
    quoted = lambda tag: F.concat(F.lit('W/"'), tag, F.lit('"'))
    record = lambda k, url, when, kind, headers, sha: F.struct(
        (p * 4 + k).alias("record_id"), url.alias("url"), when.alias("at"), F.lit(kind).alias("kind"),
        headers.alias("headers"), sha.alias("payload_sha256"),
    )
    none = F.lit(None).cast("string")
    url = F.col("url")
    records = F.array(
        record(0, url, at, "response", answer(F.col("old"), at), F.col("old_sha")),
        F.when(p % 3 == 0, record(1, url, at + 2000, "response", answer(F.col("new"), at + 2000), F.col("new_sha"))),
        record(2, again, asked, "revisit", ask(F.when(p % 5 != 0, quoted(F.col("old"))), asked), none),
        record(3, url, early, "revisit", ask(F.when(p % 7 != 0, quoted(F.col("old"))).otherwise(F.lit('"x"')), early), none),
    )
    return base.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")
