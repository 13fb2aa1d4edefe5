"""Resolution of not-modified revisits in web archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fields that a not-modified answer may update in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """``url`` without scheme, user, leading www, the scheme's own default port and fragment; host in lower case, query fields sorted, empty path as ``/``.

    Null for a null url and for one without ``://``.
    """
    authority = F.regexp_extract(url, r"://([^/?#]*)", 1)
    host = F.translate(F.regexp_replace(authority, r"^.*@", ""), _UPPER, _LOWER)
    scheme = F.translate(F.regexp_extract(url, r"^([^/?#]*?)://", 1), _UPPER, _LOWER)
    port = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", ""))
    host = F.regexp_replace(F.coalesce(port, F.regexp_replace(host, r":$", "")), r"^www[0-9]*\.", "")
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    fields = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda x: x != "")), "&")
    whole = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(fields == "", F.lit("")).otherwise(F.concat(F.lit("?"), fields)))
    return F.when(F.contains(url, F.lit("://")), whole)


def latest_before(rows: DataFrame, key: str, time: str, tie: str, payload: str) -> DataFrame:
    """``rows`` with ``found``: the payload of the latest row of the same key with an earlier time and a payload that is not null.

    Of several at one time, the one with the greatest ``tie`` counts. ``payload`` is a struct.

    Rows are sorted by key and time over range partitions, so a key with a third of all rows is spread over a third
    of them. What reaches a partition from those before it is one payload per key that crosses into it.
    """
    # At one time, rows that look back come before rows that are looked at.
    order = [time, F.col(payload).isNotNull(), tie]
    dealt = stage(rows.repartitionByRange(key, *order).select("*", F.spark_partition_id().alias("part")))
    inside = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.select("*", F.last(payload, ignorenulls=True).over(inside).alias("near"))
    carried = dealt.groupBy("part", key).agg(F.max_by(F.col(payload), F.when(F.col(payload).isNotNull(), F.struct(time, tie))).alias("last"))
    carried = carried.select("part", key, F.last("last", ignorenulls=True).over(before).alias("carried")).where("carried IS NOT NULL")
    return near.join(carried, ["part", key], "left").withColumn("found", F.coalesce("near", "carried")).drop("near", "carried", "part")


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``: record_id, canonical_url, captured_at, outcome, refers_to, payload, headers.

    ``records`` has record_id, kind (``response`` or ``revisit``), url, captured_at, etag, last_modified (text), headers
    (map of text by lower-case name) and payload (text that stands for the body, such as its digest); other columns are not read.

    A revisit refers to the latest response of the same canonical url captured before it. It is checked
    against that response alone: entity tags by weak comparison if both have one, else the times of last change.
    Outcomes: ``resolved``; ``mismatch`` (validators differ); ``no_validator`` (nothing to compare); ``no_response`` (none earlier);
    ``no_key`` (no usable url or time). ``refers_to`` names the response where there is one. Only a resolved revisit has a payload and headers: the
    response's, with the permitted fields replaced by the revisit's (a null map counts as empty).

    Rows of another kind are ignored. A response without url or time cannot be referred to. Of responses captured at one time the greatest
    record_id counts; repeated responses are one, repeated revisits are resolved each. An empty table gives none.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "etag", "last_modified", "headers", "payload"
    )
    known = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    response = F.struct("record_id", "etag", "last_modified", "headers", "payload")
    usable = rows.where(known).select("*", F.when(F.col("kind") == "response", response).alias("response"))
    matched = latest_before(usable, "canonical_url", "captured_at", "record_id", "response").where("kind = 'revisit'")
    unusable = rows.where(~known & (F.col("kind") == "revisit"))
    found = F.col("found")
    tags = F.col("etag").isNotNull() & found["etag"].isNotNull()
    times = F.col("last_modified").isNotNull() & found["last_modified"].isNotNull()
    same = F.when(tags, weak_tag(F.col("etag")) == weak_tag(found["etag"])).when(times, F.col("last_modified") == found["last_modified"])
    outcome = F.when(found.isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    matched = matched.select("record_id", "canonical_url", "captured_at", outcome.alias("outcome"), found["record_id"].alias("refers_to"), found["payload"].alias("old"), found["headers"].alias("stored"), "headers")
    resolved = F.col("outcome") == "resolved"
    matched = matched.select(
        "record_id", "canonical_url", "captured_at", "outcome", "refers_to", F.when(resolved, F.col("old")).alias("payload"),
        F.when(resolved, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
    )
    text, fields = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    unusable = unusable.select("record_id", "canonical_url", "captured_at", F.lit("no_key").alias("outcome"), text.alias("refers_to"), text.alias("payload"), fields.alias("headers"))
    return matched.unionByName(unusable)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with the permitted fields of ``fresh`` in place of its own."""
    empty = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce(fresh, empty), lambda name, _: name.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(stored, empty), lambda name, _: ~F.array_contains(F.map_keys(update), name))
    return F.map_concat(kept, update)
