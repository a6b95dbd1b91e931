"""Discovery of feeds per tag: the cache of found sources, the queue of tags, and what is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "sources:"
FEEDS = "feeds array<struct<name: string, url: string, kind: string>>, discovered_at long"
KINDS = ["rss", "atom", "json"]


def entries(cache: DataFrame) -> DataFrame:
    """(tag, feeds, discovered_at) of cache rows (key, value JSON) under the prefix; feeds is null where the value has no such
    array. Keys without a tag are left out."""
    rows = cache.where(F.startswith("key", F.lit(PREFIX))).select(F.substring("key", len(PREFIX) + 1, 1 << 20).alias("tag"), "value").where("tag <> ''")
    return rows.withColumn("v", F.from_json("value", FEEDS)).select("tag", F.col("v.feeds").alias("feeds"), F.col("v.discovered_at").alias("discovered_at"))


def cached_sources(cache: DataFrame, curated: DataFrame) -> DataFrame:
    """One row (tag, pos, name, url, kind) for each usable feed of tags that are not curated (tag): name and url are filled, the
    kind is known."""
    rows = entries(cache).join(curated.select("tag"), "tag", "left_anti").select("tag", F.posexplode("feeds").alias("pos", "f")).select("tag", "pos", "f.*")
    return rows.where((F.trim("name") != "") & (F.trim("url") != "") & F.col("kind").isin(KINDS))


def purge_cache(cache: DataFrame, curated: DataFrame) -> DataFrame:
    """The cache without the entries of tags that are curated."""
    keys = curated.select(F.concat(F.lit(PREFIX), "tag").alias("key"))
    return cache.join(keys, "key", "left_anti")


def stuck_tags(cache: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Tags whose entry has had an empty list of feeds for ``days`` days or longer."""
    return entries(cache).where((F.size("feeds") == 0) & (F.col("discovered_at") <= now_ms - days * 86_400_000)).select("tag").distinct()


def prune(user_tags: DataFrame, stuck: DataFrame) -> DataFrame:
    """User tags (user_id, tag) without the stuck ones, whatever their case and with or without a # before them."""
    return user_tags.withColumn("__tag", F.regexp_replace(F.lower("tag"), "^#", "")).join(stuck.select(F.col("tag").alias("__tag")), "__tag", "left_anti").select(*user_tags.columns)


def enqueue(pending: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """Rows to add to the queue (user_id, tag, priority, added_at) for wanted tags (user_id, tag, first): priority 10 if this is the
    user's first set of tags, else 0; what waits already is left out."""
    rows = wanted.select("user_id", "tag", F.when(F.col("first"), 10).otherwise(0).alias("priority"), F.lit(now).cast("long").alias("added_at"))
    return rows.groupBy("user_id", "tag").agg(F.max("priority").alias("priority"), F.min("added_at").alias("added_at")).join(pending.select("user_id", "tag"), ["user_id", "tag"], "left_anti")


def waiting(pending: DataFrame, user_id) -> DataFrame:
    """The tags that one user waits for."""
    return pending.where(F.col("user_id") == user_id).select("tag")


def next_tags(pending: DataFrame, limit: int = 3) -> DataFrame:
    """The tags that come next: highest priority, then the longest wait, then the name."""
    rows = pending.groupBy("tag").agg(F.max("priority").alias("priority"), F.min("added_at").alias("added_at"))
    return rows.orderBy(F.desc("priority"), "added_at", "tag").limit(limit)


def discover(tags: DataFrame, curated: DataFrame, found: DataFrame, failures: DataFrame, limit: int = 2) -> DataFrame:
    """What becomes of each tag: (tag, action, failures, cleared, feeds). Curated tags are dropped from the queue unasked; feeds found
    (tag, feeds: their number, null for an error) are cached and end the count; none add to it, and at ``limit`` failures
    an empty entry is cached and the tag gives way; an error leaves all as it was. failures: (tag, failures)."""
    rows = tags.select("tag").distinct().join(curated.select("tag").distinct().withColumn("__c", F.lit(True)), "tag", "left")
    rows = rows.join(found.select("tag", "feeds", F.lit(True).alias("__f")), "tag", "left").join(failures.select("tag", "failures"), "tag", "left")
    before = F.greatest(F.coalesce("failures", F.lit(0)), F.lit(0))
    action = F.when(F.col("__c"), "drop").when(F.col("__f").isNull() | F.col("feeds").isNull(), "error").when(F.col("feeds") > 0, "cache").when(before + 1 >= limit, "evict").otherwise("retry")
    out = rows.withColumn("action", action)
    left = F.when(F.col("action") == "retry", before + 1).when(F.col("action") == "error", before).otherwise(0)
    return out.select("tag", "action", left.cast("long").alias("failures"), F.col("action").isin("drop", "cache", "evict").alias("cleared"), F.when(F.col("action") == "cache", F.col("feeds")).when(F.col("action") == "evict", 0).cast("long").alias("feeds"))


def evict_feeds(feeds: DataFrame, evicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feeds that stay, tags to queue again because none of theirs does): feeds (tag, url), evicted (url)."""
    left = feeds.join(evicted.select("url").distinct(), "url", "left_anti").select(*feeds.columns)
    return left, feeds.select("tag").distinct().join(left.select("tag"), "tag", "left_anti")
