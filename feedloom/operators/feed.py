"""Reading queries: tag-filtered feeds, stars, reads, histories. DataFrames in, DataFrames out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.timez import local_date, local_midnight


def with_tags(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Articles that have one of the tags (a table with the column tag); none for an empty table."""
    return articles.join(tags, articles["id"] == tags["article_id"], "left_semi")


def tagged(article_tags: DataFrame, selected: list[str]) -> DataFrame:
    """Ids of articles with a selected tag; no rows, and no scan, without tags."""
    if not selected:
        return article_tags.limit(0).select("article_id")
    return article_tags.where(F.col("tag").isin(selected)).select("article_id").distinct()


def decorated(articles: DataFrame, sources: DataFrame, tags: DataFrame, stars: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """Articles with alt_source_count (other URLs than their own), sorted tags, and starred and read flags of one user. Child
    tables are aggregated before the join."""
    own = articles.select(F.col("id").alias("article_id"), "url")
    alts = sources.join(own, "article_id").where(F.col("source_url") != F.col("url")).groupBy("article_id").agg(F.count("*").alias("n"))
    names = tags.groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    out = articles.join(alts.withColumnRenamed("article_id", "id"), "id", "left").join(names.withColumnRenamed("article_id", "id"), "id", "left")
    out = out.withColumns({"alt_source_count": F.coalesce("n", F.lit(0)), "tags": F.coalesce("tags", F.lit(""))}).drop("n")
    for flag, marks in (("starred", stars), ("read", reads)):
        if marks is not None:
            keys = marks.select(F.col("article_id").alias("id"), F.lit(True).alias(flag)).distinct()
            out = out.join(keys, "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def newest(articles: DataFrame, limit: int, *first: Column) -> DataFrame:
    """The newest by ingestion, then publication, then id; ``first`` sorts before."""
    return articles.orderBy(*first, F.desc("ingested_at"), F.desc("published_at"), F.asc("id")).limit(limit)


def unread(articles: DataFrame, user_tags: DataFrame, article_tags: DataFrame, reads: DataFrame, per_user: int, salt: int = 16) -> DataFrame:
    """For every user the newest articles with one of their tags that they have not read, ``per_user`` at most, and their rank.

    Of a tag a user needs no more than the newest ``per_user`` articles and one more for each article they have read, so tags
    are ranked once, as deep as their most demanding user, in salted parts first; users meet only those rows."""
    order = [F.desc("ingested_at"), F.desc("published_at"), F.asc("article_id")]
    seen = reads.select("user_id", "article_id").distinct()
    need = F.coalesce("n", F.lit(0)) + per_user
    wanted = user_tags.select("user_id", "tag").distinct().join(seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", "tag", need.alias("need"))
    times = articles.select(F.col("id").alias("article_id"), "ingested_at", "published_at")
    rows = article_tags.select("article_id", "tag").distinct().join(times, "article_id").join(wanted.groupBy("tag").agg(F.max("need").alias("deepest")), "tag")
    rows = rows.withColumn("salt", F.pmod(F.hash("article_id"), F.lit(salt)))
    for key in (["tag", "salt"], ["tag"]):
        rows = rows.withColumn("deep", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("deep") <= F.col("deepest"))
    near = wanted.join(rows.drop("deepest", "salt"), "tag").where(F.col("deep") <= F.col("need"))
    fresh = near.select("user_id", "article_id", "ingested_at", "published_at").distinct().join(seen, ["user_id", "article_id"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= per_user)


def tag_tally(articles: DataFrame, article_tags: DataFrame, users: DataFrame, user_tags: DataFrame, now: int) -> DataFrame:
    """Articles per user and tag since the user's local midnight, most first, then by tag, and the user's total; a user's
    unused tags count zero. Midnights are as many as there are UTC offsets, so a tag is counted once for each of those, before any
    user is met."""
    since = users.select("user_id", local_midnight(F.lit(now), F.col("tz")).alias("since"))
    midnights = sorted(r.since for r in since.select("since").where("since is not null").distinct().collect())
    new = articles.where(F.col("ingested_at") >= now - 2 * 86400).select(F.col("id").alias("article_id"), "ingested_at").join(article_tags.select("article_id", "tag").distinct(), "article_id")
    after = F.explode(F.filter(F.array(*[F.lit(m) for m in midnights]).cast("array<long>"), lambda m: m <= F.col("ingested_at")))
    counts = new.select("tag", after.alias("since")).groupBy("tag", "since").agg(F.count("*").alias("n"))
    out = user_tags.select("user_id", "tag").distinct().join(since, "user_id").join(counts, ["tag", "since"], "left").select("user_id", "tag", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumns({"rank": F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "tag")).cast("long"), "total": F.sum("n").over(W.partitionBy("user_id"))})


def history(articles: DataFrame, runs: DataFrame, zones: list[str], days: int) -> DataFrame:
    """Per zone and local day: articles and sums over runs (tokens, ingested, cost where runs have one); a day exists if either
    side has rows; the newest ``days`` of each zone."""
    zone = F.explode(F.array(*[F.lit(z) for z in zones])).alias("tz")
    sums = ["tokens_in", "tokens_out", "ingested", *(["cost"] if "cost" in runs.columns else [])]
    a = articles.select(zone, "ingested_at", "id").groupBy("tz", local_date(F.col("ingested_at"), F.col("tz")).alias("day")).agg(F.count("*").alias("articles"), F.max("id").alias("last_id"))
    r = runs.select(zone, "started_at", *sums).groupBy("tz", local_date(F.col("started_at"), F.col("tz")).alias("day")).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in sums])
    both = a.join(r, ["tz", "day"], "full_outer").fillna(0, ["articles", "runs", *sums])
    return both.withColumn("rank", F.row_number().over(W.partitionBy("tz").orderBy(F.desc("day")))).where(F.col("rank") <= days).drop("rank")


def history_articles(articles: DataFrame, days: DataFrame, zones: list[str]) -> DataFrame:
    """The articles of each day of a history (tz, day), one row each, with their position in the day, newest first. Rows, not
    nested lists, so a busy day is never one value."""
    zone = F.explode(F.array(*[F.lit(z) for z in zones])).alias("tz")
    rows = articles.select("*", zone).withColumn("day", local_date(F.col("ingested_at"), F.col("tz"))).join(days.select("tz", "day"), ["tz", "day"], "left_semi")
    return rows.withColumn("position", F.row_number().over(W.partitionBy("tz", "day").orderBy(F.desc("ingested_at"), F.desc("published_at"), "id")).cast("long"))


def focused(days: DataFrame, date: str | None) -> DataFrame:
    """The one day that a link names, in each zone that has it; all days for a date of another form or one that is not there."""
    if date is None or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", date):
        return days
    named = days.select("tz", (F.col("day") == date).alias("is")).groupBy("tz").agg(F.bool_or("is").alias("__has"))
    return days.join(named, "tz").where(~F.col("__has") | (F.col("day") == date)).drop("__has")


def search(articles: DataFrame, query: str, selected: list[str], least: int = 3) -> DataFrame:
    """Articles (title, excerpt, tags array) that have a selected tag, if any is selected, and hold the query in title or
    excerpt, if it has at least ``least`` characters; no character of it is special."""
    q = query.strip().lower()
    out = articles
    if selected:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t.lower()) for t in selected])))
    if len(q) >= least:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "excerpt")), F.lit(q)))
    return out


def after_key(rows: DataFrame, keys: tuple[str, str], cursor: tuple | None, page: int) -> DataFrame:
    """The page of rows that follows the cursor in the order of the two keys."""
    a, b = F.col(keys[0]), F.col(keys[1])
    if cursor is not None:
        rows = rows.where((a > cursor[0]) | ((a == cursor[0]) & (b > cursor[1])))
    return rows.orderBy(*keys).limit(page)


def sweep_page(rows: DataFrame, keys: tuple[str, str], cursor: tuple | None, page: int = 25) -> tuple[DataFrame, dict]:
    """The page that follows the cursor, and where the sweep stands: scanned, cursor (of the page's last row), remaining, done."""
    found = after_key(rows, keys, cursor, min(page, 500))
    last = found.agg(F.count("*").alias("n"), F.max(F.struct(*keys)).alias("last")).first()
    following = tuple(last["last"]) if last["n"] else None
    a, b = F.col(keys[0]), F.col(keys[1])
    left = rows if following is None else rows.where((a > following[0]) | ((a == following[0]) & (b > following[1])))
    remaining = left.count()
    return found, {"scanned": last["n"], "cursor": following, "remaining": remaining, "done": remaining == 0}


def article(articles: DataFrame, reads: DataFrame, article_id: str, user_id, now: int) -> tuple[DataFrame, DataFrame]:
    """(one article; the reads with the user's mark on it, the first time kept). An unknown article marks nothing."""
    one = articles.where(F.col("id") == article_id)
    mark = one.select(F.lit(user_id).cast(reads.schema["user_id"].dataType).alias("user_id"), F.col("id").alias("article_id"), F.lit(now).cast("long").alias("read_at"))
    return one, reads.unionByName(mark.join(reads, ["user_id", "article_id"], "left_anti"))


def unstar(stars: DataFrame, user_id, article_id: str) -> DataFrame:
    """Stars without that one."""
    return stars.where(~((F.col("user_id") == user_id) & (F.col("article_id") == article_id)))


def set_tags(user_tags: DataFrame, user_id, tags: list[str]) -> DataFrame:
    """User tags with this user's replaced by ``tags``: the defaults to restore them, none to clear them."""
    rest = user_tags.where(F.col("user_id") != user_id)
    own = [F.lit(t) for t in dict.fromkeys(tags)]
    new = user_tags.sparkSession.range(1).select(F.lit(user_id).cast(user_tags.schema["user_id"].dataType).alias("user_id"), F.explode(F.array(*own).cast("array<string>")).alias("tag"))
    return rest.unionByName(new)


def digest_mail(users: DataFrame, headlines: DataFrame, tally: DataFrame) -> DataFrame:
    """(user_id, subject, preheader, sent_line, tally_line) for users (user_id, tz, hour, minute: of now, next_hour, next_minute),
    their headlines (user_id, rank, title) and tag counts since midnight (user_id, tag, n, total). A user has few of either."""
    titles = headlines.groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("titles"))
    used = tally.where("n > 0").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag", F.col("n").alias("count")))).alias("tags"), F.max("total").alias("total"))
    rows = users.join(titles, "user_id", "left").join(used, "user_id", "left")
    n, noun = F.coalesce("n", F.lit(0)), lambda c: F.when(c == 1, "article").otherwise("articles")
    top = F.array_join(F.transform(F.slice("tags", 1, 3), lambda t: t["tag"]), ", ")
    subject = F.when(n == 0, "Your news digest is ready").otherwise(F.concat(n.cast("string"), F.lit(" new "), noun(n), F.coalesce(F.concat(F.lit(" · "), top), F.lit(""))))
    preheader = F.coalesce(F.array_join(F.transform(F.slice("titles", 1, 3), lambda t: t["title"]), ", "), F.lit(""))
    clock = lambda h, m: F.concat(F.lpad(F.col(h).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.col(m).cast("string"), 2, "0"))
    sent = F.concat(F.lit("Sent "), clock("hour", "minute"), F.lit(" "), "tz", F.lit(" · next digest tomorrow at "), clock("next_hour", "next_minute"))
    each = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t["tag"], F.lit(" ("), t["count"].cast("string"), F.lit(")"))), " ")
    line = F.when(F.col("total") > 0, F.concat(F.lit("Since midnight: "), F.col("total").cast("string"), F.lit(" "), noun(F.col("total")), F.lit(" · "), each))
    return rows.select("user_id", subject.alias("subject"), preheader.alias("preheader"), sent.alias("sent_line"), line.alias("tally_line"))


def due_users(users: DataFrame, sent: DataFrame, now: int, bucket: int = 5) -> DataFrame:
    """Enabled users whose hour and minute fall into the current ``bucket`` of minutes in their zone and who got nothing on
    their local date (sent: user_id, local_date; null-safe)."""
    here = F.from_utc_timestamp(F.timestamp_seconds(F.lit(now)), F.col("tz"))
    start = F.minute(here) - F.minute(here) % bucket
    due = users.where(F.col("enabled") & F.col("tz").isNotNull()).where((F.col("hour") == F.hour(here)) & (F.col("minute") >= start) & (F.col("minute") < start + bucket))
    due = due.withColumn("local_date", local_date(F.lit(now), F.col("tz")))
    last = sent.groupBy("user_id").agg(F.max("local_date").alias("last"))
    return due.join(last, "user_id", "left").where(~F.col("last").eqNullSafe(F.col("local_date"))).drop("last")
