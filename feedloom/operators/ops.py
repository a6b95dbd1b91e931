"""Accounting, retention, limits, state transitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return F.coalesce(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, F.lit(0.0))


def run_costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Runs with cost; an unknown model costs nothing."""
    return runs.join(prices, "model_id", "left").withColumn("cost", cost_usd(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))


def progress(chunks: Column, done: Column) -> Column:
    """Chunks left; null while the number is unknown."""
    return F.when(chunks > 0, F.greatest(chunks - F.coalesce(done, F.lit(0)), F.lit(0)))


def retain(articles: DataFrame, stars: DataFrame, now: int, days: int = 14) -> DataFrame:
    """Articles young enough or starred by anyone."""
    old = articles.where(F.col("published_at") < now - days * 86400)
    doomed = old.join(stars.select(F.col("article_id").alias("id")).distinct(), "id", "left_anti").select("id")
    return articles.join(doomed, "id", "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def collapse(accounts: DataFrame, same: str) -> DataFrame:
    """(id, winner) for accounts that share ``same``: the earliest created, then the least id, wins; accounts without it stay."""
    winner = accounts.where(F.col(same).isNotNull()).groupBy(same).agg(F.min_by("id", F.struct("created_at", "id")).alias("winner"))
    return accounts.join(winner, same, "left").select("id", F.coalesce("winner", "id").alias("winner"))


def repoint(children: DataFrame, mapping: DataFrame, key: str, unique: list[str], first: str) -> DataFrame:
    """Children moved to their winners; of rows that meet on ``unique`` the least ``first`` stays."""
    moved = children.join(mapping.withColumnRenamed("id", key), key, "left").withColumn(key, F.coalesce("winner", key)).drop("winner")
    return moved.groupBy(*unique).agg(F.min(first).alias(first))


def rate_limited(events: DataFrame, identity: str, time: str, order: str, window: int, limit: int) -> DataFrame:
    """Events with hit number in their fixed window, allowed, and retry_after in seconds for those over the limit."""
    index = F.floor(F.col(time) / window).cast("long")
    rows = events.withColumn("window_index", index)
    hit = F.row_number().over(W.partitionBy(identity, "window_index").orderBy(time, order))
    rows = rows.withColumn("hit", hit.cast("long"))
    return rows.withColumns({"allowed": F.col("hit") <= limit, "retry_after": F.when(F.col("hit") > limit, (F.col("window_index") + 1) * window - F.col(time))})


def failure_streaks(events: DataFrame, key: str, time: str, order: str, failed: Column, ttl: int, limit: int = 30) -> DataFrame:
    """Events with the length of the run of failures that ends there (a success, or a gap over ``ttl`` seconds, starts anew) and
    whether it is long enough to evict the key."""
    w = W.partitionBy(key).orderBy(time, order)
    rows = events.withColumns({"__fail": failed, "__gap": F.coalesce(F.col(time) - F.lag(time).over(w) > ttl, F.lit(False))})
    island = F.sum(F.when(~F.col("__fail") | F.col("__gap"), 1).otherwise(0)).over(w)
    rows = rows.withColumn("__island", island)
    streak = F.sum(F.col("__fail").cast("int")).over(W.partitionBy(key, "__island").orderBy(time, order))
    rows = rows.withColumn("streak", F.when(F.col("__fail"), streak).otherwise(0).cast("long")).drop("__fail", "__gap", "__island")
    return rows.withColumn("evicted", F.col("streak") >= limit)


def _started(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("session", "ascending"), ("time", "ascending"), ("order", "ascending")])
        where, last, out = None, 0, []
        for key, session, t in zip(*(table.column(c).to_pylist() for c in ("key", "session", "time"))):
            out.append((key, session) != where or t - last > window)
            where, last = (key, session), t if out[-1] else last
        return pa.table({"key": table.column("key"), "order": table.column("order"), "started": pa.array(out, pa.bool_())})

    return run


def kick(requests: DataFrame, key: str, time: str, order: str, window: int = 120, rows_per_task: int = 50_000) -> DataFrame:
    """(key, order, started): whether a request starts a run or reuses the one that was started within ``window`` seconds before. A
    request that follows the one before by more than the window starts one in any case, so a key's requests fall into
    sessions, each of which is folded apart, many of them by a task."""
    rows = requests.select(F.col(key).cast("long").alias("key"), F.col(time).cast("long").alias("time"), F.col(order).cast("long").alias("order"))
    w = W.partitionBy("key").orderBy("time", "order")
    rows = rows.withColumn("session", F.sum(F.when(F.col("time") - F.lag("time").over(w) <= window, 0).otherwise(1)).over(w))
    shares = max(1, -(-requests.count() // rows_per_task))
    return rows.groupBy(F.pmod(F.xxhash64("key", "session"), F.lit(shares))).applyInArrow(_started(window), "key long, order long, started boolean")


def finished(chunks: DataFrame, losers: DataFrame) -> DataFrame:
    """Per run: candidates, ingested and deduped, which are a chunk's candidates that were not ingested (each chunk counted
    once, however often it is delivered) and the articles that merges removed. chunks: run, chunk, candidates, ingested;
    losers: run, loser."""
    once = chunks.groupBy("run", "chunk").agg(F.min(F.struct("candidates", "ingested")).alias("c")).select("run", "c.*")
    sums = once.groupBy("run").agg(F.sum("candidates").alias("candidates"), F.sum("ingested").alias("ingested"))
    gone = losers.groupBy("run").agg(F.count_distinct("loser").alias("lost"))
    return sums.join(gone, "run", "left").select("run", "candidates", "ingested", (F.col("candidates") - F.col("ingested") + F.coalesce("lost", F.lit(0))).alias("deduped"))


def purge_ledger(ledger: DataFrame, parents: DataFrame, key: str, finished_at: str, cutoff) -> DataFrame:
    """The ledger's rows that stay: those whose parent is there and that are in flight (no ``finished_at``) or finished at or after
    ``cutoff``."""
    return ledger.join(parents.select(key).distinct(), key, "left_semi").where(F.col(finished_at).isNull() | (F.col(finished_at) >= F.lit(cutoff)))


def purge_tokens(tokens: DataFrame, now, revoked_before) -> DataFrame:
    """Tokens (expires_at, revoked_at) neither expired at ``now`` nor revoked before ``revoked_before``."""
    return tokens.where((F.col("expires_at") >= F.lit(now)) & (F.col("revoked_at").isNull() | (F.col("revoked_at") >= F.lit(revoked_before))))


def claims(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events with claimed: true for the first of each key."""
    return events.withColumn("claimed", F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1)


def transitions(log: DataFrame, key: str, order: list[str], allowed: dict[str, list[str]], start: str) -> DataFrame:
    """Final state and number of applied transitions per key: a compare-and-set applies if the step is allowed from the state
    reached before. A fold over each key's ordered log."""
    steps = F.array_sort(F.collect_list(F.struct(*order, "to")))
    rules = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]) if v else F.array().cast("array<string>"))])

    def step(s: Column, e: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.try_element_at(rules, s["state"]), e["to"]), F.lit(False))
        return F.struct(F.when(ok, e["to"]).otherwise(s["state"]).alias("state"), (s["applied"] + ok.cast("long")).alias("applied"))

    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("applied"))
    return log.groupBy(key).agg(steps.alias("steps")).select(key, F.aggregate("steps", zero, step).alias("s")).select(key, "s.state", "s.applied")


def latest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The last row in the order of ``by``."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(1)
