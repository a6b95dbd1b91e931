"""The engine's tables derived from the sample tables, as DataFrames and, for oracles, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import seconds

#: 2024-01-01 and 2024-01-31 (UTC) in unix seconds; the fixed "now" of queries that need one.
BASE, NOW = 1704067200, 1706659200
#: Articles that events refer to: the smallest sample has so many documents.
ARTICLES = 200
ZONES = ["UTC", "Europe/Zurich", "America/New_York"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark, d) -> DataFrame:
    docs = read(spark, d, "documents")
    n = F.col("doc_id")
    return docs.select(
        F.lpad(n.cast("string"), 8, "0").alias("id"),
        F.trim(F.split("text", "\n")[0]).alias("title"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), n.cast("string")).alias("url"),
        (F.lit(BASE) + n * 3600).alias("published_at"),
        (F.lit(BASE) + n * 3600 + (n % 6) * 600).alias("ingested_at"),
        "text",
        "lang",
    )


def article_tags(spark, d) -> DataFrame:
    n = F.col("doc_id")
    tags = F.array("lang", F.concat(F.lit("t"), (n % 5).cast("string")))
    return read(spark, d, "documents").select(F.lpad(n.cast("string"), 8, "0").alias("article_id"), F.explode(tags).alias("tag"))


def article_sources(spark, d) -> DataFrame:
    n = F.col("doc_id")
    alt = F.concat(F.lit("https://alt"), (n % 7).cast("string"), F.lit(".example.org/"), n.cast("string"))
    own = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), n.cast("string"))
    urls = F.array_compact(F.array(F.when(n % 3 == 0, alt), F.when(n % 6 == 0, own)))
    return read(spark, d, "documents").select(F.lpad(n.cast("string"), 8, "0").alias("article_id"), F.explode(urls).alias("source_url"), (F.lit(BASE) + n * 3600 - 60).alias("published_at"))


def _marks(spark, d, kinds, time) -> DataFrame:
    rows = read(spark, d, "events").where(F.col("event_type").isin(kinds))
    return rows.groupBy("user_id", F.lpad((F.col("event_id") % ARTICLES).cast("string"), 8, "0").alias("article_id")).agg(F.min(seconds(F.col("ts"))).alias(time))


def reads(spark, d) -> DataFrame:
    return _marks(spark, d, ["view", "click"], "read_at")


def stars(spark, d) -> DataFrame:
    return _marks(spark, d, ["purchase"], "starred_at")


def users(spark, d) -> DataFrame:
    u = F.col("user_id")
    zone = F.array(*[F.lit(z) for z in ZONES])[(u % 3).cast("int")]
    return read(spark, d, "events").select("user_id").distinct().select("user_id", zone.alias("tz"), (u % 24).alias("hour"), (u % 60).alias("minute"), (u % 4 != 0).alias("enabled"))


def user_tags(spark, d) -> DataFrame:
    u = F.col("user_id")
    tags = F.array(F.when(u % 2 == 0, "en").otherwise("de"), F.concat(F.lit("t"), (u % 5).cast("string")), F.lit("unused"))
    return read(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(tags).alias("tag"))


def runs(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        F.lpad(k.cast("string"), 10, "0").alias("id"), seconds(F.col("o_orderdate")).alias("started_at"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.floor("o_totalprice").cast("long").alias("tokens_in"), (F.floor("o_totalprice") % 997).cast("long").alias("tokens_out"), F.concat(F.lit("m"), (k % 4).cast("string")).alias("model_id"), (k % 12 - 1).alias("chunk_count"), (k % 7).alias("ingested"),
    )


#: The same in DuckDB SQL.
CTE = {
    "articles": f"SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, trim(string_split(text, chr(10))[1]) AS title, source AS source_name, 'https://' || source || '.example.com/' || doc_id AS url, {BASE} + doc_id * 3600 AS published_at, {BASE} + doc_id * 3600 + (doc_id % 6) * 600 AS ingested_at, text, lang FROM documents",
    "article_tags": "SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS article_id, unnest([lang, 't' || (doc_id % 5)]) AS tag FROM documents",
    "article_sources": f"SELECT * FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS article_id, unnest([CASE WHEN doc_id % 3 = 0 THEN 'https://alt' || (doc_id % 7) || '.example.org/' || doc_id END, CASE WHEN doc_id % 6 = 0 THEN 'https://' || source || '.example.com/' || doc_id END]) AS source_url, {BASE} + doc_id * 3600 - 60 AS published_at FROM documents) WHERE source_url IS NOT NULL",
    "reads": f"SELECT user_id, lpad(CAST(event_id % {ARTICLES} AS VARCHAR), 8, '0') AS article_id, CAST(min(floor(epoch(ts))) AS BIGINT) AS read_at FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL",
    "stars": f"SELECT user_id, lpad(CAST(event_id % {ARTICLES} AS VARCHAR), 8, '0') AS article_id, CAST(min(floor(epoch(ts))) AS BIGINT) AS starred_at FROM events WHERE event_type = 'purchase' GROUP BY ALL",
    "users": f"SELECT DISTINCT user_id, ({ZONES})[user_id % 3 + 1] AS tz, user_id % 24 AS hour, user_id % 60 AS minute, user_id % 4 <> 0 AS enabled FROM events",
    "user_tags": "SELECT user_id, unnest([CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'de' END, 't' || (user_id % 5), 'unused']) AS tag FROM (SELECT DISTINCT user_id FROM events)",
    "runs": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS started_at, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(floor(o_totalprice) AS BIGINT) AS tokens_in, CAST(floor(o_totalprice) AS BIGINT) % 997 AS tokens_out, 'm' || (o_orderkey % 4) AS model_id, o_orderkey % 12 - 1 AS chunk_count, o_orderkey % 7 AS ingested FROM orders",
}


def sql(body: str, *names: str) -> str:
    """An oracle over derived tables: their definitions, then ``body`` (a SELECT, or further definitions and one)."""
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in names)
    return f"WITH {head}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}" if names else body
