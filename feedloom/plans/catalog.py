"""The query catalogue: each entry applies operators to the sample tables; ORACLE has the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids, text, timez, urls
from ..operators import dedup, discovery, feed, ingest, ops
from ..runtime import ship
from . import tables as T
from .tables import BASE, NOW, read, sql

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SQL_SPACE = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
SQL_HOST = "lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
SQL_CANONICAL_OF = f"""
SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#:\\s]+') THEN url ELSE 'https://' || host || CASE WHEN path = '' AND q || frag <> '' THEN '/' ELSE path END || q || frag END AS canonical_url
FROM (SELECT *, {SQL_HOST} || regexp_extract(url, '^https?://[^/?#:]+(:[0-9]+)?', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '(#.*)$', 1) AS frag,
  CASE WHEN len(kept) = len(args) THEN regexp_extract(url, '(\\?[^#]*)', 1) WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS q
  FROM (SELECT *, list_filter(args, lambda p: NOT regexp_matches(lower(string_split(p, '=')[1]), '{urls.TRACKING}')) AS kept FROM (SELECT *, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '') AS args FROM pages)))
"""
SQL_CANONICAL = SQL_CANONICAL_OF.replace("SELECT *, CASE", "SELECT page_id, url, html, CASE", 1)
SQL_TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains([{quoted(text.TITLE_STOPWORDS)}], w)))"
SQL_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", "url", "html", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


# ---- URLs and text ----


@query(f"SELECT page_id, canonical_url FROM ({SQL_CANONICAL})")
def canonical_urls(spark, d):
    return read(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


SQL_CANDIDATES = f"(SELECT *, {BASE} + (seq * 37) % 1000 AS published_at FROM (SELECT page_id AS seq, url FROM pages UNION ALL SELECT page_id + 1000000, CASE WHEN contains(url, '#') THEN url WHEN contains(url, '?') THEN url || '&utm_campaign=z' ELSE url || '?utm_campaign=z' END FROM pages))"


@query(f"""WITH c AS ({SQL_CANONICAL_OF.replace("FROM pages", "FROM " + SQL_CANDIDATES)})
SELECT seq, canonical_url, CASE WHEN row_number() OVER (PARTITION BY canonical_url ORDER BY published_at, seq) = 1 THEN 'primary' ELSE 'alternative' END AS role, min(seq) OVER (PARTITION BY canonical_url) AS cluster_order FROM c""")
def url_clusters(spark, d):
    p, u = read(spark, d, "pages"), F.col("url")
    again = F.when(F.contains(u, F.lit("#")), u).when(F.contains(u, F.lit("?")), F.concat(u, F.lit("&utm_campaign=z"))).otherwise(F.concat(u, F.lit("?utm_campaign=z")))
    rows = p.select(F.col("page_id").alias("seq"), "url").unionByName(p.select((F.col("page_id") + 1000000).alias("seq"), again.alias("url")))
    rows = rows.select("seq", urls.canonical_url(u).alias("canonical_url"), (F.lit(BASE) + F.col("seq") * 37 % 1000).alias("published_at"))
    return ingest.clusters(rows, "canonical_url", "published_at", "seq").drop("published_at")


SQL_DOMAIN = f"CASE WHEN regexp_matches(h, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') OR contains(h, ':') OR len(l) < 2 THEN h WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN ({quoted(urls.TWO_LEVEL)}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END"


@query(f"SELECT domain, count(*) AS pages, count(DISTINCT h) AS hosts FROM (SELECT h, {SQL_DOMAIN} AS domain FROM (SELECT h, string_split(h, '.') AS l FROM (SELECT {SQL_HOST} AS h FROM pages))) GROUP BY domain")
def vendor_domains(spark, d):
    hosts = read(spark, d, "pages").select(urls.host(F.col("url")).alias("host"))
    return hosts.groupBy(urls.registrable_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"))


@query(f"WITH h AS (SELECT page_id, {SQL_HOST} AS h FROM pages), x AS (SELECT page_id, {SQL_DOMAIN} AS d FROM (SELECT *, string_split(h, '.') AS l FROM h)) SELECT a.page_id, a.d = b.d AS same FROM x a JOIN x b ON b.page_id = a.page_id + 1")
def same_vendor_pairs(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return p.join(q, "page_id").select("page_id", urls.same_vendor(F.col("url"), F.col("other")).alias("same"))


@query(f"SELECT page_id, starts_with(url, 'https://') AS https, starts_with(url, 'https://') AND NOT contains(url, '@') AND {SQL_HOST} <> 'localhost' AND NOT starts_with({SQL_HOST}, 'metadata.') AS safe, CASE WHEN regexp_matches(url, '^https?://[^/?#\\s]') THEN url ELSE '#' END AS href FROM pages")
def safe_urls(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.is_https(u).alias("https"), urls.is_public_url(u).alias("safe"), urls.safe_href(u).alias("href"))


HOSTS = [("10.0.0.1", 0), ("172.15.0.1", 1), ("172.16.0.1", 0), ("172.31.9.9", 0), ("172.32.0.1", 1), ("192.168.1.1", 0), ("169.254.169.254", 0), ("100.63.0.1", 1), ("100.64.0.1", 0), ("100.127.0.1", 0), ("100.128.0.1", 1), ("0.1.2.3", 0), ("127.0.0.1", 0), ("8.8.8.8", 1), ("[::1]", 0), ("[fe80::1]", 0), ("[fd12::1]", 0), ("[2001:db8::1]", 1), ("[::ffff:172.20.0.1]", 0), ("[::ffff:100.100.1.1]", 0), ("[::ffff:8.8.4.4]", 1), ("localhost", 0), ("metadata.example.org", 0), ("example.org", 1)]


@query(f"SELECT page_id, host, safe = 1 AS safe FROM pages JOIN (VALUES {', '.join(f"({k}, '{h}', {s})" for k, (h, s) in enumerate(HOSTS))}) h(k, host, safe) ON page_id % {len(HOSTS)} = k")
def public_hosts(spark, d):
    name = F.array(*[F.lit(h) for h, _ in HOSTS])[(F.col("page_id") % len(HOSTS)).cast("int")]
    rows = read(spark, d, "pages").select("page_id", name.alias("host"))
    return rows.select("page_id", "host", urls.is_public_url(F.concat(F.lit("https://"), "host", F.lit("/x"))).alias("safe"))


@query(f"SELECT page_id, regexp_replace(substring(regexp_replace(regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugs(spark, d):
    return page_titles(spark, d).select("page_id", text.slug(F.col("title")).alias("slug"))


@query(f"SELECT page_id, array_to_string(list_sort({SQL_TOKENS.format(SQL_TITLE)}), ' ') AS tokens, CAST(len({SQL_TOKENS.format(SQL_TITLE)}) AS BIGINT) AS n FROM pages")
def title_tokens(spark, d):
    t = text.title_tokens(F.col("title"))
    return page_titles(spark, d).select("page_id", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query(f"""WITH t AS (SELECT doc_id AS seq, doc_id % 4 = 0 AS aggregator, unnest({SQL_TOKENS.format("string_split(text, chr(10))[1]")}) AS token FROM documents),
p AS (SELECT a.seq, b.seq AS direct, count(*) AS shared FROM t a JOIN t b USING (token) WHERE a.aggregator AND NOT b.aggregator GROUP BY ALL HAVING count(*) >= 3)
SELECT seq, min(direct) AS direct, arg_min(shared, direct) AS shared FROM p GROUP BY seq""")
def title_pairs(spark, d):
    items = read(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.split("text", "\n")[0].alias("title"), (F.col("doc_id") % 4 == 0).alias("aggregator"))
    return ingest.direct_matches(items)


@query(f"""WITH t AS (SELECT doc_id AS seq, doc_id % 4 = 0 AS aggregator, unnest({SQL_TOKENS.format("string_split(text, chr(10))[1]")}) AS token FROM documents),
p AS (SELECT a.seq, b.seq AS direct, count(*) AS shared FROM t a JOIN t b USING (token) WHERE a.aggregator AND NOT b.aggregator GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT seq, min(direct) AS direct FROM p GROUP BY seq), g AS (SELECT direct, l.lang, min(m.seq) AS place FROM m JOIN documents l ON l.doc_id = m.seq JOIN documents o ON o.doc_id = m.direct WHERE l.lang <> o.lang GROUP BY ALL),
x AS (SELECT direct, string_agg(lang, ',' ORDER BY place) AS more FROM g GROUP BY direct)
SELECT doc_id AS seq, lang || coalesce(',' || more, '') AS tags FROM documents LEFT JOIN x ON direct = doc_id WHERE doc_id NOT IN (SELECT seq FROM m)""")
def direct_preferred(spark, d):
    items = read(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.split("text", "\n")[0].alias("title"), (F.col("doc_id") % 4 == 0).alias("aggregator"), F.array("lang").alias("tags"))
    return ingest.prefer_direct(items).select("seq", F.array_join("tags", ",").alias("tags"))


def _replaced(column: str) -> str:
    for name, char in text.ENTITIES:
        column = f"replace({column}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return column


@query(f"SELECT page_id, trim(regexp_replace(replace({_replaced('regexp_replace(html, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '&amp;', '&'), '{SQL_SPACE}+', ' ', 'g'))[1:1200] AS snippet FROM pages")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_text(F.col("html"), 1200).alias("snippet"))


@query()
def article_extract(spark, d):
    body = text.article_text(F.col("html"))
    return read(spark, d, "pages").select("page_id", body.alias("body")).where(F.length("body") >= 100).select("page_id", F.length("body").cast("long").alias("n"), F.md5("body").alias("body_md5"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), '{SQL_SPACE}+', ' ', 'g')) AS clean FROM pages")
def sanitized(spark, d):
    return read(spark, d, "pages").select("page_id", text.sanitize(F.col("html")).alias("clean"))


@query("SELECT doc_id, CAST(len(p) AS BIGINT) AS n, coalesce(p[1], '') AS first FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '\\n', chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(13) || chr(9))), lambda x: x <> '') AS p FROM documents)")
def paragraphs(spark, d):
    p = text.paragraphs(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(p).cast("long").alias("n"), F.coalesce(F.try_element_at(p, F.lit(1)), F.lit("")).alias("first"))


@query(f"SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, CASE WHEN length(text) > 100 THEN text[1:100] || '…' ELSE text END AS field FROM documents")
def escaped(spark, d):
    return read(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("html"), text.prompt_field(F.col("text"), 100).alias("field"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*at\\s.+$', '', 'g'), '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer <redacted>', 'g'), '\\b[0-9a-fA-F]{40,}\\b', '<redacted-hex>', 'g'), '(?i)\\b([a-z][a-z0-9+.-]*://)[^\\s/@]+@', '\\1<redacted>@', 'g'), '(?:^|\\s)(?:(?:/[^\\s/:]+){2,}|[A-Za-z]:\\\\[^\\s]+)', ' <path>', 'g'), '\\s+', ' ', 'g'))[1:500] AS detail FROM documents")
def error_redaction(spark, d):
    return read(spark, d, "documents").select("doc_id", text.redact_error(F.col("text")).alias("detail"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, replace(replace(rtrim(base64(encode(source)), '='), '+', '-'), '/', '_') AS b64 FROM documents")
def digests(spark, d):
    b64 = F.rtrim(F.base64(F.col("source").cast("binary")), F.lit("="))
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.translate(b64, "+/", "-_").alias("b64"))


@query("SELECT event_id, user_id || ':' || event_type AS raw, regexp_replace(regexp_replace(lower('#' || upper(event_type) || ' v' || user_id || '!'), '^#', ''), '[^a-z0-9-]', '', 'g') AS tag FROM events")
def hashtag_norm(spark, d):
    raw = F.concat(F.lit("#"), F.upper("event_type"), F.lit(" v"), F.col("user_id").cast("string"), F.lit("!"))
    return read(spark, d, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("raw"), text.hashtag(raw).alias("tag"))


@query("""WITH t AS (SELECT user_id, list_sort(list_distinct(list(regexp_replace(lower(event_type), '[^a-z0-9-]', '', 'g')))) AS tags FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN len(tags) BETWEEN 1 AND 4 THEN array_to_string(tags, ',') END AS tags FROM t""")
def hashtag_lists(spark, d):
    tags = F.array_sort(F.collect_set("event_type"))
    return read(spark, d, "events").groupBy("user_id").agg(tags.alias("tags")).select("user_id", F.array_join(text.valid_hashtags(F.col("tags"), 4), ",").alias("tags"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|b' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'x' END AS strings FROM events")
def json_arrays(spark, d):
    e, k = F.col("event_type"), F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('["'), e, F.lit('", 1, null, "b"]'))).when(k == 1, F.lit('{"a": "b"}')).when(k == 2, F.lit("not json")).otherwise(F.lit('["x", true, 2.5]'))
    return read(spark, d, "events").select("event_id", F.array_join(text.json_strings(raw), "|").alias("strings"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS v FROM events")
def llm_answers(spark, d):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    body = F.concat(F.lit('{"v": "'), u, F.lit('", "n": {"s": "a } \\" b"}}'))
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here you are: "), body, F.lit(" {}"))).otherwise(F.lit("no { object"))
    return read(spark, d, "events").select("event_id", F.get_json_object(text.llm_json(answer), "$.v").alias("v"))


@query(sql(f"SELECT id, trim(regexp_replace(trim(title) || ' ' || CASE WHEN n % 3 = 0 THEN text WHEN n % 3 = 1 THEN 'one two' ELSE coalesce(source_name, '') END, '{SQL_SPACE}+', ' ', 'g'))[1:1800] AS input FROM (SELECT *, CAST(id AS BIGINT) AS n FROM articles)", "articles"))
def embedding_inputs(spark, d):
    n = F.col("id").cast("long")
    details = F.when(n % 3 == 1, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    return T.articles(spark, d).select("id", text.embedding_input(F.col("title"), F.when(n % 3 == 0, F.col("text")).otherwise(""), details, F.col("source_name")).alias("input"))


# ---- time, ids, formats ----

SQL_ZONES = f"unnest([{quoted(T.ZONES)}])"


@query(f"SELECT event_id, tz, strftime(timezone(tz, timezone('UTC', ts)), '%Y-%m-%d') AS local_date, CAST(epoch(timezone(tz, date_trunc('day', timezone(tz, timezone('UTC', ts))))) AS BIGINT) AS midnight FROM (SELECT event_id, date_trunc('second', ts) AS ts, {SQL_ZONES} AS tz FROM events)")
def local_midnight(spark, d):
    e = read(spark, d, "events").select("event_id", timez.seconds(F.col("ts")).alias("t"), F.explode(F.array(*[F.lit(z) for z in T.ZONES])).alias("tz"))
    return e.select("event_id", "tz", timez.local_date(F.col("t"), F.col("tz")).alias("local_date"), timez.local_midnight(F.col("t"), F.col("tz")).alias("midnight"))


@query("SELECT event_id, CAST((floor(epoch(ts) / 14400) + 1) * 14400 AS BIGINT) AS next_tick, upper(strftime(ts, '%b ')) || day(ts) AS label FROM events")
def next_tick(spark, d):
    t = timez.seconds(F.col("ts"))
    return read(spark, d, "events").select("event_id", timez.next_tick(t).alias("next_tick"), timez.month_day(t).alias("label"))


@query("SELECT event_id, CASE WHEN m < 60 THEN m || 'm' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS countdown FROM (SELECT event_id, CAST(ceil((event_id * 13 % 20000) / 60) AS BIGINT) AS m FROM events)")
def countdowns(spark, d):
    return read(spark, d, "events").select("event_id", timez.countdown(F.col("event_id") * 13 % 20000).alias("countdown"))


@query(f"SELECT user_id, tz, tz IN ({quoted(T.ZONES)}) AS valid FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'Nowhere/City' ELSE ([{quoted(T.ZONES)}])[user_id % 3 + 1] END AS tz FROM events)")
def zone_validity(spark, d):
    zone = F.when(F.col("user_id") % 5 == 0, "Nowhere/City").otherwise(F.array(*[F.lit(z) for z in T.ZONES])[(F.col("user_id") % 3).cast("int")])
    return read(spark, d, "events").select("user_id", zone.alias("tz")).distinct().select("user_id", "tz", timez.valid_zone(F.col("tz"), T.ZONES).alias("valid"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS ms, 26::BIGINT AS n FROM events")
def ulid_roundtrip(spark, d):
    ms = timez.seconds(F.col("ts")) * 1000
    rows = read(spark, d, "events").select("event_id", ids.ulid(ms, F.col("event_id")).alias("ulid"))
    return rows.select("event_id", ids.ulid_time(F.col("ulid")).alias("ms"), F.length("ulid").cast("long").alias("n"))


POWERS = [10.0**k for k in range(9)]
# printf rounds halves to even; the next number up makes it round them up
SQL_KEPT = "CAST(CASE WHEN c < 0.01 THEN printf('%.1e', abs(c) * (1 + 2.220446049250313e-16)) ELSE printf('%.2e', abs(c) * (1 + 2.220446049250313e-16)) END AS DOUBLE)"


@query(f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 0 WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice / ({POWERS}::DOUBLE[])[o_orderkey % 9 + 1] END AS c FROM orders),
k AS (SELECT *, {SQL_KEPT} AS k FROM v), u AS (SELECT *, CASE WHEN k < 0.01 THEN (20000 * CAST(k * 295147905179352825856 AS HUGEINT) + 295147905179352825856::HUGEINT) // 590295810358705651712::HUGEINT WHEN k < 1 THEN (200 * CAST(k * 1152921504606846976 AS HUGEINT) + 1152921504606846976::HUGEINT) // 2305843009213693952::HUGEINT END AS u FROM k)
SELECT o_orderkey, CASE WHEN c IS NULL THEN '—' WHEN c = 0 THEN '$0.00' WHEN k < 0.01 THEN '$' || (u // 10000) || '.' || lpad(CAST(u % 10000 AS VARCHAR), 4, '0') WHEN k < 1 THEN '$' || (u // 100) || '.' || lpad(CAST(u % 100 AS VARCHAR), 2, '0') ELSE printf('$%.2f', k) END AS cost FROM u""")
def cost_format(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    small = price / F.array(*[F.lit(x) for x in POWERS])[(k % 9).cast("int")]
    return read(spark, d, "orders").select("o_orderkey", text.cost_text(F.when(k % 5 == 1, 0.0).when(k % 5 == 0, None).when(k % 11 == 0, -price).otherwise(small)).alias("cost"))


@query("SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'hub' ELSE 'other' END AS provider, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'x:' || user_id END AS sub FROM events WHERE user_id NOT IN (0, 1)")
def user_ids(spark, d):
    raw = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("other:x:"), F.col("user_id").cast("string")))
    rows = read(spark, d, "events").where(~F.col("user_id").isin(0, 1)).select("user_id", raw.alias("raw")).distinct()
    has = F.instr("raw", ":") > 0
    return rows.select("user_id", F.when(has, F.substring_index("raw", ":", 1)).otherwise("hub").alias("provider"), F.when(has, F.regexp_replace("raw", "^[^:]*:", "")).otherwise(F.col("raw")).alias("sub"))


# ---- sources and ingest ----


@query("SELECT doc_id, 'T' || doc_id AS title, 'https://e.org/' || doc_id AS url, 1704067200 + doc_id AS published_at FROM documents WHERE doc_id % 10 < 9")
def rss_items(spark, d):
    from ..sources.feeds import read_rss

    n = F.col("doc_id").cast("string")
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")), "dd MMM yyyy HH:mm:ss")
    xml = F.concat(F.lit("<rss><channel><item><title>T"), n, F.lit("</title><link>"), F.when(F.col("doc_id") % 10 < 9, F.concat(F.lit("https://e.org/"), n)).otherwise(""), F.lit("</link><pubDate>Mon, "), date, F.lit(" +0000</pubDate></item></channel></rss>"))
    return read_rss(read(spark, d, "documents").select("doc_id", xml.alias("body")), "body", now=1 << 34).select("doc_id", "title", "url", "published_at")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'https://pub.example.org/' || doc_id WHEN doc_id % 2 = 0 THEN 'https://news.google.com/rss/articles/' || doc_id ELSE 'https://pod.example.com/' || doc_id END AS url, CASE WHEN doc_id % 5 <> 0 THEN 'Pub ' || doc_id % 4 END AS item_source, CASE WHEN doc_id % 3 <> 0 THEN 'https://pub.example.org/' || doc_id END AS item_source_url FROM documents")
def rss_sources(spark, d):
    from ..sources.feeds import read_rss

    n = F.col("doc_id")
    link = F.concat(F.when(n % 2 == 0, "https://news.google.com/rss/articles/").otherwise("https://pod.example.com/"), n.cast("string"))
    address = F.when(n % 3 != 0, F.concat(F.lit("https://pub.example.org/"), n.cast("string"))).otherwise(F.lit("javascript:alert(1)"))
    name = F.when(n % 5 != 0, F.concat(F.lit("Pub "), (n % 4).cast("string"))).otherwise(F.lit(" "))
    xml = F.concat(F.lit("<rss><channel><item><title>T</title><link>"), link, F.lit('</link><source url="'), address, F.lit('">'), name, F.lit("</source></item></channel></rss>"))
    return read_rss(read(spark, d, "documents").select("doc_id", xml.alias("body")), "body", now=1 << 34).select("doc_id", "url", "item_source", "item_source_url")


@query("""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'ssrf' WHEN 1 THEN 'network' WHEN 2 THEN 'http' WHEN 3 THEN 'body' WHEN 4 THEN 'parse' WHEN 5 THEN 'extract' END AS reason, page_id % 9 <> 0 AS fetched, page_id % 9 >= 6 AS success, CASE page_id % 9 WHEN 6 THEN 20 WHEN 7 THEN 3 WHEN 8 THEN 2 ELSE 0 END::BIGINT AS n FROM pages""")
def fetch_reasons(spark, d):
    from ..sources.feeds import fetch_results

    k = F.col("page_id") % 9
    rss = "<rss><channel>" + "<item><title>t</title></item>" * 25 + "</channel></rss>"
    body = F.when(k == 3, F.repeat(F.lit("x"), (1 << 20) + 1)).when(k == 4, "{broken").when(k == 5, "[1, 2]").when(k == 6, rss).when(k == 7, '<feed xmlns="a">' + "<entry><title>t</title></entry>" * 3 + "</feed>").otherwise('{"items": [{"title": "a"}, {"title": "b"}]}')
    kind = F.when(k == 6, "rss").when(k == 7, "atom").otherwise("json")
    url = F.when(k == 0, "https://10.1.2.3/feed").otherwise("https://feeds.example.org/x")
    rows = read(spark, d, "pages").select("page_id", url.alias("url"), kind.alias("kind"), F.when(k == 2, 503).when(k != 1, 200).alias("status"), body.alias("body"))
    return fetch_results(rows).select("page_id", "reason", "fetched", "success", "n")


@query(f"SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 4 <> 0 AND page_id % 50 > 20 AND page_id % 6 <> 0 THEN 5 * (page_id % 50) - 1 ELSE -1 END::BIGINT AS n FROM pages")
def article_gate(spark, d):
    from ..sources.feeds import article_bodies

    n = F.col("page_id")
    kind = F.when(n % 4 == 0, "application/pdf").when(n % 4 == 1, "").when(n % 4 == 2, "Text/HTML; charset=utf-8")
    html = F.concat(F.lit("<html><body><nav>menu</nav><article>"), F.repeat(F.lit("word "), (n % 50).cast("int")), F.lit("</article></body></html>"))
    rows = read(spark, d, "pages").select("page_id", F.when(n % 6 == 0, "http://a.example.org/").otherwise("https://a.example.org/").alias("url"), F.when(n % 5 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"), html.alias("html"))
    return article_bodies(rows).select("page_id", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n"))


@query("SELECT doc_id, 'A' || doc_id AS title, 'https://a.org/' || doc_id AS url, 1704067200 + doc_id AS published_at FROM documents")
def atom_entries(spark, d):
    from ..sources.feeds import read_atom

    n = F.col("doc_id").cast("string")
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    xml = F.concat(F.lit("<feed><entry><title>A"), n, F.lit('</title><link href="https://a.org/'), n, F.lit('"/><published>'), date, F.lit("</published></entry></feed>"))
    return read_atom(read(spark, d, "documents").select("doc_id", xml.alias("body")), "body", now=1 << 34).select("doc_id", "title", "url", "published_at")


@query("SELECT doc_id, 'J' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://j.org/' ELSE 'https://ext.org/' END || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 1704067200 + doc_id ELSE -1 END AS published_at, CASE WHEN doc_id % 4 = 0 THEN repeat('word ', 9) || 'end' END AS snippet FROM documents WHERE doc_id % 5 <> 4")
def json_feed(spark, d):
    from ..sources.feeds import read_json_feed

    n = F.col("doc_id")
    item = F.struct(
        F.when(n % 5 != 4, F.concat(F.lit("J"), n.cast("string"))).alias("title"), F.when(n % 2 == 0, F.concat(F.lit("https://j.org/"), n.cast("string"))).alias("url"), F.concat(F.lit("https://ext.org/"), n.cast("string")).alias("external_url"),
        F.when(n % 3 == 0, F.date_format(F.timestamp_seconds(F.lit(1704067200) + n), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("yesterday")).alias("date_published"), F.lit("short").alias("content_text"), F.when(n % 4 == 0, F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 9), F.lit("end</p>"))).alias("content_html"),
    )
    body = F.to_json(F.struct(F.array(item).alias("items")))
    return read_json_feed(read(spark, d, "documents").select("doc_id", body.alias("body")), "body", now=1 << 34).select("doc_id", "title", "url", F.coalesce("published_at", F.lit(-1)).alias("published_at"), "snippet")


@query(sql(f"SELECT id, published_at FROM articles WHERE published_at >= {BASE + 200 * 3600} - 172800", "articles"))
def freshness_gate(spark, d):
    return ingest.fresh(T.articles(spark, d), BASE + 200 * 3600).select("id", "published_at")


@query(sql("SELECT source_name, id FROM (SELECT source_name, id, row_number() OVER (PARTITION BY source_name ORDER BY id) AS r FROM articles) WHERE r <= 10", "articles"))
def source_caps(spark, d):
    return ingest.first_per(T.articles(spark, d), "source_name", ["id"], 10).select("source_name", "id")


SQL_BLOCK = f"list_transform([{quoted(urls.BLOCKED_NAMES)}], lambda b: ' ' || trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')) || ' ')"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'https://www.msn.com/x' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'The Motley-Fool UK' ELSE 'Site ' || page_id END AS name FROM pages)
SELECT page_id FROM p WHERE NOT len(list_filter([{quoted(urls.BLOCKED_HOSTS)}], lambda b: {SQL_HOST} = b OR ends_with({SQL_HOST}, '.' || b))) > 0
  AND NOT len(list_filter({SQL_BLOCK}, lambda b: contains(' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ', b))) > 0""")
def blocked_publishers(spark, d):
    n = F.col("page_id")
    p = read(spark, d, "pages").select("page_id", F.when(n % 5 == 0, "https://www.msn.com/x").otherwise(F.col("url")).alias("url"), F.when(n % 7 == 0, "The Motley-Fool UK").otherwise(F.concat(F.lit("Site "), n.cast("string"))).alias("name"))
    return p.where(~urls.blocked_host(F.col("url")) & ~urls.blocked_name(F.col("name"))).select("page_id")


@query(sql(f"""g AS (SELECT id, CAST(id AS BIGINT) AS n, trim(regexp_replace(title, '{SQL_SPACE}+', ' ', 'g')) AS title, lang FROM articles)
SELECT id, CASE WHEN (CASE WHEN n % 9 = 0 THEN '' WHEN n % 7 = 0 THEN 'abc' ELSE 'A title that fits' END) = '' OR n % 11 = 0 OR n % 120 = 0 THEN 'empty' WHEN n % 120 < 80 THEN 'words' WHEN n % 7 = 0 THEN 'title' WHEN n % 5 = 0 THEN 'tags' ELSE 'ok' END AS verdict,
CASE WHEN n % 5 = 0 THEN '' ELSE 't1,' || lang END AS tags FROM g""", "articles"))
def publish_gate(spark, d):
    n = F.col("id").cast("long")
    title = F.when(n % 9 == 0, " <b></b> ").when(n % 7 == 0, "abc").otherwise("A  title <i>that</i> fits")
    details = F.when(n % 11 == 0, F.array(F.lit("<p> </p>"))).otherwise(F.array(F.lit("\n"), F.repeat(F.lit("word "), (n % 120).cast("int"))))
    tags = F.when(n % 5 == 0, F.array(F.lit("#other"))).otherwise(F.array(F.lit(" #T1 "), F.lit("t1"), F.upper("lang"), F.lit("#zz")))
    rows = T.articles(spark, d).select("id", title.alias("title"), details.alias("details"), tags.alias("tags"), F.array(F.lit("t1"), F.lit("t2"), F.col("lang"), F.lit("")).alias("allowed"))
    return ingest.publish_gate(rows).select("id", "verdict", F.array_join("tags", ",").alias("tags"))


@query(sql("SELECT md5(text) AS h, count(*) AS n, arg_min(id, published_at) AS winner FROM articles GROUP BY text HAVING count(*) > 1", "articles"))
def exact_dup_groups(spark, d):
    return T.articles(spark, d).groupBy("text").agg(F.count("*").alias("n"), F.min_by("id", F.struct("published_at", "id")).alias("winner")).where("n > 1").select(F.md5("text").alias("h"), "n", "winner")


@query(sql("SELECT id, CASE WHEN k IS NULL THEN 'new' ELSE 'seen' END AS state FROM articles LEFT JOIN (SELECT DISTINCT article_id AS k FROM stars) s ON id = k", "articles", "stars"))
def reseen_split(spark, d):
    a = T.articles(spark, d)
    known = a.join(T.stars(spark, d), a["id"] == F.col("article_id"), "left_semi").select(urls.canonical_url(F.col("url")).alias("key"))
    found = a.select("id", urls.canonical_url(F.concat("url", F.lit("/?utm_source=x"))).alias("key"))
    new, seen = ingest.split_seen(found, known, "key")
    return new.withColumn("state", F.lit("new")).unionByName(seen.withColumn("state", F.lit("seen"))).select("id", "state")


@query(sql("""c AS (SELECT url AS key, url AS source_url, source_name, published_at, CAST(id AS BIGINT) AS seq FROM articles UNION ALL SELECT url, 'https://alt' || (CAST(id AS BIGINT) % 7) || '.example.org/' || CAST(id AS BIGINT), 'alt', published_at - 60, CAST(id AS BIGINT) + 10000000 FROM articles)
SELECT a.id AS article_id, c.source_url, arg_min(c.source_name, seq) AS source_name, arg_min(c.published_at, seq) AS published_at FROM c JOIN articles a ON a.url = c.key AND CAST(a.id AS BIGINT) % 2 = 0 WHERE NOT EXISTS (SELECT 1 FROM article_sources s WHERE s.article_id = a.id AND s.source_url = c.source_url) GROUP BY ALL""", "articles", "article_sources"))
def reseen_sources(spark, d):
    a, n = T.articles(spark, d), F.col("id").cast("long")
    own = a.select(F.col("url").alias("key"), F.col("url").alias("source_url"), "source_name", "published_at", n.alias("seq"))
    alt = F.concat(F.lit("https://alt"), (n % 7).cast("string"), F.lit(".example.org/"), n.cast("string"))
    more = a.select(F.col("url").alias("key"), alt.alias("source_url"), F.lit("alt").alias("source_name"), (F.col("published_at") - 60).alias("published_at"), (n + 10000000).alias("seq"))
    return ingest.append_sources(own.unionByName(more), a.where(n % 2 == 0).select("id", F.col("url").alias("key")), T.article_sources(spark, d))


@query(sql("SELECT user_id, article_id, min(seen_at) AS seen_at FROM (SELECT user_id, article_id, starred_at AS seen_at FROM stars UNION ALL SELECT r.user_id, r.article_id, r.read_at FROM reads r ANTI JOIN stars USING (user_id, article_id)) GROUP BY ALL", "stars", "reads"))
def insert_ignore(spark, d):
    return ingest.insert_ignore(T.stars(spark, d).withColumnRenamed("starred_at", "seen_at"), T.reads(spark, d).withColumnRenamed("read_at", "seen_at"), ["user_id", "article_id"], ["seen_at"])


@query("""WITH RECURSIVE c AS (SELECT doc_id AS seq, doc_id % 8 AS run, CASE WHEN length(text) >= 400 THEN least(length(text), 30000) ELSE 3000 END + 400 AS cost, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS r FROM documents),
p AS (SELECT run, seq, cost, r, CAST(0 AS BIGINT) AS chunk_index, cost AS size, 1 AS items FROM c WHERE r = 1
UNION ALL SELECT c.run, c.seq, c.cost, c.r, CASE WHEN p.size + c.cost > 280000 OR p.items >= 25 THEN p.chunk_index + 1 ELSE p.chunk_index END, CASE WHEN p.size + c.cost > 280000 OR p.items >= 25 THEN c.cost ELSE p.size + c.cost END, CASE WHEN p.size + c.cost > 280000 OR p.items >= 25 THEN 1 ELSE p.items + 1 END FROM p JOIN c ON c.run = p.run AND c.r = p.r + 1)
SELECT run, seq, cost, chunk_index FROM p""")
def pack_chunks(spark, d):
    rows = ship(spark).read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 8).alias("run"), F.col("doc_id").alias("seq"), text.chunk_cost(F.substring("text", 1, 30000)).alias("cost"))
    return ingest.pack_chunks(rows, "run")


SQL_ECHO = "CASE WHEN NOT (conv_id % 3 <> 0 AND turn % 4 <> 3) THEN NULL WHEN turn % 5 = 4 THEN 99 WHEN conv_id % 3 = 1 THEN (turn + 1) % 4 WHEN turn = 0 THEN 2 END"


@query(f"""WITH o AS (SELECT conv_id AS run, turn AS pos, conv_id % 3 <> 0 AND turn % 4 <> 3 AS given, {SQL_ECHO} AS echoed FROM conversations), n AS (SELECT conv_id AS run, count(*) AS n FROM conversations GROUP BY 1),
v AS (SELECT o.*, coalesce(given AND echoed >= 0 AND echoed < n.n, false) AS valid FROM o JOIN n USING (run)), m AS (SELECT run, count(*) FILTER (valid) >= 3 OR 2 * count(*) FILTER (valid) >= count(*) AS e FROM v GROUP BY run),
p AS (SELECT run, echoed AS idx, 0 AS way, pos FROM v WHERE valid UNION ALL SELECT v.run, pos, 1, pos FROM v JOIN m USING (run) WHERE NOT e AND (valid OR NOT given)),
f AS (SELECT run, idx, pos FROM p QUALIFY row_number() OVER (PARTITION BY run, idx ORDER BY way, pos) = 1),
t AS (SELECT f.*, {SQL_TOKENS.format("i.text")} AS a, {SQL_TOKENS.format("CASE WHEN o.turn % 3 = 1 THEN 'zzzzz qqqqq' ELSE o.text END")} AS b FROM f JOIN conversations i ON i.conv_id = run AND i.turn = idx JOIN conversations o ON o.conv_id = run AND o.turn = pos)
SELECT run, idx, pos FROM t WHERE len(a) < 2 OR len(b) < 2 OR list_has_any(a, b)""")
def llm_alignment(spark, d):
    c, k, t = read(spark, d, "conversations"), F.col("conv_id") % 3, F.col("turn")
    given = (k != 0) & (t % 4 != 3)
    echoed = F.when(~given, None).when(t % 5 == 4, 99).when(k == 1, (t + 1) % 4).when(t == 0, 2)
    outputs = c.select(F.col("conv_id").alias("run"), t.alias("pos"), given.alias("given"), echoed.alias("echoed"), F.when(t % 3 == 1, "zzzzz qqqqq").otherwise(F.col("text")).alias("title"))
    return ingest.align_outputs(c.select(F.col("conv_id").alias("run"), t.alias("idx"), F.col("text").alias("title")), outputs)


@query("""WITH c AS (SELECT doc_id // 10 AS run, doc_id % 10 AS idx FROM documents), h AS (SELECT run, hint, unnest(m) AS idx FROM (SELECT DISTINCT run, unnest([0, 1]) AS hint, unnest([[7, 2, run % 10], [2, 9, 99]]) AS m FROM c)),
v AS (SELECT DISTINCT h.run, hint, h.idx FROM h JOIN c ON c.run = h.run AND c.idx = h.idx), g AS (SELECT run, hint, min(idx) AS anchor FROM v GROUP BY ALL HAVING count(*) >= 2), l AS (SELECT run, anchor, max(hint) AS hint FROM g GROUP BY ALL)
SELECT v.run, l.anchor, v.idx FROM v JOIN l ON v.run = l.run AND v.hint = l.hint UNION ALL SELECT run, idx, idx FROM c WHERE (run, idx) NOT IN (SELECT (v.run, v.idx) FROM v JOIN g ON v.run = g.run AND v.hint = g.hint)""")
def hint_merges(spark, d):
    c = read(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("run"), (F.col("doc_id") % 10).alias("idx"))
    hint = F.posexplode(F.array(F.array(F.lit(7).cast("long"), F.lit(2).cast("long"), F.col("run") % 10), F.array(*[F.lit(x).cast("long") for x in (2, 9, 99)]))).alias("hint", "members")
    return ingest.hint_merge(c, c.select("run").distinct().select("run", hint))


# ---- feeds ----

USER = 3


@query(sql(f"""SELECT a.id, alt_source_count, tags, starred, was_read AS read FROM (SELECT *, coalesce(n, 0) AS alt_source_count, s.article_id IS NOT NULL AS starred, r.article_id IS NOT NULL AS was_read FROM articles a
LEFT JOIN (SELECT article_id, count(*) AS n FROM article_sources x JOIN articles y ON x.article_id = y.id WHERE source_url <> y.url GROUP BY 1) c ON c.article_id = a.id
LEFT JOIN (SELECT article_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM article_tags GROUP BY 1) t ON t.article_id = a.id
LEFT JOIN (SELECT DISTINCT article_id FROM stars WHERE user_id = {USER}) s ON s.article_id = a.id LEFT JOIN (SELECT DISTINCT article_id FROM reads WHERE user_id = {USER}) r ON r.article_id = a.id
WHERE a.id IN (SELECT article_id FROM article_tags WHERE tag IN ('en', 't1')) ORDER BY ingested_at DESC, published_at DESC, a.id LIMIT 29) a""", "articles", "article_tags", "article_sources", "stars", "reads"))
def today_feed(spark, d):
    wanted = feed.tagged(T.article_tags(spark, d), ["en", "t1"])
    top = feed.newest(feed.with_tags(T.articles(spark, d), wanted), 29)
    mine = [m(spark, d).where(F.col("user_id") == USER) for m in (T.stars, T.reads)]
    return feed.decorated(top, T.article_sources(spark, d), T.article_tags(spark, d), *mine).select("id", F.col("alt_source_count").cast("long").alias("alt_source_count"), "tags", "starred", "read")


@query(sql("SELECT user_id, article_id, rank FROM (SELECT w.user_id, w.article_id, row_number() OVER (PARTITION BY w.user_id ORDER BY ingested_at DESC, published_at DESC, w.article_id) AS rank FROM (SELECT DISTINCT user_id, article_id FROM user_tags JOIN article_tags USING (tag)) w ANTI JOIN reads r ON r.user_id = w.user_id AND r.article_id = w.article_id JOIN articles a ON a.id = w.article_id) WHERE rank <= 5", "user_tags", "article_tags", "reads", "articles"))
def unread_headlines(spark, d):
    out = feed.unread(T.articles(spark, d), T.user_tags(spark, d), T.article_tags(spark, d), T.reads(spark, d), 5)
    return out.select("user_id", "article_id", F.col("rank").cast("long").alias("rank"))


@query(sql(f"SELECT id, starred_at FROM stars JOIN articles ON article_id = id WHERE user_id = {USER} ORDER BY starred_at DESC, id LIMIT 60", "stars", "articles"))
def starred_list(spark, d):
    mine = T.stars(spark, d).where(F.col("user_id") == USER)
    return mine.join(T.articles(spark, d), F.col("article_id") == F.col("id")).orderBy(F.desc("starred_at"), "id").limit(60).select("id", "starred_at")


@query(sql(f"""m AS (SELECT user_id, CAST(epoch(timezone(tz, date_trunc('day', timezone(tz, to_timestamp({BASE + 150 * 3600}))))) AS BIGINT) AS since FROM users),
c AS (SELECT user_id, user_tags.tag, count(DISTINCT a.id) AS n FROM user_tags JOIN m USING (user_id) LEFT JOIN (SELECT tag, id, ingested_at FROM articles JOIN article_tags ON id = article_id) a ON a.tag = user_tags.tag AND a.ingested_at >= since GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS rank, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM c""", "articles", "article_tags", "users", "user_tags"))
def tag_tally(spark, d):
    return feed.tag_tally(T.articles(spark, d), T.article_tags(spark, d), T.users(spark, d), T.user_tags(spark, d), BASE + 150 * 3600)


@query(sql("SELECT u.tag, count(DISTINCT a.article_id) AS n FROM (SELECT DISTINCT tag FROM user_tags) u LEFT JOIN article_tags a ON a.tag = u.tag GROUP BY u.tag", "user_tags", "article_tags"))
def tag_counts_zero_fill(spark, d):
    counts = T.article_tags(spark, d).groupBy("tag").agg(F.count_distinct("article_id").alias("n"))
    return T.user_tags(spark, d).select("tag").distinct().join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


SQL_HISTORY = f"""z AS (SELECT {SQL_ZONES} AS tz), price(model_id, price_in, price_out) AS (VALUES ('m0', 0.35::DOUBLE, 0.75::DOUBLE), ('m1', 0.1, 0.2), ('m2', 1.5, 3.0)),
a AS (SELECT tz, strftime(timezone(tz, to_timestamp(ingested_at)), '%Y-%m-%d') AS day, count(*) AS articles, max(id) AS last_id FROM articles, z GROUP BY ALL),
r AS (SELECT tz, strftime(timezone(tz, to_timestamp(started_at)), '%Y-%m-%d') AS day, count(*) AS runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(ingested) AS BIGINT) AS ingested, sum(coalesce(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 0)) AS cost FROM runs LEFT JOIN price USING (model_id), z GROUP BY ALL),
b AS (SELECT tz, day, coalesce(articles, 0) AS articles, last_id, coalesce(runs, 0) AS runs, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out, coalesce(ingested, 0) AS ingested, round(coalesce(cost, 0), 4) AS cost FROM a FULL JOIN r USING (tz, day)),
h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY tz ORDER BY day DESC) <= 14)"""


@query(sql(SQL_HISTORY + " SELECT * FROM h", "articles", "runs"))
def history_by_day(spark, d):
    return feed.history(T.articles(spark, d), priced(spark, d), T.ZONES, 14).withColumn("cost", F.round("cost", 4))


@query(sql(SQL_HISTORY + ", x AS (SELECT id, tz, strftime(timezone(tz, to_timestamp(ingested_at)), '%Y-%m-%d') AS day, ingested_at, published_at FROM articles, z) SELECT tz, day, id, row_number() OVER (PARTITION BY tz, day ORDER BY ingested_at DESC, published_at DESC, id) AS position FROM x JOIN h USING (tz, day)", "articles", "runs"))
def history_articles(spark, d):
    days = feed.history(T.articles(spark, d), T.runs(spark, d), T.ZONES, 14)
    return feed.history_articles(T.articles(spark, d), days, T.ZONES).select("tz", "day", "id", "position")


@query(sql(SQL_HISTORY + " SELECT tz, day, articles FROM h WHERE day = '2024-01-05' OR tz NOT IN (SELECT tz FROM h WHERE day = '2024-01-05')", "articles", "runs"))
def history_focus(spark, d):
    return feed.focused(feed.history(T.articles(spark, d), T.runs(spark, d), T.ZONES, 14), "2024-01-05").select("tz", "day", "articles")


@query(sql("SELECT id FROM articles WHERE len(list_intersect([lang], ['en', 'fr'])) > 0 AND contains(lower(title || ' ' || text), 'the')", "articles"))
def search_filter(spark, d):
    rows = T.articles(spark, d).select("id", "title", F.col("text").alias("excerpt"), F.array("lang").alias("tags"))
    return feed.search(rows, " The ", ["en", "fr"]).select("id")


@query(sql("SELECT article_id, source_url, CASE WHEN n = 1 THEN 'plus 1 other source' ELSE 'plus ' || n || ' other sources' END AS label FROM (SELECT article_id, source_url, count(*) OVER (PARTITION BY article_id) AS n FROM article_sources JOIN articles ON article_id = id WHERE source_url <> url)", "article_sources", "articles"))
def alt_sources(spark, d):
    own = T.articles(spark, d).select(F.col("id").alias("article_id"), "url")
    alts = T.article_sources(spark, d).join(own, "article_id").where(F.col("source_url") != F.col("url"))
    n = F.count("*").over(W.partitionBy("article_id"))
    return alts.select("article_id", "source_url", F.when(n == 1, "plus 1 other source").otherwise(F.concat(F.lit("plus "), n.cast("string"), F.lit(" other sources"))).alias("label"))


@query(sql(f"SELECT u.user_id, u.tz, strftime(timezone(tz, to_timestamp({NOW})), '%Y-%m-%d') AS local_date FROM users u WHERE enabled AND hour = hour(timezone(tz, to_timestamp({NOW}))) AND minute BETWEEN 0 AND 4 AND user_id % 10 <> 0", "users"))
def dispatch_due(spark, d):
    u = T.users(spark, d)
    sent = u.where("user_id % 10 = 0").select("user_id", timez.local_date(F.lit(NOW), F.col("tz")).alias("local_date"))
    return feed.due_users(u, sent, NOW).select("user_id", "tz", "local_date")


@query(sql("SELECT DISTINCT tz FROM users WHERE enabled AND tz <> ''", "users"))
def enabled_zones(spark, d):
    return T.users(spark, d).where(F.col("enabled") & (F.col("tz") != "")).select("tz").distinct()


@query(sql(f"""w AS (SELECT user_id, article_id, title, row_number() OVER (PARTITION BY user_id ORDER BY ingested_at DESC, published_at DESC, article_id) AS rank FROM (SELECT DISTINCT user_id, article_id FROM user_tags JOIN article_tags USING (tag)) x ANTI JOIN reads r USING (user_id, article_id) JOIN articles a ON a.id = article_id),
h AS (SELECT user_id, count(*) AS n, string_agg(title, ', ' ORDER BY rank) FILTER (rank <= 3) AS preheader FROM w WHERE rank <= 5 GROUP BY user_id),
m AS (SELECT user_id, CAST(epoch(timezone(tz, date_trunc('day', timezone(tz, to_timestamp({BASE + 150 * 3600}))))) AS BIGINT) AS since FROM users),
c AS (SELECT user_id, user_tags.tag, count(DISTINCT a.id) AS n FROM user_tags JOIN m USING (user_id) JOIN (SELECT tag, id, ingested_at FROM articles JOIN article_tags ON id = article_id) a ON a.tag = user_tags.tag AND a.ingested_at >= since GROUP BY ALL),
t AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total, string_agg('#' || tag || ' (' || n || ')', ' ' ORDER BY n DESC, tag) AS line, array_to_string(list(tag ORDER BY n DESC, tag)[1:3], ', ') AS top FROM c GROUP BY user_id)
SELECT u.user_id, CASE WHEN h.n IS NULL THEN 'Your news digest is ready' ELSE h.n || CASE WHEN h.n = 1 THEN ' new article' ELSE ' new articles' END || coalesce(' · ' || top, '') END AS subject, coalesce(preheader, '') AS preheader,
printf('Sent %02d:%02d %s · next digest tomorrow at %02d:%02d', hour, minute, tz, (hour + 1) % 24, minute) AS sent_line, 'Since midnight: ' || total || CASE WHEN total = 1 THEN ' article' ELSE ' articles' END || ' · ' || line AS tally_line
FROM users u LEFT JOIN h USING (user_id) LEFT JOIN t USING (user_id)""", "users", "user_tags", "article_tags", "reads", "articles"))
def email_subjects(spark, d):
    a, users, tags, marks = (t(spark, d) for t in (T.articles, T.users, T.user_tags, T.article_tags))
    heads = feed.unread(a, tags, marks, T.reads(spark, d), 5).join(a.select(F.col("id").alias("article_id"), "title"), "article_id").select("user_id", "rank", "title")
    rows = users.withColumns({"next_hour": (F.col("hour") + 1) % 24, "next_minute": F.col("minute")})
    return feed.digest_mail(rows, heads, feed.tag_tally(a, marks, users, tags, BASE + 150 * 3600))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def keyset_page(spark, d):
    import datetime

    return feed.after_key(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ("o_orderdate", "o_orderkey"), (datetime.datetime(1995, 1, 1), 100), 50)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def backlog(spark, d):
    o = read(spark, d, "orders")
    status = F.when(o.o_orderkey % 3 == 0, None).when((o.o_orderkey % 3 == 1) & (o.o_orderstatus == "P"), "failed").otherwise("embedded")
    return o.withColumn("status", status).where("status is null or status = 'failed'").orderBy("o_orderdate", "o_orderkey").limit(50).select(F.col("o_orderkey").alias("id"))


# ---- vector pairs and merges ----

BANDS = dedup.Bands(threshold=0.36, penalty=0.05, floor=0.30, high=0.42)


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.lit(BASE) + F.col("vec_id") * 3600).alias("published_at"), "embedding", F.col("label").alias("vendor"))


SQL_VECTORS = f"v AS (SELECT vec_id AS id, {BASE} + vec_id * 3600 AS at, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
SQL_PAIRS = f"""{SQL_VECTORS},
s AS (SELECT a.id AS self, b.id AS match, a.at AS self_at, b.at AS match_at, list_cosine_similarity(a.e, b.e) AS score, a.label = b.label AS same_vendor FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) <= 20),
p AS (SELECT *, abs(self_at - match_at) <= 604800 AS eligible, score >= {BANDS.high} AS high, CASE WHEN same_vendor AND score < {BANDS.high} THEN score - {BANDS.penalty} ELSE score END AS adjusted, self_at < match_at AS self_is_older FROM s),
c AS (SELECT *, eligible AND (high OR adjusted >= {BANDS.threshold}) AS auto, eligible AND NOT (high OR adjusted >= {BANDS.threshold}) AND adjusted >= {BANDS.floor} AS borderline FROM p)"""


def banded(spark, d):
    """Each vector's twenty nearest, of which the window and the bands then leave what may merge."""
    v = vectors(ship(spark), d)
    return dedup.classified(dedup.top_matches(v.select("id", "published_at", "embedding"), BANDS.top_k), v, BANDS)


@query(f"WITH {SQL_VECTORS} SELECT a.id AS self, b.id AS match, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.id <> b.id AND abs(a.at - b.at) <= 604800 WHERE list_cosine_similarity(a.e, b.e) >= 0.3")
def near_pairs(spark, d):
    return dedup.near_pairs(vectors(ship(spark), d).drop("vendor"), BANDS.window, 0.3).select("self", "match", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_PAIRS} SELECT self, match, eligible, same_vendor, high, auto, borderline, self_is_older, round(adjusted, 6) AS adjusted FROM c")
def pair_bands(spark, d):
    return banded(spark, d).select("self", "match", "eligible", "same_vendor", "high", "auto", "borderline", "self_is_older", F.round("adjusted", 6).alias("adjusted"))


@query(f"WITH {SQL_PAIRS} SELECT self, match FROM c WHERE auto QUALIFY row_number() OVER (PARTITION BY self ORDER BY self_is_older, CASE WHEN NOT self_is_older THEN match_at END NULLS FIRST, adjusted DESC, match) = 1")
def best_auto(spark, d):
    return dedup.best_auto(banded(spark, d)).select("self", "match")


@query(f"WITH {SQL_PAIRS} SELECT self, match, row_number() OVER (PARTITION BY self ORDER BY adjusted DESC, self_is_older, match_at, match) AS rank FROM c WHERE borderline QUALIFY rank <= 5")
def border_top5(spark, d):
    return dedup.border_top(banded(spark, d), 5).select("self", "match", "rank")


@query(f"""WITH {SQL_PAIRS}, x AS (SELECT *, match % 10 = 0 AS gone FROM c), d AS (SELECT self, match, score, adjusted, self_is_older, high AND NOT gone AS high, eligible OR gone AND abs(self_at - match_at) <= 604800 AS within, eligible AND NOT gone AS eligible, auto AND NOT gone AS auto, borderline AND NOT gone AS borderline, count(*) FILTER (eligible AND gone) OVER (PARTITION BY self) AS absorbed FROM x)
SELECT self, count(*) AS seen, count(*) FILTER (NOT within) AS out_of_window, count(*) FILTER (eligible AND self_is_older) AS self_older, count(*) FILTER (eligible AND NOT self_is_older) AS self_newer, count(*) FILTER (eligible AND adjusted >= {BANDS.floor}) AS over_floor, count(*) FILTER (auto) AS autos, count(*) FILTER (eligible AND high) AS highs,
round(max(score) FILTER (eligible), 6) AS best, CASE WHEN count(*) FILTER (auto AND NOT self_is_older) > 0 THEN 'auto_merge' WHEN autos > 0 THEN 'auto_merge_self_wins' WHEN count(*) FILTER (borderline) > 0 THEN 'rerank_pending' WHEN over_floor > 0 THEN 'no_above_threshold' ELSE 'no_match_below_floor' END AS decision, absorbed FROM d GROUP BY self, absorbed""")
def band_diagnostics(spark, d):
    pairs = banded(spark, d).withColumn("absorbed", F.col("match") % 10 == 0)
    return dedup.diagnostics(pairs, BANDS).select("self", "seen", "out_of_window", "absorbed", "self_older", "self_newer", "over_floor", "autos", "highs", F.round("best", 6).alias("best"), "decision")


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.id AS self, b.id AS match, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) <= 20")
def top_matches(spark, d):
    return dedup.top_matches(vectors(ship(spark), d), 20).select("self", "match", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings) SELECT round(list_cosine_similarity(a.e, b.e), 6) AS cosine, a.label = b.label AS same_vendor, list_cosine_similarity(a.e, b.e) - CASE WHEN a.label = b.label THEN 0.05 ELSE 0 END >= 0.36 AS above FROM v a, v b WHERE a.id = 3 AND b.id = 7")
def pair_diagnostic(spark, d):
    v = vectors(spark, d)
    a, b = (v.where(F.col("id") == i).select(F.col("embedding").alias(f"e{i}"), F.col("vendor").alias(f"v{i}")) for i in (3, 7))
    c, same = dedup.cosine(F.col("e3"), F.col("e7")), F.col("v3") == F.col("v7")
    return a.join(b).select(F.round(c, 6).alias("cosine"), same.alias("same_vendor"), (c - F.when(same, BANDS.penalty).otherwise(0) >= BANDS.threshold).alias("above"))


def verdicts(pairs):
    """Stand-in for a model's answers to the borderline pairs: accepted when the two ids have an even sum."""
    return pairs.where("borderline").select("self", "match", ((F.col("self") + F.col("match")) % 2 == 0).alias("same"))


def settled_pairs(spark, d):
    return dedup.checkpointed(banded(spark, d))


@query()
def merge_map(spark, d):
    pairs = settled_pairs(spark, d)
    return dedup.merge_map(pairs, verdicts(pairs))


@query()
def finalize_map(spark, d):
    pairs = settled_pairs(spark, d)
    return dedup.merge_map(pairs, verdicts(pairs), newest_first=True)


@query()
def merge_apply(spark, d):
    marks = T.stars(spark, d).select("user_id", F.col("article_id").cast("long").alias("vec_id"), "starred_at")
    return dedup.apply_merge(marks, dedup.merge_map(banded(spark, d)), "vec_id", ["user_id", "vec_id"], "starred_at")


SQL_MERGED = "m AS (SELECT id AS loser, lpad(CAST(CAST(id AS BIGINT) - 3 AS VARCHAR), 8, '0') AS winner FROM articles WHERE CAST(id AS BIGINT) % 7 = 3)"


def merged(spark, d):
    """Every table after a fixed set of merges."""
    a, n = T.articles(spark, d), F.col("id").cast("long")
    mapping = a.where(n % 7 == 3).select(F.col("id").alias("loser"), F.lpad((n - 3).cast("string"), 8, "0").alias("winner"))
    sources = T.article_sources(spark, d).withColumn("source_name", F.lit("alt"))
    return dedup.merge_tables(mapping, a, sources, T.article_tags(spark, d), T.stars(spark, d), T.reads(spark, d))


@query(sql(f"{SQL_MERGED} SELECT id, title FROM articles WHERE id NOT IN (SELECT loser FROM m)", "articles"))
def merged_articles(spark, d):
    return merged(spark, d)["articles"].select("id", "title")


@query(sql(f"""{SQL_MERGED}, x AS (SELECT coalesce(winner, article_id) AS article_id, source_url, 'alt' AS source_name, published_at, winner IS NOT NULL AS moved, 2 AS alt, article_id AS origin FROM article_sources LEFT JOIN m ON loser = article_id
UNION ALL SELECT winner, url, source_name, published_at, true, 1, id FROM articles JOIN m ON loser = id)
SELECT article_id, source_url, source_name, published_at FROM x QUALIFY row_number() OVER (PARTITION BY article_id, source_url ORDER BY moved, alt, origin) = 1""", "articles", "article_sources"))
def merged_sources(spark, d):
    return merged(spark, d)["sources"].select("article_id", "source_url", "source_name", "published_at")


@query(sql(f"{SQL_MERGED} SELECT DISTINCT coalesce(winner, article_id) AS article_id, tag FROM article_tags LEFT JOIN m ON loser = article_id", "articles", "article_tags"))
def merged_tags(spark, d):
    return merged(spark, d)["tags"]


@query(sql(f"""{SQL_MERGED}, x AS (SELECT 'star' AS kind, user_id, article_id, starred_at AS since FROM stars UNION ALL SELECT 'read', user_id, article_id, read_at FROM reads)
SELECT kind, user_id, coalesce(winner, article_id) AS article_id, since FROM x LEFT JOIN m ON loser = article_id QUALIFY row_number() OVER (PARTITION BY kind, user_id, coalesce(winner, article_id) ORDER BY winner IS NOT NULL, x.article_id) = 1""", "articles", "stars", "reads"))
def merged_marks(spark, d):
    t = merged(spark, d)
    kinds = ((t["stars"], "star", "starred_at"), (t["reads"], "read", "read_at"))
    a, b = (m.select(F.lit(k).alias("kind"), "user_id", "article_id", F.col(c).alias("since")) for m, k, c in kinds)
    return a.unionByName(b)


@query(f"WITH {SQL_PAIRS} SELECT self, match, (row_number() OVER (PARTITION BY self ORDER BY adjusted DESC, match) - 1) // 3 AS batch, (self + match) % 2 = 0 AS same FROM c WHERE borderline AND NOT (self < 100 AND match < 100)")
def rerank_batches(spark, d):
    pairs = settled_pairs(spark, d).where(~((F.col("self") < 100) & (F.col("match") < 100)))
    rows = dedup.batches(pairs, 3).join(dedup.judged(pairs, lambda asked: [(r["self"] + r["match"]) % 2 == 0 for r in asked], 3), ["self", "match"], "left")
    return rows.select("self", "match", "batch", F.coalesce("same", F.lit(False)).alias("same"))


# ---- accounting, retention, limits ----

PRICES = [("m0", 0.35, 0.75), ("m1", 0.1, 0.2), ("m2", 1.5, 3.0)]
SQL_PRICES = "price(model_id, price_in, price_out) AS (VALUES ('m0', 0.35::DOUBLE, 0.75::DOUBLE), ('m1', 0.1, 0.2), ('m2', 1.5, 3.0))"


def priced(spark, d):
    return ops.run_costs(T.runs(spark, d), F.broadcast(spark.createDataFrame(PRICES, "model_id string, price_in double, price_out double")))


@query(sql(f"{SQL_PRICES} SELECT model_id, status, count(*) AS runs, round(sum(coalesce(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 0)), 4) AS cost FROM runs LEFT JOIN price USING (model_id) GROUP BY ALL", "runs"))
def run_costs(spark, d):
    return priced(spark, d).groupBy("model_id", "status").agg(F.count("*").alias("runs"), F.round(F.sum("cost"), 4).alias("cost"))


@query(sql(f"SELECT (SELECT count(*) FROM runs WHERE status = 'ready') AS ready, (SELECT count(DISTINCT article_id) FROM article_tags WHERE tag IN ('en', 't1')) AS articles, (SELECT CAST(coalesce(sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)), 0) AS BIGINT) FROM runs) AS tokens, (SELECT count(*) FROM reads WHERE user_id = {USER}) AS reads, (SELECT count(*) FROM stars WHERE user_id = {USER}) AS stars", "runs", "article_tags", "reads", "stars"))
def stats_tiles(spark, d):
    r = T.runs(spark, d).agg(F.count_if(F.col("status") == "ready").alias("ready"), F.coalesce(F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))), F.lit(0)).alias("tokens"))
    a = feed.tagged(T.article_tags(spark, d), ["en", "t1"]).agg(F.count("*").alias("articles"))
    marks = [m(spark, d).where(F.col("user_id") == USER).agg(F.count("*").alias(n)) for m, n in ((T.reads, "reads"), (T.stars, "stars"))]
    return r.join(a).join(marks[0]).join(marks[1])


@query("SELECT role, count(*) AS turns, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM conversations GROUP BY role")
def token_counts(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)))
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(words).alias("words"))


@query(sql("SELECT id, CASE WHEN chunk_count > 0 THEN greatest(chunk_count - ingested, 0) ELSE -1 END AS remaining FROM runs", "runs"))
def run_progress(spark, d):
    return T.runs(spark, d).select("id", F.coalesce(ops.progress(F.col("chunk_count"), F.col("ingested")), F.lit(-1)).alias("remaining"))


@query(f"SELECT user_id, count(*) AS chunks, CAST(sum(v) AS BIGINT) AS tokens FROM (SELECT user_id, event_id % 50 AS chunk, min(event_id) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def ledger_totals(spark, d):
    once = read(spark, d, "events").groupBy("user_id", (F.col("event_id") % 50).alias("chunk")).agg(F.min("event_id").alias("v"))
    return once.groupBy("user_id").agg(F.count("*").alias("chunks"), F.sum("v").alias("tokens"))


@query(sql("SELECT id, status FROM runs ORDER BY started_at DESC, id DESC LIMIT 1", "runs"))
def latest_run(spark, d):
    return ops.latest(T.runs(spark, d), ["started_at", "id"]).select("id", "status")


CUT = BASE + 180 * 3600


@query(sql(f"SELECT id FROM articles WHERE published_at >= {CUT} - 2 * 86400 OR id IN (SELECT article_id FROM stars)", "articles", "stars"))
def retention(spark, d):
    return ops.retain(T.articles(spark, d), T.stars(spark, d), CUT, 2).select("id")


@query(sql(f"kept AS (SELECT id FROM articles WHERE published_at >= {CUT} - 2 * 86400 OR id IN (SELECT article_id FROM stars)) SELECT user_id, article_id FROM reads WHERE article_id IN (SELECT id FROM kept)", "articles", "stars", "reads"))
def cascade_delete(spark, d):
    return ops.cascade(T.reads(spark, d), ops.retain(T.articles(spark, d), T.stars(spark, d), CUT, 2), "article_id").select("user_id", "article_id")


@query(sql("SELECT DISTINCT a.tag FROM article_tags a ANTI JOIN user_tags u ON u.tag = a.tag", "article_tags", "user_tags"))
def orphan_tags(spark, d):
    return T.article_tags(spark, d).select("tag").distinct().join(T.user_tags(spark, d), "tag", "left_anti")


SQL_TAGS = "k AS (SELECT DISTINCT user_id % 40 AS k FROM events)"


def tag_numbers(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 40).alias("k")).distinct()


def tag(k):
    return F.concat(F.lit("t"), k.cast("string"))


def source_cache(spark, d):
    """Cache entries of every shape: feeds, some of them unusable; long empty; lately empty; broken; no list of feeds."""
    k = F.col("k")
    good = F.concat(F.lit('{"feeds": [{"name": "a", "url": "https://a/'), k.cast("string"), F.lit('", "kind": "rss"}, {"name": " ", "url": "x", "kind": "rss"}, {"name": "b", "url": "https://b", "kind": "html"}, {"name": "c", "url": "https://c", "kind": "json"}], "discovered_at": 1}'))
    empty = lambda at: f'{{"feeds": [], "discovered_at": {at * 1000}}}'
    value = F.when(k % 5 == 0, good).when(k % 5 == 1, empty(NOW - 7 * 86400)).when(k % 5 == 2, empty(NOW - 7 * 86400 + 1)).when(k % 5 == 3, "broken").otherwise('{"feeds": "none", "discovered_at": 1}')
    return tag_numbers(spark, d).select(F.concat(F.lit("sources:"), tag(k)).alias("key"), value.alias("value")).unionByName(spark.createDataFrame([("sources:", "{}"), ("other:t1", "{}")], "key string, value string"))


def curated_tags(spark):
    return spark.createDataFrame([("t0",), ("t7",), ("t11",)], "tag string")


@query("SELECT DISTINCT user_id, tag FROM (SELECT user_id, unnest([CASE WHEN user_id % 2 = 0 THEN '#T' ELSE 't' END || (user_id % 40), 'kept']) AS tag, user_id % 40 AS k FROM events) WHERE tag = 'kept' OR k % 5 <> 1")
def stuck_tags(spark, d):
    u = F.col("user_id")
    mine = F.array(F.concat(F.when(u % 2 == 0, "#T").otherwise("t"), (u % 40).cast("string")), F.lit("kept"))
    tags = read(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(mine).alias("tag"))
    return discovery.prune(tags, discovery.stuck_tags(source_cache(spark, d), NOW * 1000))


@query(f"WITH {SQL_TAGS} SELECT 'sources:t' || k AS key FROM k WHERE k NOT IN (0, 7, 11) UNION ALL SELECT unnest(['sources:', 'other:t1'])")
def cache_purge(spark, d):
    return discovery.purge_cache(source_cache(spark, d), curated_tags(spark)).select("key")


@query("SELECT c_custkey AS id, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 100, c_custkey) AS winner FROM customer")
def account_collapse(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("mail"), (F.col("c_custkey") % 100).alias("created_at"))
    return ops.collapse(c, "mail")


@query(sql("SELECT user_id % 10 AS user_id, article_id, min(starred_at) AS starred_at FROM stars GROUP BY ALL", "stars"))
def account_repoint(spark, d):
    mapping = T.users(spark, d).select(F.col("user_id").alias("id"), (F.col("user_id") % 10).alias("winner"))
    return ops.repoint(T.stars(spark, d), mapping, "user_id", ["user_id", "article_id"], "starred_at")


@query("SELECT o_orderstatus, count(*) AS kept FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def ledger_purge(spark, d):
    import datetime

    parents = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    left = ops.purge_ledger(read(spark, d, "orders").withColumn("finished_at", done), parents, "o_custkey", "finished_at", datetime.datetime(1996, 1, 1))
    return left.groupBy("o_orderstatus").agg(F.count("*").alias("kept"))


@query(sql(f"SELECT id, CASE WHEN status = 'running' AND started_at < 800000000 THEN 'failed' ELSE status END AS status FROM runs", "runs"))
def orphan_runs(spark, d):
    return T.runs(spark, d).select("id", F.when((F.col("status") == "running") & (F.col("started_at") < 800000000), "failed").otherwise(F.col("status")).alias("status"))


@query("SELECT event_id, window_index, hit, hit <= 2 AS allowed, CASE WHEN hit > 2 THEN (window_index + 1) * 3600 - t ELSE 0 END AS retry_after FROM (SELECT *, row_number() OVER (PARTITION BY user_id, window_index ORDER BY t, event_id) AS hit FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS window_index FROM events))")
def rate_limit(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", timez.seconds(F.col("ts")).alias("t"))
    return ops.rate_limited(e, "user_id", "t", "event_id", 3600, 2).select("event_id", "window_index", "hit", "allowed", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type IN ('error', 'view') AS f FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER w > 172800, false) AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(CASE WHEN NOT f OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g)
SELECT event_id, CASE WHEN f THEN CAST(sum(CAST(f AS INT)) OVER (PARTITION BY user_id, island ORDER BY t, event_id) AS BIGINT) ELSE 0 END AS streak, streak >= 4 AS evicted FROM i""")
def failure_streaks(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", timez.seconds(F.col("ts")).alias("t"))
    return ops.failure_streaks(e, "user_id", "t", "event_id", F.col("event_type").isin("error", "view"), 172_800, 4).select("event_id", "streak", "evicted")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS claimed FROM events")
def claims(spark, d):
    e = read(spark, d, "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return ops.claims(e, "key", ["ts", "event_id"]).select("event_id", "claimed")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events),
p AS (SELECT event_id, user_id, r, t AS last, true AS started FROM e WHERE r = 1 UNION ALL SELECT e.event_id, e.user_id, e.r, CASE WHEN e.t - p.last > 21600 THEN e.t ELSE p.last END, e.t - p.last > 21600 FROM p JOIN e ON e.user_id = p.user_id AND e.r = p.r + 1)
SELECT event_id, started FROM p""")
def run_reuse(spark, d):
    e = read(ship(spark), d, "events").select("event_id", "user_id", timez.seconds(F.col("ts")).alias("t"))
    return ops.kick(e, "user_id", "t", "event_id", 21_600).select(F.col("order").alias("event_id"), "started")


@query("""WITH c AS (SELECT user_id % 20 AS run, event_id % 7 AS chunk, min((10 + event_id % 3, event_id % 5)) AS c FROM events GROUP BY ALL), l AS (SELECT user_id % 20 AS run, count(DISTINCT event_id % 13) AS lost FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT run, CAST(sum(c[1]) AS BIGINT) AS candidates, CAST(sum(c[2]) AS BIGINT) AS ingested FROM c GROUP BY run)
SELECT s.*, candidates - ingested + coalesce(lost, 0) AS deduped FROM s LEFT JOIN l USING (run)""")
def run_dedupes(spark, d):
    e, n = read(spark, d, "events"), F.col("event_id")
    run = (F.col("user_id") % 20).alias("run")
    chunks = e.select(run, (n % 7).alias("chunk"), (10 + n % 3).alias("candidates"), (n % 5).alias("ingested"))
    return ops.finished(chunks, e.where("event_type = 'error'").select(run, (n % 13).alias("loser")))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN '{\"a\":[' || user_id || ']}' WHEN 2 THEN 'c' || user_id WHEN 6 THEN '[1]' END AS payload, CASE event_id % 7 WHEN 0 THEN user_id WHEN 1 THEN 7 WHEN 2 THEN 11 ELSE 0 END AS tokens_in, CASE event_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 12 ELSE 0 END::BIGINT AS tokens_out FROM events")
def model_replies(spark, d):
    k, u = F.col("event_id") % 7, F.col("user_id").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit('{"response": "'), "event_type", F.lit('", "usage": {"input_tokens": '), u, F.lit(', "output_tokens": 5, "prompt_tokens": 1}}')))
        .when(k == 1, F.concat(F.lit('{"response": {"a": ['), u, F.lit(']}, "usage": {"input_tokens": "3", "prompt_tokens": 7, "completion_tokens": 8}}')))
        .when(k == 2, F.concat(F.lit('{"response": null, "tokens_in": 11, "tokens_out": 12, "choices": [{"message": {"content": "c'), u, F.lit('"}}]}')))
        .when(k == 3, '{"choices": [{"message": {"content": null}}], "usage": null}').when(k == 4, '{"response": 7, "choices": []}').when(k == 5, "no json").otherwise('{"choices": [{"message": {"content": [1]}}]}')
    )
    rows = read(spark, d, "events").select("event_id", body.alias("body"))
    return rows.select("event_id", text.response_payload(F.col("body")).alias("payload"), text.token_count(F.col("body"), *text.TOKENS_IN).alias("tokens_in"), text.token_count(F.col("body"), *text.TOKENS_OUT).alias("tokens_out"))


SQL_STEP = "(p.state = 'new' AND e.goal = 'running') OR (p.state = 'running' AND e.goal IN ('ready', 'failed')) OR (p.state = 'failed' AND e.goal = 'running')"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' ELSE 'running' END AS goal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
p AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 'new' AS state, 0::BIGINT AS applied FROM e UNION ALL SELECT e.user_id, e.r, CASE WHEN {SQL_STEP} THEN e.goal ELSE p.state END, p.applied + CASE WHEN {SQL_STEP} THEN 1 ELSE 0 END FROM p JOIN e ON e.user_id = p.user_id AND e.r = p.r + 1)
SELECT user_id, arg_max(state, r) AS state, max(applied) AS applied FROM p GROUP BY user_id""")
def state_machine(spark, d):
    log = read(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ready").otherwise("running").alias("to"))
    return ops.transitions(log, "user_id", ["ts", "event_id"], {"new": ["running"], "running": ["ready", "failed"], "failed": ["running"], "ready": []}, "new")


@query("SELECT tag, max(priority) AS priority, min(added_at) AS added_at FROM (SELECT event_type AS tag, user_id % 11 AS priority, event_id AS added_at FROM events) GROUP BY tag ORDER BY 2 DESC, 3, 1 LIMIT 3")
def discovery_queue(spark, d):
    pending = read(spark, d, "events").select(F.col("event_type").alias("tag"), (F.col("user_id") % 11).alias("priority"), F.col("event_id").alias("added_at"))
    return discovery.next_tags(pending, 3)


@query(f"SELECT DISTINCT user_id, 't' || (user_id % 40) AS tag, CASE WHEN user_id % 3 = 0 THEN 10 ELSE 0 END AS priority, {NOW}::BIGINT AS added_at FROM events WHERE user_id % 5 <> 0")
def discovery_enqueue(spark, d):
    u = F.col("user_id")
    users = read(spark, d, "events").select("user_id", tag(u % 40).alias("tag"), (u % 3 == 0).alias("first"))
    return discovery.enqueue(users.where(u % 5 == 0), users, NOW)


@query(f"""WITH {SQL_TAGS}, f AS (SELECT k, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 0 THEN k ELSE 0 END AS found, CASE WHEN k % 3 = 0 THEN k % 2 ELSE 0 END AS before FROM k),
a AS (SELECT *, CASE WHEN k IN (0, 7, 11) THEN 'drop' WHEN found IS NULL THEN 'error' WHEN found > 0 THEN 'cache' WHEN before + 1 >= 2 THEN 'evict' ELSE 'retry' END AS action FROM f)
SELECT 't' || k AS tag, action, CAST(CASE action WHEN 'retry' THEN before + 1 WHEN 'error' THEN before ELSE 0 END AS BIGINT) AS failures, action IN ('drop', 'cache', 'evict') AS cleared, CAST(CASE action WHEN 'cache' THEN found WHEN 'evict' THEN 0 ELSE -1 END AS BIGINT) AS feeds FROM a""")
def discovery_states(spark, d):
    k, rows = F.col("k"), tag_numbers(spark, d)
    found = rows.select(tag(k).alias("tag"), F.when(k % 4 == 3, None).when(k % 4 == 0, k).otherwise(0).alias("feeds"))
    return discovery.discover(rows.select(tag(k).alias("tag")), curated_tags(spark), found, rows.where(k % 3 == 0).select(tag(k).alias("tag"), (k % 2).alias("failures"))).fillna(-1, ["feeds"])


@query(sql("SELECT 'feed' AS kind, source_name, url FROM articles WHERE CAST(id AS BIGINT) % 3 <> 0 AND source_name NOT IN (SELECT min(source_name) FROM articles) UNION ALL SELECT 'requeue', min(source_name), NULL FROM articles", "articles"))
def feed_eviction(spark, d):
    a = T.articles(spark, d)
    least = a.agg(F.min("source_name").alias("least"))
    gone = a.join(F.broadcast(least), a["source_name"] == F.col("least"), "left").where((F.col("id").cast("long") % 3 == 0) | F.col("least").isNotNull()).select("url")
    left, again = discovery.evict_feeds(a.select(F.col("source_name").alias("tag"), "url"), gone)
    return left.select(F.lit("feed").alias("kind"), F.col("tag").alias("source_name"), "url").unionByName(again.select(F.lit("requeue").alias("kind"), F.col("tag").alias("source_name"), F.lit(None).cast("string").alias("url")))


@query(sql("SELECT DISTINCT tag, 'https://search.example.org/rss?q=' || tag AS url FROM user_tags WHERE tag NOT IN ('en', 't1')", "user_tags"))
def synthetic_sources(spark, d):
    curated = spark.createDataFrame([("en",), ("t1",)], "tag string")
    tags = T.user_tags(spark, d).select("tag").distinct().join(F.broadcast(curated), "tag", "left_anti")
    return tags.where(F.rlike("tag", F.lit("^[a-z0-9-]{2,32}$"))).select("tag", F.concat(F.lit("https://search.example.org/rss?q="), F.url_encode("tag")).alias("url"))


# ---- general relational coverage ----


@query("SELECT n_name, o_orderstatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def revenue_by_nation(spark, d):
    li, o, c, n = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderstatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT p_brand, p_partkey, qty FROM (SELECT p_brand, p_partkey, sum(l_quantity) AS qty, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, p_partkey) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey) WHERE r <= 3")
def top_parts(spark, d):
    q = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("qty"), "p_partkey"))
    return q.withColumn("r", r).where("r <= 3").select("p_brand", "p_partkey", "qty")


@query("SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS active, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS idle FROM customer GROUP BY 1")
def active_customers(spark, d):
    c, keys = read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    active, idle = c.join(keys, "c_custkey", "left_semi"), c.join(keys, "c_custkey", "left_anti")
    both = active.withColumn("a", F.lit(1)).unionByName(idle.withColumn("a", F.lit(0)))
    return both.groupBy("c_mktsegment").agg(F.count_if(F.col("a") == 1).alias("active"), F.count_if(F.col("a") == 0).alias("idle"))


# ---- streams ----


SQL_RUN = f"least(2, CAST(floor((epoch(ts) - {BASE}) / 864000) AS BIGINT))"


def third(ts="ts"):
    """Ten days a run, in order of time."""
    return F.least(F.lit(2), F.floor((F.unix_micros(ts) - BASE * 1_000_000) / 864_000_000_000)).cast("int")


@query("SELECT event_type, bucket, count(*) AS n FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 AS bucket FROM events) WHERE (bucket + 300) * 1000 <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000 GROUP BY ALL")
def stream_fixed_windows(spark, d):
    from ..streaming.jobs import fixed_windows, replay

    return replay(fixed_windows, spark, d, "event_type string, bucket long, n long", third(), 3)


@query("SELECT user_id, count(DISTINCT event_id % 50) AS chunks FROM events GROUP BY user_id")
def stream_ledger(spark, d):
    from ..streaming.jobs import ledger, replay

    twice = F.array(F.least(third(), F.lit(1)), F.lit(2))  # all is delivered again in the last run
    keys = replay(ledger, spark, d, "user_id long, chunk long", twice, 3)
    return keys.groupBy("user_id").agg(F.count("*").alias("chunks"))


@query(sql("SELECT id, CASE WHEN length(text) > length(title) THEN text ELSE title END AS best, CASE WHEN parts <> '' THEN parts END AS source_snippet FROM (SELECT id, text, title, array_to_string(list_filter([CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN title ELSE '' END, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN source_name ELSE '' END], lambda x: x <> ''), chr(10) || chr(10)) AS parts FROM articles)", "articles"))
def snippets(spark, d):
    n = F.col("id").cast("long")
    parts = F.array(F.when(n % 2 == 0, F.col("title")).otherwise(""), F.when(n % 3 == 0, F.col("source_name")), F.lit(""))
    return T.articles(spark, d).select("id", text.best_snippet(F.col("text"), F.col("title")).alias("best"), text.joined_snippets(parts).alias("source_snippet"))


@query("SELECT run, chunk, count(*) AS n, sha256(string_agg(CASE WHEN length(title) > 30 THEN title[1:30] || '…' ELSE title END, chr(10) ORDER BY doc_id)) AS prompt_sha FROM (SELECT doc_id // 100 AS run, doc_id % 100 // 25 AS chunk, doc_id, trim(string_split(text, chr(10))[1]) AS title FROM documents) GROUP BY ALL")
def chunk_prompts(spark, d):
    n, title = F.col("doc_id"), F.trim(F.split("text", "\n")[0])
    rows = read(spark, d, "documents").select(F.floor(n / 100).cast("long").alias("run"), F.floor(n % 100 / 25).cast("long").alias("chunk"), n.alias("seq"), title.alias("title"))
    return ingest.prompts(rows, 30).select("run", "chunk", "n", F.sha2("prompt", 256).alias("prompt_sha"))


@query(f"WITH {SQL_TAGS} SELECT 't' || k AS tag, unnest(['a', 'c']) AS name, unnest(['https://a/' || k, 'https://c']) AS url, unnest(['rss', 'json']) AS kind FROM k WHERE k % 5 = 0 AND k NOT IN (0, 7, 11)")
def cached_sources(spark, d):
    return discovery.cached_sources(source_cache(spark, d), curated_tags(spark)).select("tag", "name", "url", "kind")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN contains('application/rss+xml', 'xml') WHEN page_id % 3 = 1 THEN contains('text/html', 'json') ELSE contains('application/feed+json', 'json') AND page_id % 2 = 0 END AS valid FROM pages")
def feed_validity(spark, d):
    n = F.col("page_id")
    kind = F.when(n % 3 == 0, "rss").otherwise("json")
    mime = F.when(n % 3 == 0, "application/rss+xml").when(n % 3 == 1, "text/html").otherwise("application/feed+json")
    items = F.from_json(F.when(n % 2 == 0, '[{"title": "t", "url": "u"}]').otherwise('[{"title": "", "url": "u"}]'), "array<struct<title: string, url: string>>")
    fits = F.when(kind == "json", F.contains(mime, F.lit("json"))).otherwise(F.contains(mime, F.lit("xml")) | F.contains(mime, F.lit("rss")))
    return read(spark, d, "pages").select("page_id", (fits & ((kind != "json") | F.exists(items, lambda i: (F.trim(i["title"]) != "") & (F.trim(i["url"]) != "")))).alias("valid"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-06-01' OR (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-06-01'))")
def token_purge(spark, d):
    import datetime

    tokens = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("expires_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    return ops.purge_tokens(tokens, datetime.datetime(1996, 6, 1), datetime.datetime(1997, 6, 1)).select("o_orderkey")


@query(sql("SELECT user_id, lpad(CAST(n AS VARCHAR), 4, ' ') || '  ' || tag AS line FROM (SELECT u.user_id, u.tag, count(a.article_id) AS n FROM user_tags u LEFT JOIN article_tags a ON a.tag = u.tag GROUP BY ALL)", "user_tags", "article_tags"))
def email_tallies(spark, d):
    counts = T.article_tags(spark, d).groupBy("tag").agg(F.count("*").alias("n"))
    rows = T.user_tags(spark, d).join(counts, "tag", "left")
    return rows.select("user_id", F.concat(F.lpad(F.coalesce("n", F.lit(0)).cast("string"), 4, " "), F.lit("  "), "tag").alias("line"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'failed' ELSE 'embedded' END AS status, vec_id % 10 <> 0 AS stored FROM embeddings")
def vector_upsert(spark, d):
    ok = F.col("vec_id") % 10 != 0
    return read(spark, d, "embeddings").select("vec_id", F.when(ok, "embedded").otherwise("failed").alias("status"), F.when(ok, F.col("embedding")).isNotNull().alias("stored"))


@query(f"""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 10 = 0 THEN 3 ELSE {SQL_RUN} END AS run FROM events)
SELECT event_id FROM e WHERE run < 3 OR epoch_us(ts) > ((SELECT epoch_ms(max(ts)) FROM e WHERE run < 3) - 172800000) * 1000""")
def stream_admission(spark, d):
    from ..streaming.jobs import admitted, replay

    late = F.col("event_id") % 10 == 0  # a tenth comes last, most of it too late; then all of the third run comes again
    runs = F.when(late, F.array(F.lit(3))).when(third() == 2, F.array(F.lit(2), F.lit(4))).otherwise(F.array(third()))
    return replay(lambda s: admitted(s).select("event_id"), spark, d, "event_id long", runs, 5)


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type IN ('error', 'view') AS f FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER w > 172800, false) AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(CASE WHEN NOT f OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g)
SELECT user_id, event_id, CASE WHEN f THEN CAST(sum(CAST(f AS INT)) OVER (PARTITION BY user_id, island ORDER BY t, event_id) AS BIGINT) ELSE 0 END AS streak, streak >= 4 AS evicted FROM i""")
def stream_failures(spark, d):
    from ..streaming.jobs import replay, streaks

    bad = F.col("event_type").isin("error", "view")
    return replay(lambda s: streaks(s, bad, 172_800, 4), ship(spark), d, "user_id long, event_id long, streak long, evicted boolean", third(), 3)


@query(sql("SELECT DISTINCT u.tag FROM user_tags u WHERE u.tag NOT IN ('en', 'de') AND u.tag NOT IN (SELECT 't' || (user_id % 3) FROM events)", "user_tags"))
def tags_needing_discovery(spark, d):
    curated = F.broadcast(spark.createDataFrame([("en",), ("de",)], "tag string"))
    cached = read(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tag")).distinct()
    return T.user_tags(spark, d).select("tag").distinct().join(curated, "tag", "left_anti").join(cached, "tag", "left_anti")


@query("SELECT user_id, array_to_string(list_filter(['purchase', 'view', 'click'], lambda t: list_contains(l, t)), ',') AS tags FROM (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY user_id)")
def tag_allowlist(spark, d):
    said = F.array(*[F.lit(t) for t in ("#Purchase", " VIEW", "click", "view", "#click", "#")])
    g = read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("allowed"))
    return g.select("user_id", F.array_join(text.allowed_tags(said, F.col("allowed")), ",").alias("tags"))


@query("SELECT run, count(*) FILTER (chunk < 40) AS kept, count(*) FILTER (chunk >= 40) AS dropped FROM (SELECT doc_id // 100 AS run, doc_id % 100 // 2 AS chunk FROM documents) GROUP BY run")
def chunk_cap(spark, d):
    n = F.col("doc_id")
    rows = read(spark, d, "documents").select(F.floor(n / 100).cast("long").alias("run"), F.floor(n % 100 / 2).cast("long").alias("chunk"), "doc_id")
    kept, dropped = ingest.cap_chunks(rows, 40)
    return kept.groupBy("run").agg(F.count("*").alias("kept")).join(dropped, "run", "full_outer").select("run", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


@query(sql("SELECT id FROM articles ORDER BY ingested_at DESC, published_at DESC, id LIMIT 250", "articles"))
def finalize_candidates(spark, d):
    return feed.newest(T.articles(spark, d), 250).select("id")


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029') AS json FROM documents")
def json_escaped(spark, d):
    return read(spark, d, "documents").select("doc_id", text.json_ld(F.col("text")).alias("json"))


@query(f"WITH {SQL_PAIRS} SELECT self, match FROM c WHERE (auto OR borderline) AND match IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def live_matches(spark, d):
    live = read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("match"))
    return banded(spark, d).where(F.col("auto") | F.col("borderline")).join(live, "match", "left_semi").select("self", "match")


@query(sql("SELECT tag AS name, 'curated' AS kind FROM (VALUES ('en'), ('de')) v(tag) UNION ALL SELECT DISTINCT event_type, 'discovered' FROM events UNION ALL SELECT DISTINCT tag, 'synthetic' FROM user_tags WHERE tag NOT IN ('en', 'de')", "user_tags"))
def all_sources(spark, d):
    curated = spark.createDataFrame([("en",), ("de",)], "name string")
    found = read(spark, d, "events").select(F.col("event_type").alias("name")).distinct().join(curated, "name", "left_anti")
    rest = T.user_tags(spark, d).select(F.col("tag").alias("name")).distinct().join(curated, "name", "left_anti")
    kinds = ((curated, "curated"), (found, "discovered"), (rest, "synthetic"))
    a, b, c = (df.withColumn("kind", F.lit(k)) for df, k in kinds)
    return a.unionByName(b).unionByName(c)


@query(f"SELECT user_id, tz, CASE WHEN starts_with(tz, 'America/') THEN 'en-US' ELSE 'en-GB' END AS locale FROM (SELECT DISTINCT user_id, ([{quoted(T.ZONES)}])[user_id % 3 + 1] AS tz FROM events)")
def locales(spark, d):
    return T.users(spark, d).select("user_id", "tz", timez.locale(F.col("tz")).alias("locale"))


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-01-01', 100)), p AS (SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-01-01', 100) ORDER BY ALL LIMIT 25)
SELECT (SELECT count(*) FROM p) AS scanned, (SELECT max((o_orderdate, o_orderkey))[2] FROM p) AS last_key, (SELECT count(*) FROM o) - (SELECT count(*) FROM p) AS remaining, (SELECT count(*) FROM o) = (SELECT count(*) FROM p) AS done""")
def sweep_state(spark, d):
    import datetime

    _, at = feed.sweep_page(read(spark, d, "orders").select("o_orderdate", "o_orderkey"), ("o_orderdate", "o_orderkey"), (datetime.datetime(1995, 1, 1), 100))
    return spark.createDataFrame([(at["scanned"], at["cursor"][1] if at["cursor"] else None, at["remaining"], at["done"])], "scanned long, last_key long, remaining long, done boolean")


@query(f"SELECT DISTINCT 't' || (user_id % 40) AS tag FROM events WHERE user_id = {USER}")
def discovery_waiting(spark, d):
    u = F.col("user_id")
    return discovery.waiting(read(spark, d, "events").select("user_id", tag(u % 40).alias("tag")).distinct(), USER)


@query(sql(f"SELECT user_id, article_id, read_at FROM reads UNION ALL SELECT {USER}, '00000007', {NOW} WHERE NOT EXISTS (SELECT 1 FROM reads WHERE user_id = {USER} AND article_id = '00000007')", "reads"))
def article_read(spark, d):
    return feed.article(T.articles(spark, d), T.reads(spark, d), "00000007", USER, NOW)[1]


@query(sql(f"SELECT user_id, article_id FROM stars WHERE NOT (user_id = {USER} AND article_id = (SELECT min(article_id) FROM stars WHERE user_id = {USER}))", "stars"))
def unstarred(spark, d):
    stars = T.stars(spark, d)
    first = stars.where(F.col("user_id") == USER).agg(F.min("article_id")).first()[0]
    return feed.unstar(stars, USER, first or "").select("user_id", "article_id")


@query(sql(f"SELECT user_id, tag FROM user_tags WHERE user_id NOT IN ({USER}, 5) UNION ALL SELECT {USER}, unnest(['ai', 'cloud'])", "user_tags"))
def tags_restored(spark, d):
    return feed.set_tags(feed.set_tags(T.user_tags(spark, d), USER, ["ai", "cloud", "ai"]), 5, [])
