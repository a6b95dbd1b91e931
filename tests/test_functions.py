import pytest
from pyspark.sql import functions as F

from feedloom.functions import ids, text, timez, urls
from feedloom.operators import dedup
from feedloom.sources import feeds


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_url(spark):
    cases = {
        "http://EXAMPLE.com/a/": "https://example.com/a",
        "https://e.com/": "https://e.com",
        "https://e.com/?utm_source=x": "https://e.com",
        "https://e.com/p?a=1&UTM_Medium=z&b=2": "https://e.com/p?a=1&b=2",
        "https://e.com/p/?q=1": "https://e.com/p?q=1",
        "https://e.com/p?ref=1#frag": "https://e.com/p#frag",
        "http://e.com:80/x": "https://e.com/x",
        "https://e.com:8443/x": "https://e.com:8443/x",
        "https://e.com/#top": "https://e.com/#top",
        "mailto:a@b.c": "mailto:a@b.c",
        "not a url": "not a url",
        "https://e.com/p?refx=1": "https://e.com/p?refx=1",
    }
    got = values(spark, urls.canonical_url, list(cases))
    assert got == list(cases.values())
    assert values(spark, urls.canonical_url, got) == got  # idempotent


def test_domains_and_vendors(spark):
    cases = {"a.b.example.com": "example.com", "x.co.uk": "x.co.uk", "www.x.co.uk": "x.co.uk", "10.0.0.1": "10.0.0.1", "localhost": "localhost", "WWW.E.ORG": "e.org", "[::1]": "[::1]", "": ""}
    assert values(spark, urls.registrable_domain, list(cases)) == list(cases.values())
    pairs = [("https://a.e.com/1", "http://b.e.com", True), ("https://news.google.com/x", "https://news.google.com/y", False), ("bad", "bad", False), ("https://e.com:99/", "https://e.com/", False)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, w boolean")
    assert [r.y == r.w for r in df.select("w", urls.same_vendor(F.col("a"), F.col("b")).alias("y")).collect()] == [True] * 4


def test_public_urls(spark):
    bad = ["http://e.com", "https://localhost/x", "https://10.1.2.3/", "https://192.168.0.1/", "https://172.16.0.1/", "https://100.64.0.1/", "https://169.254.169.254/", "https://metadata.x/", "https://u@e.com/", "https://[::1]/", "https://[fd00::1]/", "https://[::ffff:10.0.0.1]/", "https://[::ffff:172.31.0.1]/", "https://[::ffff:100.64.0.1]/", None]
    good = ["https://[::ffff:172.32.0.1]/", "https://[::ffff:8.8.8.8]/", "https://[2001:db8::1]/", "https://e.com", "https://172.32.0.1/", "https://8.8.8.8/x", "https://100.128.0.1/"]
    assert values(spark, urls.is_public_url, bad + good) == [False] * len(bad) + [True] * len(good)


def test_costs(spark):
    cases = {None: "—", float("nan"): "—", 0.0: "$0.00", 0.003: "$0.0030", 1234.5: "$1230.00", 0.145: "$0.14", 0.1449: "$0.14", 0.125: "$0.13", 0.015: "$0.01", 0.00015: "$0.0001", 0.00995: "$0.01", 0.0099: "$0.0099", 0.00001: "$0.0000", 0.9999: "$1.00", 99.95: "$100.00", -3.21: "$3.20"}
    assert values(spark, lambda c: text.cost_text(c.cast("double")), list(cases)) == list(cases.values())


def test_replies(spark):
    cases = {'{"response": "a"}': "a", '{"response": {"k": 1}}': '{"k":1}', '{"response": 1, "choices": [{"message": {"content": "c"}}]}': "c", '{"response": null, "choices": []}': None, '{"choices": [{"message": {"content": null}}]}': None, "x": None}
    assert values(spark, text.response_payload, list(cases)) == list(cases.values())
    counts = ['{"usage": {"input_tokens": 3, "prompt_tokens": 4}}', '{"usage": {"input_tokens": "3", "prompt_tokens": 4}}', '{"usage": null, "tokens_in": 5}', "{}", None]
    assert values(spark, lambda c: text.token_count(c, *text.TOKENS_IN), counts) == [3, 4, 5, 0, 0]


def test_shared_words(spark):
    cases = [(["alpha", "bravo"], ["bravo", "delta"], True), (["alpha", "bravo"], ["delta", "echo"], False), (["alpha"], ["delta", "echo"], True), ([], [], True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<string>, b array<string>, w boolean")
    assert all(r.w == r.y for r in df.select("w", text.share_token(F.col("a"), F.col("b")).alias("y")).collect())


def test_blocklists(spark):
    assert values(spark, urls.blocked_host, ["https://www.msn.com/a", "https://xmsn.com", "https://fool.com"]) == [True, False, True]
    assert values(spark, urls.blocked_name, ["The Motley-Fool", "Barron's", "msnbc", None, "CNBC TV"]) == [True, True, False, False, True]


def test_text(spark):
    assert values(spark, text.slug, ["Hello,  World!", "--a--", "x" * 59 + " y z", "É"]) == ["hello-world", "a", "x" * 59, ""]
    assert values(spark, text.decode_entities, ["&lt;b&gt; &#65;&#x42; &#5; &#70000; &amp;lt; &#8217;", "&#99999999999;|&#x1F600;"]) == ["<b> AB     &lt; ’", " | "]
    assert values(spark, text.html_text, ["<p>a&nbsp;&amp;<br>b  c</p>"]) == ["a & b c"]
    assert values(spark, text.title_tokens, ["The new Model model releases with GPUs"]) == [["model", "releases", "gpus"]]
    assert values(spark, text.paragraphs, ["a\\nb\n\n c \r\n"]) == [["a", "b", "c"]]
    assert values(spark, text.sanitize, ["<b>x</b>\x00\x85y", None]) == ["x y", ""]
    assert values(spark, text.hashtag, ["#AI-Tools!", "##x"]) == ["ai-tools", "x"]
    assert values(spark, text.redact_error, ["x Bearer abc.def at /usr/lib/x " + "a" * 40 + " https://u:p@h/"]) == ["x Bearer <redacted> at <path> <redacted-hex> https://<redacted>@h/"]


def test_json(spark):
    got = values(spark, text.json_strings, [None, "", "nope", '["a", 1, null, "b\\"c", ["d"], {"e": "f"}]', '{"a": "b"}', "[]"])
    assert got == [[], [], [], ["a", 'b"c'], [], []]
    answers = ['```json\n{"a": {"b": "}"}}\n```', 'sure: {"a": "\\"}"} tail', "none {", '{"a": 1}{"b": 2}']
    assert values(spark, text.llm_json, answers) == ['{"a": {"b": "}"}}', '{"a": "\\"}"}', None, '{"a": 1}']


def test_article_text(spark):
    pages = ["<body><nav>menu</nav><article>short</article><div class='post-body x'>a much longer text</div><script>var a='</p>';</script></body>", "no body at all"]
    got = values(spark, text.article_text, pages)
    assert got == ["short a much longer text", "no body at all"]


@pytest.mark.parametrize(
    "unix, tz, date, midnight",
    [(1711846800, "Europe/Zurich", "2024-03-31", 1711839600), (1711846800, "UTC", "2024-03-31", 1711843200), (1710054000, "America/New_York", "2024-03-10", 1710046800), (0, "America/New_York", "1969-12-31", -68400)],
)
def test_zones(spark, unix, tz, date, midnight):
    r = spark.range(1).select(timez.local_date(F.lit(unix), tz).alias("d"), timez.local_midnight(F.lit(unix), tz).alias("m")).first()
    assert (r.d, r.m) == (date, midnight)


def test_times(spark):
    assert values(spark, timez.next_tick, [0, 14399, 14400], "long") == [14400, 14400, 28800]
    assert values(spark, timez.countdown, [0, 1, 3599, 3600, 3661, -5], "long") == ["0m", "1m", "1h 0m", "1h 0m", "1h 2m", "0m"]
    assert values(spark, lambda c: feeds.parse_date(c, 1_800_000_000), ["Mon, 01 Jan 2024 00:00:00 +0000", "2024-01-01T00:00:00Z", "1999-12-31T23:59:59Z", "2100-01-01T00:00:00Z", "soon", None]) == [1704067200, 1704067200, None, None, None, None]


def test_ulids(spark):
    df = spark.createDataFrame([(1704067200123, 5)], "ms long, n long")
    r = df.select(ids.ulid(F.col("ms"), F.col("n")).alias("u")).first().u
    assert len(r) == 26 and values(spark, ids.ulid_time, [r, r.lower(), "x"]) == [1704067200123, 0, 0]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(dedup.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_feed_edges(spark):
    bodies = ["<rss><channel><item><title>a</title><link>https://x/1</link><description>" + "word " * 10 + "</description></item><item><title></title><link>y</link></item></channel></rss>", "not xml", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "k int, body string")
    got = feeds.read_rss(df, "body", 1_800_000_000).collect()
    assert [(r.k, r.title, r.url, r.snippet) for r in got] == [(0, "a", "https://x/1", ("word " * 10).strip())]
    many = "<rss><channel>" + "<item><title>a</title><link>https://x/1</link></item>" * 25 + "</channel></rss>"
    assert feeds.read_rss(spark.createDataFrame([(many,)], "body string"), "body", 1 << 33).count() == 20
    item = "<rss><channel><item><title>a</title><link>{}</link><source url='{}'>P</source></item></channel></rss>"
    links = [("https://news.google.com/x", "https://p.org/1", "https://p.org/1"), ("https://news.google.com/x", "ftp://p.org/1", "https://news.google.com/x"), ("https://pod.org/x", "https://p.org/1", "https://pod.org/x")]
    df = spark.createDataFrame([(i, item.format(a, b), c) for i, (a, b, c) in enumerate(links)], "k int, body string, want string")
    assert [(r.url, r.item_source) for r in feeds.read_rss(df, "body", 1 << 33).orderBy("k").collect()] == [(c, "P") for _, _, c in links]
    entry = "<feed><entry><title>t</title><link rel='self' href='https://s'/><link href='https://alt'/></entry></feed>"
    assert [r.url for r in feeds.read_atom(spark.createDataFrame([(entry,)], "body string"), "body", 1 << 33).collect()] == ["https://alt"]
    assert feeds.read_json_feed(spark.createDataFrame([("{}",), ("x",), (None,)], "body string"), "body", 1 << 33).count() == 0
