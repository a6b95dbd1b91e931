"""Text functions: columns in, columns out, all inside whole-stage codegen but where said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title words that carry no topic. Fixed values.
TITLE_STOPWORDS = [
    "the", "that", "this", "with", "from", "into", "over", "your", "their",
    "have", "will", "been", "were", "what", "when", "about", "after",
    "announce", "announces", "announced", "release", "released", "launches",
    "launch", "update", "updates", "updated", "says", "said", "introduces",
    "introduced", "adds", "added", "gets", "gains", "makes", "made",
    "using", "uses", "based", "new", "via", "now", "for", "and",
]
#: Named entities and what they stand for, ``&amp;`` apart, which is decoded last. Fixed values.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&hellip;", "…"),
]
#: White space as JavaScript's \s and trim() know it. Fixed values.
SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Elements that never hold an article's text, and class names of containers that do. Fixed values.
BOILERPLATE = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg"]
CONTAINERS = [
    "post-content", "post-body", "post-entry", "post-full-content", "entry-content", "article-body", "article-content",
    "article__content", "gh-content", "markdown-body", "prose", "rich-text", "page-content", "story-body", "story__content",
    "post__content", "content-body", "content__body", "story-content", "mw-parser-output", "notion-page-content",
    "rst-content", "blogpost", "blog-post",
]


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def slug(title: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut at ``most`` characters, no hyphen at the ends."""
    strip = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return strip(F.substring(strip(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")), 1, most))


def title_tokens(title: Column) -> Column:
    """Distinct words of at least four letters or digits that are no stop words, in order of first sight."""
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    return F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)))


def share_token(a: Column, b: Column) -> Column:
    """Whether two token arrays meet; true if either has fewer than two."""
    return (F.size(a) < 2) | (F.size(b) < 2) | F.arrays_overlap(a, b)


def decode_entities(text: Column) -> Column:
    """Named entities, then decimal and hexadecimal ones (outside 32 to 65535: a space), ``&amp;`` last."""
    out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    for mark, digits, base in (("", "[0-9]+", 10), ("x", "[0-9a-fA-F]+", 16)):
        pattern = f"&#{mark}({digits});"
        before, found = F.split(out, pattern, -1), F.regexp_extract_all(out, F.lit(pattern), F.lit(1))
        code = lambda c, base=base: F.conv(F.right(F.concat(F.lit("0"), F.when(F.length(F.regexp_replace(c, "^0+", "")) > 6, F.lit("0")).otherwise(c)), F.lit(8)), base, 10).cast("int")
        char = _char(code)
        glued = F.array_join(F.transform(F.arrays_zip(before.alias("a"), found.alias("b")), lambda x: F.concat(x["a"], F.coalesce(char(x["b"]), F.lit("")))), "")
        out = F.when(F.contains(out, F.lit(f"&#{mark}")), glued).otherwise(out)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _char(code):
    def of(digits: Column) -> Column:
        n = code(digits)
        unit = F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
        return F.when(digits.isNull(), None).when((n >= 32) & (n < 65536), unit).otherwise(" ")

    return of


def html_text(html: Column, most: int | None = None) -> Column:
    """Tags as spaces, entities decoded, white space squeezed, cut at ``most`` characters."""
    out = squeeze(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))
    return F.substring(out, 1, most) if most else out


def article_text(html: Column, most: int = 15_000) -> Column:
    """The longest text among a page's article, main, content-class and body elements, boilerplate elements dropped; the
    earliest of equally long ones."""
    clean = F.regexp_replace(html, f"(?is)<({'|'.join(BOILERPLATE)})\\b.*?</\\1\\b[^>]*>", " ")
    classes = "|".join(CONTAINERS)
    # fixed values
    patterns = ["(?is)<article[^>]*>(.*?)</article>", "(?is)<main[^>]*>(.*?)</main>", f"(?is)<(?:div|section)[^>]*(?:class|id)=[\"'][^\"']*(?:{classes})[^\"']*[\"'][^>]*>(.*?)</(?:div|section)>"]
    body = F.regexp_extract(clean, "(?is)<body[^>]*>(.*?)</body>", 1)
    found = F.concat(*[F.regexp_extract_all(clean, F.lit(p), F.lit(1)) for p in patterns], F.array(F.when(F.rlike(clean, F.lit("(?is)<body[^>]*>.*?</body>")), body).otherwise(clean)))
    texts = F.transform(found, lambda x: html_text(x))
    best = F.aggregate(texts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.substring(best, 1, most)


def sanitize(text: Column) -> Column:
    """Model output as one clean line: tags and control characters as spaces, squeezed; null as empty."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), "[\\x00-\\x1f\\x7f-\\x9f]", " "))


def paragraphs(text: Column) -> Column:
    """Non-empty trimmed lines; a literal backslash-n ends a line too."""
    lines = F.split(F.replace(text, F.lit("\\n"), F.lit("\n")), "\r?\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")


def json_strings(text: Column) -> Column:
    """The strings of a JSON array, others dropped; an empty array for anything else."""
    items = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    # numbers and the like come out as strings there, so elements are told apart by their quotes
    quoted = F.regexp_extract_all(F.regexp_replace(text, "^\\s*\\[|\\]\\s*$", ""), F.lit('(?:^|,)\\s*("(?:[^"\\\\]|\\\\.)*"|[^",\\[\\]{}]+|[\\[{].*?[\\]}])\\s*(?=,|$)'), F.lit(1))
    strings = F.filter(quoted, lambda x: F.startswith(x, F.lit('"')))
    parsed = F.transform(strings, lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"))
    return F.when(items.isNull() | ~F.rlike(F.coalesce(text, F.lit("")), F.lit("^\\s*\\[")), F.array().cast("array<string>")).otherwise(parsed)


def hashtag(raw: Column) -> Column:
    """Lower case, one leading # dropped, then all but letters, digits and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "^#", ""), "[^a-z0-9-]", "")


def valid_hashtags(tags: Column, most: int = 25) -> Column:
    """Normalised tags in order without repeats; null if any is malformed or the number is not 1 to ``most``."""
    out = F.array_distinct(F.transform(tags, hashtag))
    ok = F.forall(out, lambda t: F.rlike(t, F.lit("^[a-z0-9-]{2,32}$"))) & F.size(out).between(1, most)
    return F.when(F.coalesce(ok, F.lit(False)), out)


def embedding_input(title: Column, snippet: Column, details: Column, summary: Column, most: int = 1800) -> Column:
    """Title and the first body there is: snippet, joined details (an array), summary; squeezed and cut."""
    joined = F.when(F.size(details) > 0, F.array_join(details, " "))
    body = F.coalesce(F.nullif(snippet, F.lit("")), joined, summary, F.lit(""))
    return F.substring(squeeze(F.concat(F.trim(title), F.lit("\n\n"), body)), 1, most)


def escape_html(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), pairs, text)


def prompt_field(text: Column, most: int) -> Column:
    """Backtick fences neutralised, cut at ``most`` with an ellipsis."""
    clean = F.regexp_replace(text, "`{3,}", "[code-block]")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def redact_error(text: Column, most: int = 500) -> Column:
    """Stack frames, bearer tokens, long hex, URL credentials and file paths out of an error message."""
    steps = [  # fixed values
        ("(?m)^\\s*at\\s.+$", ""), ("(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer <redacted>"), ("\\b[0-9a-fA-F]{40,}\\b", "<redacted-hex>"),
        ("(?i)\\b([a-z][a-z0-9+.-]*://)[^\\s/@]+@", "$1<redacted>@"), ("(?:^|\\s)(?:(?:/[^\\s/:]+){2,}|[A-Za-z]:\\\\[^\\s]+)", " <path>"),
    ]
    return F.substring(squeeze(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)), 1, most)


def llm_json(text: Column) -> Column:
    """The first balanced JSON object of a model's answer, fences and preamble dropped; null if there is none. The scan keeps
    (depth, in string, escaped, start, end) in a fold over the characters."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)^\\s*```[a-zA-Z]*\\s*", ""), "(?s)\\s*```\\s*$", "")
    chars = F.split(bare, "")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("a"), F.lit(0).alias("z"))

    def step(s: Column, ch: Column) -> Column:
        inside, done, i = s["depth"] > 0, s["z"] > 0, s["i"] + 1
        opens = (ch == "{") & ~s["quoted"] & ~done
        closes = (ch == "}") & ~s["quoted"] & inside & ~done
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        quote = (ch == '"') & ~s["escaped"] & inside
        return F.struct(
            i.alias("i"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), ((ch == "\\") & s["quoted"] & ~s["escaped"]).alias("escaped"),
            F.when(opens & (s["a"] == 0), i).otherwise(s["a"]).alias("a"), F.when(closes & (depth == 0), i).otherwise(s["z"]).alias("z"),
        )

    got = F.aggregate(chars, zero, step)
    return F.when(got["z"] > 0, F.substr(bare, got["a"], got["z"] - got["a"] + 1))


def cost_text(value: Column) -> Column:
    """An amount in dollars: a dash for none, three significant digits (two under a cent, and for negatives, whose sign is
    dropped) as two decimals, or as four where less than a cent is left. Decimals are rounded by the number's exact binary
    value, significant digits by its shortest decimal form."""
    size = F.abs(value)
    kept = F.when(value < 0.01, F.format_string("%.1e", size)).otherwise(F.format_string("%.2e", size)).cast("double")

    def fixed(places: int, shift: int) -> Column:
        # kept * 2^shift is a whole number; with it, round half up in whole numbers, by halves of 30 bits
        whole = (kept * float(1 << shift)).cast("long")
        high, low = F.shiftright(whole, 30), whole.bitwiseAND(F.lit((1 << 30) - 1).cast("long"))
        twice = F.lit(2 * 10**places).cast("long")
        units = F.shiftright(twice * high + F.lit(1 << (shift - 30)).cast("long") + F.shiftright(twice * low, 30), shift - 29)
        return F.concat(F.floor(units / 10**places).cast("string"), F.lit("."), F.lpad((units % 10**places).cast("string"), places, "0"))

    text = F.when(kept < 0.01, fixed(4, 68)).when(kept < 1, fixed(2, 60)).otherwise(F.format_string("%.2f", kept))
    return F.when(value.isNull() | F.isnan(value) | (size == float("inf")), "—").when(value == 0, "$0.00").otherwise(F.concat(F.lit("$"), text))


def _typed(body: Column, path: str, kinds: str) -> Column:
    """What stands at a path of JSON text if its type is one of ``kinds`` (a pattern); strings bare, the rest as JSON."""
    v = F.try_variant_get(F.try_parse_json(body), path, "variant")
    return F.when(F.rlike(F.schema_of_variant(v), F.lit(f"^({kinds})")), F.try_variant_get(F.try_parse_json(body), path, "string"))


def response_payload(body: Column) -> Column:
    """What a model's reply (JSON text) holds: a string, object or array under response, else such a content of the first choice's
    message; null for any other shape."""
    kinds = "STRING|OBJECT|ARRAY"
    return F.coalesce(_typed(body, "$.response", kinds), _typed(body, "$.choices[0].message.content", kinds))


def token_count(body: Column, *paths: str) -> Column:
    """The first of the paths of a reply that holds a number, 0 if none does."""
    return F.coalesce(*[_typed(body, p, "BIGINT|DECIMAL|DOUBLE|FLOAT").cast("double").cast("long") for p in paths], F.lit(0).cast("long"))


#: Where replies of different makers have their counts. Fixed values.
TOKENS_IN = ["$.usage.input_tokens", "$.usage.prompt_tokens", "$.tokens_in"]
TOKENS_OUT = ["$.usage.output_tokens", "$.usage.completion_tokens", "$.tokens_out"]


def json_ld(text: Column) -> Column:
    """JSON that may stand in a script element: < > & and the two line separators as escapes."""
    pairs = [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), pairs, text)


def chunk_cost(snippet: Column) -> Column:
    """Characters that an item is reckoned at in a prompt: its snippet's length if that is 400 or more, else 3000, and 400 for the rest."""
    n = F.length(F.coalesce(snippet, F.lit("")))
    return (F.when(n >= 400, n).otherwise(3000) + 400).cast("long")


def best_snippet(fetched: Column, feed: Column) -> Column:
    """The fetched text if it is longer than the feed's own, else that."""
    return F.when(F.length(fetched) > F.length(F.coalesce(feed, F.lit(""))), fetched).otherwise(feed)


def joined_snippets(parts: Column) -> Column:
    """The filled ones of an array of snippets, with a blank line between; null if there are none."""
    return F.nullif(F.array_join(F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False))), "\n\n"), F.lit(""))


def allowed_tags(tags: Column, allowed: Column) -> Column:
    """Normalised tags that are allowed (an array), in order of first sight."""
    return F.array_intersect(F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: hashtag(F.trim(t)))), F.filter(allowed, lambda a: a != ""))
