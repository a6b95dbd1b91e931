"""Secret scans over a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import KeyFilter, stored


@dataclass(frozen=True)
class Rule:
    """A regular expression of the subset that Java and Python read alike; matches whose ``group`` is shorter than ``least``
    characters are dropped. ``base`` rules make the digest that the query's contract fixes."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = True


#: The base rules, in the order of their kinds, then further ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the runs of [0-9a-f]+ that are long enough: runs end where the class ends
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, base=False),
)

GAP = "\0"


def _strings(tree, most: int = 64) -> list[str]:
    """Strings that between them cover all matches: each match has, for some string, all its pieces between gaps."""
    out = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            part = [chr(arg)]
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            part = [chr(v) for _, v in arg]
        elif op is C.SUBPATTERN:
            part = _strings(arg[3], most)
        elif op is C.BRANCH:
            part = [s for branch in arg[1] for s in _strings(branch, most)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            part = ["", *_strings(arg[2], most)] if arg[0] == 0 else _strings(arg[2], most)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            part = [s + GAP for s in _strings(arg[2], most)]
        else:
            part = [GAP]
        out = [a + b for a in out for b in part] if len(out) * len(part) <= most else [a + GAP for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean query of a pattern in disjunctive form: a text that matches has all trigrams (of its lower-cased form) of
    one of the sets. An empty list means that some match has no mandatory trigram: scan every text."""
    sets = set()
    for s in _strings(P.parse(pattern)):
        pieces = s.lower().split(GAP)
        sets.add(frozenset(p[i : i + 3] for p in pieces for i in range(len(p) - 2)))
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _present(rule: Rule, text: Column) -> Column:
    """Of the rule's matches in order: lengths of the gaps before (and after) them, their lengths, and whether they are good."""
    p = F.lit(rule.pattern)
    before, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    kept = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else hits
    return F.struct(F.transform(before, lambda x: F.length(x)).alias("gaps"), F.transform(hits, lambda x: F.length(x)).alias("sizes"), F.transform(kept, lambda x: F.length(x) >= rule.least).alias("good"))


def _listed(k: int, found: Column) -> Column:
    """The matches of rule k as an array of structs (kind, i, gap, size, good); null if there are none."""
    n = F.coalesce(F.size(found["sizes"]), F.lit(0))
    match = lambda i: F.struct(F.lit(k).alias("kind"), i.alias("i"), found["gaps"][i].alias("gap"), found["sizes"][i].alias("size"), found["good"][i].alias("good"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), match))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows (doc_id, __c0, __c1, ...): for each rule with mandatory trigrams whether the document's postings answer its query.

    The inverted index has a posting (trigram, doc_id) for each trigram that some query names and each text that
    has it; a query is answered by intersecting postings, as a fold of each document's trigrams into bit sets."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({t for q in queries for s in q for t in s})
    low = F.lower("text")
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(grams)]))
    postings = docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(has).alias("gram"))
    words = range(-(-len(grams) // 62))
    bit = F.expr("shiftleft(1L, gram % 62)")
    merged = postings.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words])

    def answered(query) -> Column:
        def all_of(s) -> Column:
            masks = [sum(1 << (i % 62) for i, t in enumerate(grams) if t in s and i // 62 == w) for w in words]
            return reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in enumerate(masks) if m])

        return reduce(lambda a, b: a | b, [all_of(s) for s in query])

    flags = {f"__c{k}": answered(q) for k, q in enumerate(queries) if q}
    return merged.select("doc_id", *[v.alias(k) for k, v in flags.items()]).where(reduce(lambda a, b: a | b, [F.col(k) for k in flags]))


def _routed(docs: DataFrame, rules) -> DataFrame:
    """``docs`` with the candidates' flags. A key filter of bounded size splits the texts; only those that it lets through are
    joined by doc_id, so the plan is the same at every size and the other texts are never shuffled."""
    found = stored(candidates(docs, rules).withColumn("__key", F.xxhash64("doc_id")).withColumnRenamed("doc_id", "__id"), "candidates")
    flags = [c for c in found.columns if c.startswith("__c")]
    marked = KeyFilter(found, "__key").mark(docs, F.xxhash64("doc_id"))
    hits = marked.where("__maybe").drop("__maybe").join(found.drop("__key"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return marked.where("not __maybe").drop("__maybe").withColumns({c: F.lit(False) for c in flags}).unionByName(hits)


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_<kind> of each base rule, base_sha256, spans.

    Every whole text is scanned, null as empty. A rule is tried on the texts that answer its trigram query, one without
    mandatory trigrams on all texts. Matches are leftmost and do not overlap within a kind; those that are too short
    are dropped after matching. Spans are kind:start:end in code points, by start, then by the rules' order;
    base_sha256 is the hash of the base rules' spans alone. Rows that repeat get equal results, rows that share a doc_id
    are scanned each by its own text; other columns are ignored; an empty table gives an empty result. Starts are summed
    by a window within a document, so that many matches in one text cost no more than their number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    routed = _routed(rows, rules)
    found = []
    for k, rule in enumerate(rules):
        fits = F.coalesce(F.col(f"__c{k}"), F.lit(False)) if trigram_query(rule.pattern) else F.rlike("text", F.lit(rule.pattern))
        found.append(F.when(fits, _present(rule, F.col("text"))).alias(f"r{k}"))
    seen = stored(routed.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *found), "matches")
    one = [_listed(k, F.col(f"r{k}")) for k in range(len(rules))]
    each = seen.select("uid", "doc_id", F.explode_outer(F.flatten(F.array_compact(F.array(*one)))).alias("m")).select("uid", "doc_id", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("uid", "kind").orderBy("i"))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", "kind", F.concat_ws(":", kinds[F.col("kind")], F.col("start"), F.col("end")).alias("text"))
    bases = [k for k, r in enumerate(rules) if r.base]
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["text"]), ",")
    out = each.groupBy("uid", "doc_id").agg(
        *[F.count_if(F.col("good") & (F.col("kind") == k)).alias(f"n_{rules[k].kind}") for k in bases],
        F.collect_list(F.when(F.col("good") & F.col("kind").isin(bases), span)).alias("base"),
        F.collect_list(F.when(F.col("good"), span)).alias("all"),
    )
    return out.select("doc_id", *[f"n_{rules[k].kind}" for k in bases], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each good match in ``text`` replaced by ``mark``, rule after rule; all else stays, null texts too.
    Only candidate texts are rewritten by rules that have mandatory trigrams."""
    names = docs.columns
    routed = _routed(docs, rules)
    text = F.col("text")
    for k, rule in enumerate(rules):
        p = F.lit(rule.pattern)
        before, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
        kept = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else hits
        glued = F.array_join(F.transform(F.arrays_zip(before.alias("a"), hits.alias("b"), kept.alias("c")), lambda x: F.concat(x["a"], F.when(F.length(x["c"]) >= rule.least, F.lit(mark)).otherwise(F.coalesce(x["b"], F.lit(""))))), "")
        fits = F.coalesce(F.col(f"__c{k}"), F.lit(False)) if trigram_query(rule.pattern) else F.rlike("text", F.lit(rule.pattern))
        routed = routed.withColumn("text", F.when(fits, glued).otherwise(F.col("text")))
    return routed.select(names)


def _sql_spans(k: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"SELECT uid, {k} AS kind, unnest(range(1, len(h) + 1)) AS i, unnest(list_transform(b[1:len(h)], lambda x: length(x))) AS gap, unnest(list_transform(h, lambda x: length(x))) AS size, unnest(list_transform(g, lambda x: length(x) >= {rule.least})) AS good FROM (SELECT uid, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {rule.group}) AS g, string_split_regex(t, '{p}') AS b FROM d)"


def oracle(rules=RULES) -> str:
    """The query in DuckDB SQL, without an index."""
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    base = ", ".join(str(k) for k, r in enumerate(rules) if r.base)
    counts = ", ".join(f"count(*) FILTER (good AND kind = {k}) AS n_{r.kind}" for k, r in enumerate(rules) if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(rules))}),
e AS (SELECT *, sum(gap + size) OVER (PARTITION BY uid, kind ORDER BY i) AS stop FROM m),
s AS (SELECT uid, kind, good, stop - size AS start, ([{kinds}])[kind + 1] || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM e)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (good AND kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (good), '') AS spans
FROM d LEFT JOIN s USING (uid) GROUP BY uid, doc_id
"""
