"""Removal of lines that many sites share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, stored

#: log2 of a sketch's registers; relative standard error 1.04 / sqrt(2 ** LG).
LG = 10


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines (site, hash, hash2) that at least ``min_sites`` distinct sites have, with their key. One sketch per
    line is merged by aggregation; where its estimate is within three standard errors (at least one site) of the threshold,
    the distinct sites are counted exactly, so sketches decide clear cases only. What the key filter lets through besides
    is counted exactly as well."""
    margin = max(1.0, 3 * 1.04 / 2 ** (LG / 2) * min_sites)
    sketched = lines.groupBy("hash", "hash2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG))).alias("sites"))
    likely = stored(sketched.where(F.col("sites") >= min_sites - margin), "likely")
    clear = likely.where(F.col("sites") > min_sites + margin).select("hash", "hash2")
    near = KeyFilter(likely.where(F.col("sites") <= min_sites + margin), "hash").mark(lines, F.col("hash")).where("__maybe")
    counted = near.select("hash", "hash2", "site").distinct().groupBy("hash", "hash2").agg(F.count("*").alias("sites"))
    return stored(clear.union(counted.where(F.col("sites") >= min_sites).select("hash", "hash2")).distinct(), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = 10, site: str = "source", counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the lines of ``text`` removed that at least ``min_sites`` distinct values of ``site`` share, plus two long
    columns named by ``counts``: lines, and lines removed (none with ``counts`` None). A column n_chars, if there is one,
    follows the text.

    Lines end at newlines and are compared without blanks around them; blank lines are never removed. Of each such
    line the first occurrence in the corpus (least doc_id, then text hash, then position; null doc_ids last) stays, so no
    text is lost and the first of a group of copies stays whole. Null texts stay null with no lines; a null site is the
    site with the empty name; rows that repeat are treated alike, as one document; columns of other names pass through
    (those named by ``counts`` are replaced); an empty table gives an empty result. Lines and texts are known by 128 bits of hash.
    The corpus is read three times. Line hashes are pre-aggregated; only hashes, and the lists of lines to drop, are
    joined, but for the texts that a bounded filter says may have such a list: those are shuffled once.
    """
    names = [c for c in docs.columns if c not in (counts or ())]
    text = F.col("text").cast("string")
    doc = {"doc_id": F.col("doc_id").cast("long"), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}
    base = docs.where("text is not null").select(*[c.alias(k) for k, c in doc.items()], F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), text.alias("text"))
    hashes = F.transform(F.split("text", "\n", -1), lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(F.trim(x)).alias("hash"), F.xxhash64(F.lit(1), F.trim(x)).alias("hash2"))))
    lines = base.select("site", F.explode(hashes).alias("h")).where("h is not null").select("site", "h.*")
    shared = boilerplate(lines, min_sites)
    placed = base.select("doc_id", "t1", "t2", F.posexplode(hashes).alias("pos", "h")).where("h is not null").select("doc_id", "t1", "t2", "pos", "h.*")
    hits = KeyFilter(shared, "hash").mark(placed, F.col("hash")).where("__maybe").drop("__maybe")
    hits = stored(hits.join(shared, ["hash", "hash2"]), "hits")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2", "pos")
    first = stored(hits.groupBy("hash", "hash2").agg(F.min(order).alias("keep")), "first")
    drops = hits.join(first, ["hash", "hash2"]).where(order != F.col("keep")).groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    drops = stored(drops.withColumn("key", F.xxhash64("doc_id", "t1")), "drops")
    rows = docs.withColumns({f"__{k}": c for k, c in doc.items()})
    rows = KeyFilter(drops).mark(rows, F.xxhash64("__doc_id", "__t1"))
    parts = F.split(text, "\n", -1)
    n_lines, n_removed = counts or ("__n", "__m")
    plain = rows.where("not __maybe").withColumns({n_lines: F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), n_removed: F.lit(0).cast("long")}).select(*names, n_lines, n_removed)
    # beyond the join: the lines stand in one array, and what stays are the slices between dropped positions
    drops = drops.select(*[F.col(k).alias(f"__d_{k}") for k in doc], F.concat(F.array(F.lit(-1)), "drops").alias("__from"), "drops")
    same = [F.col(f"__{k}").eqNullSafe(F.col(f"__d_{k}")) for k in doc]
    split = rows.where("__maybe").withColumn("__parts", parts).drop("text").join(drops.withColumnRenamed("drops", "__drops"), same, "left")
    span = F.arrays_zip(F.col("__from").alias("a"), F.concat("__drops", F.array(F.size("__parts"))).alias("z"))
    kept = F.flatten(F.transform(span, lambda s: F.slice("__parts", s["a"] + 2, s["z"] - s["a"] - 1)))
    kind = dict(docs.dtypes)
    fresh = {"text": F.array_join(F.when(F.col("__drops").isNull(), F.col("__parts")).otherwise(kept), "\n"), n_lines: F.size("__parts").cast("long"), n_removed: F.coalesce(F.size("__drops"), F.lit(0)).cast("long")}
    split = split.withColumns(fresh)
    if "n_chars" in names:
        split = split.withColumn("n_chars", F.when(F.col("__drops").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind["n_chars"])))
    out = plain.unionByName(split.select(*names, n_lines, n_removed))
    return out if counts else out.select(*names)


def oracle(min_sites: int = 10) -> str:
    """The digest of the query in DuckDB SQL, with exact counts."""
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS uid, doc_id, coalesce(source, '') AS site, text FROM documents),
l AS (SELECT uid, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {min_sites}),
f AS (SELECT trim(l.line) AS line, min((uid, pos)) AS keep FROM l JOIN b ON trim(l.line) = b.line GROUP BY 1),
x AS (SELECT l.*, f.keep IS NOT NULL AND f.keep <> (uid, pos) AS dropped FROM l LEFT JOIN f ON trim(l.line) = f.line)
SELECT d.doc_id, count(x.pos) AS n_lines, count(*) FILTER (x.dropped) AS n_removed,
  sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (NOT x.dropped), '')) AS text_sha256
FROM d LEFT JOIN x USING (uid) GROUP BY d.uid, d.doc_id
"""
