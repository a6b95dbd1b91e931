"""Vector near-duplicate pairs, their classification, ordered merges, and merge application."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import checkpointed, components


@dataclass(frozen=True)
class Bands:
    """Thresholds on cosine; out-of-range values fall back to the defaults."""

    threshold: float = 0.88
    penalty: float = 0.05
    floor: float = 0.70
    window: int = 604_800
    high: float = 0.92
    top_k: int = 20
    borderline: int = 5

    def __post_init__(self):
        default = type(self).__dataclass_fields__
        for name in ("threshold", "penalty", "floor", "high"):
            if not 0 <= getattr(self, name) <= 1:
                object.__setattr__(self, name, default[name].default)
        if self.window <= 0:
            object.__setattr__(self, "window", default["window"].default)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The vector at length one, in doubles; null for a zero vector."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm))


#: Most rows of a block: blocks meet in pairs, as one matrix product each.
BLOCK = 4096
FOUND = "self long, match long, self_at long, match_at long, score double"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, times, unit vectors (zero where there is none; short ones filled up) and their lengths."""
    vectors = table.column("u").combine_chunks()
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    x[np.arange(x.shape[1])[None, :] < sizes[:, None]] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
    return table.column("id").to_numpy(), table.column("published_at").to_numpy(), x, sizes


def _scores(left, right, step: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines of some rows of ``left`` at a time with all of ``right``; vectors of unlike length have none (0)."""
    (_, _, x, n), (_, _, y, m) = left, right
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
    for a in range(0, len(x), step):
        yield a, np.where(n[a : a + step, None] == m[None, :], x[a : a + step] @ y.T, 0.0)


def _found(rows: list) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0)] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.table({n: pa.array(c.astype(np.float64 if k == pa.float64() else np.int64), k) for n, c, k in zip(("self", "match", "self_at", "match_at", "score"), columns, kinds)})


def _sides(table: pa.Table):
    left = table.column("left").to_numpy(zero_copy_only=False)
    return _matrix(table.filter(pa.array(left))), _matrix(table.filter(pa.array(~left)))


def _within(window: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        within = table.column("d")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()  # a block and itself
        (ids, at, *_), (others, when, *_), rows = left, right, []
        for a, scores in _scores(left, right):
            ok = (scores >= least) & (np.abs(at[a : a + len(scores), None] - when[None, :]) <= window)
            i, j = np.nonzero(ok)
            keep = ids[a + i] != others[j]
            i, j = i[keep], j[keep]
            one = (ids[a + i], others[j], at[a + i], when[j])
            rows.append((*one, scores[i, j]))
            if not within:
                rows.append((one[1], one[0], one[3], one[2], scores[i, j]))
        return _found(rows)

    return run


def near_pairs(vectors: DataFrame, window: int, least: float = -1.0, rows: int = BLOCK) -> DataFrame:
    """Ordered pairs (self, match, self_at, match_at, score) of ``vectors`` (id, published_at, embedding) within ``window``
    seconds of each other and at a cosine of ``least`` or more.

    Rows are bucketed by time; a bucket meets itself and the next one, so each pair is looked at once. Buckets are cut into
    blocks of about ``rows`` rows, and two blocks meet as one matrix product, so no task gathers a dense window."""
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("published_at").cast("long").alias("published_at"), unit(F.col("embedding")).alias("u"))
    v = v.withColumn("b", F.floor(F.col("published_at") / max(window, 1)))
    cuts = v.groupBy("b").agg(F.ceil(F.count("*") / rows).cast("int").alias("cuts"))
    before, after = cuts.select((F.col("b") + 1).alias("b"), F.col("cuts").alias("before")), cuts.select((F.col("b") - 1).alias("b"), F.col("cuts").alias("after"))
    v = v.join(cuts.join(before, "b", "left").join(after, "b", "left"), "b").withColumn("i", F.pmod(F.hash("id"), F.col("cuts")))

    def cells(first: Column, last: Column, make) -> Column:
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: F.struct(*[c.alias(n) for c, n in zip(make(k), ("b", "d", "i", "j", "left"))]))).otherwise(F.array())

    b, i, zero, yes, no = F.col("b"), F.col("i"), F.lit(0), F.lit(True), F.lit(False)
    every = F.concat(
        cells(i, F.col("cuts") - 1, lambda k: (b, zero, i, k, yes)), cells(zero, i, lambda k: (b, zero, k, i, no)),
        cells(zero, F.coalesce("after", zero) - 1, lambda k: (b, zero + 1, i, k, yes)), cells(zero, F.coalesce("before", zero) - 1, lambda k: (b - 1, zero + 1, k, i, no)),
    )
    placed = v.select("id", "published_at", "u", F.explode(every).alias("c")).select("id", "published_at", "u", "c.*")
    return placed.groupBy("b", "d", "i", "j").applyInArrow(_within(window, least), FOUND)


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        (ids, at, *_), (others, when, *_), rows = left, right, []
        if not len(others):
            return _found([])
        for a, scores in _scores(left, right):
            scores = np.where(ids[a : a + len(scores), None] == others[None, :], -np.inf, scores)
            least = np.partition(scores, -min(k, len(others)), axis=1)[:, -min(k, len(others))]
            i, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            order = np.lexsort((others[j], -scores[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < k], j[rank < k]
            rows.append((ids[a + i], others[j], at[a + i], when[j], scores[i, j]))
        return _found(rows)

    return run


def top_matches(vectors: DataFrame, k: int, rows: int = BLOCK) -> DataFrame:
    """For each vector its ``k`` nearest others, exactly; of equal scores the least id. Every block of ``rows`` rows meets every
    block as one matrix product that keeps ``k`` a row, and the bests of all blocks are merged, so nothing is gathered but
    k rows a vector and block. Quadratic by its definition, like any exact search."""
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("published_at").cast("long").alias("published_at"), unit(F.col("embedding")).alias("u"))
    blocks = max(1, -(-v.count() // rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = v.withColumns({"q": own, "left": F.lit(True)}).withColumn("d", every)
    there = v.withColumns({"d": own, "left": F.lit(False)}).withColumn("q", every)
    best = asked.unionByName(there).groupBy("q", "d").applyInArrow(_best(k), FOUND)
    return best.withColumn("r", F.row_number().over(W.partitionBy("self").orderBy(F.desc("score"), "match"))).where(F.col("r") <= k).drop("r")


def classified(pairs: DataFrame, vendors: DataFrame, bands: Bands) -> DataFrame:
    """Pairs with same_vendor, adjusted score and the flags eligible, high, auto, borderline, self_is_older. vendors: (id, vendor);
    a null vendor is the same as none."""
    v = vendors.select("id", "vendor")
    out = pairs.join(v.withColumnsRenamed({"id": "self", "vendor": "__a"}), "self", "left").join(v.withColumnsRenamed({"id": "match", "vendor": "__b"}), "match", "left")
    out = out.withColumn("same_vendor", F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))).drop("__a", "__b")
    out = out.withColumn("high", F.col("score") >= bands.high)
    out = out.withColumn("adjusted", F.when(F.col("same_vendor") & ~F.col("high"), F.col("score") - bands.penalty).otherwise(F.col("score")))
    out = out.withColumn("eligible", F.abs(F.col("self_at") - F.col("match_at")) <= bands.window)
    out = out.withColumn("auto", F.col("eligible") & (F.col("high") | (F.col("adjusted") >= bands.threshold)))
    out = out.withColumn("borderline", F.col("eligible") & ~F.col("auto") & (F.col("adjusted") >= bands.floor))
    return out.withColumn("self_is_older", (F.col("self_at") < F.col("match_at")) | ((F.col("self_at") == F.col("match_at")) & (F.col("self") < F.col("match"))))


def best_auto(pairs: DataFrame) -> DataFrame:
    """One automatic match per row: the oldest older match, else the newer one of highest adjusted score."""
    order = [F.col("self_is_older").asc(), F.when(~F.col("self_is_older"), F.col("match_at")).asc(), F.desc("adjusted"), "match"]
    return pairs.where("auto").withColumn("r", F.row_number().over(W.partitionBy("self").orderBy(*order))).where("r = 1").drop("r")


def border_top(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` best borderline matches per row with their rank: adjusted score, older matches first, then the oldest."""
    order = [F.desc("adjusted"), F.col("self_is_older").asc(), "match_at", "match"]
    return pairs.where("borderline").withColumn("rank", F.row_number().over(W.partitionBy("self").orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def diagnostics(pairs: DataFrame, bands: Bands) -> DataFrame:
    """Counts and bests of each row's matches, and what is decided: auto_merge (into an older match), auto_merge_self_wins,
    rerank_pending, no_above_threshold, no_match_below_floor. Matches that are ``absorbed`` already (an optional column) are
    counted apart, as are those out of the window; a row without matches has none (no_candidates)."""
    gone = F.col("absorbed") if "absorbed" in pairs.columns else F.lit(False)
    e = F.col("eligible") & ~gone
    auto, border, older = F.col("auto") & ~gone, F.col("borderline") & ~gone, F.col("self_is_older")
    out = pairs.groupBy("self").agg(
        F.count("*").alias("seen"), F.count_if(~F.col("eligible")).alias("out_of_window"), F.count_if(F.col("eligible") & gone).alias("absorbed"), F.count_if(e & older).alias("self_older"), F.count_if(e & ~older).alias("self_newer"),
        F.count_if(e & (F.col("adjusted") >= bands.floor)).alias("over_floor"), F.count_if(auto).alias("autos"), F.count_if(e & F.col("high")).alias("highs"), F.max(F.when(e, F.col("score"))).alias("best"), F.max(F.when(e, F.col("adjusted"))).alias("best_adjusted"),
        F.count_if(auto & ~older).alias("__into"), F.count_if(border).alias("borders"),
    )
    label = F.when(F.col("__into") > 0, "auto_merge").when(F.col("autos") > 0, "auto_merge_self_wins").when(F.col("borders") > 0, "rerank_pending").when(F.col("over_floor") > 0, "no_above_threshold").otherwise("no_match_below_floor")
    return out.withColumn("decision", label).drop("__into")


def _sweep(table: pa.Table) -> pa.Table:
    """Replays the oldest-first sweep over one component's edges."""
    edges: dict = {}
    for r in table.to_pylist():
        edges.setdefault((r["self_at"], r["self"]), []).append(r)
    gone, winners, losers = set(), [], []

    def absorb(winner, loser):
        gone.add(loser)
        winners.append(winner)
        losers.append(loser)

    for (_, me), rows in sorted(edges.items()):
        if me in gone:
            continue
        rows = sorted((r for r in rows if r["match"] not in gone), key=lambda r: (-r["score"], r["match"]))
        older = [r for r in rows if r["auto"] and not r["self_is_older"]]
        if older:
            absorb(min(older, key=lambda r: r["match_at"])["match"], me)
            continue
        newer = [r for r in rows if r["self_is_older"]]
        for r in [r for r in newer if r["auto"]] + [r for r in newer if r["borderline"] and r["accepted"]]:
            if r["match"] not in gone:
                absorb(me, r["match"])
    return pa.table({"loser": pa.array(losers, pa.int64()), "winner": pa.array(winners, pa.int64())})


def _finalize(table: pa.Table) -> pa.Table:
    """Replays the newest-first pass with one merge a row; the last column says how winners moved on later."""
    edges: dict = {}
    for r in table.to_pylist():
        edges.setdefault((-r["self_at"], r["self"]), []).append(r)
    gone, pairs = set(), []
    for (_, me), rows in sorted(edges.items()):
        if me in gone:
            continue
        rows = [r for r in rows if r["match"] not in gone]
        auto = sorted((r for r in rows if r["auto"]), key=lambda r: (r["self_is_older"], r["match_at"] if not r["self_is_older"] else 0, -r["adjusted"], r["match"]))
        border = sorted((r for r in rows if r["borderline"]), key=lambda r: (-r["adjusted"], r["self_is_older"], r["match_at"], r["match"]))[:5]
        pick = auto[:1] or [r for r in border if r["accepted"]][:1]
        for r in pick:
            winner, loser = (me, r["match"]) if r["self_is_older"] else (r["match"], me)
            gone.add(loser)
            pairs.append((loser, winner))
    last = dict(pairs)

    def end(x):
        while x in last:
            x = last[x]
        return x

    return pa.table({"loser": pa.array([a for a, _ in pairs], pa.int64()), "winner": pa.array([end(b) for _, b in pairs], pa.int64())})


def merge_map(pairs: DataFrame, verdicts: DataFrame | None = None, newest_first: bool = False, watermark: Column | None = None) -> DataFrame:
    """(loser, winner) of the ordered greedy merge. Edges are pruned to automatic ones and accepted borderline ones (verdicts:
    self, match, same; missing is no; pairs under ``watermark`` are not asked again); merges only travel along edges,
    so each connected component is replayed by a task of its own: oldest first with two passes, or newest first
    with one merge a row."""
    accepted = F.lit(False)
    if verdicts is not None:
        pairs = pairs.join(verdicts.select("self", "match", "same"), ["self", "match"], "left")
        accepted = F.coalesce("same", F.lit(False))
        if watermark is not None:
            accepted = accepted & ~watermark
    edges = pairs.withColumn("accepted", accepted).where(F.col("auto") | (F.col("borderline") & (F.col("accepted") | F.lit(newest_first))))
    edges = edges.select("self", "match", "self_at", "match_at", "score", "adjusted", "auto", "borderline", "self_is_older", "accepted")
    edges = checkpointed(edges)
    parts = components(edges.select(F.col("self").alias("u"), F.col("match").alias("v"))).withColumnRenamed("node", "self")
    return edges.join(parts, "self").groupBy("label").applyInArrow(_finalize if newest_first else _sweep, "loser long, winner long")


def judged(pairs: DataFrame, verdict_fn: Callable[[list[dict]], list[bool]], batch: int = 15) -> DataFrame:
    """Verdicts (self, match, same) of a caller's function over the borderline pairs, best first, ``batch`` pairs of one row a
    call; pairs that it has no answer for, or whose call fails, count as no."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["adjusted"], r["match"]))
        same: list[bool] = []
        for a in range(0, len(rows), batch):
            try:
                said = [bool(x) for x in verdict_fn(rows[a : a + batch])][: len(rows[a : a + batch])]
            except Exception:  # noqa: BLE001
                said = []
            same += said + [False] * (len(rows[a : a + batch]) - len(said))
        return pa.table({"self": pa.array([r["self"] for r in rows], pa.int64()), "match": pa.array([r["match"] for r in rows], pa.int64()), "same": pa.array(same, pa.bool_())})

    return pairs.where("borderline").select("self", "match", "score", "adjusted").groupBy("self").applyInArrow(run, "self long, match long, same boolean")


def batches(pairs: DataFrame, size: int = 15) -> DataFrame:
    """Borderline pairs with the number of the call, within their own row, that asks about them: ``size`` a call, best first."""
    n = F.row_number().over(W.partitionBy("self").orderBy(F.desc("adjusted"), "match"))
    return pairs.where("borderline").withColumn("batch", F.floor((n - 1) / size).cast("long"))


def embedded(rows: DataFrame, embed_fn: Callable[[list[str]], list], text: str = "input", key: str = "id") -> DataFrame:
    """(key, embedding, status) by a caller's function over batches of texts; a batch that fails gives 'failed' and no vector."""
    kind = dict(rows.dtypes)[key]

    def run(parts):
        for b in parts:
            try:
                got = [None if v is None else [float(x) for x in v] for v in embed_fn(b.column(1).to_pylist())]
            except Exception:  # noqa: BLE001
                got = []
            got = [*got, *[None] * b.num_rows][: b.num_rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64())), pa.array(["failed" if v is None else "embedded" for v in got], pa.string())], [key, "embedding", "status"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<double>, status string")


def merge_tables(mapping: DataFrame, articles: DataFrame, sources: DataFrame, tags: DataFrame, stars: DataFrame, reads: DataFrame) -> dict[str, DataFrame]:
    """All tables after the merges of ``mapping`` (loser, winner; a winner is no loser): a loser's own source and its alternative
    ones become the winner's, as do its tags, stars and reads; losers go. A row that the winner has already stays as it is; of
    losers' rows that meet, the loser's own source wins over alternatives, then the least loser id. Applying the
    mapping again changes nothing."""
    to = mapping.select(F.col("loser").alias("article_id"), "winner").distinct()

    def moved(children: DataFrame) -> DataFrame:
        out = children.join(to, "article_id", "left")
        return out.withColumns({"__moved": F.col("winner").isNotNull(), "__from": F.col("article_id"), "article_id": F.coalesce("winner", "article_id")}).drop("winner")

    def one(children: DataFrame, keys: list[str], rest: list[str], *order: str) -> DataFrame:
        first = F.min_by(F.struct(*rest), F.struct("__moved", *order, "__from")).alias("r")
        return children.groupBy(*keys).agg(first).select(*keys, *[f"r.{c}" for c in rest])

    own = articles.select(F.col("id").alias("article_id"), "source_name", F.col("url").alias("source_url"), "published_at").join(to.select("article_id"), "article_id", "left_semi")
    every = moved(own).withColumn("__alt", F.lit(1)).unionByName(moved(sources.select("article_id", "source_name", "source_url", "published_at")).withColumn("__alt", F.lit(2)))
    return {
        "articles": articles.join(to.select(F.col("article_id").alias("id")), "id", "left_anti"),
        "sources": one(every, ["article_id", "source_url"], ["source_name", "published_at"], "__alt"),
        "tags": moved(tags).select("article_id", "tag").distinct(),
        "stars": one(moved(stars), ["user_id", "article_id"], ["starred_at"]),
        "reads": one(moved(reads), ["user_id", "article_id"], ["read_at"]),
    }


def apply_merge(children: DataFrame, mapping: DataFrame, key: str, unique: list[str], first: str) -> DataFrame:
    """Children of losers moved to the winners; existing rows win, then the least ``first``."""
    moved = children.join(mapping.select(F.col("loser").alias(key), "winner"), key, "left")
    moved = moved.withColumns({"__moved": F.col("winner").isNotNull(), key: F.coalesce("winner", key)})
    return moved.groupBy(*unique).agg(F.min_by(first, F.struct("__moved", first)).alias(first))
