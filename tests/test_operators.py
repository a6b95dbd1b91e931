import collections
import math
import random

from pyspark.sql import functions as F

from feedloom.operators import dedup, feed, ingest, ops
from feedloom.plans import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_and_caps(spark):
    df = spark.createDataFrame([(0, "a", 5), (1, "b", 1), (2, "a", 3), (3, "a", 3)], "seq long, url string, at long")
    got = {r.seq: (r.role, r.cluster_order) for r in ingest.clusters(df, "url", "at", "seq").collect()}
    assert got == {0: ("alternative", 0), 1: ("primary", 1), 2: ("primary", 0), 3: ("alternative", 0)}
    assert rows(ingest.first_per(df, "url", ["seq"], 1).select("seq")) == [(0,), (1,)]


def test_freshness_edges(spark):
    df = spark.createDataFrame([(1, 1000 - 172_800), (2, 999 - 172_800), (3, None)], "id long, published_at long")
    assert rows(ingest.fresh(df, 1000).select("id", "published_at")) == [(1, 1000 - 172_800), (3, 1000)]


def test_prefer_direct_takes_the_first(spark):
    items = [(0, "alpha bravo charlie delta", True, ["x", "y"]), (1, "bravo alpha echo charlie", False, ["y", "z"]), (2, "alpha bravo charlie delta", False, None), (3, "alpha bravo", True, []), (4, "echo bravo charlie", True, ["w", "x"]), (5, "the with", True, None)]
    df = spark.createDataFrame(items, "seq long, title string, aggregator boolean, tags array<string>")
    assert rows(ingest.direct_matches(df)) == [(0, 1, 3), (4, 1, 3)]
    assert rows(ingest.prefer_direct(df).select("seq", "tags")) == [(1, ["y", "z", "x", "w"]), (2, None), (3, []), (5, None)]


def test_absorbed_tags_are_gathered_once_each(spark):
    """One direct item absorbs nearly all: each tag comes once, where it is first met, and no row lists all that was absorbed."""
    items = [(0, "alpha bravo charlie", False, ["own", None])] + [(i, "alpha bravo charlie", True, [f"t{i % 3}", "own", None] if i % 5 else None) for i in range(1, 3000)]
    items += [(4000, "delta echo foxtrot", False, None), (4001, "delta echo foxtrot", True, None)]
    out = ingest.prefer_direct(spark.createDataFrame(items, "seq long, title string, aggregator boolean, tags array<string>"))
    assert rows(out.select("seq", "tags")) == [(0, ["own", None, "t1", "t2", "t0"]), (4000, [])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "flatten(" not in plan


def test_direct_matches_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(12)] + ["common"]
    items = [(i, " ".join(["common"] + rng.sample(words, rng.randrange(1, 6))), rng.random() < 0.5) for i in range(150)]
    tokens = {i: set(t.split()) for i, t, _ in items}
    want = []
    for i, _, aggregator in items:
        found = [(j, len(tokens[i] & tokens[j])) for j, _, other in items if aggregator and not other and len(tokens[i] & tokens[j]) >= 3]
        want += [(i, *min(found))] if found else []
    assert rows(ingest.direct_matches(spark.createDataFrame(items, "seq long, title string, aggregator boolean"))) == sorted(want, key=str)


def most_joined(spark, since):
    """The most rows that a join made in the SQL executions numbered from ``since`` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(since, store.executionsCount()):
        run = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_direct_matches_in_ranges(spark, monkeypatch):
    """Titles of a few common words: the first match ends an item's search, so that not all pairs are made."""
    monkeypatch.setattr(ingest, "FIRST", 32, raising=False)
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    items = [(i * 7 % 2003, " ".join(rng.sample(words, 12)) if i % 20 else f"lone{i} word1 word2 word{i % 60}", rng.random() < 0.3) for i in range(2000)]
    tokens = {i: set(t.split()) for i, t, _ in items}
    direct = sorted(i for i, _, aggregator in items if not aggregator)
    want = [next(((i, j, len(tokens[i] & tokens[j])) for j in direct if len(tokens[i] & tokens[j]) >= 3), None) for i, _, aggregator in items if aggregator]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert rows(ingest.direct_matches(spark.createDataFrame(items, "seq long, title string, aggregator boolean"))) == sorted(filter(None, want), key=str)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < most_joined(spark, since) < 300_000


def test_outputs_find_their_inputs(spark):
    """Echoes out of range neither count nor match, not even by position; valid ones keep their place when positions fill the rest."""

    def aligned(inputs, outputs):
        a = spark.createDataFrame([(1, i) for i in range(inputs)], "run long, idx long")
        b = spark.createDataFrame([(1, k, g, e) for k, (g, e) in enumerate(outputs)], "run long, pos long, given boolean, echoed long")
        return {r.idx: r.pos for r in ingest.align_outputs(a, b).collect()}

    none = (False, None)
    assert aligned(7, [(True, 3), (True, 99), none, none, none, none, none]) == {0: 0, 2: 2, 3: 0, 4: 4, 5: 5, 6: 6}
    assert aligned(4, [(True, 2), (True, 2), (True, 0), none]) == {2: 0, 0: 2}  # three echoes: by echo alone
    assert aligned(4, [(True, 1), none]) == {1: 0}  # half of them
    assert aligned(5, [(True, 4), (True, None), none, none, none]) == {4: 0, 0: 0, 2: 2, 3: 3}  # null is given and invalid
    assert aligned(2, []) == {}


def test_overlapping_hints(spark):
    clusters = spark.createDataFrame([(1, i) for i in range(10)], "run long, idx long")
    hints = spark.createDataFrame([(1, 0, [2, 5]), (1, 1, [7, 2, 99]), (1, 2, [8]), (1, 3, [6, 5, 5])], "run long, hint long, members array<long>")
    got = {}
    for r in ingest.hint_merge(clusters, hints).collect():
        got.setdefault(r.anchor, set()).add(r.idx)
    assert got == {2: {2, 7}, 5: {5, 6}, **{i: {i} for i in (0, 1, 3, 4, 8, 9)}}


def test_sources_of_seen_clusters(spark):
    seen = spark.createDataFrame([("k", "n1", "u1", 5, 0), ("k", "n2", "u1", 4, 1), ("k", "n3", "u2", 6, 2), ("new", "n4", "u4", 7, 3)], "key string, source_name string, source_url string, published_at long, seq long")
    known = spark.createDataFrame([("a", "k")], "id string, key string")
    there = spark.createDataFrame([("a", "u2")], "article_id string, source_url string")
    assert rows(ingest.append_sources(seen, known, there)) == [("a", "u1", "n1", 5)]


def test_packing_resets(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([100, 100, 101, 500, 1, 1])], "run long, seq long, cost long")
    got = [r.chunk_index for r in ingest.pack_chunks(df, "run", budget=200, items=2).orderBy("seq").collect()]
    assert got == [0, 0, 1, 2, 3, 3]
    assert ingest.pack_chunks(df.limit(0), "run").count() == 0


def pair(a, b, ta, tb, score, vendor=False):
    return (a, b, ta, tb, score, vendor)


BANDS = dedup.Bands()


def classify(spark, pairs):
    ids = {p[0] for p in pairs} | {p[1] for p in pairs}
    df = spark.createDataFrame([p[:5] for p in pairs], "self long, match long, self_at long, match_at long, score double")
    same = {x for p in pairs if p[5] for x in p[:2]}
    vendors = spark.createDataFrame([(i, "v" if i in same else f"v{i}") for i in ids], "id long, vendor string")
    return dedup.classified(df, vendors, BANDS)


def test_classifier_boundaries(spark):
    w = BANDS.window
    cases = [
        (pair(1, 2, 0, w, 0.88), (True, True, False)), (pair(3, 4, 0, w + 1, 0.95), (False, False, False)), (pair(5, 6, 0, 1, 0.8799), (True, False, True)),
        (pair(7, 8, 0, 1, 0.69), (True, False, False)), (pair(9, 10, 0, 1, 0.92, True), (True, True, False)), (pair(11, 12, 0, 1, 0.91, True), (True, False, True)),
    ]
    for p, want in cases:
        r = classify(spark, [p]).first()
        assert (r.eligible, r.auto, r.borderline) == want and r.self_is_older


def test_sweep_is_greedy_and_not_transitive(spark):
    near = [(1, 2, 10, 20, 0.95), (2, 3, 20, 30, 0.95)]
    both = [(*p, False) for p in near] + [(b, a, tb, ta, s, False) for a, b, ta, tb, s in near]
    got = rows(dedup.merge_map(classify(spark, both)))
    assert got == [(2, 1)]  # 3 is near 2 only, which has gone
    finalized = rows(dedup.merge_map(classify(spark, both), newest_first=True))
    assert finalized == [(2, 1), (3, 1)]  # 3 into 2, then 2 into 1


def test_merge_keeps_marks(spark):
    marks = spark.createDataFrame([("u", 1, 5), ("u", 2, 3), ("w", 2, 4)], "user string, id long, at long")
    mapping = spark.createDataFrame([(2, 1)], "loser long, winner long")
    assert rows(dedup.apply_merge(marks, mapping, "id", ["user", "id"], "at")) == [("u", 1, 5), ("w", 1, 4)]


def replayed(pairs, newest_first):
    """The merges of all rows in order, over everything, without components or pruned edges."""
    gone, out = set(), []
    mine = collections.defaultdict(list)
    for r in pairs:
        mine[(r.self_at, r.self)].append(r)
    for (_, me), found in sorted(mine.items(), key=lambda x: (-x[0][0], x[0][1]) if newest_first else x[0]):
        if me in gone:
            continue
        found = [r for r in found if r.match not in gone]
        yes = lambda r: r.borderline and (r.self + r.match) % 2 == 0
        if newest_first:
            older = sorted((r for r in found if r.auto and not r.self_is_older), key=lambda r: (r.match_at, -r.adjusted, r.match))
            newer = sorted((r for r in found if r.auto and r.self_is_older), key=lambda r: (-r.adjusted, r.match))
            border = sorted((r for r in found if r.borderline), key=lambda r: (-r.adjusted, r.self_is_older, r.match_at, r.match))[:5]
            pick = (older + newer or [r for r in border if yes(r)])[:1]
        else:
            older = sorted((r for r in found if r.auto and not r.self_is_older), key=lambda r: (r.match_at, -r.score, r.match))[:1]
            newer = sorted((r for r in found if r.self_is_older), key=lambda r: (-r.score, r.match))
            pick = older or [r for r in newer if r.auto] + [r for r in newer if yes(r)]
        for r in pick:
            winner, loser = (me, r.match) if r.self_is_older else (r.match, me)
            if loser not in gone:
                gone.add(loser)
                out.append((loser, winner))
    last = dict(out)

    def end(x):
        while x in last:
            x = last[x]
        return x

    return sorted((a, end(b)) for a, b in out)


def test_merges_replayed_in_plain_python(spark):
    """Both orders over a sample table, and the marks that they move, against a replay of every row in turn."""
    d = "/root/testdata/sf0.01"
    pairs = catalog.banded(spark, d).collect()
    assert any(r.auto for r in pairs) and any(r.borderline for r in pairs)
    for name, newest in (("merge_map", False), ("finalize_map", True)):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, d).collect()))
        assert got == replayed(pairs, newest) and len(got) > 20, name
    to = dict(dedup.merge_map(catalog.banded(spark, d)).collect())
    marks = {}
    for r in catalog.T.stars(spark, d).collect():
        old = int(r.article_id)
        at = (r.user_id, to.get(old, old))
        marks[at] = min(marks.get(at, (True, 1 << 60)), (old in to, r.starred_at))
    assert rows(catalog.QUERIES["merge_apply"](spark, d)) == sorted(((u, v, at) for (u, v), (_, at) in marks.items()), key=str)


def test_top_matches_bind_before_the_window(spark):
    """The nearest lie outside the window, so nothing inside it is among the one nearest that are looked at."""
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 10, [0.9, 0.1]), (3, 10_000_000, [1.0, 0.001])], "id long, published_at long, embedding array<double>")
    assert {(r.self, r.match) for r in dedup.top_matches(v, 1).collect()} == {(1, 3), (2, 3), (3, 1)}
    vendors = spark.createDataFrame([(i, str(i)) for i in (1, 2, 3)], "id long, vendor string")
    assert not any(r.eligible for r in dedup.classified(dedup.top_matches(v, 1), vendors, BANDS).collect())
    assert any(r.auto for r in dedup.classified(dedup.top_matches(v, 2), vendors, BANDS).collect())


def test_pairs_in_blocks(spark):
    """Blocks of a few rows against brute force, with nulls, zero vectors and unlike lengths."""
    rng = random.Random(6)
    made = [(i, rng.randrange(5000), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, 100, None), (61, 100, [0.0] * 4), (62, 200, [1.0, 2.0]), (63, 300, [2.0, 4.0]), (64, 300, [])]
    df = spark.createDataFrame(made, "id long, published_at long, embedding array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = {(i, j): cosine(a, b) for i, s, a in made for j, t, b in made if i != j and abs(s - t) <= 700 and cosine(a, b) >= 0.2}
    for size in (4096, 7):
        got = {(r.self, r.match): r.score for r in dedup.near_pairs(df, 700, 0.2, size).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {}
    for r in dedup.top_matches(df, 3, 9).collect():
        best.setdefault(r.self, []).append((round(-r.score, 9), r.match))
    for i, _, a in made:
        assert sorted(best[i]) == sorted((round(-cosine(a, b), 9), j) for j, _, b in made if j != i)[:3]


def test_whole_merge(spark):
    a = spark.createDataFrame([("w", "wn", "wu", 1), ("l", "ln", "lu", 2), ("m", "mn", "lu", 3)], "id string, source_name string, url string, published_at long")
    sources = spark.createDataFrame([("w", "s", "x", 9), ("l", "t", "x", 8), ("l", "t", "y", 7), ("m", "q", "y", 6)], "article_id string, source_name string, source_url string, published_at long")
    tags = spark.createDataFrame([("w", "a"), ("l", "a"), ("l", "b")], "article_id string, tag string")
    marks = spark.createDataFrame([(1, "w", 5), (1, "l", 4), (2, "l", 3), (2, "m", 2)], "user_id long, article_id string, at long")
    mapping = spark.createDataFrame([("l", "w"), ("m", "w")], "loser string, winner string")
    args = (a, sources, tags, marks.withColumnRenamed("at", "starred_at"), marks.withColumnRenamed("at", "read_at"))
    got = dedup.merge_tables(mapping, *args)
    assert rows(got["articles"].select("id")) == [("w",)]
    assert rows(got["sources"]) == [("w", "lu", "ln", 2), ("w", "x", "s", 9), ("w", "y", "t", 7)]
    assert rows(got["tags"]) == [("w", "a"), ("w", "b")]
    assert rows(got["stars"]) == rows(got["reads"]) == [(1, "w", 5), (2, "w", 3)]
    again = dedup.merge_tables(mapping, *[got[k] for k in ("articles", "sources", "tags", "stars", "reads")])
    assert all(rows(again[k].select(sorted(again[k].columns))) == rows(got[k].select(sorted(got[k].columns))) for k in got)


def test_hooks(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, input string")
    assert rows(dedup.embedded(texts, lambda t: [[float(len(x))] for x in t])) == [(1, [1.0], "embedded"), (2, [2.0], "embedded")]
    assert {r.status for r in dedup.embedded(texts, lambda t: 1 / 0).collect()} == {"failed"}
    pairs = spark.createDataFrame([(1, m, 0.8, 0.8 - m / 100, True) for m in range(2, 8)] + [(1, 9, 0.9, 0.9, False)], "self long, match long, score double, adjusted double, borderline boolean")
    got = {r.match: r.same for r in dedup.judged(pairs, lambda asked: [r["match"] % 2 == 0 for r in asked][:2], 3).collect()}
    assert got == {2: True, 3: False, 4: False, 5: False, 6: True, 7: False}  # the third of each call has no answer
    assert not any(r.same for r in dedup.judged(pairs, lambda asked: 1 / 0).collect())


def test_runs_are_reused_while_they_are_fresh(spark):
    asked = [("a", t) for t in (0, 100, 120, 121, 200, 242, 1000)]
    df = spark.createDataFrame([(1, t, k) for k, (_, t) in enumerate(asked)], "key long, t long, k long")
    assert [r.started for r in ops.kick(df, "key", "t", "k").orderBy("order").collect()] == [True, False, False, True, False, True, True]


def test_run_totals(spark):
    chunks = spark.createDataFrame([(1, 0, 10, 4), (1, 0, 10, 4), (1, 1, 5, 5), (2, 0, 3, 1)], "run long, chunk long, candidates long, ingested long")
    losers = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "run long, loser string")
    assert rows(ops.finished(chunks, losers)) == [(1, 15, 9, 8), (2, 3, 1, 2)]


def test_unread_looks_deep_enough(spark):
    """A user who has read a tag's newest articles still gets five; tags are ranked in salted parts."""
    a = spark.createDataFrame([(f"{i:03}", i, i) for i in range(60)], "id string, ingested_at long, published_at long")
    tags = spark.createDataFrame([(f"{i:03}", "x" if i % 2 else "y") for i in range(60)], "article_id string, tag string")
    users = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "none")], "user_id long, tag string")
    read = spark.createDataFrame([(1, f"{i:03}") for i in range(20, 60)] + [(2, "058")], "user_id long, article_id string")
    got = {}
    for r in feed.unread(a, users, tags, read, 3).collect():
        got.setdefault(r.user_id, {})[r.rank] = r.article_id
    assert got == {1: {1: "019", 2: "017", 3: "015"}, 2: {1: "059", 2: "057", 3: "056"}}


def test_history_links(spark):
    days = spark.createDataFrame([("UTC", "2024-01-05", 1), ("UTC", "2024-01-06", 2), ("X", "2024-01-06", 3)], "tz string, day string, n long")
    assert rows(feed.focused(days, "2024-01-05").select("n")) == [(1,), (3,)]
    assert all(feed.focused(days, x).count() == 3 for x in (None, "2024-1-5", "2024-01-05x", "1999-01-01"))


def test_high_water_mark(spark, tmp_path):
    from feedloom.operators.orchestrate import HighWater

    mark = HighWater(spark, str(tmp_path / "mark"))
    assert mark.read() is None and mark.advance(5, 3, 0) and mark.read() == 5
    assert not mark.advance(9, 3, 3) and not mark.advance(4, 3, 0) and not mark.advance(5, 1, 0) and mark.read() == 5
    assert mark.advance(9, 3, 2) and mark.read() == 9


def test_shared_folder_is_not_guessed_on_a_cluster():
    import types

    import pytest

    from feedloom.runtime import shared_dir

    def session(master, path=None):
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, default: path or default), sparkContext=types.SimpleNamespace(master=master))

    assert shared_dir(session("spark://x:1", "hdfs://c/y")) == "hdfs://c/y" and shared_dir(session("local[4]"))
    for master in ("spark://x:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_retention_edges(spark):
    day = 86400
    a = spark.createDataFrame([(1, 100 * day - 14 * day), (2, 100 * day - 14 * day - 1), (3, 0)], "id long, published_at long")
    stars = spark.createDataFrame([("u", 3)], "user string, article_id long")
    assert rows(ops.retain(a, stars, 100 * day).select("id")) == [(1,), (3,)]


def test_limits_streaks_states(spark):
    e = spark.createDataFrame([(i, "k", t, f) for i, (t, f) in enumerate([(0, True), (1, True), (2, False), (3, True), (500, True)])], "id long, key string, t long, failed boolean")
    got = ops.rate_limited(e, "key", "t", "id", 60, 3).orderBy("id").collect()
    assert [(r.hit, r.allowed, r.retry_after) for r in got] == [(1, True, None), (2, True, None), (3, True, None), (4, False, 57), (1, True, None)]
    assert [(r.streak, r.evicted) for r in ops.failure_streaks(e, "key", "t", "id", F.col("failed"), 100, 2).orderBy("id").collect()] == [(1, False), (2, True), (0, False), (1, False), (1, False)]
    log = spark.createDataFrame([("r", 1, "ready"), ("r", 2, "running"), ("r", 3, "ready"), ("r", 4, "running")], "run string, t long, to string")
    assert rows(ops.transitions(log, "run", ["t"], {"new": ["running"], "running": ["ready"], "ready": []}, "new")) == [("r", "ready", 2)]


def test_feeds(spark):
    tags = spark.createDataFrame([("1", "x"), ("2", "y")], "article_id string, tag string")
    assert feed.tagged(tags, []).count() == 0 and rows(feed.tagged(tags, ["x"])) == [("1",)]
    a = spark.createDataFrame([("1", "50% off", "now", ["x"]), ("2", "none", "", ["y"])], "id string, title string, excerpt string, tags array<string>")
    assert rows(feed.search(a, "0% o", []).select("id")) == [("1",)] and feed.search(a, "zz", ["Y"]).count() == 1


def test_native_queries_use_no_python(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for name in ("canonical_urls", "html_text", "title_pairs", "unread_headlines", "tag_tally", "merged_sources", "discovery_states", "today_feed", "history_by_day", "failure_streaks"):
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_components_both_ways(spark, monkeypatch):
    import random

    from feedloom.operators import graph

    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 150), rng.randrange(200, 250)) for _ in range(40)]
    df = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    alone = rows(graph.components(df))
    monkeypatch.setattr(graph, "ALONE", 0)
    assert rows(graph.components(df)) == alone and ("40", "0") in [tuple(map(str, r)) for r in alone]
    assert graph.components(df.limit(0)).count() == 0


def test_orchestration():
    from feedloom.operators.orchestrate import Permanent, Run, advance, deliver, outage

    run = Run()
    for _ in range(11):
        run = advance(run, False, 0)
    assert (run.status, run.waits) == ("running", 11) and advance(run, False, 0).status == "failed"
    run = advance(run, True, 0)
    assert run.phase == "embed" and advance(run, True, 5).phase == "embed"
    run = advance(advance(run, True, 0), True, 0)
    assert (run.phase, run.status) == ("done", "done") and advance(run, True, 0) == run
    calls, dead = [], []

    def bad(m):
        calls.append(m)
        raise Permanent if m == "p" else ValueError

    assert not deliver(bad, "x", terminal=lambda m, e: dead.append(m)) and calls == ["x"] * 3 and dead == ["x"]
    assert not deliver(bad, "p") and calls.count("p") == 1 and deliver(len, "ok")
    assert outage(3, 3) and not outage(3, 2) and not outage(0, 0)
