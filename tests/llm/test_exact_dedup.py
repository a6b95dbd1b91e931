import hashlib

import numpy as np

from feedloom.llm import exact_dedup as X


def test_filter_is_lossless_and_merges():
    rng = np.random.default_rng(1)
    values = [rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64) * np.uint64(2) for _ in range(3)]
    values[1][:200] = values[0][:200]
    filters = [X.CountingQuotientFilter.build(*np.unique(v, return_counts=True), 12, 0, 1 << 12) for v in values]
    filters = [X.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters]
    fps, counts = X.CountingQuotientFilter.merge(filters).items()
    want = np.unique(np.concatenate(values), return_counts=True)
    assert (fps == want[0]).all() and (counts == want[1]).all()


def test_against_brute_force(spark):
    rows = [(1, "Abc", "a"), (2, "aBC", "a"), (3, "É", "b"), (4, "é", "b"), (5, None, "c"), (6, "", "c"), (7, "x" * 50000, "d"), (8, "x" * 50000, "d"), (9, "x" * 49999 + "y", "d"), (None, "abc", "e"), (2, "aBC", "a")]
    rows += [(100 + i, "same", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = X.exact_dedup(docs).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t, _ in rows:
        keep = max(x for x in groups[low(t)] if x is not None)
        want.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert X.exact_dedup(docs.limit(0)).count() == 0
