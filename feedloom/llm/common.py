"""Helpers that the training-data operators share: shared storage, checked broadcasts, key filters, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, scratch

#: Most rows of a side that is broadcast; a row of these sides holds one or two longs, so this is tens of MB at most.
BROADCAST_ROWS = 500_000
#: log2 of the fewest and of the most bits of a key filter: 4 KB and 32 MB.
FILTER_BITS = 15, 28


#: Folders that ``stored`` wrote, by application, oldest first.
_written: dict[str, list[str]] = {}


def _folder(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and gives
    the optimizer real sizes. Each call has a folder of its own below one per application (see ``cleanup``)."""
    spark = df.sparkSession
    path = _folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def written(spark: SparkSession) -> int:
    """How many tables ``stored`` has written for this application, as a mark for ``release``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since a mark, but for ``keep``, which ``stored`` returned: for intermediate tables whose last
    reader has been written."""
    held = {df._stored_at for df in keep}
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in [p for p in paths[since:] if p not in held]:
        discard(spark, path)
        paths.remove(path)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that ``stored`` wrote for this application; call it once the results are written."""
    discard(spark, scratch(spark))
    _written.pop(spark.sparkContext.applicationId, None)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, so that counting is cheap) with a broadcast hint if it has at most ``rows`` rows, else as it is:
    the join is then a shuffled one with the same result."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class KeyFilter:
    """A bit map over hashed keys, small enough to broadcast whatever the number of keys: rows that it lets through may
    have one of the keys, all others surely have not. Only the former need a join, so a table of texts is split
    first and its larger part never shuffled, by one plan at every size. About 1 in 32 other rows goes through until the map has its
    most bits, gradually more with more than 8 million keys: that costs time, never a result."""

    def __init__(self, keys: DataFrame, column: str = "key"):
        """``keys`` is a stored table with the hashes of the keys in a long column; nulls are left out."""
        low, high = FILTER_BITS
        keys = keys.select(F.col(column).alias("k")).where("k is not null")
        self.bits = min(high, max(low, (32 * keys.count()).bit_length()))
        at = self._at(F.col("k"))
        self.map = stored(keys.groupBy((at / 32768).cast("int").alias("__bucket")).agg(F.bitmap_construct_agg(at % 32768).alias("__map")), "filter")

    def _at(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << self.bits))

    def mark(self, df: DataFrame, key: Column, name: str = "__maybe") -> DataFrame:
        """``df`` with a boolean column, true on all rows whose ``key`` may be among the keys."""
        rows = df.withColumn("__at", self._at(key)).withColumn("__bucket", (F.col("__at") / 32768).cast("int"))
        byte = F.conv(F.hex(F.substring("__map", ((F.col("__at") % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(__at % 8 as int)) as int)")) > 0
        return rows.join(F.broadcast(self.map), "__bucket", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__at", "__bucket", "__map")


def batched(batches, step: int, *held):
    """Slices of at most ``step`` rows of a task's batches. After each, Arrow gives its freed memory back, and at the task's end caches
    ``held`` are cleared, so that workers, the waiting ones too, hold little."""
    import pyarrow as pa

    pool = pa.default_memory_pool()
    try:
        for b in batches:
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
                pool.release_unused()
    finally:
        for cache in held:
            cache.clear()
        pool.release_unused()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _forest(batches):
    """Replace a partition's edges by a spanning forest of stars (member, smallest member): union-find over one task's
    edges. Components stay as they are; a task's memory is bounded by its partition."""
    import pyarrow as pa

    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (long columns u, v; repeats, loops and nulls allowed) as rows (node, label),
    label the smallest node of the component; nodes without an edge to another node are absent.

    Every partition's edges are folded into spanning stars. Then, in rounds, each node takes the smallest label among its own,
    its neighbours' and its label's label, and edges are contracted to the labels of their ends, folded again, until none is
    left: the graph shrinks from round to round. State is written in the shared folder every round, so a lost executor
    costs one round. No side is gathered in one task or on the driver.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    spark, since, mapping = edges.sparkSession, written(edges.sparkSession), None
    # what makes the edges may run Python as well: stored first, a task never needs two workers at once
    edges = stored(stored(edges, "raw").mapInArrow(_forest, "u long, v long"), "edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = stored(hooked.join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
        if mapping is None:
            mapping = labels
        else:
            further = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            mapping = stored(mapping.join(further, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
        ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in ("u", "v")]
        contracted = edges.join(ends[0], "u").join(ends[1], "v").where("of_u <> of_v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")).distinct()
        edges = stored(contracted.mapInArrow(_forest, "u long, v long"), "edges")
        release(spark, since, mapping, edges)
        if not edges.limit(1).count():
            release(spark, since, mapping)
            return mapping
    raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
