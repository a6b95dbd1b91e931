"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checked_broadcast, stored


def differencing(sums: np.ndarray) -> np.ndarray:
    """Combine partial partitions (rows of ``sums``, one column a bin) into one: repeatedly the two of largest spread, in
    opposite orders, so that the largest bin of one meets the smallest of the other. Returns the final bin of each
    (row, column) as an array of the same shape; empty bins of a partial partition may land anywhere. Final bins
    are numbered from the smallest sum."""
    n, k = sums.shape
    ids = np.arange(n * k).reshape(n, k)
    order = np.argsort(sums, axis=1, kind="stable")
    sums, ids = np.take_along_axis(sums, order, 1), np.take_along_axis(ids, order, 1)
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapify(heap)
    state, parents, made, ties = {i: (sums[i], ids[i]) for i in range(n)}, [], n * k, n
    while len(heap) > 1:
        (sa, ia), (sb, ib) = (state.pop(heappop(heap)[1]) for _ in range(2))
        total = sa + sb[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        parents.append((ia[order], ib[::-1][order]))
        state[ties] = (total, np.arange(made, made + k))
        heappush(heap, (-int(total[-1] - total[0]), ties))
        made, ties = made + k, ties + 1
    final = np.zeros(made, np.int32)
    final[state[heap[0][1]][1]] = np.arange(k)
    for j in range(len(parents) - 1, -1, -1):
        own = final[n * k + j * k : n * k + (j + 1) * k]
        final[parents[j][0]] = own
        final[parents[j][1]] = own
    return final[: n * k].reshape(n, k)


def _first(shards: int):
    """Each group is a partial partition with one filled bin."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("key", "ascending")])
        sums = np.zeros((table.num_rows, shards), np.int64)
        sums[:, -1] = table.column("bytes").to_numpy()
        return table.append_column("bin", pa.array(differencing(sums)[:, -1]))

    return run


def _combine(shards: int):
    """Combines the parts of one table row group: rows (part, up, bin, bytes) with all bins of each part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("bin", "ascending")])
        sums = table.column("bytes").to_numpy().reshape(-1, shards)
        return table.append_column("up_bin", pa.array(differencing(sums).ravel()))

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 40, part_groups: int = 20_000, fan: int = 500) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Documents of equal text form an indivisible group; groups go to ``shards`` shards of near equal bytes (UTF-8 length plus
    16 a row). Groups are dealt into parts of about ``part_groups``; each part is differenced to one partial partition
    of ``shards`` bins, and partial partitions are differenced in turn, ``fan`` at a time, until one is left. A group
    over the mean shard keeps a shard to itself as far as it can; no law could split it. Slots number a shard's rows from 0
    without gaps: rows are ranked within cells of a bounded number of rows, so a hot group or shard is no task's alone. Null text counts as empty text of size 16; a null doc_id and repeated rows are rows like others; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = stored(rows, "rows")
    total = rows.count()
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = stored(groups, "groups")
    parts = max(1, -(-groups.count() // part_groups))
    placed = stored(groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(_first(shards), "key binary, bytes long, part long, bin int"), "placed")
    bins = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("bin")
    where = placed
    while parts > 1:
        sums = where.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes"))
        every = sums.select("part").distinct().select("part", bins).join(sums, ["part", "bin"], "left").fillna(0, ["bytes"])
        moved = every.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up").applyInArrow(_combine(shards), "part long, bin int, bytes long, up long, up_bin int")
        moved = checked_broadcast(stored(moved.select("part", "bin", "up", "up_bin"), "moved"))
        where = stored(where.join(moved, ["part", "bin"]).select("key", "bytes", F.col("up").alias("part"), F.col("up_bin").alias("bin")), "placed")
        parts = -(-parts // fan)
    found = rows.join(where.select("key", F.col("bin").alias("shard")), "key").select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("row"))
    found = stored(found.withColumn("cell", F.floor(F.col("row") / max(256, -(-total // 100_000)))), "sharded")
    counts = found.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")
    starts = checked_broadcast(stored(counts.select("shard", "cell", before.alias("start")), "starts"))
    rank = F.row_number().over(W.partitionBy("shard", "cell").orderBy("row"))
    out = found.withColumn("rank", rank).join(starts, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
