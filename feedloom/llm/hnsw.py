"""Embedding near-deduplication by cells around the nodes of a hierarchical navigable small-world graph."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import KeyFilter, components, stored, tasks

#: Links of a node in the ground layer and above it.
GROUND, UPPER = 32, 16
#: What single precision may be off by, and how far below the least similarity a range search still walks on.
MARGIN, SLACK = 1e-3, 0.05
#: Cells that a row joins at most, how much less (in cosine) than to its nearest node a further cell's node may be similar, and what
#: nodes stay below among each other: about twice the angle of a cosine of 0.9, so that no dense group has several nodes.
COPIES, REACH, APART = 7, 0.3, 0.6
#: Most nodes of a graph, and how many rows for each are sampled to fit it (1,024 rows at least).
NODES, SPARE = 16_384, 4
#: What a cosine of two vectors in half precision may be off by; pairs so near to the least similarity are compared exactly.
DOUBT = 2e-3


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled by the largest component first, so that squares neither over- nor underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """A navigable small-world graph over unit vectors. Nodes are inserted in batches: each batch searches the graph so
    far, and its own members by brute force, for its neighbours; links are chosen for diversity, in both directions."""

    def __init__(self, x: np.ndarray, build_beam: int = 64, seed: int = 5):
        self.x, n = np.ascontiguousarray(x, np.float32), len(x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(UPPER)).astype(int), 6)
        top = int(level.max(initial=0))
        self.layers = [np.full((n, UPPER if k else GROUND), -1, np.int32) for k in range(top + 1)]
        self.entry, at = -1, 0
        done_top = -1
        while at < n:
            batch = order[at : at + min(1024, max(32, at))]
            at += len(batch)
            found = []  # all layers are searched before any is linked, else a node would find itself a layer below
            for k in range(top, -1, -1):
                own = batch[level[batch] >= k]
                if not len(own):
                    continue
                ids = np.full((len(own), 0), -1, np.int32)
                sims = np.zeros((len(own), 0), np.float32)
                if self.entry >= 0 and done_top >= k:
                    start = self._descend(self.x[own], done_top, k)
                    ids, sims = self.beam(self.x[own], start[:, None], build_beam, k)
                among = self.x[own] @ self.x[own].T
                np.fill_diagonal(among, -np.inf)
                most = min(GROUND, len(own) - 1)
                if most:
                    best = np.argpartition(-among, most - 1, axis=1)[:, :most]
                    ids = np.concatenate([ids, own[best].astype(np.int32)], axis=1)
                    sims = np.concatenate([sims, np.take_along_axis(among, best, 1)], axis=1)
                found.append((own, ids, sims, k))
            for layer in found:
                self._link(*layer)
            head = int(batch[level[batch].argmax()])
            if level[head] > done_top:
                self.entry, done_top = head, int(level[head])
        self.top = done_top
        self._repair()

    def _repair(self, links: int = 4) -> None:
        """Give ground nodes that no walk from the entry reaches a way in: links from the nearest nodes that it reaches, in
        further columns of the ground layer, until all are reached."""
        n = len(self.x)
        while n:
            adj = self.layers[0]
            reached = np.zeros(n, bool)
            front = np.array([self.entry])
            while len(front):
                reached[front] = True
                front = np.unique(adj[front])
                front = front[(front >= 0) & ~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            to, source = [], []
            for a in range(0, len(lost), 1024):
                part = lost[a : a + 1024]
                ids, _ = self.beam(self.x[part], np.full((len(part), 1), self.entry, np.int32), 48)
                for j in range(links):
                    ok = ids[:, j] >= 0
                    source.append(ids[ok, j])
                    to.append(part[ok])
            source, to = np.concatenate(source), np.concatenate(to)
            if not len(to):
                raise ValueError("a node without a direction: vectors must be finite and of length one")
            order = np.argsort(source, kind="stable")
            source, to = source[order], to[order]
            _, starts, counts = np.unique(source, return_index=True, return_counts=True)
            column = np.arange(len(source)) - np.repeat(starts, counts)
            keep = column < 8  # of many the first: they lead to their neighbours, and the next round sees to the rest
            more = np.full((n, int(column[keep].max()) + 1), -1, np.int32)
            more[source[keep], column[keep]] = to[keep]
            self.layers[0] = np.concatenate([adj, more], axis=1)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row's node than to any chosen before; slots left
        over go to the nearest of the rest, which keeps dense groups connected."""
        by_id = np.argsort(ids, axis=1, kind="stable")
        in_order = np.take_along_axis(ids, by_id, 1)
        again = np.zeros(ids.shape, bool)
        np.put_along_axis(again, by_id[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
        sims = np.where(again | (ids < 0), -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        picked, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        chosen = np.full((len(ids), most), -1, np.int32)
        for c in range(ids.shape[1]):
            r = np.flatnonzero(np.isfinite(sims[:, c]) & (count < most))
            if not len(r):
                continue
            have = chosen[r, : max(1, int(count[r].max()))]
            near = np.einsum("bmd,bd->bm", self.x[have], self.x[ids[r, c]])
            near[have < 0] = -np.inf
            r = r[(near < sims[r, c][:, None]).all(1)]
            chosen[r, count[r]] = ids[r, c]
            picked[r, c] = True
            count[r] += 1
        first = np.argsort(np.where(np.isfinite(sims), ~picked, 2), axis=1, kind="stable")[:, :most]
        out = np.where(np.isfinite(np.take_along_axis(sims, first, 1)), np.take_along_axis(ids, first, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        adj = self.layers[k]
        most = adj.shape[1]
        adj[own] = self._select(ids, sims, most)
        to, source = adj[own].ravel(), np.repeat(own, most)
        to, source = to[to >= 0], source[adj[own].ravel() >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 512):
            part, n = nodes[a : a + 512], np.minimum(counts[a : a + 512], 2 * most)
            new = np.full((len(part), int(n.max())), -1, np.int32)
            cols = np.arange(new.shape[1])[None, :]
            where = cols < n[:, None]
            new[where] = source[(starts[a : a + 512][:, None] + cols)[where]]
            both = np.concatenate([adj[part], new], axis=1)
            close = np.einsum("bmd,bd->bm", self.x[both], self.x[part])
            close[both < 0] = -np.inf
            adj[part] = self._select(both, close, most)

    def _descend(self, q: np.ndarray, top: int, down_to: int) -> np.ndarray:
        """The node that greedy walks reach from the entry through the layers above ``down_to``."""
        cur = np.full(len(q), self.entry, np.int32)
        best = q @ self.x[self.entry]
        for k in range(top, down_to, -1):
            active = np.arange(len(q))
            while len(active):
                near = self.layers[k][cur[active]]
                sims = np.einsum("bmd,bd->bm", self.x[near], q[active])
                sims[near < 0] = -np.inf
                j = sims.argmax(1)
                got = sims[np.arange(len(active)), j]
                better = got > best[active]
                active, j, got, near = active[better], j[better], got[better], near[better]
                cur[active], best[active] = near[np.arange(len(active)), j], got
        return cur

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, k: int = 0, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: each round opens the ``step`` best unopened nodes of every query's
        beam. Returns ids (-1: none) and similarities, best first."""
        adj, n = self.layers[k], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("bmd,bd->bm", self.x[start], q)
        np.put_along_axis(seen, start.astype(np.int64), True, 1)
        opened = ids < 0
        active = np.arange(n)
        while len(active):
            a_ids, a_sims, a_open = ids[active], sims[active], opened[active]
            order = np.argsort(np.where(a_open, np.inf, -a_sims), axis=1, kind="stable")[:, :step]
            pick = np.take_along_axis(a_ids, order, 1)
            fresh = ~np.take_along_axis(a_open, order, 1)
            np.put_along_axis(a_open, order, True, 1)
            near = np.where(fresh[:, :, None], adj[np.maximum(pick, 0)], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)  # repeats stand together
            dup = np.zeros(near.shape, bool)
            dup[:, 1:] = near[:, 1:] == near[:, :-1]
            bad = (near < 0) | dup | np.take_along_axis(seen[active], np.maximum(near, 0).astype(np.int64), 1)
            row, col = np.nonzero(~bad)
            got = near[row, col]
            seen[active[row], got] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[row, col] = np.einsum("md,md->m", self.x[got], q[active[row]])
            all_ids = np.concatenate([a_ids, np.where(bad, -1, near)], axis=1)
            all_sims = np.concatenate([a_sims, new], axis=1)
            all_open = np.concatenate([a_open, bad], axis=1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[active], sims[active] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            opened[active] = np.take_along_axis(all_open, keep, 1) | (ids[active] < 0)
            active = active[~opened[active].all(1)]
        return ids, sims

    def search(self, q: np.ndarray, exact: np.ndarray, least: float, beam: int):
        """Links of the unit vectors ``q`` (doubles) to nodes at a cosine of at least ``least`` by ``exact`` (the nodes in double
        precision), as (wide, rows, nodes) in turn. A query whose beam holds more than links is narrow and done
        with it; if the whole beam is near links, a range search walks on from there."""
        lean, n, wide, seeds = q.astype(np.float32), len(self.x), [np.zeros(0, np.int64)], []
        size = max(16, min(1024, (1 << 26) // max(1, n)))
        for a in range(0, len(q), size):
            ids, sims = self.beam(lean[a : a + size], self._descend(lean[a : a + size], self.top, 0)[:, None], beam)
            near = sims >= least - MARGIN
            full = near.all(1)
            row, col = np.nonzero(near & ~full[:, None])
            node = ids[row, col].astype(np.int64)
            ok = np.einsum("md,md->m", exact[node], q[a + row]) >= least
            yield False, a + row[ok], node[ok]
            wide.append(a + np.flatnonzero(full))
            seeds.append(ids[full])
        wide = np.concatenate(wide)
        if len(wide):
            seeds = np.concatenate(seeds)
            side = np.random.default_rng(3).standard_normal((q.shape[1], 64))
            order = np.argsort((q[wide] @ side).argmax(1), kind="stable")  # near queries share most of their walk
            for a in range(0, len(wide), 256):
                part = order[a : a + 256]
                for row, node in self._range(q[wide[part]], exact, np.unique(seeds[part]), least):
                    yield True, wide[part][row], node

    def _range(self, q: np.ndarray, exact: np.ndarray, front: np.ndarray, least: float):
        """All links of a few queries that walks over nodes near any of them reach, as (rows, nodes) in turn."""
        seen = np.zeros(len(self.x), bool)
        front = front[front >= 0]
        seen[front] = True
        while len(front):
            more = []
            for a in range(0, len(front), 4096):
                part = front[a : a + 4096]
                sims = q @ exact[part].T
                row, col = np.nonzero(sims >= least)
                yield row, part[col].astype(np.int64)
                more.append(part[(sims >= least - SLACK).any(0)])
            near = self.layers[0][np.concatenate(more)]
            front = np.unique(near[near >= 0])
            front = front[~seen[front]]
            seen[front] = True


def recalled(hits: np.ndarray, links: np.ndarray, few: int, recall: float) -> bool:
    """Whether audited queries found ``hits`` of their ``links`` to the share ``recall``: in total, on average over the queries
    that have links, and on average over those of them with fewer than ``few``, which large groups would outweigh."""
    hits, links = hits[links > 0], links[links > 0]
    rare = links < few
    return hits.sum() >= recall * links.sum() and all((hits[m] / links[m]).mean() >= recall for m in (rare | True, rare) if m.any())


def _turned(exact: np.ndarray, away: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors turned in the directions ``away`` until their cosine to themselves is just above ``least``."""
    away = away - np.einsum("bd,bd->b", away, exact)[:, None] * exact
    size = np.linalg.norm(away, axis=1, keepdims=True)
    cos = least + 0.1 * (1 - least)
    return _unit(np.where(size > 1e-9, cos * exact + np.sqrt(max(0.0, 1 - cos * cos)) * away / np.maximum(size, 1e-9), exact))


def audited(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, beam: int, recall: float, audit: int) -> tuple[int, int, int]:
    """The beam, doubled until audits pass, and the true links and found ones of the last audit. Audited are ``audit`` of the
    queries and as many probes: nodes turned away from themselves until just above ``least``, so that each has a link and
    no audit passes on nothing. A beam as wide as the graph ends it: such a beam opens every node."""
    rng = np.random.default_rng(11)
    nodes = rng.permutation(len(exact))[:audit]
    away = rng.standard_normal((len(nodes), exact.shape[1]))
    probes = _turned(exact[nodes], away, least)
    asked = np.concatenate([q[rng.permutation(len(q))[:audit]], probes])
    truth = np.concatenate([(asked[a : a + 64] @ exact.T >= least).sum(1) for a in range(0, len(asked), 64)])
    while True:
        hits = np.zeros(len(asked), np.int64)
        for _, row, _ in graph.search(asked, exact, least, beam):
            hits += np.bincount(row, minlength=len(asked))
        if beam >= len(exact) or recalled(hits, truth, beam, recall):
            return beam, int(truth.sum()), int(hits.sum())
        beam *= 2


def _vectors(column: pa.Array):
    """A batch's usable vectors by length: (length, rows, matrix). Left out are those that are null, empty, zero, or hold null or
    non-finite components."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = values[starts[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        if ok.any():
            yield dim, rows[ok], x[ok]


def _keys(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(v, digest_size=16).digest() for v in x]


def _table(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[k]) for c, k in zip(columns, kinds)], list(names))


KEYED = "vec_id long, key binary, dim int, vec binary"


def _keyed(share: float):
    """Rows with a key of their vector (null: unusable) and, for ``share`` of all keys, its bytes."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            key, dims, vec = [None] * n, [None] * n, [None] * n
            for dim, rows, x in _vectors(b.column("embedding")):
                for r, k, v in zip(rows.tolist(), _keys(x), x):
                    key[r], dims[r] = k, dim
                    if int.from_bytes(k[:6], "little") < share * (1 << 48):
                        vec[r] = v.tobytes()
            yield _table(KEYED, b.column("vec_id"), key, dims, vec)

    return run


class Cells:
    """Cells of the vectors of one length: each has a node in a graph, and a row joins the cells of the ``COPIES`` nearest nodes
    that a search of the graph finds. Linked rows meet in a cell that both join."""

    def __init__(self, sample: np.ndarray, cells: int, beam: int):
        self.beam, lean, chosen = beam, sample.astype(np.float32), []
        free = np.ones(len(lean), bool)
        for i in range(len(lean)):
            if free[i] and len(chosen) < cells:
                chosen.append(i)
                free &= lean @ lean[i] < APART
        self.graph = Graph(lean[chosen])
        self.blocks = np.ones(len(chosen), np.int64)

    def of(self, q: np.ndarray) -> np.ndarray:
        """For each unit vector the cells it joins, -1: none."""
        lean, out = q.astype(np.float32), np.full((len(q), COPIES), -1, np.int32)
        for a in range(0, len(q), 1024):
            part = lean[a : a + 1024]
            ids, sims = self.graph.beam(part, self.graph._descend(part, self.graph.top, 0)[:, None], max(self.beam, COPIES))
            ids, sims = ids[:, :COPIES], sims[:, :COPIES]
            out[a : a + 1024] = np.where(sims >= sims[:, :1] - REACH, ids, -1)
        return out

    def met(self, sample: np.ndarray, least: float, most: int) -> np.ndarray:
        """Whether sampled rows meet their probes: each row turned away until just above ``least``, half of them in a random
        direction, the others towards another sampled row."""
        rng = np.random.default_rng(11)
        exact = sample[rng.integers(0, len(sample), most)]
        away = rng.standard_normal(exact.shape)
        away[::2] = sample[rng.integers(0, len(sample), len(away[::2]))]
        return _share(self.of(exact), self.of(_turned(exact, away, least)))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of cells have one in common (-1 counts for none)."""
    return ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any((1, 2))


def fitted(sample: np.ndarray, least: float, cells: int, beam: int, recall: float, audit: int) -> tuple[Cells, np.ndarray, int]:
    """Cells for sampled unit vectors, halved in number until the share ``recall`` of probes meets its row; with one cell all do."""
    while True:
        out = Cells(sample, cells, beam)
        met = out.met(sample, least, 64 * audit)
        if met.mean() >= recall or cells <= 1:
            return out, met, cells
        cells //= 2


def _record(dim: int) -> np.dtype:
    return np.dtype([("key", "V16"), ("n", "<i4"), ("side", "<i2"), ("cells", "<i2", COPIES), ("x", "<f2", dim)])


ROUTED = "dim int, cell int, i int, j int, data binary"


def _route(shared, least: float):
    """Copies of each distinct vector of a batch, one for each of its cells; in a cell of several blocks, one for each pair of blocks with
    its own. Lastly, as cell -1, how many rows each audited vector links to by brute force, itself included."""

    def copies(dim: int, cells: Cells | None, exact: np.ndarray, keys: np.ndarray, n: np.ndarray):
        rec = np.zeros(len(n), _record(dim))
        rec["key"], rec["n"], rec["x"] = keys, n, exact
        rec["cells"] = cells.of(exact) if cells else [0] + [-1] * (COPIES - 1)
        rec["cells"].sort(axis=1)
        row, col = np.nonzero(rec["cells"] >= 0)
        cell = rec["cells"][row, col].astype(np.int32)
        blocks = cells.blocks[cell] if cells else np.ones(len(cell), np.int64)
        own = np.frombuffer(keys.tobytes(), "<u4")[::4][row] % blocks
        other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row, cell, own = (np.repeat(c, blocks) for c in (row, cell, own))
        for a in range(0, len(row), 20_000):
            part = slice(a, a + 20_000)
            out = rec[row[part]]
            out["side"] = own[part]
            offsets = np.arange(len(out) + 1, dtype=np.int32) * rec.dtype.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
            yield _table(ROUTED, np.full(len(out), dim, np.int32), cell[part], np.minimum(own, other)[part].astype(np.int32), np.maximum(own, other)[part].astype(np.int32), data)

    def run(batches):
        truth = {}
        for b in batches:
            for dim, _, x in _vectors(b.column("embedding")):
                cells, asked = shared.value.get(dim, (None, None))
                keys, first, n = np.unique(np.array(_keys(x), "V16"), return_index=True, return_counts=True)
                exact = _unit(x[first].astype(np.float64))
                if asked is not None:
                    truth[dim] = truth.get(dim, 0) + n @ (exact @ asked.T >= least)
                yield from copies(dim, cells, exact, keys, n)
        for dim, counts in truth.items():
            yield _table(ROUTED, [dim], [-1], [0], [0], [counts.astype("<i8").tobytes()])

    return run


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a binary column, one row after another."""
    out = []
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]])
    return np.concatenate(out)


#: What a cell gives: 0 the number w of links of a; 3 an edge that joins components; 5 a pair to be compared exactly; 9 the number w of
#: links of audited vector a (its number in four bytes) by brute force, for vectors of length v.
FOUND = "kind int, a binary, b binary, w long, v long"


def _bounding(x: np.ndarray) -> np.ndarray:
    """Vectors of half the length whose products are at least those of ``x``: half of the components, and the norm of the rest
    (Cauchy-Schwarz)."""
    half = (x.shape[1] + 1) // 2
    return np.concatenate([x[:, :half], np.linalg.norm(x[:, half:], axis=1, keepdims=True)], axis=1)


def _compare(least: float):
    """A function over the copies in a cell, or in two blocks of it, that finds all links of pairs that share no lower cell."""

    def run(table: pa.Table) -> pa.Table:
        dim, cell, i, j = (table.column(c)[0].as_py() for c in ("dim", "cell", "i", "j"))
        out = []
        if cell < 0:
            counts = np.frombuffer(_bytes(table.column("data")).tobytes(), "<i8").reshape(table.num_rows, -1).sum(0)
            out.append(_table(FOUND, [9] * len(counts), [k.to_bytes(4, "little") for k in range(len(counts))], [None] * len(counts), counts, [dim] * len(counts)))
            return pa.Table.from_batches(out)
        rec = _bytes(table.column("data")).view(_record(dim))
        keys, first, group = np.unique(rec["key"], return_index=True, return_inverse=True)
        n = np.bincount(group, rec["n"]).astype(np.int64)
        rec = rec[first]
        order = np.argsort(rec["side"], kind="stable")
        rec, keys, n = rec[order], keys[order], n[order]
        x, lower = rec["x"].astype(np.float32), np.where(rec["cells"] < cell, rec["cells"], -1)
        half = _bounding(x)
        split = int(np.searchsorted(rec["side"], j)) if i < j else len(rec)
        at, end = (split, len(rec)) if i < j else (0, len(rec))
        total, label, edges, doubts = np.zeros(len(rec)), np.arange(len(rec)), [], []
        room = np.empty(512 * 1024, np.float32)  # products stay in a core's cache
        for a in range(0, split, 512):
            for b in range(a if i == j else at, end, 1024):
                u, v = slice(a, min(a + 512, split)), slice(b, min(b + 1024, end))
                shape = u.stop - a, v.stop - b
                s = np.dot(half[u], half[v].T, out=room[: shape[0] * shape[1]].reshape(shape))
                if s.max() < least - DOUBT:
                    continue
                flat = np.flatnonzero(s >= least - DOUBT)
                full = len(flat) > s.size >> 7  # many are left: whole products cost less than one by one
                if full:
                    s = x[u] @ x[v].T
                    flat = np.flatnonzero(s >= least - DOUBT)
                for c in range(0, len(flat), 1 << 17):
                    row, col = np.divmod(flat[c : c + (1 << 17)], s.shape[1])
                    sims = s[row, col] if full else np.einsum("md,md->m", x[row + a], x[col + b])
                    row, col = row + a, col + b
                    ok = (row < col) & (sims >= least - DOUBT)
                    ok[ok] = ~_share(lower[row[ok]], lower[col[ok]])
                    row, col, sure = row[ok], col[ok], sims[ok] >= least + DOUBT
                    doubts.append((row[~sure], col[~sure]))
                    row, col = row[sure], col[sure]
                    total += np.bincount(row, n[col], len(rec)) + np.bincount(col, n[row], len(rec)) if len(row) else 0
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    for p, q in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
                        me, others = label[row[p]], label[col[p:q]]
                        near, at_first = np.unique(others, return_index=True)
                        new = near != me
                        if new.any():
                            edges += [(row[p], col[p + k]) for k in at_first[new].tolist()]
                            label[np.isin(label, near)] = me
        key = lambda rows: [keys[r].tobytes() for r in rows]
        some = np.flatnonzero(total)
        out.append(_table(FOUND, [0] * len(some), key(some), [None] * len(some), total[some].astype(np.int64), [0] * len(some)))
        row, col = (np.concatenate([d[k] for d in doubts]) if doubts else np.zeros(0, int) for k in (0, 1))
        for kind, u, v in ((3, [e[0] for e in edges], [e[1] for e in edges]), (5, row, col)):
            out.append(_table(FOUND, [kind] * len(u), key(u), key(v), [0] * len(u), [0] * len(u)))
        return pa.Table.from_batches(out)

    return run


def _verify(least: float):
    """Of pairs (a, dim, vec_a, b, vec_b, n_a, n_b) those at ``least`` or above in double precision."""

    def run(batches):
        for b in batches:
            for dim in np.unique(b.column("dim").to_numpy()).tolist():
                part = b.filter(pa.array(b.column("dim").to_numpy() == dim))
                x, y = (_unit(np.stack([np.frombuffer(v.as_py(), f"<f{len(v.as_py()) // dim}") for v in part.column(c)]).astype(np.float64)) for c in ("vec_a", "vec_b"))
                part = part.filter(pa.array(np.einsum("bd,bd->b", x, y) >= least))
                yield part.select(["a", "b", "n_a", "n_b"])

    return run


def _exactly(rows: DataFrame, groups: DataFrame, doubt: DataFrame, least: float) -> DataFrame:
    """Those of the pairs of keys ``doubt`` that link in double precision, with the counts n_a and n_b of their vectors."""
    ends = stored(doubt.select(F.col("a").alias("key")).union(doubt.select("b")).distinct(), "ends")
    maybe = KeyFilter(stored(ends.select(F.xxhash64("key").alias("key")), "hashes"))
    vecs = maybe.mark(rows.mapInArrow(_keyed(1), KEYED).where("key is not null"), F.xxhash64("key")).where("__maybe").join(ends, "key", "left_semi")
    vecs = stored(vecs.groupBy("key", "dim").agg(F.first("vec").alias("vec")).join(groups.select("key", "n"), "key"), "vecs")
    sides = [vecs.select(F.col("key").alias(c), "dim", F.col("vec").alias(f"vec_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b")]
    pairs = stored(doubt.select("a", "b").join(sides[0], "a").join(sides[1].drop("dim"), "b"), "pairs")
    return stored(pairs.mapInArrow(_verify(least), "a binary, b binary, n_a long, n_b long"), "exact")


def _units(sample: list) -> dict[int, tuple[list[bytes], np.ndarray]]:
    """Sampled rows (dim, key, vec) as keys and unit vectors by length, in the order of their keys."""
    out: dict = {}
    for dim, key, vec in sorted((r.dim, bytes(r.key), bytes(r.vec)) for r in sample):
        keys, vecs = out.setdefault(dim, ([], []))
        keys.append(key)
        vecs.append(np.frombuffer(vec, f"<f{len(vec) // dim}"))
    return {dim: (keys, _unit(np.stack(vecs).astype(np.float64))) for dim, (keys, vecs) in out.items()}


def embedding_groups(vectors: DataFrame, least: float = 0.9, shards: int = 4, block_rows: int = 200_000, beam: int = 32, recall: float = 0.99, audit: int = 64) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    A graph is fitted on a bounded sample of the vectors: the square root of their number, nodes no nearer to each other than
    ``APART``, at least ``shards``. Every row searches it and joins the cells of the nearest nodes; in each cell all pairs are compared, in
    half precision by matrix products, and exactly, by cosine in double precision, where that leaves doubt, so that no pair below
    ``least`` links. A pair counts in the lowest cell that both join, for both ends. Cells of more than about ``block_rows`` rows are
    compared in pairs of blocks. The number of cells is halved until audits find the share ``recall``: first of probes (sampled rows turned away
    until just above ``least``) that meet their row, then, after the comparison, of the links that brute force over all rows
    finds for ``audit`` vectors. One cell compares everything, so this ends. Equal vectors are one node with a count.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors
    of different lengths; their component is themselves. Rows that repeat are vectors of their own; a null vec_id never is
    a component's id if another exists; other columns are ignored; an empty table gives an empty result.
    """
    spark, column = vectors.sparkSession, F.col("embedding")
    if not isinstance(vectors.schema["embedding"].dataType.elementType, FloatType):
        column = column.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column.alias("embedding"))
    total = rows.count()
    share = max(1024, SPARE * min(NODES, math.isqrt(total) + 1)) / max(1, total)
    keyed = stored(rows.mapInArrow(_keyed(share), KEYED), "keyed")
    groups = keyed.where("key is not null").groupBy("key", "dim").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    groups = stored(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    numbers = {r.dim: r["count"] for r in groups.groupBy("dim").count().collect()}
    sample = _units(keyed.where("vec is not null").groupBy("dim", "key").agg(F.first("vec").alias("vec")).collect())
    most = {dim: max(shards, min(NODES, math.isqrt(numbers[dim]) + 1)) for dim in sample}
    parts = max(tasks(spark), total * COPIES * _record(max(numbers, default=1)).itemsize >> 26)
    while True:
        shared, met = {}, []
        for dim, (_, x) in sample.items():
            cells, ok, most[dim] = fitted(x, least, most[dim], beam, recall, audit)
            joined = cells.of(x)
            cells.blocks = -(-np.bincount(joined[joined >= 0], minlength=len(cells.blocks)) * numbers[dim] // (len(x) * block_rows))
            cells.blocks = np.maximum(cells.blocks, 1)
            shared[dim] = cells, x[:audit]
            met.append(ok)
        graphs = spark.sparkContext.broadcast(shared)
        where = ["dim", "cell", "i", "j"]
        found = rows.mapInArrow(_route(graphs, least), ROUTED).repartition(parts, *where).groupBy(*where).applyInArrow(_compare(least), FOUND)
        found = stored(found, "found")
        graphs.unpersist()
        links, counts = found.where("kind = 3").select("a", "b"), found.where("kind = 0").select(F.col("a").alias("key"), "w")
        doubt = found.where("kind = 5").select("a", "b")
        if doubt.limit(1).count():
            exact = _exactly(rows, groups, doubt, least)
            links = links.union(exact.select("a", "b"))
            counts = counts.union(exact.select("a", "n_b")).union(exact.select("b", "n_a"))
        counts = stored(counts.groupBy("key").agg(F.sum("w").alias("w")), "counts")
        # what brute force has for the audited vectors, and what was found
        truth = {(r.v, int.from_bytes(r.a, "little")): r.w for r in found.where("kind = 9").groupBy("v", "a").agg(F.sum("w").alias("w")).collect()}
        asked = [k for keys, _ in sample.values() for k in keys[:audit]]
        got = groups.where(F.col("key").isin([F.lit(bytearray(k)) for k in asked])).join(counts, "key", "left") if asked else groups.limit(0).withColumn("w", F.lit(0))
        got = {bytes(r.key): r.n + (r.w or 0) - 1 for r in got.select("key", "n", "w").collect()}
        pairs = [(got[keys[k]], truth[dim, k] - 1) for dim, (keys, _) in sample.items() for k in range(min(audit, len(keys)))]
        hits, all_links = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        met = np.concatenate([*met, np.zeros(0, bool)]).astype(np.int64)
        if recalled(np.concatenate([hits, met]), np.concatenate([all_links, np.ones_like(met)]), beam, recall) or all(m <= 1 for m in most.values()):
            break
        most = {dim: max(1, m // 2) for dim, m in most.items()}
    ids = [groups.select(F.col("key").alias(c), F.col("gid").alias(g)) for c, g in (("a", "u"), ("b", "v"))]
    labels = components(links.join(ids[0], "a").join(ids[1], "b").select("u", "v"))
    linked = stored(groups.join(labels.withColumnRenamed("node", "gid"), "gid").select("key", "label", "least_id"), "linked")
    least_id = linked.groupBy("label").agg(F.min("least_id").alias("component_id"))
    known = groups.join(counts, "key", "left").join(linked.join(least_id, "label").select("key", "component_id"), "key", "left")
    known = stored(known.select("key", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "known")
    out = keyed.where("key is not null").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
