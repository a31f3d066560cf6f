"""Embedding near-duplicates by navigable small-world graphs.

Equal vectors become one node. Nodes are dealt into shards of bounded size by a hash, and each shard gets a hierarchical
navigable small-world graph: layers of geometrically falling size, each node linked to near and mutually distant others.
Of each two shards the nodes of one are then searched for in the other, and those of each shard in itself, by blocks of
queries: a descent through the upper layers, and a beam in the lowest. Graphs travel in small parts, and queries stream behind them, so that no row and no group is large. A query whose beam holds nothing but links is in a dense group and compared with all nodes of the shard, in
tiles. Of the others in a block, the links of a sample are counted exactly; while its queries find on average too small a
share of their own links, all beams are widened. Cosines of what was found are verified in double precision. A block
returns the number of links of each query, and a spanning forest of the links, from which the components are joined; pairs
are added up as they are found and never held, whatever the size of a group.

Searches are vectorised: all queries of a block advance in step, as rows of numpy arrays.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.common import Workspace, lean
from readqc.llm.components import connected_components

NEAR = 0.9
_SLACK = 1e-4  # single-precision cosines may be off by less
_PART = 1 << 16  # bytes of a graph in one row


class Graph:
    """Layers of neighbour tables over unit vectors; ``layers[0]`` has all nodes, row i of a table the neighbours of node
    i (-1: none). Nodes stand in the order of insertion, those of upper layers first."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = 16, beam: int = 48, first: int = 64, batch: int = 1024) -> Graph:
        """Layer k has n / degree^k nodes. A layer starts as an exact neighbour graph of its first nodes; then come batches
        as large as what is there at most, each node linked to what its beam and its own batch offer."""
        sizes = [len(vectors)]
        while sizes[-1] > first:
            sizes.append(max(1, sizes[-1] // degree))
        self = cls(vectors, [np.zeros((0, 0), np.int32)] * len(sizes))
        for k in range(len(sizes) - 1, -1, -1):
            width = 2 * degree if k == 0 else degree
            self.layers[k] = np.full((sizes[k], width), -1, np.int32)
            done = min(first, sizes[k])
            self._link(k, np.arange(done), np.zeros((done, 0), np.int32), degree)
            while done < sizes[k]:
                new = np.arange(done, min(sizes[k], done + min(done, batch)))
                found, _ = self._beam(k, vectors[new], self._descend(vectors[new], k, done), beam, limit=done)
                self._link(k, new, found, degree)
                done = int(new[-1]) + 1
        return self

    def _choose(self, base: np.ndarray, ids: np.ndarray, want: int) -> np.ndarray:
        """Of each row's candidates (-1: none) up to ``want``: nearest first those that are nearer to the base than to any
        chosen one, then the nearest others."""
        v = self.vectors
        sims = np.einsum("md,mcd->mc", v[base], v[np.maximum(ids, 0)])
        again = np.sort(ids, 1)
        if (again[:, 1:] == again[:, :-1]).any():
            order = np.argsort(ids, 1, kind="stable")
            sorted_ids = np.take_along_axis(ids, order, 1)
            twice = np.zeros(ids.shape, bool)
            np.put_along_axis(twice, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
            ids = np.where(twice, -1, ids)
        ids = np.where(ids == base[:, None], -1, ids)
        sims = np.where(ids >= 0, sims, -np.inf)
        order = np.argsort(-sims, 1, kind="stable")[:, : max(want * 3, 32)]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        near = v[np.maximum(ids, 0)]
        between = near @ near.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf, np.float32)  # to any chosen one
        left = np.full(len(ids), want // 2)
        for j in range(ids.shape[1]):
            ok = (ids[:, j] >= 0) & (sims[:, j] >= closest[:, j]) & (left > 0)
            taken[:, j] = ok
            left -= ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
        rank = np.where(ids >= 0, np.where(taken, 0, 1), 2)
        order = np.argsort(rank, 1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, 1)

    def _link(self, k: int, new: np.ndarray, found: np.ndarray, degree: int, block: int = 256) -> None:
        table, v = self.layers[k], self.vectors
        width = table.shape[1]
        own = min(len(new), degree + 1)
        chosen = np.full((len(new), degree), -1, np.int32)
        for i in range(0, len(new), block):
            part = new[i : i + block]
            sims = v[part] @ v[new].T
            mates = new[np.argpartition(-sims, own - 1, 1)[:, :own]] if own < len(new) else np.broadcast_to(new, sims.shape)
            offer = np.concatenate([found[i : i + block], mates], 1).astype(np.int32)
            got = self._choose(part, offer, degree)
            chosen[i : i + block, : got.shape[1]] = got
        table[new, :degree] = chosen
        to, back = chosen.ravel(), np.repeat(new, degree)
        back, to = back[to >= 0], to[to >= 0]
        if not len(to):
            return
        near = np.einsum("ed,ed->e", v[to], v[back])
        order = np.lexsort((-near, to))
        to, back = to[order], back[order]
        start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        place = np.arange(len(to)) - np.repeat(start, np.diff(np.r_[start, len(to)]))
        few = place < width
        to, back, place = to[few], back[few], place[few]
        targets, row = np.unique(to, return_inverse=True)
        extra = np.full((len(targets), width), -1, np.int32)
        extra[row, place] = back
        for i in range(0, len(targets), block):
            part = targets[i : i + block]
            got = self._choose(part, np.concatenate([table[part], extra[i : i + block]], 1), width)
            table[part] = -1
            table[part, : got.shape[1]] = got

    def _descend(self, queries: np.ndarray, to: int, limit: int, entries: int = 4) -> np.ndarray:
        """Entry nodes of each query for layer ``to``, below ``limit``."""
        top = len(self.layers) - 1
        if top == to:
            return np.broadcast_to(np.arange(min(limit, entries)), (len(queries), min(limit, entries)))
        start = np.broadcast_to(np.arange(min(len(self.layers[top]), entries)), (len(queries), min(len(self.layers[top]), entries)))
        for k in range(top, to, -1):
            found, _ = self._beam(k, queries, start, 8 if k > to + 1 else 12)
            start = found[:, :entries]
        return np.where(start < limit, start, 0)

    def _beam(self, k: int, queries: np.ndarray, start: np.ndarray, beam: int, limit: int | None = None, block: int = 256, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query, and their cosines, best first (-1: none)."""
        table, n = self.layers[k], limit or len(self.layers[k])
        out_ids, out_sims = [], []
        for i in range(0, len(queries), block):
            q, s = queries[i : i + block], start[i : i + block]
            m = len(q)
            rows = np.arange(m)
            seen = np.zeros((m, n + 1), bool)
            seen[:, n] = True
            ids = np.full((m, beam), n, np.int64)
            sims = np.full((m, beam), -np.inf, np.float32)
            spent = np.ones((m, beam), bool)
            new = np.where(s >= 0, s, n)
            live = rows
            while True:
                # Of the offered nodes the unseen ones; a node offered twice in a row counts once.
                fresh = ~seen[live[:, None], new]
                order = np.argsort(new, 1, kind="stable")
                sorted_new = np.take_along_axis(new, order, 1)
                once = np.ones(new.shape, bool)
                np.put_along_axis(once, order[:, 1:], sorted_new[:, 1:] != sorted_new[:, :-1], 1)
                fresh &= once
                seen[live[:, None], new] = True
                got = np.full(new.shape, -np.inf, np.float32)
                r, c = np.nonzero(fresh)
                got[r, c] = np.einsum("ed,ed->e", q[live[r]], self.vectors[new[r, c]])
                both_sims = np.concatenate([sims[live], got], 1)
                both_ids = np.concatenate([ids[live], np.where(fresh, new, n)], 1)
                both_spent = np.concatenate([spent[live], ~fresh], 1)
                best = np.argpartition(-both_sims, beam - 1, 1)[:, :beam]
                sims[live], ids[live], spent[live] = (np.take_along_axis(x, best, 1) for x in (both_sims, both_ids, both_spent))
                open_sims = np.where(spent[live], -np.inf, sims[live])
                going = (open_sims > -np.inf).any(1)
                live, open_sims = live[going], open_sims[going]
                if not len(live):
                    break
                w = min(at_once, beam)
                pick = np.argpartition(-open_sims, w - 1, 1)[:, :w]
                valid = np.take_along_axis(open_sims, pick, 1) > -np.inf
                node = np.take_along_axis(ids[live], pick, 1)
                spent[live[:, None], pick] = True
                near = table[np.where(valid, node, 0)]
                near = np.where(valid[:, :, None] & (near >= 0) & (near < n), near, n)
                new = near.reshape(len(live), -1).astype(np.int64)
            order = np.argsort(-sims, 1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            out_ids.append(np.where(sims > -np.inf, ids, -1))
            out_sims.append(sims)
        return np.concatenate(out_ids), np.concatenate(out_sims)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(0, queries, self._descend(queries, 0, len(self.vectors)), min(beam, len(self.vectors)))

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) of the nodes found at a cosine of ``least`` or more, and the queries whose beams are full of such
        nodes; these have no pairs."""
        if beam >= len(self.vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(queries))
        ids, sims = self.search(queries, beam)
        hit = sims >= least
        full = hit.all(1)
        q, c = np.nonzero(hit & ~full[:, None])
        return q, ids[q, c], np.flatnonzero(full)

    def wide_enough(self, queries: np.ndarray, least: float, own: np.ndarray, beam: int, sample: int = 256, most: int = 2048, enough: int = 64, recall: float = 0.99) -> int:
        """A beam with which sampled queries (those that it isn't full of links for) find on average at least ``recall`` of
        their exact links; ``own`` is each query's place in the graph (-1: none), no link of it. A sample has ``sample``
        queries, and up to ``most`` until ``enough`` of them have links."""
        # Strides over the queries, one place on each time, so that any first of them lie all over them.
        step = max(1, len(queries) // 64)
        order = np.concatenate([np.arange(k, len(queries), step) for k in range(step)])[:most]
        checked, truth, linked = [], [], 0
        for i in range(0, len(order), 64):
            if i >= sample and linked >= enough:
                break
            some = order[i : i + 64]
            near = queries[some] @ self.vectors.T >= least
            near[np.flatnonzero(own[some] >= 0), own[some][own[some] >= 0]] = False
            checked.append(some)
            truth.append(near.sum(1))
            linked += int((truth[-1] > 0).sum())
        if not linked:
            return beam
        checked, truth = np.concatenate(checked), np.concatenate(truth)
        checked, truth = checked[truth > 0], truth[truth > 0]
        while beam < len(self.vectors):
            q, n, full = self.within(queries[checked], least, beam)
            counts = np.bincount(q[n != own[checked[q]]], minlength=len(checked))
            counts[full] = truth[full]  # they are compared with all nodes
            if np.minimum(counts / truth, 1).mean() >= recall:
                break
            beam *= 2
        return beam

    def links(self, queries: np.ndarray, least: float, own: np.ndarray, found: Links, beam: int = 32, block: int = 1024) -> None:
        """Put the links of all queries to ``found``. Beams are as wide as an audit of queries asks for whose beams aren't
        full of links; a query whose beam is full of them, in a dense group, is compared with all nodes."""
        few, kept, dense = [], [], []
        for i in range(0, len(queries), block):
            q, n, full = self.within(queries[i : i + block], least, beam)
            kept.append((i + q, n))
            dense.append(i + full)
            few.append(np.setdiff1d(np.arange(i, min(i + block, len(queries))), i + full))
        few = np.concatenate(few)
        width = self.wide_enough(queries[few], least, own[few], beam) if len(few) else beam
        if width == beam:
            for q, n in kept:
                found.add(q, n)
        else:
            for i in range(0, len(few), block):
                part = few[i : i + block]
                q, n, full = self.within(queries[part], least, width)
                found.add(part[q], n)
                dense.append(part[full])
        found.compare(np.concatenate(dense))


class Links:
    """How many links each query of a block has, and which nodes and queries are connected. No pairs are kept: what is
    held grows with the nodes and queries, not with the links of a dense group. ``back`` has the links of nodes to queries
    that aren't nodes, each as many as ``weights`` says."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, weights: np.ndarray | None = None):
        self.vectors, self.copies, self.queries, self.own, self.least = vectors, copies, queries, own, least
        self.counts, self.back = np.zeros(len(queries), np.int64), np.zeros(len(vectors), np.int64)
        self.weights = np.where(own < 0, np.ones(len(queries), np.int64) if weights is None else weights, 0)
        # Nodes by their place, then the queries that aren't nodes.
        self.place = np.where(own >= 0, own, len(vectors) + np.arange(len(queries)))
        self.root = np.arange(len(vectors) + len(queries))

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        parent = self.root

        def find(x: int) -> int:
            while (p := int(parent[x])) != x:
                parent[x] = x = int(parent[p])
            return x

        for x, y in np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], 1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        self.root = parent

    def add(self, q: np.ndarray, n: np.ndarray, at_once: int = 65_536) -> None:
        """Pairs found, to be verified in double precision."""
        for i in range(0, len(q), at_once):
            a, b = q[i : i + at_once], n[i : i + at_once]
            ok = (np.einsum("ed,ed->e", self.queries[a], self.vectors[b]) >= self.least) & (self.own[a] != b)
            np.add.at(self.counts, a[ok], self.copies[b[ok]])
            np.add.at(self.back, b[ok], self.weights[a[ok]])
            self.unite(self.place[a[ok]], b[ok])

    def compare(self, queries: np.ndarray, rows: int = 256, columns: int = 8192) -> None:
        """All pairs of ``queries`` and nodes, tile by tile; cosines that single precision leaves open are verified."""
        single = self.vectors.astype(np.float32) if len(queries) else None
        for i in range(0, len(queries), rows):
            q = queries[i : i + rows]
            mine = self.queries[q].astype(np.float32)
            for k in range(0, len(self.vectors), columns):
                sims = mine @ single[k : k + columns].T
                near = sims >= self.least + _SLACK
                r, c = np.nonzero((sims >= self.least - _SLACK) & ~near)
                for s in range(0, len(r), 65_536):
                    a, b = r[s : s + 65_536], c[s : s + 65_536]
                    near[a, b] = np.einsum("ed,ed->e", self.queries[q[a]], self.vectors[k + b]) >= self.least
                inside = np.flatnonzero((self.own[q] >= k) & (self.own[q] < k + near.shape[1]))
                near[inside, self.own[q[inside]] - k] = False
                self.counts[q] += near @ self.copies[k : k + columns]
                self.back[k : k + columns] += self.weights[q] @ near
                self._connect(near, self.place[q], np.arange(k, k + near.shape[1]))

    def _connect(self, near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Unite what a tile's links connect: the least root goes from rows to columns and back until none changes."""
        of_rows, of_columns = self.root[rows], self.root[columns]
        none = len(self.root)
        while True:
            to_columns = np.minimum(of_columns, np.where(near, of_rows[:, None], none).min(0))
            to_rows = np.minimum(of_rows, np.where(near, to_columns, none).min(1))
            if np.array_equal(to_rows, of_rows) and np.array_equal(to_columns, of_columns):
                break
            of_rows, of_columns = to_rows, to_columns
        self.unite(np.concatenate([rows, columns]), np.concatenate([of_rows, of_columns]))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place that is connected to a lesser one, and the least one it is connected to."""
        some = np.flatnonzero(self.root != np.arange(len(self.root)))
        return some, self.root[some]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe against overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = values.chunk(0)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[bytes | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows in the order of (dim, shard, slot, part): a group's graph and up to ``block`` of its queries at a time, as
    names, copies and vectors. A graph stands in front of its queries in parts; it comes with the first of their blocks, and None with
    the others. Queries without a graph, and graphs without queries, are left out."""
    at, parts, graph, queries, held = None, [], None, [], 0

    def some() -> tuple[bytes | None, np.ndarray, np.ndarray, np.ndarray]:
        nonlocal graph, queries, held
        names, copies, vectors = (pa.concat_arrays([q.column(k) for q in queries]) for k in ("node", "copies", "v"))
        out = graph, names.to_numpy(), copies.to_numpy(), _matrix(vectors)
        graph, queries, held = None, [], 0
        return out

    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in ("dim", "shard", "slot")])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for start, end in zip(np.r_[0, edges].tolist(), np.r_[edges, batch.num_rows].tolist(), strict=True):
            if end == start:
                continue
            if (group := tuple(key[:, start])) != at:
                if held:
                    yield some()
                at, parts, graph, there = group, [], None, False
            rows = batch.slice(start, end - start)
            first = rows.num_rows - rows.column("part").null_count
            parts += rows.column("graph").slice(0, first).to_pylist()
            if first == rows.num_rows:
                continue
            if parts:
                graph, parts, there = b"".join(parts), [], True
            while there and first < rows.num_rows:
                n = min(block - held, rows.num_rows - first)
                queries.append(rows.slice(first, n))
                first, held = first + n, held + n
                if held == block:
                    yield some()
    if held:
        yield some()


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = NEAR, least_shards: int = 4, shard_size: int = 50_000, block: int = 16_384, shard_bytes: int = 64 << 20, slot_size: int = 131_072, least_tasks: int = 32) -> DataFrame:
    """Links of cosine ``least`` or more among all vectors, and their components.

    One row for each row of ``rows``: the id, n_links (other rows linked directly), component_id (smallest id reachable),
    kept (id = component_id). A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing and is its own component; vectors of different length don't link. A shard has at most about ``shard_size`` vectors
    and ``shard_bytes`` of them in double precision. A task gets a shard's graph in parts of 64 KB and then some of its queries, those
    of about ``slot_size`` nodes, fewer if there would be under ``least_tasks`` tasks, and holds ``block`` queries at a time. Rows that repeat a
    vector link with one another, repeated ids among them. A null id isn't kept, and is no component's id beside another. Other
    columns are not read. Equal vectors are told by a 64-bit hash.
    """
    ws = Workspace(rows.sparkSession, "hnsw")
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    marked = rows.select(F.col(id_col).alias("id"), F.coalesce(fine, F.lit(False)).alias("fine"), v.cast(kind).alias("v"))
    marked = marked.select("id", F.when(F.col("fine"), F.xxhash64(F.col("v").cast("array<double>"))).alias("node"), "v")
    ids = ws.stage(marked.select("id", "node"), "ids")
    nodes = marked.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.any_value("v").alias("v"))
    nodes = ws.stage(nodes.withColumn("dim", F.size("v")), "nodes")
    n, dim = nodes.agg(F.count("*"), F.max("dim")).first()
    most = max(1, shard_bytes // (8 * (dim or 1)))  # long vectors: smaller shards and blocks
    shards, blocks = max(least_shards, -(-n // min(shard_size, most))), max(1, -(-n // min(block, most)))
    slots = max(-(-n // slot_size), min(blocks, -(-least_tasks // shards)))
    deal = F.pmod(F.xxhash64("node", F.lit("shard")), F.lit(shards)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy())  # one order whatever the tasks, and no order of likeness
        raw = _matrix(table["v"])[order]
        graph = Graph.build(unit(raw).astype(np.float32))
        out = io.BytesIO()
        np.savez(out, raw=raw, node=table["node"].to_numpy()[order], copies=table["copies"].to_numpy()[order], **{f"layer{k}": x for k, x in enumerate(graph.layers)})
        parts = [out.getbuffer()[i : i + _PART] for i in range(0, out.tell(), _PART)]
        return pa.table({"dim": pa.array([table["dim"][0].as_py()] * len(parts), pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "graph": pa.array(parts, pa.binary())})

    # Small row groups: Spark's reader holds the binaries of a whole one.
    graphs = ws.stage(nodes.withColumn("shard", deal).groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, part int, graph binary"), "graphs", **{"parquet.block.size": 128 * _PART})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, names, weights, raw in _blocks(batches, min(block, most)):
            if data is not None:
                with np.load(io.BytesIO(data)) as f:
                    vectors, node, copies = unit(f["raw"]), f["node"], f["copies"]
                    graph = Graph(vectors.astype(np.float32), [f[f"layer{k}"] for k in range(sum(x.startswith("layer") for x in f.files))])
                data = None
            queries = unit(raw)
            place = np.minimum(np.searchsorted(node, names), len(node) - 1)
            own = np.where(node[place] == names, place, -1)
            found = Links(vectors, copies, queries, own, least, weights)
            graph.links(queries.astype(np.float32), least - _SLACK, own, found)
            every = np.concatenate([node, names])
            a, b = found.forest()
            n_links = np.concatenate([found.back, found.counts])
            some = np.flatnonzero(n_links)
            blank = np.zeros(len(some), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([every[a], every[some]])),
                pa.array(np.concatenate([every[b], blank]), mask=np.r_[np.zeros(len(a), bool), np.ones(len(some), bool)]),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), n_links[some]]), mask=np.r_[np.ones(len(a), bool), np.zeros(len(some), bool)]),
            ], names=["u", "v", "n"])

    # A node is searched for in its own shard and the next half of them, in a circle; of shards that stand opposite one
    # another the first half's nodes are searched for in the other's.
    steps = F.when(deal < shards // 2, shards // 2).otherwise((shards - 1) // 2)
    to = F.explode(F.transform(F.sequence(F.lit(0), steps), lambda k: F.pmod(deal + k, F.lit(shards))))
    slot = F.pmod(F.xxhash64("node", F.lit("slot")), F.lit(slots)).cast("int")
    queries = nodes.select("dim", to.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("graph"), "node", "copies", "v")
    spread = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "part", "graph", *[F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("copies", "long"), ("v", kind))])
    key = ("dim", "shard", "slot")
    dealt = spread.union(queries).repartition(3 * shards * slots, *key).sortWithinPartitions(*key, F.col("part").asc_nulls_last(), "node")
    found = ws.stage(dealt.mapInArrow(lambda batches: lean(search(batches)), "u long, v long, n long"), "found")
    ws.drop(graphs)
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("v IS NOT NULL").select("u", "v"), ws)
    per_node = nodes.select("node", "copies").join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    home = ids.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("home"))
    per_node = per_node.join(home, "node")
    least_id = per_node.groupBy("component").agg(F.min("home").alias("component_id"))
    per_node = per_node.join(least_id, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = ids.join(per_node, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
