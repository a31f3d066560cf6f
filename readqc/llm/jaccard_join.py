"""N-gram Jaccard join by multiple-global-order filtering.

Documents with equal shingle sets become one node (pre-aggregated by a digest of the set). Two nodes with similarity t or
more share a token among the first n - ceil(t n) + 1 of their n shingles under ANY global order, so a candidate must pass
under every order used. All three orders go by how many nodes have a shingle, rare ones first (a prefix of shingles that no
other node has yields no candidates); they differ in the hash that settles ties.

1. Every task sends its shingles to the ranges of their hashes, packed. A shingle that very many nodes of a task have goes
   out once, with a mark, and counts as frequent everywhere. A range learns how many nodes have each shingle, and tells
   nodes those that they share.
2. A node whose shared shingles can't reach into its prefix has no partner. The others get their prefixes under the
   orders A, B and C. Order A spreads (token, node) entries; tokens of more than one node form lists.
3. A pair of a list is dropped unless its prefixes meet under B and C as well; the texts of the pairs left are compared.

Lists are worked off without writing out all their pairs: in each round every list's hub (of its members the one with the least
shingles of its own, as an original among its edited copies) is paired with those that aren't in its component yet. That settles all pairs of the hub (they are compared, or connected already), so it leaves
the list; lists whose members are all in one component leave as well. After at least one round, when the pairs across components
that are left are few against the entries, they are all compared at once, which makes the result exact: whatever the sizes of the lists,
each pair that could link two components is looked at, in the list of the first token that the two have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from readqc.llm.common import Workspace, lean, pieces, small_batches
from readqc.llm.components import connected_components
from readqc.llm.words import hashes

WIDTH = 5
PERCENT = 75
TOKEN_BITS = 48  # of a shingle's hash, by which it is known to the filters
RANGE_TOKENS = 2 << 20
BATCH_TOKENS = 1 << 20
HOT = 64  # nodes of a batch that share a token; from there on it goes out once
TEXT_ROWS = 20  # rows of a few numbers that one with a text counts for in files
_HOT_LEVEL = np.uint64(255)
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


_GAP = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_LOW = np.array([b + 32 * (65 <= b <= 90) for b in range(256)], np.uint8)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    low = _LOW[np.frombuffer(b"\n".join(raw), np.uint8)]
    mask = ~_GAP[low]
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    begins, lens = edge[::2], edge[1::2] - edge[::2]
    words = hashes(low[mask], np.cumsum(lens) - lens, lens)
    ends = np.searchsorted(begins, np.cumsum([len(r) + 1 for r in raw]) - 1)
    starts = np.r_[0, ends[:-1]]

    def joined(first: np.ndarray, width: int) -> np.ndarray:
        s = np.full(len(first), width, np.uint64)
        for k in range(width):
            s = (s ^ words[first + k]) * _M
            s ^= s >> np.uint64(29)
        s *= _M2
        return s ^ (s >> np.uint64(32))

    every = joined(np.arange(max(0, len(words) - WIDTH + 1)), WIDTH)  # across texts too
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(np.unique(every[a : b - WIDTH + 1]) if b - a >= WIDTH else joined(np.array([a]), b - a) if b > a else every[:0])
    return out


def set_digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _coded(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens with how frequent they are in the bits above."""
    return tokens | levels.astype(np.uint64) << np.uint64(TOKEN_BITS)


def _level(nodes: np.ndarray) -> np.ndarray:
    """Frequency on a scale that is exact to 127 nodes, then goes by quarter powers of two."""
    return np.where(nodes < 128, nodes, np.minimum(254, 128 + 4 * np.log2(np.maximum(nodes, 1) / 128))).astype(np.uint64)


def prefixes(shared: np.ndarray, n: int) -> list[np.ndarray] | None:
    """The shared tokens in a node's prefix under each order, of its distinct coded tokens and the number of all its
    shingles: what its own shingles, which come first, leave room for. None if they leave none."""
    room = prefix_size(n) - (n - len(shared))
    if room <= 0:
        return None
    level, token = shared >> np.uint64(TOKEN_BITS), shared & np.uint64((1 << TOKEN_BITS) - 1)
    full = token << np.uint64(64 - TOKEN_BITS)
    return [token[np.lexsort((token, mixed, level))[:room]] for mixed in (full * _M, ~(full * _M), (full * _M2) ^ (full >> np.uint64(29)))]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's node and set size."""
    for batch in batches:
        for part, texts in pieces(batch):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "node", "n"])


_ROWS = "k int, packed binary"


def _rows(k: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(packed, pa.binary())], names=["k", "packed"])


def _told(tokens: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, homes: int) -> tuple[list[int], list[bytes]]:
    """Coded tokens for the nodes that share them (owner: place among ``nodes``), as one message for each of the ``homes``
    parts that nodes are dealt to: nodes, sizes, counts of tokens, tokens."""
    to = (nodes.view(np.uint64) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((owner, to[owner]))
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    count, who = np.diff(np.append(first, len(owner))), owner[first]
    cuts = np.searchsorted(to[who], np.arange(homes + 1))
    out: tuple[list[int], list[bytes]] = ([], [])
    for k in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
        w, c = who[cuts[k] : cuts[k + 1]], count[cuts[k] : cuts[k + 1]]
        start = int(first[cuts[k]])
        part = tokens[start : start + int(c.sum())]
        out[0].append(k)
        out[1].append(b"".join([np.array([len(w)], "<u8").tobytes(), nodes[w].astype("<i8").tobytes(), sizes[w].astype("<u4").tobytes(), c.astype("<u4").tobytes(), part.astype("<u8").tobytes()]))
    return out


def _hear(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    nodes, sizes, counts = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<u4", n, 8 + 8 * n), np.frombuffer(blob, "<u4", n, 8 + 12 * n)
    return nodes, sizes, counts, np.frombuffer(blob, "<u8", -1, 8 + 16 * n)


def _pack(tokens: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Ascending tokens with their owners' places (-1: a marked token, of very many nodes), and the owners' nodes and
    sizes. Steps between tokens take four bytes if they can."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    first, wide = int(steps[0]) if len(steps) else 0, bool((steps[1:] >= 1 << 32).any())
    steps[:1] = 0
    used, place = np.unique(owner, return_inverse=True)
    marked = bool(len(used) and used[0] < 0)
    known = used[1:] if marked else used
    head = np.array([first, len(tokens), len(known), wide, marked], "<u8")
    kind = "<u2" if len(used) < 1 << 16 else "<u4"
    return b"".join([head.tobytes(), steps.astype("<u8" if wide else "<u4").tobytes(), place.astype(kind).tobytes(), nodes[known].astype("<i8").tobytes(), sizes[known].astype("<u4").tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, count, known, wide, marked = np.frombuffer(blob, "<u8", 5).tolist()
    at = 40
    out = []
    for kind, n in (("<u8" if wide else "<u4", count), ("<u2" if known + marked < 1 << 16 else "<u4", count), ("<i8", known), ("<u4", known)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return np.cumsum(out[0], dtype=np.uint64) + np.uint64(first), out[1].astype(np.int32) - np.int32(marked), out[2], out[3]


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(TOKEN_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _scatter(ranges: int, speakers):
    """Kernel over (doc_id, text): packed tokens for each range, and each node's tokens that very many here share.
    ``speakers``: of sets that very many documents have, the one document that speaks for them."""

    def send(tokens: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in tokens], np.int64)
        names, all_tokens = np.array(nodes, np.int64), np.concatenate(tokens) >> np.uint64(64 - TOKEN_BITS)
        order = np.argsort(all_tokens)
        token, owner = all_tokens[order], np.repeat(np.arange(len(nodes)), sizes)[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(first, len(token)))
        common = np.repeat(count >= HOT, count)
        mine = np.flatnonzero(np.bincount(owner[common], minlength=len(nodes)))
        number = np.zeros(len(nodes), np.int64)
        number[mine] = np.arange(len(mine))
        if len(mine):
            to, told = _told(_coded(token[common], _HOT_LEVEL), number[owner[common]], names[mine], sizes[mine], ranges)
            yield _rows([-1 - k for k in to], told)
        once = ~common
        once[first] = True
        owner = np.where(common, -1, owner)[once]
        token = token[once]
        cuts = np.searchsorted(_range_of(token, ranges), np.arange(ranges + 1))
        some = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
        for i in range(0, len(some), 64):
            part = some[i : i + 64]
            yield _rows(part, [_pack(token[cuts[k] : cuts[k + 1]], owner[cuts[k] : cuts[k + 1]], names, sizes) for k in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, speaks = set(), speakers.value
        tokens, nodes, held = [], [], 0
        for batch in batches:
            for part, texts in pieces(batch):
                for doc_id, s in zip(part.column(0).to_pylist(), shingle_sets(texts), strict=True):
                    if not len(s) or (node := set_digest(s)) in seen or speaks.get(node, doc_id) != doc_id:
                        continue
                    seen.add(node)
                    tokens.append(s)
                    nodes.append(node)
                    held += len(s)
                    if held >= BATCH_TOKENS:
                        yield from send(tokens, nodes)
                        tokens, nodes, held = [], [], 0
        if nodes:
            yield from send(tokens, nodes)

    return run


def _gather(ranges: int):
    """Kernel that passes on what tasks told, and finds the tokens of several nodes in each range, and tells these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            known = batch.filter(pa.compute.less(batch.column(0), 0))
            if known.num_rows:
                yield _rows([-1 - k for k in known.column(0).to_pylist()], known.column(1))
            rest = batch.filter(pa.compute.greater_equal(batch.column(0), 0))
            for k, blob in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist(), strict=True):
                blobs.setdefault(k, []).append(blob)
        for k in list(blobs):
            yield _rows(*_tell(blobs.pop(k), ranges))

    return run


def _tell(blobs: list[bytes], ranges: int) -> tuple[list[int], list[bytes]]:
    parts = [_unpack(blob) for blob in blobs]
    blobs.clear()
    names, first = np.unique(np.concatenate([x[2] for x in parts]), return_index=True)
    sizes = np.concatenate([x[3] for x in parts])[first]
    token = np.concatenate([x[0] for x in parts])
    owner = np.concatenate([np.where(x[1] < 0, -1, np.append(np.searchsorted(names, x[2]), -1)[x[1]]).astype(np.int32) for x in parts])
    del parts
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    del order
    # Tokens that came once, and not as shared, are of one node. The others are few.
    alone = np.append(True, token[1:] != token[:-1]) & np.append(token[1:] != token[:-1], True) & (owner >= 0)
    token, owner = token[~alone], owner[~alone]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    fresh = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))[: len(token)]
    token, owner = token[fresh], owner[fresh]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    count = np.diff(np.append(first, len(token)))
    # A mark stands first of its token.
    several = np.repeat((count > 1) | (owner[first] < 0), count) & (owner >= 0)
    level = np.repeat(np.where(owner[first] < 0, _HOT_LEVEL, _level(count)), count)
    return _told(_coded(token[several], level[several]), owner[several], names, sizes, ranges)


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of the nodes of a part, from all that was told of their shared tokens."""
    heard = [_hear(blob) for batch in batches for blob in batch.column(1).to_pylist()]
    if not heard:
        return
    node = np.concatenate([np.repeat(x[0], x[2]) for x in heard])
    size = np.concatenate([np.repeat(x[1], x[2]) for x in heard])
    token = np.concatenate([x[3] for x in heard])
    heard.clear()
    order = np.lexsort((token, node))
    node, size, token = node[order], size[order], token[order]
    # Copies of a set in several tasks each learn of the same tokens.
    fresh = np.append(True, (node[1:] != node[:-1]) | (token[1:] != token[:-1]))
    node, size, token = node[fresh], size[fresh], token[fresh]
    cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1])).tolist() + [len(node)]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if (found := prefixes(token[a:b], int(size[a]))) is not None:
            rows.append((int(node[a]), int(size[a]), b - a, *(x.view(np.int64) for x in found)))
        if len(rows) >= 5000 or b == len(node):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "n", "shared", "a", "b", "c"])
            rows = []


def _speakers(spark, homes: DataFrame, copies: int = 256, bound: int = 200_000):
    """Broadcast of node -> home for the nodes of ``copies`` documents or more; of more if these are over ``bound``."""
    while homes.where(F.col("copies") >= copies).count() > bound:
        copies *= 4
    rows = homes.where((F.col("copies") >= copies) & F.col("home").isNotNull()).select("node", "home").collect()
    return spark.sparkContext.broadcast({r["node"]: r["home"] for r in rows})


def _texts_of(docs: DataFrame, ids: DataFrame, bound: int = 2_000_000) -> DataFrame:
    """The (doc_id, text) rows whose doc_id is in ``ids``; these are broadcast only if they are ``bound`` at most."""
    few = ids.count() <= bound
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verify_pairs(pairs: DataFrame, docs: DataFrame, homes: DataFrame, filters: DataFrame, ws: Workspace) -> DataFrame:
    """Links among ``pairs`` (u, v), as (u, v). Pairs whose prefixes don't meet under B and C go before texts are read."""
    bound = pairs.count()
    pairs = pairs.join(filters.selectExpr("node AS u", "b AS ub", "c AS uc"), "u").join(filters.selectExpr("node AS v", "b AS vb", "c AS vc"), "v")
    pairs = ws.stage(pairs.where("arrays_overlap(ub, vb) AND arrays_overlap(uc, vc)").select("u", "v"), "candidates", rows=bound)
    bound = pairs.count()
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    ids = homes.join(nodes, "node", "left_semi").select(F.col("home").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    nameless = docs.select("doc_id", "text").where("doc_id IS NULL AND text IS NOT NULL")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                found = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in found], pa.int64()), part.column(1)], names=["node", "text"])

    texts = ws.stage(_texts_of(docs, ids).union(nameless).mapInArrow(lambda batches: lean(sets(batches)), "node long, text string").dropDuplicates(["node"]), "texts", rows=2 * bound * TEXT_ROWS)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, of_v in pieces(batch, "tv"):
                u, v, of_u = (part.column(k).to_pylist() for k in (0, 1, 2))
                # Each text of the slice once.
                texts = dict(zip(u, of_u, strict=True)) | dict(zip(v, of_v, strict=True))
                found = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
                links = []
                for i in range(len(u)):
                    x, y = found[u[i]], found[v[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= PERCENT * (len(x) + len(y) - both):
                        links.append(i)
                at = pa.array(links, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["u", "v"])

    members = pairs.join(texts.selectExpr("node AS v", "text AS tv"), "v")
    both = members.join(texts.selectExpr("node AS u", "text AS tu"), "u").select("u", "v", "tu", "tv")
    links = ws.stage(both.mapInArrow(lambda batches: lean(check(batches)), "u long, v long"), "links", rows=bound)
    ws.drop(texts, pairs)
    return links


def _all_pairs(lists: DataFrame, close: str, block: int = 2048) -> DataFrame:
    """Pairs (u, v) across components in each list that are ``close``. A long list is dealt into blocks of about ``block``
    members, and each two blocks meet by themselves, so that no task has a long list's pairs."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > block)
    sizes = sizes.select("token", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    dealt = lists.join(F.broadcast(sizes) if sizes.count() <= 200_000 else sizes, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    # A member of block i is in the meetings (i, i..) as the first, and (..i, i) as the second.
    first = dealt.select("token", "node", "n", "rest", "comp", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"))
    second = dealt.select("token", "node", "n", "rest", "comp", F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"))
    meet = F.expr(f"a.token = b.token AND a.x = b.x AND a.y = b.y AND (a.x < a.y OR a.node < b.node) AND a.comp <> b.comp AND {close}")
    return first.alias("a").join(second.alias("b"), meet).selectExpr("a.node AS u", "b.node AS v")


def similar(docs: DataFrame, max_rounds: int = 2, pairs_per_entry: int = 64) -> DataFrame:
    """Groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z
    lower-cased. A text of fewer than five words is one shingle; a null text or one without words has none, n_shingles 0
    and its own id as component. One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, itself included; a null id never is the smallest beside another). Repeated rows are copies. Only
    doc_id and text are read. Shingles and sets are told apart by 64-bit hashes.
    """
    return _groups(docs, Workspace(docs.sparkSession, "jaccard"), max_rounds, pairs_per_entry)[0].drop("node")


def _groups(docs: DataFrame, ws: Workspace, max_rounds: int = 2, pairs_per_entry: int = 64) -> tuple[DataFrame, int]:
    """As ``similar``, with each row's set digest (node), and the number of rows. What the result reads stays in the
    workspace."""
    with small_batches(docs.sparkSession):
        return _grouped(docs, ws, max_rounds, pairs_per_entry)


def _grouped(docs: DataFrame, ws: Workspace, max_rounds: int, pairs_per_entry: int) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    meta = ws.stage(docs.mapInArrow(lambda batches: lean(_describe(batches)), "doc_id long, node long, n long"), "nodes")
    rows = meta.count()
    homes = ws.stage(meta.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("home"), F.count("*").alias("copies"), F.max("n").alias("n")), "homes", rows=rows)
    tokens = homes.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-tokens // RANGE_TOKENS))

    run = _scatter(ranges, _speakers(spark, homes))
    scatter = lambda batches: lean(run(batches))
    collect = _gather(ranges)
    gather = lambda batches: lean(collect(batches))
    told = docs.mapInArrow(scatter, _ROWS).repartition(ranges, "k").mapInArrow(gather, _ROWS).repartition(ranges, "k")
    filters = ws.stage(told.mapInArrow(lambda batches: lean(_select(batches)), "node long, n int, shared int, a array<long>, b array<long>, c array<long>"), "prefixes")
    # A node's own shingles stand before its shared ones: where a token stands bounds what its set can have in common
    # with another from there on.
    entries = filters.select(F.posexplode("a").alias("at", "token"), "node", "n", "shared").select("token", "node", "n", (F.col("shared") - F.col("at")).alias("rest"), (F.col("n") - F.col("shared")).alias("own"))
    common = entries.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    bound = filters.agg(F.sum(F.size("a"))).first()[0] or 0
    lists = ws.stage(entries.join(common, "token", "left_semi").withColumn("comp", F.col("node")), "lists", rows=bound)
    links = None
    for k in range(max_rounds + 1):
        per = lists.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        left, pairs, tokens = per.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.count("*")).first()
        if not pairs:
            break
        last = k == max_rounds or k and pairs <= pairs_per_entry * left
        # The first token that two similar sets have in common stands so early in both that enough can follow.
        close = f"{100 + PERCENT} * least(a.rest, b.rest) >= {PERCENT} * (a.n + b.n)"
        if last:
            found = _all_pairs(lists, close)
        else:
            hubs = ws.stage(lists.groupBy("token").agg(F.min_by(F.struct("node", "n", "rest", "comp"), F.struct(F.col("own") / F.col("n"), F.xxhash64("node"))).alias("h")).select("token", "h.*"), "hubs", rows=tokens)
            found = lists.alias("a").join(hubs.alias("b"), F.expr(f"a.token = b.token AND a.comp <> b.comp AND {close}")).selectExpr("b.node AS u", "a.node AS v")
        found = ws.stage(found.selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct(), "pairs", rows=pairs if last else min(left, pairs))
        more = _verify_pairs(found, docs, homes, filters, ws)
        ws.drop(found)
        links = more if links is None else links.union(more)
        if last:
            break
        comps = connected_components(links, ws)
        moved = lists.join(hubs.selectExpr("token", "node AS hub"), "token").where("node <> hub").drop("hub", "comp").join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        moved = ws.stage(moved.select("token", "node", "n", "rest", "own", "comp"), "moved", rows=left)
        mixed = moved.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        found = ws.stage(moved.join(mixed, "token", "left_semi"), "lists", rows=left)
        ws.drop(lists, moved, hubs)
        lists = found
    ws.drop(lists, filters)
    if links is None:
        links = spark.createDataFrame([], "u long, v long")
    comps = ws.stage(connected_components(links, ws), "components", rows=rows)
    ws.keep_only(meta, homes, comps)
    grouped = homes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("home").alias("component_id"))
    ids = grouped.join(least, "component").select("node", "component_id")
    return meta.join(ids, "node", "left").select("doc_id", "node", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), rows


_NODE = "_set_digest"


def keep_one(docs: DataFrame, bound: int = 2_000_000) -> DataFrame:
    """One document of each group, the one with the smallest id; columns stay as they are. Only rows that are copies go,
    not others with their ids. Of rows left that repeat an id one stays, the one whose text is smallest; a row with a null
    id stays, as does one with a null text or without words unless its id repeats. The ids to remove are broadcast only if they are ``bound`` at most."""
    ws = Workspace(docs.sparkSession, "jaccard")
    groups, rows = _groups(docs, ws)
    groups = ws.stage(groups, "groups", rows=rows)
    ws.keep_only(groups)
    copies, others = groups.where("doc_id <> component_id"), groups.where("doc_id = component_id")
    gone = copies.select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= bound else gone, "doc_id", "left_anti")
    again = others.groupBy("doc_id").count().where("count > 1").select("doc_id")
    mixed = others.join(copies.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    if n := mixed.count():
        # Some rows of these ids are copies and some aren't; their texts tell which.
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes = [x for b in _describe(iter([batch.select(["doc_id", "text"])])) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, _NODE])

        rows = docs.join(F.broadcast(mixed) if n <= bound else mixed, "doc_id", "left_semi").select(docs.columns)
        rows = rows.mapInArrow(mark, StructType([*docs.schema.fields, StructField(_NODE, LongType())]))
        away = copies.join(mixed, "doc_id", "left_semi").select("doc_id", F.col("node").alias(_NODE)).distinct()
        kept = kept.select(docs.columns).unionByName(rows.join(away, ["doc_id", _NODE], "left_anti").select(docs.columns))
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= bound else again
    every = F.struct(*docs.columns)
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.struct("text", F.xxhash64(*docs.columns))).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(one)
