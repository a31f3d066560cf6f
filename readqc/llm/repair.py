"""Token-id files under Re-Pair grammar compression.

A file is a sequence of shards, each a row with a binary payload: a grammar and the ids of some documents under it.
Frequent pairs of neighbouring ids (never across documents) are replaced by nonterminals, round by round: a round counts
all pairs, gives the most frequent ones new symbols, and replaces them, until no pair occurs twice. Rules are stored with the
lengths they expand to, and documents with their places in the sequence and in the ids, so that a document, or an id of
it, is decoded without the others.

Payload, little-endian: ``<4sIIIIBB2x`` magic RPR2, documents, rules, symbols, first rule's symbol, bits of a symbol, bits
of a length; then doc_id int64[documents], null flag of it uint8[documents], place in the sequence uint32[documents + 1],
place in the ids uint64[documents + 1], and as bits, lowest first, each filled up to a byte: the rules' symbols [rules][2],
expansion lengths [rules], the sequence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.byte_bpe import load
from readqc.llm.common import Workspace, lean, pieces, small_batches
from readqc.llm.words import Known, mixed, spread

HEAD = struct.Struct("<4sIIIIBB2x")


def _to_bits(x: np.ndarray, width: int, block: int = 1 << 16) -> bytes:
    """Numbers of ``width`` bits each, one after another; a block fills whole bytes."""
    out = []
    for i in range(0, len(x), block):
        bits = np.unpackbits(x[i : i + block].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
        out.append(np.packbits(bits, axis=None, bitorder="little").tobytes())
    return b"".join(out)


def _of_bits(data: np.ndarray, n: int, width: int, block: int = 1 << 16) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for i in range(0, n, block):
        m = min(block, n - i)
        bits = np.unpackbits(data[i * width // 8 : -(-(i + m) * width // 8)], count=m * width, bitorder="little").reshape(m, width)
        some = np.packbits(bits, axis=1, bitorder="little")
        out[i : i + m].view(np.uint8).reshape(m, 4)[:, : some.shape[1]] = some
    return out


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 2, a_round: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (k x 2; rule i makes symbol base + i), the sequence, and the documents' ends in it. A round counts pairs
    exactly and replaces the ``a_round`` most frequent ones, and those as frequent as the last of them. Rounds go on until no
    pair occurs ``least`` times without overlap (of a run of one symbol every other pair counts). Where two of a round's
    pairs overlap, the more frequent one is replaced; a pair of which some are left keeps its symbol.

    A round closes the gaps that it leaves, and costs what it looks at: places whose pair was frequent, is of equal symbols,
    or has changed. A pair that occurs too seldom gets no new place unless one of its symbols is put anew, and then all
    places of such a symbol are looked at."""
    if not len(ids):
        return np.zeros((0, 2), np.uint32), ids.astype(np.uint32), np.zeros(0, np.int64)
    # Where masks are mixed, places (flatnonzero) are several times faster than the masks themselves.
    seq, look, rules, known = ids.astype(np.uint32), np.ones(len(ids), bool), [np.zeros((0, 2), np.uint32)], Known()
    look[ends - 1] = False
    while len(places := np.flatnonzero(look)):
        width, bits = np.uint64((base + known.n).bit_length()), np.uint64(len(seq).bit_length())
        mask = (np.uint64(1) << bits) - np.uint64(1)
        packed = 2 * width + bits <= 64
        a, b = seq[places], seq[places + 1]
        key = a.astype(np.uint64)
        key <<= width
        key |= b
        some, twin = len(places), places[np.flatnonzero(a == b)]
        del a, b
        if len(twin):
            fresh = np.r_[True, twin[:-1] + 1 != twin[1:]]
            begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            skip = np.searchsorted(places, twin[(np.arange(len(twin)) - begin) % 2 == 1])
            key[skip] = (np.uint64(1) << 2 * width) - np.uint64(1)  # no pair; sorts last
            some -= len(skip)
        if packed:
            key <<= bits
            key |= places.view(np.uint64)
            del places
            key.sort()
            key = key[:some]
            fresh = (key[1:] ^ key[:-1]) > mask
        else:
            order = np.argsort(key, kind="stable")[:some]
            key, places = key[order], places[order]
            fresh = key[1:] != key[:-1]
            del order

        def counted(first: np.ndarray, n: np.ndarray) -> np.ndarray:
            """The places of pairs, one pair after another."""
            at = spread(first, n)
            return (key[at] & mask).view(np.int64) if packed else places[at]

        start = np.flatnonzero(np.r_[True, fresh])
        counts = np.diff(start, append=some)
        often = counts >= least
        chosen, seldom = np.flatnonzero(often), np.flatnonzero(~often)
        if not len(chosen):
            break
        look[counted(start[seldom], counts[seldom])] = False
        look[twin] = True
        n_of = counts[chosen]
        if len(chosen) > a_round:
            top = n_of >= np.partition(n_of, len(chosen) - a_round)[len(chosen) - a_round]
            chosen, n_of = chosen[top], n_of[top]
        order = np.argsort(-n_of, kind="stable")
        chosen, n_of = chosen[order], n_of[order]
        by_place = counted(start[chosen], n_of)
        by_place <<= 32
        by_place |= np.repeat(np.arange(len(chosen)), n_of)
        by_place.sort()
        at, which = by_place >> 32, by_place & 0xFFFFFFFF
        beside = at[:-1] + 1 == at[1:]
        free = np.ones(len(at), bool)
        free[1:] &= ~beside | (which[1:] < which[:-1])
        free[:-1] &= ~beside | (which[:-1] < which[1:])
        by_place = by_place[np.flatnonzero(free)]
        which = by_place & 0xFFFFFFFF
        good = np.bincount(which, minlength=len(chosen)) >= least  # the first one always is
        by_place = by_place[np.flatnonzero(good[which])]
        at, which = by_place >> 32, by_place & 0xFFFFFFFF
        pair = key[start[chosen[good]]]
        if packed:
            pair >>= bits
        del key, start, counts, often, seldom, by_place
        # Rules by their pair; those of earlier rounds keep their number.
        left, right = pair >> width, pair & ((np.uint64(1) << width) - np.uint64(1))
        name = mixed((left << np.uint64(32) | right) + np.uint64(1))
        rule = known.find(name)
        old, new = rule[rule >= 0], rule < 0
        rules.append(np.stack([left[new], right[new]], 1).astype(np.uint32))
        rule[new] = known.n + np.arange(int(new.sum()))
        known.add(name[new])
        if len(old):
            again = np.zeros(base + known.n, bool)
            again[base + old] = True
            here = np.flatnonzero(again[seq])
            look[here] = look[here - 1] = True
        symbol = np.zeros(len(chosen), np.uint32)
        symbol[good] = base + rule
        seq[at] = symbol[which]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        if 50 * len(at) > len(seq):
            kept = np.flatnonzero(kept)
        seq, look = seq[kept], look[kept]
        ends = ends - np.searchsorted(at, ends - 1)
        at -= np.arange(len(at))
        look[at] = look[at - 1] = True
        look[ends - 1] = False
    return np.concatenate(rules), seq, ends


def _generations(rules: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Ranges of rules, each of which uses rules before the range only."""
    need = rules.max(1).astype(np.int64) - base + 1 if len(rules) else np.zeros(0, np.int64)
    out, start = [], 0
    while start < len(rules):
        beyond = np.flatnonzero(need[start : start + 65_536] > start)
        stop = start + int(beyond[0]) if len(beyond) else min(len(rules), start + 65_536)
        if stop == start:
            raise ValueError("a rule uses itself or a later one")
        out.append((start, stop))
        start = stop
    return out


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to; a rule uses earlier rules only."""
    out = np.ones(len(rules), np.int64)
    for a, b in _generations(rules, base):
        part = rules[a:b].astype(np.int64) - base
        out[a:b] = np.where(part >= 0, out[np.maximum(part, 0)], 1).sum(1)
    return out


def pack(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """A shard's payload."""
    sizes = np.array([len(x) for x in ids], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    rules, seq, ends = compress(np.concatenate(ids), starts[1:], base)
    spans = lengths(rules, base)
    width, long = max(int(base + len(rules)).bit_length(), int(seq.max(initial=0)).bit_length()), int(spans.max(initial=0)).bit_length()
    return b"".join([
        HEAD.pack(b"RPR2", len(doc_ids), len(rules), len(seq), base, width, long),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.r_[0, ends].astype("<u4").tobytes(), starts.astype("<u8").tobytes(),
        _to_bits(rules.ravel(), width), _to_bits(spans, long), _to_bits(seq, width),
    ])


class Shard:
    """Reads a payload; decodes all of it, one document, or one id."""

    def __init__(self, payload: bytes):
        magic, docs, rules, symbols, self.base, width, long = HEAD.unpack_from(payload)
        if magic != b"RPR2":
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        def numbers(n: int, width: int) -> np.ndarray:
            return _of_bits(take("u1", -(-n * width // 8)), n, width)

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.places, self.starts = take("<u4", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        self.rules, self.sizes = numbers(2 * rules, width).reshape(-1, 2), numbers(rules, long).astype(np.int64)
        self.seq = numbers(symbols, width)
        # All rules' expansions, one after another: each is that of its left symbol, then its right one.
        self.offset = np.r_[0, np.cumsum(self.sizes)]
        self.flat = np.empty(int(self.offset[-1]), np.uint32)
        for first, end in _generations(self.rules, self.base):
            pair = self.rules[first:end].astype(np.int64)
            place = self.offset[first:end]
            for k in range(2):
                own, rule = pair[:, k] < self.base, np.maximum(pair[:, k] - self.base, 0)
                self.flat[place[own]] = pair[own, k]
                size = np.where(own, 1, self.sizes[rule])
                far = ~own
                self.flat[spread(place[far], size[far])] = self.flat[spread(self.offset[rule[far]], size[far])]
                place = place + size

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of a part of the sequence."""
        out = [np.zeros(0, "<u4")]
        for i in range(0, len(seq), 1 << 14):
            part = seq[i : i + (1 << 14)].astype("<u4")
            at = np.flatnonzero(part >= self.base)
            rule = part[at].astype(np.int64) - self.base
            size = np.ones(len(part), np.int64)
            size[at] = sizes = self.sizes[rule]
            place = (np.cumsum(size) - size)[at]
            part = np.repeat(part, size)
            part[spread(place, sizes)] = self.flat[spread(self.offset[rule], sizes)]
            out.append(part)
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's i-th document."""
        return self.expand(self.seq[self.places[i] : self.places[i + 1]])

    def token(self, i: int, k: int) -> int:
        """Id k of the i-th document, by the expansion lengths; descends one rule a step."""
        seq = self.seq[self.places[i] : self.places[i + 1]].astype(np.int64)
        size = np.where(seq >= self.base, self.sizes[np.maximum(seq - self.base, 0)] if len(self.sizes) else 1, 1)
        ends = np.cumsum(size)
        j = int(np.searchsorted(ends, k, "right"))
        k -= int(ends[j] - size[j])
        s = int(seq[j])
        while s >= self.base:
            left, right = self.rules[s - self.base].tolist()
            n = int(self.sizes[left - self.base]) if left >= self.base else 1
            s, k = (left, k) if k < n else (right, k - n)
        return s


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 20) -> None:
    """Write the ids of every whole text, each document closed by ``end_id``, in ascending order of doc_id (nulls first,
    equal ids by text) as shards of about ``shard_tokens`` ids (a longer document is a shard of its own): columns part,
    shard, n_docs, n_tokens, offset (ids of the part before the shard), payload. Parts are ranges of ids, in order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = load(tokenizer_path), TaskContext.get().partitionId()
        names, ids, held, offset, shard = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([offset], pa.int64()), pa.array([pack(names, ids, bpe.size)])], names=["part", "shard", "n_docs", "n_tokens", "offset", "payload"])

        for batch in batches:
            for piece, texts in pieces(batch):
                flat, counts = bpe.encode(texts)
                for doc_id, own in zip(piece.column(0).to_pylist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    own = np.append(own, np.uint32(end_id))
                    names.append(doc_id)
                    ids.append(own)
                    held += len(own)
                    if held >= shard_tokens:
                        yield row()
                        names, ids, offset, held, shard = [], [], offset + held, 0, shard + 1
        if names:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        rows.mapInArrow(lambda batches: lean(encode(batches)), "part long, shard long, n_docs long, n_tokens long, offset long, payload binary").write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Decode all shards: for each document doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its
    ids as little-endian unsigned 32-bit integers). The parts' totals are as many rows as there are parts."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(payload)
                ids = memoryview(shard.expand(shard.seq)).cast("B")
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(base + shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    at = files.select("part", "offset", "payload").join(F.broadcast(first), "part").select((F.col("first") + F.col("offset")).alias("base"), "payload")
    return at.mapInArrow(lambda batches: lean(decode(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the token files and read them back.

    One row for each row of ``docs``: doc_id, start, n_tokens (with the end id), ids_crc32. A null or empty text is its
    end id alone. Null ids come first; repeated ids are ordered by text. Other columns are not read. An empty table makes
    empty files and no rows.
    """
    path = path or f"{Workspace(docs.sparkSession, 'tokens').path}/files"
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path)
