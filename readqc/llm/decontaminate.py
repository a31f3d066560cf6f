"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

The items' words become one automaton, built on the driver and sent out as arrays (about 100 bytes for each word). A larger
benchmark is dealt into automata of at most ``max_words`` words; as many as have ``pass_words`` words go out at once, and each
further lot is a pass of its own over the documents, whose few finds are joined by text. So neither the driver nor a worker
holds more than one lot.

Training words are streamed through it; the state gives the longest match that ends at each word. The stream is cut where two
words in a row stand so in no item, as no match of two words goes on there; all parts advance in step, as rows of arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.common import Workspace, lean, pieces
from readqc.llm.words import Known, hashes, spread

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD = np.array([bool(WORDS.match(bytes([b]))) for b in range(256)])
_LOW = np.array([b + 32 * (65 <= b <= 90) for b in range(256)], np.uint8)


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z only) text in UTF-8: runs of ASCII letters, digits and all non-ASCII characters."""
    return WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []


class Words:
    """Words of many texts: their hashes, first bytes and ends in the texts' UTF-8, and each text's end among them."""

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        low = _LOW[np.frombuffer(b"\n".join(raw), np.uint8)]
        mask = _WORD[low]
        edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
        begins, lens = edge[::2], edge[1::2] - edge[::2]
        self.hashes = hashes(low[mask], np.cumsum(lens) - lens, lens)
        stops = np.cumsum([len(r) + 1 for r in raw]) - 1
        self.ends = np.searchsorted(begins, stops)
        self.counts = np.diff(np.r_[0, self.ends])
        self.text = np.repeat(np.arange(len(raw)), self.counts)
        heads = np.r_[0, stops[:-1] + 1][self.text]
        self.begins, self.stops, self.raw = begins - heads, begins + lens - heads, raw


def _group(keys: list[int], values: list[tuple[int, ...]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by key: sorted distinct keys, each one's first value, and the values (with one more end)."""
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    key = np.array(keys, np.int64)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.r_[first, len(key)], np.array(values, np.int32).reshape(len(key), width)[order]


def _of_keys(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys`` the values a table has of it: which key, and the value."""
    names, first, values = table
    if not len(names):
        return np.zeros(0, np.int64), values
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    hit = np.flatnonzero(names[at] == keys)
    lens = first[at[hit] + 1] - first[at[hit]]
    return np.repeat(hit, lens), values[spread(first[at[hit]], lens)]


@dataclass
class Matcher:
    """An automaton as arrays, with the words of the stream told by their hashes."""

    window: int
    items: list[str | None]
    vocab: Known
    steps: np.ndarray  # state and word, sorted
    to: np.ndarray
    link: np.ndarray
    size: np.ndarray
    least: np.ndarray
    first: np.ndarray  # state of each word by itself
    wide: tuple  # state -> items of its windows
    short: tuple  # state -> (words, item) of whole items of fewer words

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = state.astype(np.int64) << 32 | word
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        return np.where(self.steps[at] == key, self.to[at], -1)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words at which a match that counts ends, with state and length of the longest match there."""
        c = self.vocab.find(words.hashes)
        at = np.flatnonzero(c >= 0)
        if not len(at):
            return at, at, at
        joint = np.flatnonzero((np.diff(at) == 1) & (words.text[at[1:]] == words.text[at[:-1]])) + 1
        joint = joint[self._step(self.first[c[at[joint] - 1]], c[at[joint]]) >= 0]
        begin = np.ones(len(at), bool)
        begin[joint] = False
        head = np.flatnonzero(begin)
        lens = np.diff(np.r_[head, len(at)])
        order = np.argsort(-lens, kind="stable")
        start, lens = at[head[order]], lens[order]
        state, n = self.first[c[start]].astype(np.int64), np.ones(len(start), np.int64)
        out = []
        for k in range(int(lens[0])):
            if k:
                live = int(np.searchsorted(-lens, -k))  # those longer than k
                state, n = state[:live], n[:live]
                word = c[start[:live] + k]
                nxt = self._step(state, word)
                left = np.flatnonzero(nxt < 0)
                while len(left):
                    state[left] = self.link[state[left]]
                    n[left] = self.size[state[left]]
                    nxt[left] = self._step(state[left], word[left])
                    left = left[nxt[left] < 0]
                state, n = nxt, n + 1
            good = np.flatnonzero(n >= self.least[state])
            if len(good):
                out.append((start[good] + k, state[good], n[good]))
        if not out:
            return at[:0], at[:0], at[:0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def scan(self, words: Words) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Which words occurrences of windows cover, and (text, item) of the items they are from."""
        at, state, n = self.matches(words)
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        if not len(at):
            return edge[:-1] > 0, []
        far = np.flatnonzero(n >= self.window)
        np.add.at(edge, at[far] + 1 - self.window, 1)
        np.add.at(edge, at[far] + 1, -1)
        top = state[far]
        while len(up := np.flatnonzero(self.size[self.link[top]] >= self.window)):
            top[up] = self.link[top[up]]
        which, item = _of_keys(self.wide, top)
        found = [np.stack([words.text[at[far]][which], item[:, 0]], 1)]
        rest = np.flatnonzero(self.least[state] < self.window)
        q, p, m = state[rest], at[rest], n[rest]
        while len(q):
            which, value = _of_keys(self.short, q)
            fits = value[:, 0] <= m[which] if len(which) else np.zeros(0, bool)
            k, end = value[fits, 0], p[which[fits]] + 1
            np.add.at(edge, end - k, 1)
            np.add.at(edge, end, -1)
            found.append(np.stack([words.text[end - 1], value[fits, 1]], 1))
            q = self.link[q]
            on = (q > 0) & (self.least[np.maximum(q, 0)] < self.window)
            q, p, m = q[on], p[on], m[on]
        pairs = np.unique(np.concatenate(found), axis=0)
        return np.cumsum(edge[:-1]) > 0, [(t, name) for t, i in pairs.tolist() if (name := self.items[i]) is not None]


class Automaton:
    """Generalised suffix automaton over word ids; ``window`` words in a row of an item, or a whole shorter item, count."""

    def __init__(self):
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> Matcher:
        self = cls()
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        # For each window, the items that hold it, at the state whose strings include it.
        wide: dict[tuple[int, int], None] = {}
        short: list[tuple[int, int, int]] = []
        for k, (_, word_ids) in enumerate(coded):
            s = n = 0
            if len(word_ids) < window:
                for c in word_ids:
                    s = self.step[s][c]
                short.append((s, len(word_ids), k))
                continue
            for c in word_ids:
                s, n = self.step[s][c], n + 1
                while self.size[self.link[s]] >= window:
                    s = self.link[s]
                n = min(n, self.size[s])
                if n >= window:
                    wide[s, k] = None
        least = [window] * len(self.size)  # of each state, the shortest match that counts
        for s, n, _ in short:
            least[s] = min(least[s], n)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            least[s] = min(least[s], least[self.link[s]])
        moves = sorted((s << 32 | c, t) for s, step in enumerate(self.step) for c, t in step.items())
        vocab = Known()
        names = list(self.vocab)
        lens = np.array([len(w) for w in names], np.int64)
        vocab.add(hashes(np.frombuffer(b"".join(names), np.uint8), np.cumsum(lens) - lens, lens))
        return Matcher(
            window, [item for item, _ in coded], vocab, np.array([k for k, _ in moves], np.int64), np.array([t for _, t in moves], np.int32), np.array(self.link, np.int32), np.array(self.size, np.int32), np.array(least, np.int32),
            np.array([self.step[0][c] for c in range(len(names))], np.int32), _group([s for s, _ in wide], [(k,) for _, k in wide], 1), _group([s for s, _, _ in short], [x[1:] for x in short], 2),
        )


def matchers(benchmark: DataFrame, window: int, max_words: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Matcher, int]]:
    """The benchmark's automata, each of at most ``max_words`` words or one item, and their words. The items are read
    group by group."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    group, held = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if group and held + len(words) > max_words:
            yield Automaton.of(group, window), held
            group, held = [], 0
        if words:
            group.append((row["item"], words))
            held += len(words)
    if group:
        yield Automaton.of(group, window), held


def lots(benchmark: DataFrame, window: int, max_words: int, pass_words: int) -> Iterator[list[Matcher]]:
    """Automata that go out together: of at most ``pass_words`` words, or one."""
    lot, held = [], 0
    for matcher, n in matchers(benchmark, window, max_words):
        if lot and held + n > pass_words:
            yield lot
            lot, held = [], 0
        lot.append(matcher)
        held += n
    if lot:
        yield lot


Found = tuple[list[tuple[int, int]], set[str]]  # merged ranges (first word, end) of a text, and items


def scan(lot: list[Matcher], words: Words) -> list[Found]:
    """What a lot of automata finds in each text."""
    covered = np.zeros(len(words.hashes), bool)
    out: list[Found] = [([], set()) for _ in words.raw]
    for matcher in lot:
        more, items = matcher.scan(words)
        covered |= more
        for text, item in items:
            out[text][1].add(item)
    starts = words.ends - words.counts
    if covered.any():
        # A range ends with its text.
        on = np.flatnonzero(covered)
        fresh = np.r_[True, (np.diff(on) != 1) | (words.text[on[1:]] != words.text[on[:-1]])]
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(on)] - 1
        for a, b in zip(on[first].tolist(), on[last].tolist(), strict=True):
            text = int(words.text[a])
            out[text][0].append((a - int(starts[text]), b + 1 - int(starts[text])))
    return out


def _united(finds: list[Found]) -> Found:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(x for spans, _ in finds for x in spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, set().union(*(items for _, items in finds))


_MD5, _FINDS = "_text_md5", "_finds"


def _over(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int, pass_words: int, kernel, schema) -> DataFrame:
    """``kernel`` (a slice of the rows, their texts, Words, finds) over all rows, for the whole benchmark."""
    spark = docs.sparkSession
    every = lots(benchmark, window, max_words, pass_words)
    lot, more = next(every, []), next(every, None)
    shared = spark.sparkContext.broadcast(lot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = shared.value
        for batch in batches:
            for part, texts in pieces(batch):
                words = Words(texts)
                yield kernel(part, texts, words, scan(lot, words))

    if more is None:
        return docs.mapInArrow(lambda batches: lean(run(batches)), schema)

    def find(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lot = shared.value
            for batch in batches:
                for part, texts in pieces(batch):
                    finds = scan(lot, Words(texts))
                    hit = [i for i, (spans, _) in enumerate(finds) if spans]
                    spans, items = [[x for span in finds[i][0] for x in span] for i in hit], [sorted(finds[i][1]) for i in hit]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit, pa.int64())), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[_MD5, "spans", "items"])

        return lambda batches: lean(run(batches))

    # Copies of a text have the same finds, so a text's digest names them.
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    ws, found = Workspace(spark, "contamination"), []
    texts = docs.where("text IS NOT NULL").select(digest.alias(_MD5), "text")
    while lot is not None:
        found.append(ws.stage(texts.mapInArrow(find(shared), f"{_MD5} binary, spans array<int>, items array<string>").dropDuplicates([_MD5]), "finds"))
        shared.unpersist()
        lot, more = more, next(every, None)
        if lot is not None:
            shared = spark.sparkContext.broadcast(lot)
    finds = found[0]
    for other in found[1:]:
        finds = finds.union(other)
    finds = ws.stage(finds.groupBy(_MD5).agg(F.collect_list(F.struct("spans", "items")).alias(_FINDS)), "all")
    ws.keep_only(finds)
    names = docs.columns
    joined = docs.withColumn(_MD5, digest).join(finds, _MD5, "left").select(*names, _FINDS)

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                given = [[(list(zip(f["spans"][::2], f["spans"][1::2], strict=True)), set(f["items"])) for f in x or ()] for x in part.column(part.num_columns - 1).to_pylist()]
                yield kernel(part.select(names), texts, Words(texts), [_united(x) for x in given])

    return joined.mapInArrow(lambda batches: lean(late(batches)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 250_000, pass_words: int = 1_000_000) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 (of the matched item ids, sorted as
    strings, joined by commas), contaminated. A null or empty text has no words and no hits; an item without words
    matches nothing; an item with a null id covers words but isn't counted or listed; an empty benchmark gives no hits.
    Repeated rows and null ids pass through; other columns are not read. No shuffle unless the benchmark has over
    ``pass_words`` words; then the finds of each lot are joined by text.
    """

    def kernel(part: pa.RecordBatch, texts: list, words: Words, finds: list[Found]) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in spans) for spans, _ in finds]
        digest = [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, items in finds]
        cols = [part.column(0), pa.array(words.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(items) for _, items in finds], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _over(docs.select("doc_id", "text"), benchmark, window, max_words, pass_words, kernel, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    words = Words([text])
    raw, out, last = words.raw[0], [], 0
    for a, b in spans:
        out.append(raw[last : int(words.begins[a])])
        last = int(words.stops[b - 1])
    return b"".join([*out, raw[last:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = 250_000, pass_words: int = 1_000_000) -> DataFrame:
    """The documents without benchmark passages: spans of hit words are cut from the texts; a document whose words are
    hit by more than ``max_coverage`` is dropped whole. Columns stay as they are, with n_chars set anew where a text
    changes. Null and empty texts are kept, as are repeated rows and null ids that aren't hit; an empty benchmark changes
    nothing. No shuffle unless the benchmark has over ``pass_words`` words."""

    def kernel(part: pa.RecordBatch, texts: list, words: Words, finds: list[Found]) -> pa.RecordBatch:
        names = part.schema.names
        keep = [sum(b - a for a, b in spans) <= max_coverage * n for (spans, _), n in zip(finds, words.counts.tolist(), strict=True)]
        new = [clean(t, spans) if spans and k else t for t, (spans, _), k in zip(texts, finds, keep, strict=True)]
        cols = list(part.columns)
        cols[names.index("text")] = pa.array(new, pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            cols[k] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, cols[k].to_pylist(), strict=True)], cols[k].type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return _over(docs, benchmark, window, max_words, pass_words, kernel, docs.schema)
