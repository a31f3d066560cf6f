"""Language ID of code-switched text by a linear-chain conditional random field over words.

A run of over 40 letters, as of text without spaces, is cut into consecutive words of 40 and a rest. Features of a word
are its affixes, its character n-grams with its edges, and lexicon features (the word itself, if it is among the frequent
words of a language in the training rows); hashed into a fixed table of weights. Transitions between the languages of
neighbouring words, and the language that a text starts in, are learned with them, from training sentences put together to
switch language. Forward-backward labels all words of a slice at once: the words of all its texts are one chain with
restarts, cut into blocks; the products of the blocks' transfer matrices link the blocks exactly.

Texts are arrays of code points: words, their hashes and the features of all words that aren't remembered are found without
a loop over words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.common import lean, pieces
from readqc.llm.words import Known, codes_of, hashes, mixed, spread, sums

LETTER = re.compile(r"[^\W\d_]")
LONGEST = 40  # letters of a word
UNKNOWN = "und"
_BLOCK = 128


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether words are made of it, and whether it is a letter."""
    every = [chr(i) for i in range(0x110000)]
    word = np.zeros(0x110000, bool)
    word[[ord(c) for c in LETTER.findall("".join(every[:0xD800] + every[0xE000:]))]] = True
    return word, np.array([c.isalpha() for c in every], bool)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words of the lower-cased texts, one word after another; the words' lengths; the number of words
    up to the end of each text."""
    low = [t.lower() if t else "" for t in texts]
    codes = codes_of("\n".join(low))
    mask = _letters()[0][codes]
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    starts, ends = edge[::2], edge[1::2]
    # The feed between two texts is no letter, so no word spans them.
    last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in low]) - 1) if len(low) else np.zeros(0, np.int64)
    lens = ends - starts
    if (lens > LONGEST).any():
        parts = -(-lens // LONGEST)
        final = lens - (parts - 1) * LONGEST
        lens = np.full(int(parts.sum()), LONGEST)
        lens[np.cumsum(parts) - 1] = final
        last = np.r_[0, np.cumsum(parts)][last]
    return codes[mask], lens, last


def _place(kind: int, *codes: np.ndarray, size: int) -> np.ndarray:
    """Place in the table of weights of a feature: its kind and its characters."""
    h = np.uint64(kind)
    for c in codes:
        h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(31))
    return (mixed(h) % np.uint64(size)).astype(np.int32)


def features(codes: np.ndarray, lens: np.ndarray, lexicon: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words' features, ordered by word, and their number of each word: character 1- to 3-grams of the
    word between ``<`` and ``>``, prefixes and suffixes of one to three letters with their edge, the word if the (sorted)
    ``lexicon`` has its hash."""
    n = len(lens)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    long = lens + 2
    starts = np.cumsum(long) - long
    w = np.zeros(int(long.sum()), np.uint32)
    w[spread(starts + 1, lens)] = codes
    w[starts], w[starts + long - 1] = ord("<"), ord(">")
    owner = np.repeat(np.arange(n), long)
    two = np.flatnonzero(owner[:-1] == owner[1:])
    three = np.flatnonzero(owner[:-2] == owner[2:])
    end = starts + long
    fourth = np.minimum(3, long - 1)  # the whole of a word of one letter is its own affix
    grams = [(owner, _place(1, w, size=size)), (owner[two], _place(2, w[two], w[two + 1], size=size)), (owner[three], _place(3, w[three], w[three + 1], w[three + 2], size=size))]
    every = np.arange(n)
    front, back = [w[starts + k] for k in range(3)], [w[end - 1 - k] for k in range(3)]
    for k, (edge, more) in enumerate(((front, w[starts + fourth]), (back, w[end - 1 - fourth]))):
        grams += [(every, _place(4 + k, *edge[:2], size=size)), (every, _place(6 + k, *edge, size=size)), (every, _place(8 + k, *edge, more, size=size))]
    h = hashes(codes, np.cumsum(lens) - lens, lens)
    if len(lexicon):
        listed = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h)
        grams.append((listed, (mixed(h[listed]) % np.uint64(size)).astype(np.int32)))
    of, place = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    counts = np.bincount(of, minlength=n)
    # Each kind is in order of words already, so its places in the output follow from running counts.
    at = np.cumsum(counts) - counts
    out = np.empty(len(place), np.int32)
    for word, p in grams:
        c = np.bincount(word, minlength=n)
        first = np.cumsum(c) - c
        out[at[word] + np.arange(len(word)) - first[word]] = p
        at = at + c
    return out, counts


def forward_backward(emit: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label probabilities of each word (n x L), and with ``count`` the expected count of each transition (L x L).

    ``emit``: positive scores n x L; ``begins``: True at the first word of each text; ``trans``, ``start``: positive.
    """
    n, labels = emit.shape
    counts = np.zeros((labels, labels))
    if not n:
        return np.zeros((0, labels)), counts
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    # Word k of all blocks side by side: _BLOCK x L x blocks.
    e = np.ascontiguousarray(np.concatenate([emit, np.ones((pad, labels))]).reshape(blocks, _BLOCK, labels).transpose(1, 2, 0))
    b = np.concatenate([begins, np.ones(pad, bool)]).reshape(blocks, _BLOCK)
    b[0, 0] = True
    # Blocks that begin a text at word k: they are few.
    heads = [np.flatnonzero(b[:, k]) for k in range(_BLOCK)]
    first, forth = start[:, None], np.ascontiguousarray(trans.T)

    def scaled(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(v.sum(0), 1e-300)

    # Row i of a block's transfer matrix: what label i before the block leads to.
    whole = np.zeros((labels, labels, blocks))
    whole[range(labels), range(labels)] = 1.0
    for k in range(_BLOCK):
        moved = np.empty_like(whole)
        for i in range(labels):
            np.matmul(forth, whole[i], out=moved[i])
        if len(at := heads[k]):
            moved[:, :, at] = whole[:, :, at].sum(1)[:, None] * first
        moved *= e[k]
        if k % 4 == 3:
            moved /= np.maximum(moved.sum((0, 1)), 1e-300)
        whole = moved
    enter, leave = np.empty((labels, blocks)), np.empty((labels, blocks))
    step = np.ascontiguousarray(whole.transpose(2, 0, 1))
    v = np.full(labels, 1 / labels)
    for i in range(blocks):
        enter[:, i] = v
        v = v @ step[i]
        v = v / max(v.sum(), 1e-300)
    v = np.ones(labels)
    for i in range(blocks - 1, -1, -1):
        leave[:, i] = v
        v = step[i] @ v
        v = v / max(v.sum(), 1e-300)
    ahead = np.empty((_BLOCK, labels, blocks))
    v = enter
    for k in range(_BLOCK):
        moved = forth @ v
        if len(at := heads[k]):
            moved[:, at] = v[:, at].sum(0) * first
        moved *= e[k]
        ahead[k] = v = scaled(moved)
    back = leave
    post = np.empty_like(ahead)
    for k in range(_BLOCK - 1, -1, -1):
        post[k] = back
        weighed = e[k] * back
        if count:
            before = ahead[k - 1] if k else enter
            inner = ~b[:, k]
            pair = before[:, None, inner] * trans[:, :, None] * weighed[None, :, inner]
            counts += (pair / np.maximum(pair.sum((0, 1)), 1e-300)).sum(2)
        moved = trans @ weighed
        if len(at := heads[k]):
            moved[:, at] = (weighed[:, at] * first).sum(0)
        back = scaled(moved)
    post *= ahead
    post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
    return post.transpose(2, 0, 1).reshape(-1, labels)[:n], counts


@dataclass
class Model:
    langs: list[str]
    lexicon: np.ndarray  # sorted hashes of frequent words
    weights: np.ndarray  # features x L
    trans: np.ndarray
    start: np.ndarray

    def __post_init__(self):
        self._forget()

    def _forget(self) -> None:  # what is remembered of words, in the workers
        self.known, self.scores, self.letter = Known(), np.zeros((0, len(self.langs)), np.float32), np.zeros(0, bool)

    def __reduce__(self):
        return Model, (self.langs, self.lexicon, self.weights, self.trans, self.start)

    def _learn(self, codes: np.ndarray, lens: np.ndarray) -> None:
        places, counts = features(codes, lens, self.lexicon, len(self.weights))
        new = np.add.reduceat(self.weights[places], np.cumsum(counts) - counts, axis=0).astype(np.float32)
        letter = np.logical_or.reduceat(_letters()[1][codes], np.cumsum(lens) - lens)
        new[~letter] = 0.0
        if len(self.scores) < (n := self.known.n + len(lens)):
            self.scores = np.concatenate([self.scores, np.zeros((max(n - len(self.scores), len(self.scores) // 2), len(self.langs)), np.float32)])
            self.letter = np.concatenate([self.letter, np.zeros(len(self.scores) - len(self.letter), bool)])
        self.scores[self.known.n : n], self.letter[self.known.n : n] = new, letter

    def label(self, texts: list[str | None], keep: int = 200_000) -> tuple[list[str], list[float]]:
        """Language of each text, and its share of the probabilities of the text's words; a full memory of words is
        emptied, which changes no result."""
        if self.known.n > keep:
            self._forget()
        codes, lens, ends = words_of(texts)
        if not len(lens):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        starts = np.cumsum(lens) - lens
        h = hashes(codes, starts, lens)
        ids = self.known.find(h)
        new = np.flatnonzero(ids < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            at = new[at]
            self._learn(codes[spread(starts[at], lens[at])], lens[at])
            self.known.add(fresh)
            ids[new] = self.known.find(h[new])
        emit = self.scores[ids].astype(np.float64)
        emit = np.exp(emit - emit.max(1, keepdims=True))
        begins = np.zeros(len(ids) + 1, bool)
        begins[np.r_[0, ends[:-1]]] = True
        post, _ = forward_backward(emit, begins[:-1], self.trans, self.start, count=False)
        post[~self.letter[ids]] = 0.0
        mass = sums(post, ends)
        every = mass.sum(1)
        best = mass.argmax(1)
        share = np.minimum(1.0, mass.max(1) / np.maximum(every, 1e-300))
        langs = [UNKNOWN if m < 0.5 else self.langs[k] for k, m in zip(best.tolist(), every.tolist(), strict=True)]
        return langs, np.where(every < 0.5, 0.0, share).tolist()


_warm: list[Model | None] = [None, None]


def warm(model: Model) -> Model:
    """A copy of a broadcast model that remembers words across the tasks of a worker. Only the last model's is kept, as
    broadcast values live as long as the worker."""
    if _warm[0] is not model:
        _warm[:] = [model, Model(model.langs, model.lexicon, model.weights, model.trans, model.start)]
    return _warm[1]


def fit(rows: list[tuple[str, str]], size: int = 1 << 16, rounds: int = 18, lexicon_words: int = 300, seed: int = 7) -> Model:
    """Learn from (language, text) rows. Sentences of the rows, in runs of two to six of one language, are put together
    to chains of eight runs that switch, and the weights, transitions and starts are fitted by gradients of their likelihood."""
    langs = sorted({lang for lang, _ in rows}) or [UNKNOWN]
    place = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, str]] = []
    for lang, text in rows:
        sentences = [s for s in re.split(r"[.!?\n]+", text) if LETTER.search(s)]
        i = 0
        while i < len(sentences):
            k = int(rng.integers(2, 7))
            runs.append((place[lang], "\n".join(sentences[i : i + k])))
            i += k
    labels = len(langs)
    weights, trans, start = np.zeros((size, labels)), np.zeros((labels, labels)), np.zeros(labels)
    empty = np.zeros(0, np.uint64)
    if not runs:
        return Model(langs, empty, weights.astype(np.float32), np.ones((labels, labels)), np.ones(labels))
    runs = [runs[r] for r in rng.permutation(len(runs))]
    codes, lens, ends = words_of([text for _, text in runs])
    starts = np.cumsum(lens) - lens
    truth = np.repeat([k for k, _ in runs], np.diff(np.r_[0, ends]))
    begins = np.zeros(len(lens) + 1, bool)
    begins[np.r_[0, ends[:-1]][::8]] = True
    begins = begins[:-1]
    distinct, at, ids = np.unique(hashes(codes, starts, lens), return_index=True, return_inverse=True)
    wanted = np.bincount(ids * labels + truth, minlength=len(distinct) * labels).reshape(-1, labels).astype(np.float64)
    frequent = np.argsort(-wanted, 0, kind="stable")[:lexicon_words]
    lexicon = np.unique(distinct[frequent[np.take_along_axis(wanted, frequent, 0) > 0]])
    flat, counts = features(codes[spread(starts[at], lens[at])], lens[at], lexicon, size)
    owner, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    inner = ~begins[1:]
    moves = np.bincount(truth[:-1][inner] * labels + truth[1:][inner], minlength=labels * labels).reshape(labels, labels).astype(np.float64)
    opens = np.bincount(truth[begins], minlength=labels).astype(np.float64)
    uses = np.bincount(flat, np.bincount(ids, minlength=len(counts))[owner], size)[:, None] + 1.0
    speed = np.zeros_like(weights)
    for k in range(rounds):
        score = np.add.reduceat(weights[flat], first, axis=0)
        emit = np.exp(score - score.max(1, keepdims=True))
        post, expected = forward_backward(emit[ids], begins, np.exp(trans), np.exp(start))
        got = np.stack([np.bincount(ids, post[:, j], len(counts)) for j in range(labels)], 1)
        slope = (wanted - got)[owner]
        slope = np.stack([np.bincount(flat, slope[:, j], size) for j in range(labels)], 1) - 0.1 * weights
        speed = 0.7 * speed + slope / np.sqrt(uses * len(ids)) * 2.0
        weights = np.clip(weights + speed * min(1.0, (k + 1) / 5), -8, 8)
        trans = trans + np.clip((moves - expected) / np.maximum(moves + expected, 50.0), -0.5, 0.5)
        opened = post[begins].sum(0)
        start = start + np.clip((opens - opened) / np.maximum(opens + opened, 50.0), -0.5, 0.5)
    return Model(langs, lexicon, weights.astype(np.float32), np.exp(trans - trans.max()), np.exp(start - start.max()))


def sample(docs: DataFrame, usable: Column, per_lang: int, max_chars: int, max_langs: int) -> list[tuple[str, str]]:
    """At most ``per_lang`` different (language, text) rows of each of the ``max_langs`` languages with the most rows, by a
    hash of id and text; texts of over ``max_chars`` characters aren't taken. Counts are made over all rows; copies of a
    row count once among those taken, and only these reach the driver."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    # Twice the share, as some are copies; the ranks make the bound exact.
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / float(1 << 63)
    near = rows.select("lang", "text", u.alias("u")).join(F.broadcast(counts), "lang").where(F.col("u") * F.col("n") < 2 * per_lang)
    once = near.groupBy("lang", "text").agg(F.min("u").alias("u"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    taken = once.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "text").collect()
    return sorted((r["lang"], r["text"]) for r in taken)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that nothing is learned from: crc32 of the id as text is a multiple of 5. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = 200, max_chars: int = 20_000, max_langs: int = 200) -> Model:
    """A model learned from text and lang of a bounded sample of the rows that aren't held out: at most ``per_lang`` rows
    of each language, of ``max_chars`` characters at most, in at most ``max_langs`` languages. Without usable rows it knows
    no language and predicts ``und``."""
    return fit(sample(docs, ~held_out(), per_lang, max_chars, max_langs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every whole text.

    One row for each row of ``docs``: doc_id, held_out, lang_pred (``und`` if the text is null or has no letter), score
    (the language's share of the words' probabilities; 0 for ``und``). Ties go to the first language by name. Repeated
    rows and null ids pass through; no other column is read. No shuffle; the broadcast model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = warm(shared.value)
        for batch in batches:
            for part, texts in pieces(batch):
                lang, score = model.label(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lambda batches: lean(run(batches)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a share of at least ``least``; columns stay as they are. Null and empty
    texts and those without a letter go; repeated rows and null ids are judged by their texts like all others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = warm(shared.value)
        for batch in batches:
            for part, texts in pieces(batch):
                yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in zip(*model.label(texts), strict=True)], pa.bool_()))

    return docs.mapInArrow(lambda batches: lean(run(batches)), docs.schema)
