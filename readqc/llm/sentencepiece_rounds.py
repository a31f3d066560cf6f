"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Texts are cut where no vocabulary piece can reach across: between two characters that stand side by side in no piece.
The distinct words of a slice that aren't remembered become one flat numpy array of symbols. Each round finds the smallest
pair rank of every word by a segmented minimum, merges all leftmost occurrences of that pair at once, compacts, and
retires the words in which no pair is left. A pair whose merged piece could start a still better merge is merged once a
round, so that the order is the library's. A word of over ``LONG`` characters, of which each round would merge little,
takes its pairs from a heap in the same order. Ids are decoded by gathering the bytes of their pieces.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readqc.llm.common import lean, pieces
from readqc.llm.words import Known, Lists, codes_of, hashes, mixed, spread, sums

SPACE = "▁"
UNKNOWN = " ⁇ "  # how the library decodes its unknown id
LONG = 256
_NONE = np.iinfo(np.int32).max
_BLANK, _MARK = ord(" "), ord(SPACE)


codecs.register_error("replace-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceModel:
    """Vocabulary and merge table of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.n = n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int32)
        vocab: dict[str, int] = {}
        for i, piece in enumerate(text):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                vocab[piece] = i
        if (self.byte_ids < 0).any() or sp.encode("a b") != sp.encode("a▁b") or sp.encode("a  b ")[-1:] != sp.encode("a b ")[-1:]:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        score = {piece: -sp.get_score(i) for piece, i in vocab.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values())))}
        rank = {piece: place[s] for piece, s in score.items()}
        shared = Counter(rank[piece] for piece in vocab if len(piece) > 1)
        symbol = dict(vocab)
        for piece in vocab:
            for c in piece:
                symbol.setdefault(c, len(symbol) + n)
        self.other = n + len(symbol) + len(vocab) + 1
        chars = {c: i for c, i in symbol.items() if len(c) == 1}
        self.wide = self.other + 1
        pairs: dict[int, tuple[int, int]] = {}
        # Pieces of equal score go by place in the word, and some can start a better merge: these go one at a time.
        hasty = {vocab[piece] for piece in vocab if shared[rank[piece]] > 1}
        for piece, i in vocab.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in symbol and right in symbol:
                    pairs[symbol[left] * self.wide + symbol[right]] = (rank[piece], i)
                    hasty.update(vocab[x] for x in (left, right) if x in rank and len(x) > 1 and rank[x] > rank[piece])
        self.pairs = Known(18)
        self.pairs.add(mixed(np.fromiter(pairs, np.uint64, len(pairs))))
        self.pair_rank = np.array([r for r, _ in pairs.values()] + [_NONE], np.int32)  # the last one is for no pair
        self.pair_piece = np.array([i for _, i in pairs.values()] + [-1], np.int32)
        self.hasty = np.zeros(self.wide, bool)
        self.hasty[list(hasty)] = True
        self.table = np.full(0x110000, self.other, np.int32)
        self.table[[ord(c) for c in chars]] = list(chars.values())
        # Which characters stand side by side in a piece.
        inner = sorted({c for piece in vocab if len(piece) > 1 for c in piece})
        self.small = np.zeros(0x110000, np.uint16)
        self.small[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for piece in vocab:
            at = self.small[codes_of(piece)]
            self.beside[at[:-1], at[1:]] = True
        raw = [b"" if sp.is_control(i) else UNKNOWN.encode() if sp.is_unknown(i) else piece.replace(SPACE, " ").encode() for i, piece in enumerate(text)]
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.raw_bytes, self.raw_lens = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int32)
        self.raw_starts = np.cumsum(self.raw_lens) - self.raw_lens
        # Each id in decimals and a comma, filled up with zero bytes.
        digits = len(str(n)) + 1
        self.decimals = np.frombuffer(b"".join([f"{i},".encode().ljust(digits, b"\0") for i in range(n)]), np.uint8).reshape(n, digits)

    def cut(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Starts of the independent words of texts that lie one after another and start at ``begins``."""
        small = self.small[codes]
        start = np.ones(len(codes), bool)
        start[1:] = ~self.beside[small[:-1], small[1:]]
        start[begins] = True
        return np.flatnonzero(start)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find(mixed(left.astype(np.uint64) * np.uint64(self.wide) + right.astype(np.uint64)))

    def _by_heap(self, sym: np.ndarray) -> np.ndarray:
        """Places of the symbols that are left of one long word, and in ``sym`` what they are."""
        n = len(sym)
        pair = self._pair(sym[:-1], sym[1:])
        at = np.flatnonzero(pair >= 0)
        heap = list(zip(self.pair_rank[pair[at]].tolist(), at.tolist(), (at + 1).tolist(), sym[at].tolist(), sym[at + 1].tolist(), strict=True))
        heapq.heapify(heap)
        s, after, ahead = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        merges: dict[tuple[int, int], tuple[int, ...]] = {}

        def merge(a: int, b: int) -> tuple[int, ...]:
            found = merges.get((a, b))
            if found is None:
                k = int(self._pair(np.array([a]), np.array([b]))[0])
                found = merges[a, b] = (int(self.pair_rank[k]), int(self.pair_piece[k])) if k >= 0 else ()
            return found

        def offer(i: int, j: int) -> None:
            if found := merge(s[i], s[j]):
                heapq.heappush(heap, (found[0], i, j, s[i], s[j]))

        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if s[i] != a or s[j] != b or after[i] != j:
                continue
            s[i], s[j] = merge(a, b)[1], -1
            after[i] = k = after[j]
            if k < n:
                ahead[k] = i
                offer(i, k)
            if ahead[i] >= 0:
                offer(ahead[i], i)
        sym[:] = s
        return np.flatnonzero(sym >= 0)

    def encode_words(self, code: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (code points, one word after another), one word after another, and the count of each word."""
        words = len(lens)
        code = np.where(code == _BLANK, _MARK, code).astype(np.int64)
        word = np.repeat(np.arange(words, dtype=np.int32), lens)
        sym = self.table[code]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if (lens > LONG).any():
            ends = np.cumsum(lens)
            for w in np.flatnonzero(lens > LONG).tolist():
                part = slice(int(ends[w] - lens[w]), int(ends[w]))
                left = self._by_heap(own := sym[part].copy())
                done.append((word[part][left], own[left], code[part][left]))
            short = np.repeat(lens <= LONG, lens)
            sym, word, code = sym[short], word[short], code[short]
        # The pair that starts at each symbol; the last place is for none.
        pair = np.full(len(sym), -1, np.int32)
        at = np.flatnonzero(word[:-1] == word[1:])
        pair[at] = self._pair(sym[at], sym[at + 1])
        while len(sym):
            rank = self.pair_rank[pair]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            if (over := low == _NONE).any():
                over = np.repeat(over, size)
                done.append((word[over], sym[over], code[over]))
                live = ~over
                sym, word, code, pair, rank = sym[live], word[live], code[live], pair[live], rank[live]
                size, low = size[low != _NONE], low[low != _NONE]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(low, size))
            # Overlapping occurrences (a pair of equal symbols) stand side by side in one word: every other one is merged.
            fresh = np.r_[True, (np.diff(pick) != 1) | (word[pick[1:]] != word[pick[:-1]])]
            if not fresh.all():
                begin = pick[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                pick = pick[(pick - begin) % 2 == 0]
            made = self.pair_piece[pair[pick]]
            if (rush := self.hasty[made]).any():
                firsts = np.r_[True, word[pick[1:]] != word[pick[:-1]]]
                pick, made = pick[~rush | firsts], made[~rush | firsts]
            sym[pick] = made
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, word, code, pair = sym[keep], word[keep], code[keep], pair[keep]
            pick -= np.arange(len(pick))
            at = np.concatenate([pick, pick[pick > 0] - 1])
            at = at[at + 1 < len(sym)]
            same = word[at] == word[at + 1]
            pair[at[~same]] = -1
            at = at[same]
            pair[at] = self._pair(sym[at], sym[at + 1])
            pair[-1] = -1
        if not done:
            return np.zeros(0, np.int32), np.zeros(words, np.int64)
        word, sym, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, sym, code = word[order], sym[order], code[order]
        fall = sym >= self.n
        if not fall.any():
            return sym, np.bincount(word, minlength=words)
        width = np.ones(len(sym), np.int64)
        width[fall] = 1 + (code[fall] > 0x7F) + (code[fall] > 0x7FF) + (code[fall] > 0xFFFF)
        ids = np.repeat(sym, width)
        where = (np.cumsum(width) - width)[fall]
        data = np.frombuffer(code[fall].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        ids[spread(where, width[fall])] = self.byte_ids[data]
        return ids.astype(np.int32), np.bincount(word, width, words).astype(np.int64)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of id sequences that lie one after another: the bytes of their pieces, without the dummy
        space; each byte that isn't part of a character becomes U+FFFD."""
        lens = self.raw_lens[ids]
        flat = self.raw_bytes[spread(self.raw_starts[ids], lens)].tobytes()
        out, start = [], 0
        for size in sums(lens, np.cumsum(counts)).tolist():
            text = flat[start : start + size]
            start += size
            text = text[1:] if text[:1] == b" " else text
            try:
                if not text.isascii():
                    text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace-each-byte").encode()
            out.append(text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return self.decode_all(np.array(ids, np.int32), np.array([len(ids)]))[0].decode()


@functools.lru_cache(1)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes texts and remembers about ``keep`` words; a full memory is emptied, which changes no result."""

    def __init__(self, path: str, keep: int = 400_000):
        self.model, self.keep = load(path), keep
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = Known(), Lists(np.int32)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and the count of each; a null counts as empty."""
        some = [i for i, t in enumerate(texts) if t]
        counts = np.zeros(len(texts), np.int64)
        if not some:
            return np.zeros(0, np.int32), counts
        codes = codes_of("".join([f" {texts[i]}" for i in some]))  # with the dummy space that the library adds
        codes = np.where((codes == _BLANK), np.uint32(_MARK), codes)
        lens = np.fromiter((len(texts[i]) + 1 for i in some), np.int64, len(some))
        ends = np.cumsum(lens)
        starts = self.model.cut(codes, ends - lens)
        sizes = np.diff(np.r_[starts, len(codes)])
        h = hashes(codes, starts, sizes)
        if self.known.n > self.keep:
            self._forget()
        found = self.known.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            at = new[at]
            ids, n = self.model.encode_words(codes[spread(starts[at], sizes[at])], sizes[at])
            self.ids.add(ids, n)
            self.known.add(fresh)
            found[new] = self.known.find(h[new])
        ids, n = self.ids.take(found)
        counts[some] = sums(n, np.searchsorted(starts, ends))
        return ids, counts

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Of id sequences that lie one after another, each in decimals joined by commas."""
        table = self.model.decimals[ids]
        full = table != 0
        ends = sums(full.sum(1), np.cumsum(counts)).cumsum()
        flat = table[full].tobytes()
        return [flat[a : max(a, b - 1)] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, and decode each document's ids.

    One row for each row of ``docs``: the id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids. A null
    text counts as empty: no ids, and the digests of the empty string. Null ids and repeated rows pass through; no
    other column is read. No shuffle; memory is one slice of a batch and the bounded memory of words. A text of a
    million characters without a space is encoded in seconds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(model_path)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                ids, n = encode(texts)
                digest = [hashlib.sha256(x).hexdigest() for x in encode.joined(ids, n)]
                back = [hashlib.sha256(x).hexdigest() for x in encode.model.decode_all(ids, n)]
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(lambda batches: lean(run(batches)), schema)
