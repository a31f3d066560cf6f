"""Byte-level BPE ids as the tokenizers library gives them, with a memory of pre-tokens.

Byte-level BPE never merges across pre-tokens. Texts of Latin letters and common signs are cut as the library's pattern
cuts them, in numpy arrays of code points, and each new pre-token is encoded by the library once. All other texts, texts that
hold one of the tokenizer's added tokens, and other kinds of tokenizer go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from readqc.llm.words import Known, Lists, codes_of, hashes, sums

#: Letters, numbers and white space below U+0250 as the pattern's classes have them, and the other signs
#: that texts cut here may hold.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = r"\t\n\r "
SAFE = "\t\n\r -~¡-ɏ"
#: What follows an apostrophe to make a pre-token of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, SIGN, UNSAFE = range(5)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point below U+0250; the last place is for all others."""
    out = np.full(0x251, UNSAFE, np.uint8)
    for kind, form in ((SIGN, SAFE), (NUMBER, NUMBERS), (LETTER, LETTERS), (SPACE, SPACES)):
        out[[i for i in range(0x250) if re.fullmatch(f"[{form}]", chr(i))]] = kind
    return out


@functools.cache
def alphabet() -> np.ndarray:
    """The character of each byte in byte-level BPE: printable ones of Latin-1 stand for themselves, the others take the
    code points from 256 on."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return np.array([b if own[b] else 256 + sum(not x for x in own[:b]) for b in range(256)], np.uint32)


def cut(codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie one after another and start at ``begins``; none is empty."""
    n = len(codes)
    head = np.zeros(n + 1, bool)
    head[begins] = True
    head[n] = True
    run = head.copy()
    run[1:n] |= kinds[1:] != kinds[:-1]
    first = np.flatnonzero(run[:n])
    end = np.r_[first[1:], n]
    start = run.copy()
    # Of white space before something, the last character stands alone; a blank goes with what follows.
    after = end[np.flatnonzero((kinds[first] == SPACE) & ~head[end])]
    start[after - 1] = True
    start[after[np.flatnonzero(codes[after - 1] == 0x20)]] = False
    # An apostrophe by itself, and not after a blank, takes one of the endings with it.
    lone = np.flatnonzero(codes[first] == 0x27)
    lone = first[lone[(end[lone] - first[lone] == 1) & start[first[lone]] & ~head[end[lone]]]]
    lone = lone[kinds[lone + 1] == LETTER]
    if len(lone):
        padded = np.r_[codes, np.zeros(2, codes.dtype)]
        takes = np.zeros(len(lone), np.int64)
        for ending in ENDINGS:
            fits = np.ones(len(lone), bool)
            for k, c in enumerate(ending):
                fits &= padded[lone + 1 + k] == ord(c)
                fits &= ~head[np.minimum(lone + 1 + k, n)]
            takes[fits & (takes == 0)] = len(ending)
        lone, takes = lone[takes > 0], takes[takes > 0]
        start[lone + 1] = False
        start[lone + 1 + takes] = True
    return np.flatnonzero(start[:n])


class ByteBpe:
    def __init__(self, path: str, keep: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.keep = Tokenizer.from_file(path), keep
        self.library.no_truncation()
        self.library.no_padding()
        form = str(self.library.pre_tokenizer)
        self.cuts = "ByteLevel" in form and "add_prefix_space=False" in form and "use_regex=True" in form and "Sequence" not in form and self.library.normalizer is None
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        # The same model for pre-tokens, whose bytes are written in the model's alphabet, which has no white space.
        self.cut_already = Tokenizer.from_file(path)
        self.cut_already.no_truncation()
        self.cut_already.no_padding()
        self.cut_already.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = alphabet()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(token) for token in vocab]
        signs = {t for t in vocab if len(t) == 1}
        self.cuts = self.cuts and all(chr(c) in signs for c in self.alphabet.tolist())
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = Known(), Lists()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str], at_once: int = 256) -> None:
        """Encode new pre-tokens, many at a time, one on a line."""
        for i in range(0, len(words), at_once):
            part = [w.encode("utf-8", "surrogatepass") for w in words[i : i + at_once]]
            codes = self.alphabet[np.frombuffer(b"".join(part), np.uint8)]
            ends = np.cumsum([len(w) for w in part])
            lines = np.insert(codes, ends[:-1], 0x0A).tobytes().decode("utf-32-le")
            ids = np.array(self.cut_already.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            # Ids stand for so many bytes each, and a pre-token's ids for all of its bytes.
            last = np.searchsorted(np.cumsum(self.bytes[ids]), ends)
            self.ids.add(ids, np.diff(last, prepend=-1))

    def _numbers(self, texts: list[str], codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The known numbers of all pre-tokens of safe, non-empty texts, and each text's end among them."""
        joined = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lens) - lens
        starts = cut(codes, kinds, begins)
        sizes = np.diff(np.r_[starts, len(codes)])
        h = hashes(codes, starts, sizes)
        if self.known.n > self.keep:
            self._forget()
        found = self.known.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            at = new[at]
            self._learn([joined[a : a + k] for a, k in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)])
            self.known.add(fresh)
            found[new] = self.known.find(h[new])
        return found, np.searchsorted(starts, begins + lens)

    def _sorted_out(self, texts: list[str | None]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Places of the texts to cut here, and of those for the library; code points of the former, and their classes."""
        own, other = [], []
        for i, t in enumerate(texts):
            if t:
                safe = self.cuts and (t.isascii() or int(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).max()) < 0x250) and not (self.special and self.special.search(t))
                (own if safe else other).append(i)
        codes = codes_of("".join([texts[i] for i in own]))
        kinds = classes()[codes]
        # Control characters and the like are few; one pass over all tells whether there are any.
        if len(codes) and kinds.max() == UNSAFE:
            ends = np.cumsum([len(texts[i]) for i in own])
            safe = [k.max() < UNSAFE for k in np.split(kinds, ends[:-1])]
            other += [i for i, ok in zip(own, safe, strict=True) if not ok]
            own = [i for i, ok in zip(own, safe, strict=True) if ok]
            codes = codes_of("".join([texts[i] for i in own]))
            kinds = classes()[codes]
        return own, other, codes, kinds

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts, one text after another, and the count of each; a null counts as empty."""
        own, other, *cut_by = self._sorted_out(texts)
        counts = np.zeros(len(texts), np.int64)
        flat = np.zeros(0, np.uint32)
        if own:
            found, ends = self._numbers([texts[i] for i in own], *cut_by)
            flat, lens = self.ids.take(found)
            counts[own] = sums(lens, ends)
        if not other:
            return flat, counts
        ends = np.cumsum(counts[own]) if own else np.zeros(0, np.int64)
        parts: dict[int, np.ndarray] = {i: flat[e - c : e] for i, e, c in zip(own, ends.tolist(), counts[own].tolist(), strict=True)} if own else {}
        for i in other:
            parts[i] = self._whole(texts[i])
            counts[i] = len(parts[i])
        return np.concatenate([parts[i] for i in sorted(parts)]), counts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each whole text."""
        own, other, *cut_by = self._sorted_out(texts)
        counts = np.zeros(len(texts), np.int64)
        if own:
            found, ends = self._numbers([texts[i] for i in own], *cut_by)
            counts[own] = sums(self.ids.lens[found], ends)
        for i in other:
            counts[i] = len(self._whole(texts[i]))
        return counts


@functools.lru_cache(1)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
