"""Token files, digest cache, SentencePiece."""

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from readqc.llm import byte_bpe, digest_cache, repair, sentencepiece_rounds, words

BPE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LETTERS = "abcdeé ▁ ñ\n\t\r<s>0x0A日本語😀́aaa  ===---\x00 ﻿#'s'tre'll12²½¹_!«» ſ\x1c\x85"


def strings(n=3000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 3001, " " * 777, "ab" * 500, "", "</s>", "<unk>", " x ", "▁", "http://" * 50, "\n\n  \n", "=-" * 300 + "=" * 99, "<|endoftext|>", "a <|endoftext|>b"]


def split(flat, counts):
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_sentencepiece_is_the_librarys():
    sp, encode = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_rounds.Encoder(PIECE)
    texts = [*strings(), None]
    flat, counts = encode(texts)
    every = zip(texts, split(flat, counts), encode.joined(flat, counts), encode.model.decode_all(flat, counts), strict=True)
    for t, ids, joined, back in every:
        assert ids == sp.encode(t or ""), t
        assert joined.decode() == ",".join(map(str, ids))
        assert back.decode() == sp.decode(ids) == encode.model.decode(ids)


def test_sentencepiece_without_spaces():
    """Long texts without spaces take no longer for each character than others, whether cut, merged by rounds or by heap."""
    rng = random.Random(7)
    sp, encode = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_rounds.Encoder(PIECE)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    cjk = [chr(i) for i in range(0x4E00, 0x9FA5)]
    texts = [some(x, n) for x in ("abcdefghijklmnopqrstuvwxyz", cjk, "ACGT", ["the", "quick", "house", "ing", "ation"], "x", "ab") for n in (255, 257, 100_000)] + [some("abcdefghijklmnopqrstuvwxyz", 1_000_000), some(cjk, 1_000_000)]
    began = time.process_time()
    found = split(*encode(texts))
    assert time.process_time() - began < 60
    assert all(ids == sp.encode(t) for t, ids in zip(texts, found, strict=True))


def test_decoding_any_ids():
    """Ids in any order, control ids and lone bytes among them."""
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_rounds.load(PIECE)
    rng = random.Random(8)
    rows = [[rng.randrange(3, 3 + (300 if k % 2 else 31_000)) for _ in range(rng.randint(0, 30))] for k in range(500)]
    whole = [r for r in rows if all(i >= 259 for i in r)]
    got = model.decode_all(np.array([i for r in whole for i in r], np.int32), np.array([len(r) for r in whole]))
    assert [x.decode() for x in got] == [sp.decode(r) for r in whole]
    for r in rows:
        assert model.decode(r) == sp.decode(r), r


def test_a_full_memory_changes_nothing():
    texts = strings(300)
    for make in (lambda keep: sentencepiece_rounds.Encoder(PIECE, keep), lambda keep: byte_bpe.ByteBpe(BPE, keep).encode):
        small, large = make(5), make(100_000)
        assert [split(*small([t]))[0] for t in texts] == split(*large(texts))


@pytest.mark.parametrize("path", [BPE, WORD])
def test_byte_bpe_is_the_librarys(path):
    library, texts, bpe = Tokenizer.from_file(path), [*strings(), None], byte_bpe.ByteBpe(path)
    flat, counts = bpe.encode(texts)
    for t, ids in zip(texts, split(flat, counts), strict=True):
        assert ids == library.encode(t or "", add_special_tokens=False).ids, t
    assert np.array_equal(bpe.count(texts), counts)


def test_pre_tokens():
    """Blanks, feeds and apostrophes in all orders."""
    rng = random.Random(3)
    bits = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "\r", "a", "Z", "é", "1", "²", "!", "'s", "'ll", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    library, bpe = Tokenizer.from_file(BPE), byte_bpe.ByteBpe(BPE)
    assert split(*bpe.encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_known_numbers():
    rng = np.random.default_rng(1)
    known, numbers = words.Known(4), {}
    for n in (3, 40, 1000, 5000):
        h = np.unique(np.r_[rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(1, 50, 5, dtype=np.uint64)])
        h = h[known.find(h) < 0]
        known.add(h)
        numbers |= {x: len(numbers) + i for i, x in enumerate(h.tolist())}
    every = np.array(list(numbers), np.uint64)
    assert known.find(every).tolist() == list(numbers.values())
    assert (known.find(rng.integers(1, 1 << 63, 1000, dtype=np.uint64)) < 0).all()


def test_op9_rows(odd, odd_rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in odd_rows:
        ids = sp.encode(r[1] or "")
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert Counter(map(tuple, sentencepiece_rounds.encode_documents(odd, PIECE).collect())) == want
    assert sentencepiece_rounds.encode_documents(none, PIECE).count() == 0
    with_ids = sentencepiece_rounds.encode_documents(odd, PIECE, with_ids=True).collect()
    assert all(len(r.ids) == r.n_tokens and sha(",".join(map(str, r.ids))) == r.ids_sha256 for r in with_ids)


def test_op2_rows(spark, odd, odd_rows, none, tmp_path):
    library = Tokenizer.from_file(BPE)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 50) for r in odd_rows)
    path = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert Counter(map(tuple, digest_cache.count_tokens(odd, BPE, 50, path).collect())) == want
    cache = spark.read.parquet(path)
    assert cache.count() == cache.select("digest").distinct().count() == len({r[1] or "" for r in odd_rows})
    # Another tokenizer has counts of its own.
    assert digest_cache.count_tokens(odd, WORD, 50, path).agg({"n_tokens": "sum"}).first()[0] == sum(len(Tokenizer.from_file(WORD).encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    assert spark.read.parquet(path).count() == 2 * len({r[1] or "" for r in odd_rows})
    assert digest_cache.count_tokens(none, BPE).count() == 0


def test_stored_counts_are_used(spark, none, tmp_path):
    path, docs = f"file://{tmp_path}/cache", spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    stored = docs.select(digest_cache.digest_of("text").alias("digest")).selectExpr(f"'{digest_cache.file_version(BPE)}' AS version", "digest", "77L AS n_tokens")
    digest_cache.CountCache(spark, path).append(stored)
    assert digest_cache.count_tokens(docs, BPE, cache_path=path).first().n_tokens == 77


def test_op1_rows(odd, odd_rows, none):
    library = Tokenizer.from_file(BPE)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for r in ordered:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, repair.token_files(odd, BPE).collect()), key=lambda x: x[1]) == want
    assert repair.token_files(none, BPE).count() == 0


@pytest.mark.parametrize("kind", ["random", "runs", "copies", "few"])
def test_repair_round_trip(kind):
    rng = np.random.default_rng(3)
    docs = {
        "random": [rng.integers(0, 50257, rng.integers(1, 300)) for _ in range(50)],
        "runs": [np.full(rng.integers(1, 3000), rng.integers(0, 3)) for _ in range(30)],
        "copies": [np.tile(rng.integers(0, 40, 50), rng.integers(1, 9)) for _ in range(60)] * 3,
        "few": [np.array([0]), np.array([7])],
    }[kind]
    docs = [d.astype("<u4") for d in docs]
    shard = repair.Shard(repair.pack([*range(len(docs) - 1), None], docs, 50257))
    assert shard.doc_ids == [*range(len(docs) - 1), None]
    assert np.array_equal(shard.expand(shard.seq), np.concatenate(docs))
    for i, d in enumerate(docs):
        assert np.array_equal(shard.document(i), d)
        assert all(shard.token(i, k) == d[k] for k in range(0, len(d), 1 + len(d) // 20))
    if kind in ("runs", "copies"):
        assert len(shard.rules) and len(shard.seq) < 0.5 * sum(map(len, docs))
        flat = [len(shard.expand(np.array([50257 + i]))) for i in range(len(shard.rules))]
        assert flat == shard.sizes.tolist()


def test_repair_leaves_no_pair():
    """No pair is left that occurs twice without overlap, rare and equal symbols among them."""
    rng = np.random.default_rng(5)
    for n, symbols in ((40_000, 50_000), (5000, 40), (3000, 2), (1, 1), (2, 1), (9, 1)):
        ids = np.minimum(rng.zipf(1.3, n), symbols).astype("<u4")
        ends = np.unique(np.r_[rng.integers(1, n + 1, n // 200), n])
        rules, seq, places = repair.compress(ids, ends, 50_257)
        left, taken = Counter(), {}
        inner = set((places - 1).tolist())
        for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
            if i not in inner and taken.get(pair) != i - 1:
                left[pair] += 1
                taken[pair] = i
        assert max(left.values(), default=0) < 2
        assert len(rules) == len(set(map(tuple, rules.tolist())))


def test_repair_memory(spark, tmp_path, monkeypatch):
    """Workers get batches of bounded bytes, and compressing a shard takes little beside it."""
    frame = type(spark.range(1))
    plain = frame.mapInArrow

    def watched(self, kernel, schema, *rest):
        def run(batches):
            def noted():
                for batch in batches:
                    (tmp_path / f"{time.time_ns()}-{batch.nbytes}").touch()
                    yield batch

            return kernel(noted())

        return plain(self, run, schema, *rest)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 400) AS text")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    repair.write_token_files(docs.coalesce(1), f"file://{tmp_path}/out", BPE)
    sizes = [int(p.name.split("-")[1]) for p in tmp_path.glob("*-*") if p.is_file()]
    assert sum(sizes) > 12e6 and max(sizes) < 6e6 and spark.conf.get(setting) == before

    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 1 << 20) % 50_000).astype(np.uint32)
    ends = np.arange(512, len(ids) + 1, 512)
    tracemalloc.start()
    repair.compress(ids, ends, 50_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6


def test_repair_effort():
    """Compressing a shard takes little CPU time, told by sorts and gathers of as many numbers, and little memory."""
    rng = np.random.default_rng(3)
    ids, ends = (rng.zipf(1.3, 1 << 20) % 50_000).astype(np.uint32), np.arange(512, (1 << 20) + 1, 512)
    x, at = rng.integers(0, 1 << 60, 1 << 20), rng.integers(0, 1 << 20, 1 << 20)

    def plain():
        for _ in range(4):
            y = np.sort(x)
            y[at], np.cumsum(y), np.flatnonzero(y > 5)

    def least_time(work):
        took = []
        for _ in range(7):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert least_time(lambda: repair.compress(ids, ends, 50_000)) < 2.5 * least_time(plain)
    tracemalloc.start()
    repair.compress(ids, ends, 50_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 55e6


def test_hashes_of_runs():
    """Runs within, across and longer than a block; the hash of a run doesn't depend on where it stands."""
    rng = np.random.default_rng(2)
    lens = np.r_[rng.integers(1, 9, 9000), 16_384, 1, 16_383, 2, 50_000, 1, 1, 80_000, rng.integers(1, 9, 9000)]
    starts, codes = np.cumsum(lens) - lens, rng.integers(0, 0x110000, lens.sum()).astype(np.uint32)
    odd, number, every = int(words._M2), words.mixed(codes.astype(np.uint64) + np.uint64(1)).tolist(), []
    for a, n in zip(starts.tolist(), lens.tolist(), strict=True):
        total, power = 0, 1
        for x in number[a : a + n]:
            total, power = (total + x * power) % 2**64, power * odd % 2**64
        every.append(total)
    want = words.mixed(np.array(every, np.uint64))
    assert np.array_equal(words.hashes(codes, starts, lens), want)
    some = np.flatnonzero(lens < 9)[::-1]
    again = np.concatenate([codes[a : a + n] for a, n in zip(starts[some].tolist(), lens[some].tolist(), strict=True)])
    assert np.array_equal(words.hashes(again, np.cumsum(lens[some]) - lens[some], lens[some]), want[some])


def test_cut_texts_among_others():
    """Texts with control characters, special strings and other letters between those that are cut here."""
    library, bpe = Tokenizer.from_file(BPE), byte_bpe.ByteBpe(BPE)
    texts = ["plain it's", "a\x00b", None, " \n x  y\n", "<|endoftext|>", "日本", "", "é ' s't 'll", "\x85", "end "]
    for some in (texts, texts[1:2], texts[::-1], texts * 3):
        flat, counts = bpe.encode(some)
        assert split(flat, counts) == [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert np.array_equal(bpe.count(some), counts)
