"""Secrets, decontamination, sharding, language, quality."""

import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readqc.llm import decontaminate, interleave, knn_quality, language_crf, secret_scan
from tests.llm.conftest import SCHEMA, prose, row


def base_by_hand(text):
    out = []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, (form, ok) in enumerate(((assign, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        out += [(m.start(), k, m.end()) for m in form.finditer(text) if ok(m)]
    return sorted(out)


def test_base_spans():
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " = ", '"', "'", "abc", "deadbeef", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "ſecret=abcdefgh", "toKen=abcdefgh", "é", "\n", ".", "="]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secret_scan.base_spans(text) == base_by_hand(text), text


def test_entropy_windows():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aabbcdeABC0123456789+/") for _ in range(rng.randint(1, 90)))
        good = set()
        for i in range(len(text) - 23):
            counts = Counter(text[i : i + 24])
            if -sum(n / 24 * math.log2(n / 24) for n in counts.values()) >= 3.6 - 1e-9:
                good |= set(range(i, i + 24))
        assert good == {x for a, b in secret_scan.entropy_spans(text, 3.6) for x in range(a, b)}


def test_added_and_allowed():
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQkLmTr9Vw"
    found = secret_scan.scan(f"use {key} here")
    assert found[0] == [] and found[1] == [(4, 3, 4 + len(key))]
    for text in ("123e4567-e89b-12d3-a456-426614174000", "aVeryLongCamelCaseNameOfSomething/and-another_word", "abababababababababababababababab", "sha512-" + key, "EXAMPLE" + key, "1234567890" * 4):
        assert secret_scan.scan(text)[1] == secret_scan.scan(text)[0], text
    assert secret_scan.redact("a token=abcdefgh b", secret_scan.scan("a token=abcdefgh b")[1], "#") == "a # b"


def words_by_hand(run):
    """Parts between signs, letter by letter."""
    for part in re.findall("[^_/=-]+", run):
        upper, lower, digits = (sum(c in letters for c in part) for letters in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
        one_case = lower + digits + upper == len(part) and digits == 0 and (upper == 0 or lower == 0 or (upper == 1 and part[0] in string.ascii_uppercase))
        if digits == len(part) < 16 or upper + lower == len(part) < 16 or (one_case and len(part) < 24):
            continue
        if upper + lower < len(part) or one_case or upper / len(part) > 0.3:
            return False
    return True


def spans_by_hand(text):
    """Known forms, and windows of 24 characters (16 in shorter runs) whose entropy, counted anew for each, is at or over the
    limit of the narrowest class that holds the run, if it isn't on the allow-list and no known form covers them."""
    base, out = base_by_hand(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        run = m[0]
        size = 24 if len(run) >= 24 else 16
        if run.isdigit():
            continue
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
            limit = 2.9 if size == 24 else 9
        elif re.fullmatch("[a-z]+|[A-Z]?[a-z]+|[A-Z]+", run):
            limit = 4.0 if size == 24 else 9
        else:
            limit = 3.5 if size == 16 else 3.7 if run.isalnum() else 3.9
        changes = sum(a.isalnum() and b.isalnum() and a.isdigit() != b.isdigit() for a, b in itertools.pairwise(run))
        if (size == 16 and changes < 4) or words_by_hand(run) or any(form.fullmatch(run) for form in secret_scan.ALLOWED):
            continue
        hit = set()
        for i in range(len(run) - size + 1):
            counts = Counter(run[i : i + size])
            if -sum(n / size * math.log2(n / size) for n in counts.values()) >= limit - 1e-9:
                hit |= set(range(m.start() + i, m.start() + i + size))
        for a in sorted(x for x in hit if x - 1 not in hit):
            b = a
            while b in hit:
                b += 1
            if not any(s <= a and b <= e for s, _, e in base):
                out.append((a, 3, b))
    return base, sorted(base + out)


def test_classes_and_words():
    """Keys of each class that has a limit are found, also short ones and ones without a digit; names, paths, numbers and
    checksums are left alone."""

    def found(text):
        return [(a, b) for a, k, b in secret_scan.scan(text)[1] if k == 3]

    for key in ("Zq3vT8nLw2Kp5xRb", "k7fq2m9xw4zt8bvc1", "hVbQzTnLwKdPxRjGmYcSaFuE", "qzjxkvbwpymfgcdhtlnrsoieuaqz", "docs/example/9fKq2LmX7vTz4BnR8wYc1HpD", "F03A91C7B25E8D640F9C3A7E"):
        text = f"the value {key} here"
        assert found(text), key
    for text in (
        "transformer2023model", "9807915762804490", "deadbeef01234567", "anthrererendanhe", "Einungtzheitgeungverlich", "average_phred_quality_by_position_and_tile",
        "2024/section-12/notes-on-many-things", "aVeryLongCamelCaseNameOfSomething", "MAX_NUMBER_OF_RETRIES_PER_REQUEST", "2024-01-15T10-30-00", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    ):
        assert not found(text), text


def test_op3_rows(spark, odd, odd_rows, none, sf_dir):
    rng = random.Random(20)
    keys = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 70))) for letters in ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJabcdefghij+/=_-0123456789", "aab1", "0123456789", string.ascii_letters, string.ascii_lowercase, string.ascii_letters + "0123456789", "abcdefghijklmnop-/_", "Abcdefghijklmnopq12-/") for _ in range(60)]
    keys += [f"{rng.choice(('docs/example/', 'example', 'my_'))}{k}" for k in keys[::3]]
    keys += [k[: rng.randint(12, 24)] for k in keys[::2]]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in odd_rows] + [(r.doc_id, r.text) for r in docs] + [(-i, f"{prose(rng, 5)} {rng.choice(('', 'token=', 'key '))}{k}, {k[:23]}") for i, k in enumerate(keys, 1)]
    want, found = Counter(), 0
    for name, text in rows:
        base, every = spans_by_hand(text or "")
        found += len(every) - len(base)
        said = [",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, every)]
        want[name, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said[0].encode()).hexdigest(), said[1]] += 1
    assert found > 300
    assert Counter(map(tuple, secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want
    assert secret_scan.find_secrets(none).count() == 0 and secret_scan.redact_secrets(none).count() == 0
    kept = secret_scan.redact_secrets(odd)
    assert kept.schema == odd.schema and kept.count() == len(odd_rows)


def windows_by_hand(items, window):
    out = {}
    for item, text in items:
        words = decontaminate.words_of(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            out.setdefault(tuple(words[i : i + k]), set()).add(item)
    return out


def hits_by_hand(table, text):
    words, hit, items = decontaminate.words_of(text), set(), set()
    for k in {len(w) for w in table}:
        for i in range(len(words) - k + 1):
            if (found := table.get(tuple(words[i : i + k]))) is not None:
                items |= {x for x in found if x is not None}
                hit.update(range(i, i + k))
    return words, hit, items


@pytest.mark.parametrize("limits", [(10**6, 10**6), (25, 10**6), (25, 120)])
def test_op8_rows(spark, odd, odd_rows, none, limits):
    """One automaton, several at once, and several passes."""
    limits = dict(zip(("max_words", "pass_words"), limits, strict=True))
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows if r[1]]
    items = [(i, " ".join(t.split()[j : j + rng.choice((3, 10, 14, 30))])) for i, t in enumerate(texts[:20]) for j in [rng.randint(0, max(0, len(t.split()) - 5))]]
    items += [(20, None), (21, ""), (22, "the"), (None, texts[5]), (23, items[0][1]), (23, "of and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = windows_by_hand([(None if i is None else str(i), t) for i, t in items], 10)
    want = Counter()
    for r in odd_rows:
        words, hit, found = hits_by_hand(table, r[1])
        want[r[0], len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, decontaminate.contamination(odd, bench, **limits).collect())) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.where("false")).where("contaminated").count() == 0
    kept = decontaminate.remove_contamination(odd, bench, **limits)
    assert kept.schema == odd.schema
    for r in kept.collect():
        if r.text is not None and r.n_chars is not None:
            assert r.n_chars == len(r.text)


def test_matches_by_hand():
    """Few different words, so that items, windows and their parts overlap in every way."""
    rng = random.Random(12)
    for _ in range(60):
        items = [(str(i), [rng.choice((b"a", b"b", b"c", b"dd")) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(1, 8))]
        window = rng.randint(1, 5)
        table = windows_by_hand([(i, b" ".join(w).decode()) for i, w in items], window)
        texts = [" ".join(rng.choice(("a", "B", "c", "dd", "zz")) for _ in range(rng.randint(0, 40))) for _ in range(12)] + ["", None]
        words = decontaminate.Words(texts)
        for text, (spans, found) in zip(texts, decontaminate.scan([decontaminate.Automaton.of(items, window)], words), strict=True):
            _, hit, want = hits_by_hand(table, text)
            assert {x for a, b in spans for x in range(a, b)} == hit and found == want


def test_a_large_benchmark(spark):
    """Two million words: two lots of automata, about 65 MB each, a pass each."""
    rng = np.random.default_rng(13)
    words = np.array([f"w{i}" for i in range(60_000)])
    items = [(i, " ".join(words[(rng.pareto(0.7, 500) * 10).astype(np.int64) % 60_000])) for i in range(4000)]
    docs = [(i, " ".join(["start", *items[40 * i][1].split()[7 : 7 + i], "end"])) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(8)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert len(got) == 60
    for r in got:
        assert r.n_words == r.doc_id + 2
        assert (r.n_hit, r.contaminated) == ((r.doc_id, True) if r.doc_id >= 10 else (0, False))
        if r.doc_id >= 12:
            assert r.items_sha256 == hashlib.sha256(str(40 * r.doc_id).encode()).hexdigest()


def test_cleaned_text():
    assert decontaminate.clean("One two, THREE four! five", [(1, 3)]) == "One  four! five"


def test_op5_rows(spark, odd, odd_rows, none):
    got = interleave.interleave(odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert interleave.interleave(none).count() == 0
    assert sorted(r.shard for r in interleave.interleave(odd.limit(3)).collect()) == [0, 1, 2]


def test_interleaving_keeps_the_mixture(spark):
    n = 4000
    rows = [(i, "x" * (i % 7), "a" if i % 3 else "b" if i % 2 else f"c{i % 5}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source, total = {r[0]: r[2] for r in rows}, Counter(r[2] for r in rows)
    runs = [{r.doc_id: (r.shard, r.slot) for r in interleave.interleave(df, rows_per_bin=k).collect()} for df, k in ((docs, 20_000), (docs.repartition(7), 150))]
    for run in runs:
        share = Counter((s, source[i]) for i, (s, _) in run.items())
        assert all(abs(share[s, x] - total[x] / 16) <= 3 for s in range(16) for x in total)
    by_hand = []
    for x in total:
        own = sorted((hashlib.md5(f"mixture:{i}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest(), i) for i, text, s in rows if s == x)
        by_hand += [((2 * k + 1) / (2 * len(own)), f"={x}", key, i) for k, (key, i) in enumerate(own)]
    place = {i: divmod(k, n // 16) for k, (*_, i) in enumerate(sorted(by_hand))}
    assert runs[0] == runs[1] == place


def test_forward_backward():
    rng = np.random.default_rng(0)
    n, labels = 700, 3
    emit, trans, start = rng.random((n, labels)) + 0.01, rng.random((labels, labels)) + 0.1, rng.random(labels) + 0.1
    begins = rng.random(n) < 0.05
    begins[0] = True
    ahead, back, counts = np.zeros((n, labels)), np.ones((n, labels)), np.zeros((labels, labels))
    for i in range(n):
        ahead[i] = (start if begins[i] else ahead[i - 1] @ trans) * emit[i]
        ahead[i] /= ahead[i].sum()
    for i in range(n - 2, -1, -1):
        w = emit[i + 1] * back[i + 1]
        back[i] = (w * start).sum() if begins[i + 1] else trans @ w
        back[i] /= back[i].sum()
        if not begins[i + 1]:
            pair = ahead[i][:, None] * trans * w
            counts += pair / pair.sum()
    post = ahead * back / (ahead * back).sum(1, keepdims=True)
    got, got_counts = language_crf.forward_backward(emit, begins, trans, start)
    assert np.allclose(got, post) and np.allclose(got_counts, counts)


def test_op6_rows(spark, odd, odd_rows, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_crf.train(docs)
    assert model.langs == sorted(r[0] for r in docs.select("lang").distinct().collect() if r[0])
    got = language_crf.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    rows = language_crf.identify(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" for i in (100, 101, 102, 203)) and by[0].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert language_crf.identify(none, model).count() == 0
    untaught = language_crf.identify(odd, language_crf.train(none)).collect()
    assert len(untaught) == len(odd_rows) and {r.lang_pred for r in untaught} == {"und"}
    kept = language_crf.keep_identified(odd, model)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()}.isdisjoint({100, 101, 102, 203})


def test_switching_words(spark, sf_dir):
    """Words in a sentence of another language are labelled as such."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_crf.train(docs)
    # A text half of one language, half of another, has a share between.
    by = {r.lang: r.text for r in docs.where("lang IN ('en', 'de') AND length(text) BETWEEN 500 AND 3000").orderBy("doc_id").collect()}
    mixed = by["en"][:400] + "\n" + by["de"][:400]
    (lang,), (score,) = model.label([mixed])
    assert lang in ("en", "de") and 0.3 < score < 0.8


def test_all_of_a_long_run_counts():
    """What stands between the ends of a long run of letters is looked at, and counts by its length."""
    rng = random.Random(9)
    glued = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    model = language_crf.fit([(lang, " ".join(glued(x, rng.randint(3, 40)) for _ in range(60)) + ".") for lang, x in (("aa", "abcde"), ("zz", "vwxyz")) for _ in range(20)])
    ends, middle = glued("vwxyz", 40), glued("abcde", 10_000)
    (lang, mixed), (score, share) = model.label([ends + middle + ends, middle[:1000] + " " + glued("vwxyz", 20)])
    assert lang == "aa" and score > 0.95 and mixed == "aa" and share > 0.9
    codes, lens, _ = language_crf.words_of([middle])
    assert "".join(map(chr, codes)) == middle and lens.tolist() == [40] * 250


def label_by_hand(model, texts):
    """Words by a pattern, features word by word, and a chain for each text."""
    out = []
    for text in texts:
        found = [w for run in re.findall(r"[^\W\d_]+", (text or "").lower()) for w in re.findall(".{1,40}", run)]
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        emit = []
        for w in found:
            codes = np.array([ord(c) for c in w], np.uint32)
            places, _ = language_crf.features(codes, np.array([len(w)]), model.lexicon, len(model.weights))
            score = model.weights[places].sum(0) if any(map(str.isalpha, w)) else np.zeros(len(model.langs))
            emit.append(np.exp(score - score.max()))
        ahead, back = [model.start * emit[0]], [np.ones(len(model.langs))]
        for e in emit[1:]:
            ahead.append((ahead[-1] / ahead[-1].sum() @ model.trans) * e)
        for e in emit[:0:-1]:
            v = model.trans @ (e * back[-1])
            back.append(v / v.sum())
        mass = np.zeros(len(model.langs))
        for w, a, b in zip(found, ahead, back[::-1], strict=True):
            if any(map(str.isalpha, w)):
                mass += a * b / (a * b).sum()
        out.append((model.langs[int(mass.argmax())], float(mass.max() / mass.sum())))
    return out


def test_op6_by_hand(spark, odd, odd_rows, sf_dir):
    """The query's rows, and odd ones, text by text and word by word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_crf.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(60).collect()] + [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 5000] + [(-1, "²½ ¹ ²"), (-2, "a"), (-3, "ª İSTANBUL ß ﬁ")]
    got = language_crf.identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    for r, (lang, score) in zip(got, label_by_hand(model, [t for _, t in rows]), strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_features_by_hand():
    """Each word's places, by kind, whatever words stand beside it."""
    words = ["a", "été", "über", "straße", "o", "ab", "x" * 40]
    codes, lens, _ = language_crf.words_of(words)
    flat, counts = language_crf.features(codes, lens, np.zeros(0, np.uint64), 1 << 16)
    place = lambda kind, *s: int(language_crf._place(kind, *(np.array([ord(c)]) for c in s), size=1 << 16)[0])
    at = 0
    for word, n in zip(words, counts.tolist(), strict=True):
        w = f"<{word}>"
        want = [place(1, c) for c in w] + [place(2, *w[i : i + 2]) for i in range(len(w) - 1)] + [place(3, *w[i : i + 3]) for i in range(len(w) - 2)]
        for k, x in enumerate((w, w[::-1])):
            want += [place(4 + k, *x[:2]), place(6 + k, *x[:3]), place(8 + k, *x[:3], x[min(3, len(x) - 1)])]
        assert Counter(flat[at : at + n].tolist()) == Counter(want)
        at += n


def test_the_sample_is_bounded(spark):
    """Null ids, repeated rows and many languages don't bring more rows to the driver."""
    rows = [(None, f"null id {i}", "aa") for i in range(3000)] + [(7, "one text again and again", "aa")] * 3000 + [(i, f"words {i}", "bb") for i in range(3000)] + [(i, f"{i}", f"l{i % 50}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    taken = Counter(lang for lang, _ in language_crf.sample(docs, F.lit(True), 200, 1000, 10))
    assert len(taken) == 10 and max(taken.values()) == 200 and taken["bb"] > 150
    assert len(language_crf.sample(docs, F.lit(True), 10_000, 1000, 100)) == 3001 + 3000 + 500


def test_op10_rows(spark, odd, odd_rows, none, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = knn_quality.train(docs, labels)
    got = knn_quality.score_quality(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.8 * len(got)
    rows = knn_quality.score_quality(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert knn_quality.score_quality(none, model).count() == 0
    assert {r.score for r in knn_quality.score_quality(odd, knn_quality.train(none, labels)).collect()} == {0.5}


def scores_by_hand(model, texts, size=8192):
    """Counts of tokens and shapes, the share of repeated pairs, one product with the projection, and all votes, a text at
    a time in double precision; None where the last neighbour's place is shared."""
    out = []
    crc = lambda s: zlib.crc32(s.encode("utf-8", "replace"))
    for text in texts:
        tokens = knn_quality.TOKENS.findall(text or "")
        place = [64 + crc(t.lower()) % (size - 64) for t in tokens]
        counts = Counter(place) + Counter(crc(knn_quality.shape(t)) % 64 for t in tokens)
        if tokens:
            pairs = list(zip(place[:-1], place[1:], strict=True))
            again = 1 - len(set(pairs)) / max(1, len(pairs))
            counts[size + min(7, int(again * 8))] += max(1, len(tokens) // 4)
        total = sum(counts.values())
        v = sum((math.sqrt(n / total) * model.project[k].astype(float) for k, n in counts.items()), np.zeros(model.project.shape[1]))
        v = v / max(np.linalg.norm(v), 1e-12)
        sims = sorted(((float(v @ u), y) for u, y in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)
        if len(sims) > 25 and sims[24][0] - sims[25][0] < 1e-5 and sims[24][0] > 0:
            out.append(None)
            continue
        w = [max(s, 0) ** 8 for s, _ in sims[:25]]
        out.append(sum(a * y for a, (_, y) in zip(w, sims[:25], strict=True)) / sum(w) if sum(w) > 1e-30 else float(model.labels.mean()))
    return out


def test_op10_by_hand(spark, odd_rows, sf_dir):
    """The query's scores, and those of odd rows, text by text; and the projection spans what it should."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = knn_quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(150).collect()] + [(r[0], r[1]) for r in odd_rows]
    got = knn_quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    want = scores_by_hand(model, [t for _, t in rows])
    assert sum(w is not None for w in want) > 120
    assert all(w is None or abs(r.score - w) < 1e-4 for r, w in zip(got, want, strict=True))


def test_the_latent_space_is_that_of_the_singular_vectors():
    rng = random.Random(15)
    rows = [(i % 2, prose(rng, 30)) for i in range(40)]
    model, features = knn_quality.fit(rows, size=512, dimensions=6), knn_quality.Features(512)
    table = np.zeros((40, 512 + knn_quality.REPEATS))
    for i, (_, text) in enumerate(rows):
        at, n = features(text)
        table[i, at] = np.sqrt(n / n.sum())
    idf = np.log(41 / (1 + (table > 0).sum(0))) + 0.1
    scaled = table * idf
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    own = np.linalg.svd(scaled, full_matrices=False)[2][:6]
    v = table * idf @ own.T
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(v @ v.T, model.vectors @ model.vectors.T, atol=1e-3)


def test_votes_are_exact(spark):
    rng = random.Random(5)
    rows = [(i % 2, prose(rng, 40) if i % 2 else prose(rng, 40).upper().replace(" ", "!! ")) for i in range(60)]
    model = knn_quality.fit(rows)
    features, texts = knn_quality.Features(8192), [t for _, t in rows[:10]] + ["", None, "of the and"]
    vectors = model.vectors_of(texts, features)
    got = model.score(texts, features, block=4)
    for v, score in zip(vectors, got, strict=True):
        sims = sorted(((float(v @ u), y) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:25]
        w = [max(s, 0) ** 8 for s, _ in sims]
        want = sum(a * y for a, (_, y) in zip(w, sims, strict=True)) / sum(w) if sum(w) > 1e-30 else 0.5
        assert abs(score - want) < 1e-2
    assert row(1, None) and SCHEMA
