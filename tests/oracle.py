"""The trim chain of one read, step by step in plain Python, to hold the columns against."""

from readqc.config import ADAPTER_MATCH, ADAPTERS


def scores(qual):
    return [max(ord(c) - 33, 0) for c in qual]


def window_means(qual, w):
    s = scores(qual)
    return [sum(s[i : i + w]) // w for i in range(len(s) - w + 1)] if len(s) >= w else []


def cut_front(qual, w, q):
    if len(qual) < w:
        return 0
    for i, mean in enumerate(window_means(qual, w)):
        if mean >= q:
            return i
    return len(qual) - w + 1


def cut_right(qual, w, q):
    for i, mean in enumerate(window_means(qual, w)):
        if mean < q:
            return i
    return len(qual)


def cut_tail(qual, w, q):
    if len(qual) < w:
        return len(qual)
    end = len(qual)
    while end >= w:
        if window_means(qual[end - w : end], w)[0] >= q:
            return end
        end -= 1
    return 0


def run_at_end(seq, base):
    n = 0
    while n < len(seq) and seq[-1 - n] == base:
        n += 1
    return n


def adapter(seq, custom=()):
    best = None
    for rank, (name, a) in enumerate([*ADAPTERS, *(("custom", c) for c in custom)]):
        at = seq.find(a[:ADAPTER_MATCH])
        if at >= 0 and (best is None or (at, rank) < best[:2]):
            best = (at, rank, name)
    return best and (best[0], best[2])


def trim(seq, qual, cfg):
    """(seq, qual, adapter) of a kept read, or None."""
    name = None
    if cfg.trim_front:
        if len(seq) <= cfg.trim_front:
            return None
        seq, qual = seq[cfg.trim_front :], qual if qual is None else qual[cfg.trim_front :]
    if cfg.trim_tail:
        if len(seq) <= cfg.trim_tail:
            return None
        n = len(seq) - cfg.trim_tail
        seq, qual = seq[:n], qual if qual is None else qual[:n]
    if qual is not None:
        if cfg.cut_front:
            k = cut_front(qual, cfg.window, cfg.window_quality)
            if k >= len(seq):
                return None
            seq, qual = seq[k:], qual[k:]
        for wanted, cut in ((cfg.cut_right, cut_right), (cfg.cut_tail, cut_tail)):
            if wanted:
                k = cut(qual, cfg.window, cfg.window_quality)
                if k == 0:
                    return None
                seq, qual = seq[:k], qual[:k]
    if cfg.poly_g:
        run = run_at_end(seq, "G")
        n = len(seq) - run if run >= cfg.poly_g else len(seq)
        seq, qual = seq[:n], qual if qual is None else qual[:n]
    if cfg.quality_trim and qual is not None:
        n = len(qual)
        while n and scores(qual[n - 1])[0] < cfg.quality_trim:
            n -= 1
        seq, qual = seq[:n], qual[:n]
    if cfg.modules.adapter and (hit := adapter(seq, cfg.custom_adapters)):
        n, name = hit
        seq, qual = seq[:n], qual if qual is None else qual[:n]
    if cfg.poly_x and seq and not (seq[-1] == "G" and cfg.poly_g):
        run = run_at_end(seq, seq[-1])
        n = len(seq) - run if run >= cfg.poly_x else len(seq)
        seq, qual = seq[:n], qual if qual is None else qual[:n]
    if cfg.max_n is not None and sum(c in "Nn" for c in seq) > cfg.max_n:
        return None
    if cfg.min_quality and qual is not None and (not qual or sum(scores(qual)) // len(qual) < cfg.min_quality):
        return None
    return None if len(seq) < cfg.min_length else (seq, qual, name)
