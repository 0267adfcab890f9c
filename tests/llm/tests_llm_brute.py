"""Plain versions that several tests compare with."""

import re

import xxhash


def shingles_of(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))} if words else set()


def check_kept(rows, kept):
    """rows: (doc_id, text); kept: ids. Texts far from all others stay, of near ones only one does."""
    sets = {d: shingles_of(t) for d, t in rows}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = sorted(sets)
    best = {d: max([alike(sets[d], sets[o]) for o in ids if o != d], default=0.0) for d in ids}
    assert kept >= {d for d in ids if best[d] < 0.7}
    for i, d in enumerate(ids):
        for o in ids[:i]:
            assert not (d in kept and o in kept and alike(sets[d], sets[o]) >= 0.93), (d, o)
