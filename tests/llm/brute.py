"""The operators' contracts again, by brute force over a handful of rows."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, k: int = 5) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(rows: list[tuple]) -> list[tuple]:
    """(id, n_shingles, component_id) of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    of = roots(len(rows), links)
    least = {r: min((rows[i][0] for i in range(len(rows)) if of[i] == r and rows[i][0] is not None), default=None) for r in set(of)}
    return [(rows[i][0], len(sets[i]), least[of[i]]) for i in range(len(rows))]


def removed(texts: list[bytes], window: int) -> list[list[bool]]:
    places: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            places[t[i : i + window]] = places.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if places[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def report(rows: list[tuple], window: int = 400) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of (id, text)."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, gone in zip(rows, texts, removed(texts, window), strict=True):
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def all_without_passages(texts: dict, window: int = 51) -> dict:
    """Each text without every run of ``window`` words that also starts elsewhere, and what stands inside such runs."""
    places: dict[tuple, int] = {}
    for t in texts.values():
        w = words(t)
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])] = places.get(tuple(w[i : i + window]), 0) + 1
    out = {}
    for k, t in texts.items():
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        w = words(t)
        gone = [False] * len(t or "")
        for i in range(len(w) - window + 1):
            if places[tuple(w[i : i + window])] > 1:
                lo, hi = at[i][0], at[i + window - 1][1]
                gone[lo:hi] = [True] * (hi - lo)
        out[k] = None if t is None else "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out
