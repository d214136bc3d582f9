"""The semantics again in plain Python, written apart from the Spark code; for comparison on small inputs."""

from __future__ import annotations

import re
from collections import Counter

STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}:\d{2}:\d{2}(?:\.\d+)?")
RULES = [
    ("<TIME>", r"\d{4}-\d\d-\d\d[\sT]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?"), ("<DATE>", r"\d{4}-\d\d-\d\d"), ("<TIME>", r"\d\d:\d\d:\d\d(\.\d+)?"),
    ("<ID>", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"), ("<ID>", r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}"), ("<DURATION>", r"\d+(\.\d+)?(ms|s|m|h|d|MB|GB|KB|B)"),
    ("<IP>", r"\d{1,3}(\.\d{1,3}){3}"), ("<IP>", r"[0-9a-f:]+::[0-9a-f:]*"), ("<NUM>", r"-?\d+(\.\d+)?"), ("<ID>", r"[0-9a-fA-F]{8,}"),
]
NAMES = set("mon tue wed thu fri sat sun jan feb mar apr may jun jul aug sep oct nov dec".split())


def words(line: str) -> list[str]:
    marked = STAMP.sub(lambda m: f"\0{m[0]}\0", line)
    return re.findall(r"[ \t]|[\[\](){},;]|[^\0 \t\[\](){},;]+", marked)


def variable(word: str) -> str | None:
    for name, rule in RULES:
        if re.fullmatch(rule, word):
            return name
    return "<TIME>" if word.lower() in NAMES and len(word) == 3 else None


def signature(line: str) -> tuple:
    return tuple(("v", v) if (v := variable(w)) else ("f", " " if w in " \t" else w) for w in words(line))


def templates(lines: list[str]) -> Counter:
    return Counter(signature(x) for x in lines)


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def clusters(texts: list[str], limit: float) -> list[list[int]]:
    """The sequential definition: each unassigned text in turn leads and takes all later ones in reach."""
    out, taken = [], set()
    for i, a in enumerate(texts):
        if i in taken:
            continue
        own = [i]
        taken.add(i)
        for j in range(i + 1, len(texts)):
            longest = max(len(a), len(texts[j]))
            if j not in taken and (levenshtein(a, texts[j]) / longest if longest else 0.0) <= limit:
                own.append(j)
                taken.add(j)
        out.append(own)
    return sorted(out, key=lambda c: (-len(c), c[0]))


def ngram_scores(texts: list[str], n: int) -> list[float]:
    def grams(t: str) -> list[str]:
        w = [x for x in re.split(r"[\s\[\](){}:,;\"']", t) if x]
        return [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]

    counts = Counter(g for t in texts for g in grams(t))
    total = sum(counts.values())
    return [sum(counts[g] for g in grams(t)) / total / len(grams(t)) for t in texts]
