"""What the operators should return, computed one text at a time in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SECRETS = [
    (
        "assign",
        re.compile(r"""(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                   r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""),
        lambda m: len(m[1]) >= 6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
    return 12 <= len(digits) <= 19 and total % 10 == 0


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (
        "ip",
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        lambda m: all(int(part) <= 255 for part in m[0].split(".")),
    ),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: luhn(m[0])),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
]


def base_spans(text: str | None, kinds) -> str:
    found = sorted(
        (m.start(), k, m.end())
        for k, (_, pattern, valid) in enumerate(kinds)
        for m in pattern.finditer(text or "")
        if valid(m)
    )
    return ",".join(f"{kinds[k][0]}:{start}:{end}" for start, k, end in found)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None, lower: bool = True) -> list[str]:
    return WORD.findall((text or "").translate(UPPER) if lower else text or "")


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def overlap(doc: list[str], item: list[str], masks, mismatch: int) -> tuple[int, list[int]]:
    """Best score, and the scores of all alignments with a common seed."""
    span = len(masks[0])
    shifts = {
        p - q
        for mask in masks
        for p in range(len(doc) - span + 1)
        for q in range(len(item) - span + 1)
        if all(bit == "0" or doc[p + k] == item[q + k] for k, bit in enumerate(mask))
    }
    scores = []
    for shift in shifts:
        run = best = 0
        for i, word in enumerate(item):
            if 0 <= shift + i < len(doc):
                run = max(0, run + (1 if doc[shift + i] == word else -mismatch))
                best = max(best, run)
        scores.append(best)
    return max(scores, default=0), scores
