"""Plain restatements of operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, fine in kinds for m in re.finditer(p, text) if fine(m[0])]


def secrets(text):
    text = text or ""
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), i, k, m.end()) for i, (k, p, fine) in enumerate(kinds) for m in re.finditer(p, text, re.ASCII) if fine(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(spans):
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def repeated_lines(docs, least=50):
    """doc key -> numbers of lines to remove, for {(doc_id, order): text} in document order."""
    rows = {}
    for key in sorted(docs):
        kept = [(p, " ".join(words(x))) for p, x in enumerate((docs[key] or "").split("\n")) if words(x)]
        rows[key] = kept
    windows, first = {}, {}
    for key, lines in rows.items():
        windows[key] = []
        for i in range(len(lines)):
            n, j = 0, i
            while j < len(lines) and n < least:
                n += len(lines[j][1].split(" "))
                j += 1
            if n >= least:
                content = tuple(x for _, x in lines[i:j])
                windows[key].append((i, content))
                first.setdefault(content, (key, i))
    removed = {}
    for key, lines in rows.items():
        gone, last = set(), {}
        for i, content in windows[key]:
            source = (key, last[content]) if content in last else first[content]
            last[content] = i
            if source == (key, i):
                continue
            other, i0 = rows[source[0]], source[1]
            d, a, b = i - i0, i, i
            while a - 1 >= 0 and a - 1 - d >= 0 and lines[a - 1][1] == other[a - 1 - d][1]:
                a -= 1
            while b + 1 < len(lines) and b + 1 - d < len(other) and lines[b + 1][1] == other[b + 1 - d][1]:
                b += 1
            gone |= set(range(a, b + 1))
        removed[key] = sorted(lines[i][0] for i in gone)
    return removed


def components(docs, k, percent=80):
    """doc_id -> smallest id reachable over pairs that are similar enough, from all pairs."""
    sets = {}
    for d, t in docs.items():
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[d] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    name = {d: d for d in docs}

    def top(d):
        while name[d] != d:
            d = name[d]
        return d

    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {d: top(d) for d in docs}
