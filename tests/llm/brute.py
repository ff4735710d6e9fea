"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
import string
from collections import Counter, defaultdict

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def confirmed(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "")
            if confirmed(k, m.group())]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_groups(docs):
    """docs: {id: text} -> {id: (set size, component)}"""
    sets = {k: shingle_set(t) for k, t in docs.items()}
    held = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            held[x].append(k)
    shared = Counter()
    for ks in held.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = groups(docs, links)
    return {k: (len(sets[k]), found[k]) for k in docs}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, window=10):
    """-> {id: (n_words, n_hit, n_items, items_sha256)}"""
    windows = defaultdict(set)
    for k, t in items.items():
        w = WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i:i + window])].add(str(k))
    sizes = {len(w) for w in windows}
    out = {}
    for k, t in docs.items():
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out[k] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out
