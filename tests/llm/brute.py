"""Plain versions of the operators, for small inputs."""

import hashlib
import re

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def base_rules(text):
    text = text or ""
    found = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 5))
    n = len(found)
    return (n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n)


def contamination(docs, items):
    """[(n_words, n_hit, n_items, sha256, contaminated)] for each text."""
    windows = {}
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        w = BENCH_WORD.findall(lower(text))
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    found |= windows[tuple(w[k:k + size])]
                    hit[k:k + size] = [1] * size
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_groups(docs):
    """{doc_id: (n_shingles, smallest reachable id)} of (doc_id, text) with ids."""
    sets = {}
    for i, text in docs:
        sets.setdefault(i, []).append(shingles(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}
