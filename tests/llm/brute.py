"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(texts, k, num, den):
    """Index -> least index of its component."""
    sets = []
    for t in texts:
        w = WHITE.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def kept_words(rows, window):
    """rows in order, with the text in the second place -> the kept words and the number of words of each."""
    seen, out = set(), []
    for _, t, *_ in rows:
        w = WHITE.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        out.append(([x for x, g in zip(w, gone, strict=True) if not g], len(w)))
    return out


def statistics(text):
    t = text or ""
    w = WHITE.findall(t)
    lines = [x for x in t.split("\n") if WHITE.search(x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def contamination(text, items, window):
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        b = ALNUM.findall(lower(t))
        n = min(window, len(b))
        wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def mixing_targets(rows, weights, most):
    """(source, size) of each row -> the size and the target of each source."""
    sources = sorted({s for s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for x, n in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, open_ = {}, sum(size.values()), set(sources)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * size[s]}
        if not full:
            break
        for s in full:
            target[s] = most * size[s]
            left -= target[s]
        open_ -= full
    return size, target | {s: level * weight[s] for s in open_}


def entropy_rates(size, target, most):
    """min(most, exp(l * size)) with the l that meets the target, by halving."""
    import numpy as np

    low, high = -100.0, 100.0
    for _ in range(300):
        mid = (low + high) / 2
        r = np.exp(np.minimum(mid * size, np.log(most)))
        low, high = (mid, high) if (size * r).sum() < target else (low, mid)
    return np.where(size > 0, r, 1.0)
