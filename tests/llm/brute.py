"""Plain versions of the operators' definitions, for small inputs."""

import re


def words(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(sets):
    """Smallest id reachable over pairs with Jaccard of at least 4/5."""
    label, ids = {d: d for d in sets}, sorted(sets)

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in ids}


def greedy_tiles(doc, item, least):
    """Lengths of greedy tiles, by looking at every pair of positions for the longest unmarked match again and again."""
    used_doc, used_item, out = set(), set(), []
    places = {}
    for i, w in enumerate(doc):
        places.setdefault(w, []).append(i)
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in places.get(item[j], []):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_doc and j + n not in used_item:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_doc.update(range(i, i + n))
        used_item.update(range(j, j + n))
        out.append(n)
