"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text, k=4):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows, percent=85):
    """(doc_id, size, component) of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    links = set()
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        links |= {(j, i) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    comp = components(sets, links)
    return sorted((i, len(s), comp[i]) for i, s in sets.items())


def repeats(rows, length=50):
    """{doc_id: set of word positions that lie in a run of ``length`` words seen before in (doc_id, position) order}."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        out[i] = set()
        for p in range(len(w) - length + 1):
            run = tuple(w[p:p + length])
            if run in seen:
                out[i].update(range(p, p + length))
            seen.add(run)
    return out
