"""Plain versions of what the operators compute, for small tables."""

import collections
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
_FOLD = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(_FOLD))


def shingle_set(text, width=5):
    w = words(text)
    return set(zip(*(w[i:] for i in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())


def components(rows):
    """doc_id -> (size of the set, smallest doc_id reachable)."""
    sets = {d: shingle_set(t) for d, t in rows}
    lists, both = collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for t in s:
            lists[t].append(d)
    for ids in lists.values():
        ids.sort()
        both.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d)) for d in sets}


def repeats(rows, least=50):
    """doc_id -> starts of ``least`` words that another document has as well."""
    where = collections.defaultdict(set)
    texts = {d: words(t) for d, t in rows}
    for d, w in texts.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(d)
    return {d: [i for i in range(len(w) - least + 1) if len(where[tuple(w[i : i + least])]) > 1] for d, w in texts.items()}
