"""Plain forms of decisions, for small tables."""

import re


def near_groups(texts, size, percent):
    """Groups of ids linked by the similarity of their shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    group = {i: {i} for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            k = len(sets[a] & sets[b]) if a < b else 0
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return list({id(g): g for g in group.values()}.values())


def brute_contaminated(text, items, window=10):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    have = b" " + b" ".join(words(text)) + b" "
    for t in items:
        p = words(t)
        size = min(window, len(p))
        if size and any(b" " + b" ".join(p[k : k + size]) + b" " in have for k in range(len(p) - size + 1)):
            return True
    return False
