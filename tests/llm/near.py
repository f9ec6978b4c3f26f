"""Near-duplicate groups by an exact join: prefixes of rare shingles, every candidate compared."""

from collections import Counter


def shingle_set(text, n=5):
    w = (text or "").lower().encode().split()
    return frozenset(b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset([b""])


def links(texts, similarity=0.8, n=5):
    """(pairs of distinct shingle sets at least ``similarity`` alike, set of each text)."""
    sets = [shingle_set(t, n) for t in texts]
    distinct = sorted(set(sets), key=lambda s: (len(s), sorted(s)[0]))
    often = Counter(x for s in distinct for x in s)
    seen, out = {}, []
    for i, s in enumerate(distinct):
        prefix = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-int(similarity * len(s) * 1000) // 1000) + 1]
        met = {j for x in prefix for j in seen.get(x, ()) if len(distinct[j]) >= similarity * len(s)}
        for j in met:
            common = len(s & distinct[j])
            if common >= similarity * (len(s) + len(distinct[j]) - common):
                out.append((distinct[j], s))
        for x in prefix:
            if often[x] > 1:
                seen.setdefault(x, []).append(i)
    return out, sets


def groups(texts, similarity=0.8, n=5):
    """Root of each text's group, and the linked pairs as roots before linking."""
    pairs, sets = links(texts, similarity, n)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(s) for s in sets], pairs
