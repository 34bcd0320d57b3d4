"""Plain versions of the operators, for small inputs."""

import hashlib

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split(text):
    return (text or "").encode().split()


def kept(texts, window=13):
    """doc_id: (words, words removed, digest of the rest)."""
    first, out = {}, {}
    for i in sorted(texts):
        w = split(texts[i])
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i in texts:
        w = split(texts[i])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(rest).hexdigest())
    return out


def shingle_set(text, width=5):
    w = (text or "").encode().translate(LOW).split()
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})


def components(texts):
    """doc_id: (set size, least id that links reach)."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}
