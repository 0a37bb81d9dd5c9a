"""A slow model of the engine in plain Python."""

from collections import Counter, defaultdict

COMPLEMENT = {"DNA": str.maketrans("ACGT", "TGCA"), "RNA": str.maketrans("ACGU", "UGCA")}
LETTERS = {"DNA": set("ACGT"), "RNA": set("ACGU")}


def kmers(records, k, reverse=False, natype="DNA"):
    out = []
    for ref, seq in records:
        seq = (seq or "").upper()
        for i in range(len(seq) - k + 1):
            w = seq[i : i + k]
            if set(w) <= LETTERS[natype]:
                out.append((ref, i, "+", w))
                if reverse:
                    out.append((ref, i, "-", w[::-1].translate(COMPLEMENT[natype])))
    return out


def counts(ks):
    return Counter(w for *_, w in ks)


def unique(ks):
    n = counts(ks)
    return [x for x in ks if n[x[3]] == 1]


def vector(ks, masked=False):
    n, own = counts(ks), Counter((r, w) for r, _, _, w in ks)
    out = [(r, s, i, n[w] - (own[r, w] if masked else 0)) for r, i, s, w in ks]
    return [x for x in out if x[3] > 0]


def dense(v):
    by = defaultdict(dict)
    for r, s, i, n in v:
        by[r, s][i] = n
    return [(r, s, i, cells.get(i, 0)) for (r, s), cells in by.items() for i in range(max(cells) + 1)]
