"""Definitions as plain loops."""

CODE = {"A": 0x95C60474, "C": 0x62A02B4C, "T": 0x82572324, "G": 0x4BE24456}
RC = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rotl(x, n):
    n %= 32
    return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF


def rc(s):
    return "".join(RC[c] for c in reversed(s))


def kmer_hash(s):
    f = r = 0
    for i, c in enumerate(s):
        f ^= rotl(CODE[c], len(s) - 1 - i)
        r ^= rotl(CODE[RC[c]], i)
    return (f + r) & 0xFFFFFFFF


def minimizers(seq, k, w):
    seq, out, last = seq.upper(), [], None
    for p in range(len(seq) - k - w + 2):
        window = seq[p : p + k + w - 1]
        if set(window) - set("ACGT"):
            continue
        hashes = [kmer_hash(window[i : i + k]) for i in range(w)]
        forward = 2 * sum(c in "GT" for c in window) > len(window)
        best = min(hashes)
        at = p + (hashes.index(best) if forward else w - 1 - hashes[::-1].index(best))
        if at != last:
            out.append((at, min(seq[at : at + k], rc(seq[at : at + k]))))
            last = at
    return out


def required(hits_abs, rel, total):
    import math

    return max(hits_abs, max(1, math.floor(rel * total + 0.5)) if total else 0)
