"""Plain versions that tests compare with."""

import re

import numpy as np

MOTIFS = ("CCCTAA", "TTAGGG")


def disrupted_spans(text):
    """Runs (start, length) that fewer than six rotations of the strand's hexamer cover, but for the hexamer itself."""
    up = (text or "").upper()
    found = {m: [i for i in range(len(up)) if up[i : i + 6] in {m[k:] + m[:k] for k in range(6)}] for m in MOTIFS}
    motif = MOTIFS[0] if len(found[MOTIFS[0]]) >= len(found[MOTIFS[1]]) else MOTIFS[1]
    if not found[motif]:
        return []
    depth = [sum(i <= p < i + 6 for i in found[motif]) for p in range(len(up))]
    for i in range(len(up)):
        if up[i : i + 6] == motif:
            depth[i : i + 6] = [6] * 6
    return [(m.start(), len(m[0])) for m in re.finditer("1+", "".join("01"[d < 6] for d in depth))]


def fragments(text, k=6):
    """Pieces of k letters from the start, equal neighbours as one: (start, length, fragment)."""
    out = []
    for i in range(0, len(text), k):
        piece = text[i : i + k]
        if out and out[-1][2] == piece:
            out[-1] = (out[-1][0], out[-1][1] + len(piece), piece)
        else:
            out.append((i, len(piece), piece))
    return out


def interval_means(cigar, quality, pos, intervals):
    """Mean base quality of the read's bases in each interval that it touches, in the order of the intervals.

    Matched bases count where they lie, inserted ones where the walk stands, and soft-clipped ones if the reference base
    next to them lies in an interval; deleted bases have no quality.
    """
    if not cigar or quality is None or pos is None or not len(intervals):
        return []
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    soft = [k for k, (_, op) in enumerate(ops) if op == "S"]
    aligned = [k for k, (_, op) in enumerate(ops) if op in "M=X"]
    q = np.asarray(quality, float)
    ref, read = pos, 0
    total, n = np.zeros(len(intervals)), np.zeros(len(intervals), int)
    begin, end = np.array([x["start"] for x in intervals]), np.array([x["stop"] for x in intervals])

    def add(at, a, b):
        for k in np.flatnonzero((begin <= at) & (at < end)):
            total[k] += q[a:b].sum()
            n[k] += b - a

    for k, (size, op) in enumerate(ops):
        if op in "M=X":
            low, high = np.maximum(begin, ref), np.minimum(end, ref + size)
            for j in np.flatnonzero(low < high):
                a, b = read + int(low[j]) - ref, read + int(high[j]) - ref
                total[j] += q[a:b].sum()
                n[j] += b - a
            ref, read = ref + size, read + size
        elif op == "I":
            add(ref, read, read + size)
            read += size
        elif op == "S":
            left = k in soft and (not aligned or k < aligned[0])
            add(ref if left else ref - 1, read, read + size)
            read += size
        elif op in "DN":
            ref += size
    return [float(t / c) for t, c in zip(total, n) if c]
