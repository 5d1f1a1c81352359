"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        sets[d] = shingles(t)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def cut(rows, window=50):
    """doc_id to (bytes, removed, runs, hash of the rest)."""
    first, raw = {}, {d: (t or "").encode() for d, t in rows}
    for d in sorted(raw):
        for i in range(len(raw[d]) - window + 1):
            first.setdefault(raw[d][i : i + window], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def base_measures(text):
    text = text or ""
    w = words(text)
    seen, later = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            later += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), later, len(covered)


def targets(sizes, weights=(1, 2, 3), limit=3):
    """Shares by weight, stopped at ``limit`` times the size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > limit * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def ring(points, rows, n_shards):
    """shard of every row: own arcs first up to the capacity, the rest clockwise."""
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    arcs = defaultdict(list)
    for r in rows:
        arcs[r[0]].append(r)
    out, over = {}, []
    for arc in range(len(points)):
        for r in arcs.get(arc, []):
            s = points[arc][1]
            if room[s]:
                room[s] -= 1
                out[r] = s
            else:
                over.append(r)
    for r in over:
        step = r[0] + 1
        while not room[points[step % len(points)][1]]:
            step += 1
        out[r] = points[step % len(points)][1]
        room[out[r]] -= 1
    return out
