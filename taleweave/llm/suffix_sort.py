"""Deep-shallow sorting of short byte strings within groups.

Shallow: multikey quicksort with eight bytes as a symbol, to a depth of
``SHALLOW`` symbols; all segments that are still open are split around their own
pivots in one round.  Deep: strings that still agree go into a blind trie, which
keeps only branching positions and bytes, so inserting one compares it once,
with a single string of its group; equal strings share a leaf.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 2  # symbols


def symbols(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit symbols, filled up with zeros."""
    n, width = strings.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = strings
    return full.view(">u8").astype(np.uint64)


def multikey_quicksort(group: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, first ``depth`` symbols) and a mark at the first row of each segment of equal ones."""
    n = len(group)
    order = np.argsort(group, kind="stable")
    first = np.append(True, group[order][1:] != group[order][:-1]) if n else np.empty(0, bool)
    at = np.zeros(n, np.int64)  # depth reached by the row in this place
    open_ = np.arange(n)
    while len(open_):
        # segments of one row, and those at full depth, are done
        start = np.flatnonzero(first[open_])
        size = np.diff(np.append(start, len(open_)))
        go = np.repeat(size > 1, size) & (at[open_] < depth)
        open_ = open_[go]
        if not len(open_):
            break
        start = np.flatnonzero(first[open_])
        size = np.diff(np.append(start, len(open_)))
        rows = order[open_]
        key = keys[rows, at[open_]]
        pivot = np.repeat(key[start + size // 2], size)
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        segment = np.repeat(np.arange(len(start)), size)
        by = np.argsort(segment * 3 + side, kind="stable")
        order[open_], side, segment = rows[by], side[by], segment[by]
        first[open_[1:]] = (segment[1:] != segment[:-1]) | (side[1:] != side[:-1])
        at[open_] += side == 1  # all of a segment had the same depth
    return order, first


def blind_trie_order(values: list[bytes]) -> list[int]:
    """Indices of strings of one width in ascending order, equal ones in input order."""
    leaves: dict[bytes, list[int]] = {}
    for i, value in enumerate(values):
        leaves.setdefault(value, []).append(i)
    # a node is (depth, {byte: child}), a leaf a list of equal strings
    root: list | tuple | None = None
    for value, leaf in leaves.items():
        if root is None:
            root = leaf
            continue
        node = root
        while isinstance(node, tuple):
            node = node[1].get(value[node[0]]) or next(iter(node[1].values()))
        other = values[node[0]]
        low, high = 0, len(value)  # their common prefix by halving
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if value[:mid] == other[:mid] else (low, mid - 1)
        parent, edge, node = None, 0, root
        while isinstance(node, tuple) and node[0] < low:
            parent, edge = node, value[node[0]]
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == low:
            node[1][value[low]] = leaf
            continue
        split = (low, {value[low]: leaf, other[low]: node})
        if parent is None:
            root = split
        else:
            parent[1][edge] = split
    out: list[int] = []
    stack = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Order of rows by (group, bytes of the row); ``strings`` is a matrix of bytes."""
    n, width = strings.shape
    keys = symbols(strings)
    order, first = multikey_quicksort(group, keys, min(SHALLOW, keys.shape[1]))
    if width <= 8 * SHALLOW or n < 2:
        return order
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    deep = keys[:, SHALLOW:]
    # segments whose rest is equal throughout need no trie
    rest = deep[order]
    head = np.repeat(start, size)
    alike = np.logical_and.reduceat((rest == rest[head]).all(axis=1), start) if n else np.empty(0, bool)
    for a, m in zip(start[~alike].tolist(), size[~alike].tolist(), strict=True):
        own = order[a : a + m]
        raw = rest[a : a + m].astype(">u8").tobytes()
        step = len(raw) // m
        order[a : a + m] = own[blind_trie_order([raw[i * step : (i + 1) * step] for i in range(m)])]
    return order


def common_prefixes(group: np.ndarray, strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in order with the one before; -1 where a group begins."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        same = strings[order[1:]] == strings[order[:-1]]
        lcp = np.where(same.all(axis=1), strings.shape[1], np.argmin(same, axis=1))
        out[1:] = np.where(group[order[1:]] == group[order[:-1]], lcp, -1)
    return out
