"""Removal of byte strings that also start in an earlier document, by a sampled suffix array.

Every ``window``-byte string has an anchor: the ``GRAM``-byte string of least
hash in it (the leftmost, if several).  Equal windows have equal anchors at
equal places, so only suffixes that start at anchors are sorted, one for some
18 bytes.  The successive windows of one anchor form a phrase.

1. Tasks cut their texts into phrases and send the bytes of each to the range of
   its anchor.  Of equal phrases of a task's chunk one of the smallest document
   goes; those of later documents are repeated, and known at once.  A task
   remembers phrases that came again, so a passage of a third of all documents
   comes to its range some once a task.
2. In each range the suffixes from the anchors on, and the reversed prefixes
   before them, are sorted deep-shallow.  With their common prefixes a set of
   equal windows is a run in both orders, and its smallest document stays.
   Anchors with too little in common around them for any window aren't sorted.
3. Texts meet their repeated spans, which are cut out.

Hashes deal phrases to tasks and rule out what can't match; every removal rests
on compared bytes.  Nothing but sums goes to the driver, and tasks hold one
range, chunk or bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm import kernels
from taleweave.llm.scratch import forget_shuffles, written
from taleweave.llm.suffix_sort import common_prefixes, deep_shallow_order

U64 = np.uint64
GRAM = 16
WINDOW = 50
SLICE = 1 << 18  # bytes of text cut into phrases at a time
CHUNK_PHRASES = 1 << 16  # gathered in a task before they are sent
OFTEN = 1 << 15  # phrases a task remembers because they were repeated
RANGE_PHRASES = 1 << 16  # of one range of anchors
BUCKET_BYTES = 2 << 20  # text of one bucket of documents
SPACING = 18  # bytes from one anchor to the next, on average


def phrases(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window, anchor, anchor hash and hash of the whole of every phrase of a slice of texts."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none, none, np.empty(0, U64), np.empty(0, U64)
    span, grams = window - GRAM + 1, n - GRAM + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * kernels.powers(kernels.BASE, n), out=sums[1:])
    undo = kernels.powers(kernels.BASE_INVERSE, n + 1)
    gram = kernels.mix((sums[GRAM:] - sums[:grams]) * undo[:grams])
    least, place, reach = gram, np.arange(grams, dtype=np.int32), 1
    while reach < span:  # the leftmost least of ``reach`` grams, doubled up to the span
        step = min(reach, span - reach)
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])
        reach += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(at):
        return none, none, none, none, np.empty(0, U64), np.empty(0, U64)
    anchor = place[at].astype(np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    low, high = at[new], at[np.append(new[1:], len(at)) - 1]
    anchor = anchor[new]
    whole = kernels.mix((sums[high + window] - sums[low]) * undo[low] + (high - low).astype(U64)) ^ (anchor - low).astype(U64)
    return row[low], low, high, anchor, gram[anchor], whole


def slices(column: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its text); a long text comes in overlapping parts."""
    for first, _, data, offsets in kernels.slices(column, SLICE):
        if len(offsets) > 2 or len(data) <= 2 * SLICE:
            yield first, data, offsets, 0
            continue
        for at in range(0, max(1, len(data) - window + 1), SLICE):
            part = data[at : at + SLICE + window - 1]
            yield first, part, np.array([0, len(part)]), at


SENT = pa.schema([("to", pa.int32()), ("part", pa.int32()), ("docs", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
SENT_SQL = "to int, part int, docs binary, a binary, b binary"
PLACE = 5  # bytes of a place in a text


def _deltas(ids: np.ndarray) -> bytes:
    """Ids as differences, which compress well."""
    return np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()


def _undeltas(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<i8"))


def _packed(raw: bytes) -> bytes:
    """Compressed, after the number of bytes: Spark's own compression does little for them."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[4:], int.from_bytes(blob[:4], "little"), "zstd", asbytes=True)


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)


def bucket_of(doc: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of a document's id; ``bucket_column`` is the same for Spark."""
    x = doc.astype(np.int64).view(U64)
    x = x ^ (x >> U64(23))
    x = x ^ (x << U64(11))
    return np.mod(x.view(np.int64), np.int64(n_buckets))


def bucket_column(doc: Column, n_buckets: int) -> Column:
    x = F.coalesce(doc, F.lit(0).cast("long"))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 23))
    x = x.bitwiseXOR(F.shiftleft(x, 11))
    return F.pmod(x, F.lit(n_buckets).cast("long")).cast("int")


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int, n_ranges: int) -> Iterator[tuple]:
    """Repeated spans packed by bucket of documents, those that meet as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):  # ends grow with starts but for overlaps of phrases with parts of themselves
        first = np.append(True, doc[1:] != doc[:-1])
        own = np.cumsum(first)
        reach = np.maximum.accumulate(end + own * (1 << 42)) - own * (1 << 42)
        new = np.flatnonzero(first | np.append(True, start[1:] > reach[:-1]))
        doc, start, end = doc[new], start[new], reach[np.append(new[1:], len(reach)) - 1]
    bucket = bucket_of(doc, n_buckets)
    order = np.argsort(bucket, kind="stable")
    doc, start, end, bucket = doc[order], start[order], end[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[b], cuts[b + 1])
        yield b % n_ranges, 1 + b, _packed(_deltas(doc[own])), _packed(kernels.to_planes(start[own].astype(U64), PLACE)), _packed(kernels.to_planes((end - start)[own].astype(U64), PLACE))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of all spans, one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)]


def text_place(raw: bytes) -> int:
    """A text's own place among those of one id, where an id may have several texts: spans of another don't fall into it."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=PLACE).digest(), "little") >> 1


def _send(window: int, n_ranges: int, n_buckets: int, spread: bool):
    def pack(parts: list[tuple], often: list[tuple]) -> Iterator[tuple]:
        """Rows of a chunk; ``often`` keeps the phrases that were met again and again in this task, and is brought up to date."""
        if not parts:
            return
        n_new = sum(len(p[0]) for p in parts)
        doc, low, before, size, key, whole, flat = (np.concatenate(c) for c in zip(*parts, *often, strict=True))
        old = np.arange(len(doc)) >= n_new
        base = np.cumsum(size) - size
        # equal phrases of this chunk: same hash, then the same bytes
        order = np.lexsort((doc, whole))
        lead = np.append(True, whole[order][1:] != whole[order][:-1])
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        later = np.flatnonzero((doc[order] > doc[head]) & (size[order] == size[head]) & (before[order] == before[head]))
        known = np.zeros(len(doc), dtype=bool)
        if len(later):
            mine, theirs = order[later], head[later]
            same = _gathered(flat, base[mine], size[mine]) == _gathered(flat, base[theirs], size[theirs])
            known[mine] = np.logical_and.reduceat(same, np.cumsum(size[mine]) - size[mine])
            kept, times = np.unique(theirs[known[mine]], return_counts=True)
            kept = kept[np.argsort(-times, kind="stable")[:OFTEN]]
            often[:] = [(doc[kept], low[kept], before[kept], size[kept], key[kept], whole[kept], _gathered(flat, base[kept], size[kept]))]
            known &= ~old
            yield from _spans(doc[known], low[known], (low + size)[known], n_buckets, n_ranges)
        to = (((key >> U64(32)) * U64(n_ranges)) >> U64(32)).astype(np.int64)
        order = np.lexsort((low, doc, to))
        order = order[~(known | old)[order]]
        cuts = np.searchsorted(to[order], np.arange(n_ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[r] : cuts[r + 1]]
            where = kernels.to_planes(low[own].astype(U64), PLACE) + before[own].astype(np.uint8).tobytes() + size[own].astype(np.uint8).tobytes()
            yield r, 0, _packed(_deltas(doc[own])), _packed(where), _packed(_gathered(flat, base[own], size[own]).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, often, total = [], [], 0
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            own = np.array([text_place(t.as_py()) for t in batch["text"].cast(pa.binary())], np.int64) if spread else np.zeros(len(ids), np.int64)
            for first, data, offsets, at in slices(batch["text"], window):
                row, low, high, anchor, key, whole = phrases(data, offsets, window)
                if len(row):
                    size = high + window - low
                    parts.append((ids[first + row], low - offsets[row] + at + own[first + row], anchor - low, size, key, whole, _gathered(data, low, size)))
                    total += len(row)
                if total >= CHUNK_PHRASES:
                    yield _rows(pack(parts, often))
                    parts, total = [], 0
            del batch, ids
            kernels.give_back()
        yield _rows(pack(parts, often))
        parts = []
        kernels.give_back()

    return run


def _shared(doc: np.ndarray, key: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rows whose key, where valid, is also that of another document."""
    out = np.zeros(len(doc), dtype=bool)
    rows = np.flatnonzero(valid)
    if len(rows) > 1:
        order = rows[np.argsort(key[rows], kind="stable")]
        start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        d = doc[order]
        several = np.maximum.reduceat(d, start) > np.minimum.reduceat(d, start)
        out[order] = np.repeat(several, np.diff(np.append(start, len(order))))
    return out


PART = 4096  # phrases whose surroundings are laid out at a time


def _around(base: np.ndarray, before: np.ndarray, after: np.ndarray, flat: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before the anchors (nearest first) and after them, zero where the phrase ends, and the anchors as two numbers."""
    j, at = np.arange(side, dtype=np.int32), (base + before)[:, None]
    left = np.where(j < before[:, None], flat[np.maximum(at - 1 - j, 0)], 0)
    right = np.where(j < after[:, None], flat[np.minimum(at + GRAM + j, len(flat) - 1)], 0)
    return left, right, flat[at + np.arange(GRAM, dtype=np.int32)].view("<u8").astype(U64)


def _half_hashes(left: np.ndarray, right: np.ndarray, gram: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors with ``half`` bytes before, and after, them."""
    out = []
    for context in (left, right):
        words = np.zeros((len(context), -(-half // 8) * 8), np.uint8)
        words[:, :half] = context[:, :half]
        h = gram[:, 0] * U64(kernels.BASE) + gram[:, 1]
        for w in words.view("<u8").T:
            h = kernels.mix(h * U64(kernels.BASE) + w)
        out.append(h)
    return tuple(out)


def repeated(doc: np.ndarray, low: np.ndarray, before: np.ndarray, size: np.ndarray, flat: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the windows of phrases whose bytes also occur in an earlier document's phrase."""
    side = window - GRAM
    half = side // 2
    base = np.cumsum(size, dtype=np.int64) - size
    after = size - before - GRAM
    # a window holds half of the bytes around its anchor on one side at least
    hashes = np.empty((2, len(doc)), U64)
    for first in range(0, len(doc), PART):
        own = slice(first, first + PART)
        hashes[:, own] = _half_hashes(*_around(base[own], before[own], after[own], flat, side), half)
    rows = np.flatnonzero(_shared(doc, hashes[0], before >= half) | _shared(doc, hashes[1], after >= half))
    del hashes
    none = np.empty(0, np.int64)
    if len(rows) < 2:
        return none, none, none
    left, right, gram = np.empty((len(rows), side), np.uint8), np.empty((len(rows), side), np.uint8), np.empty((len(rows), 2), U64)
    for first in range(0, len(rows), PART):
        own = rows[first : first + PART]
        to = slice(first, first + PART)
        left[to], right[to], gram[to] = _around(base[own], before[own], after[own], flat, side)
    del flat, base, after
    doc, low, before, size = doc[rows], low[rows], before[rows].astype(np.int64), size[rows].astype(np.int64)
    order = np.lexsort((gram[:, 1], gram[:, 0]))
    g = gram[order]
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(np.append(True, (g[1:] != g[:-1]).any(axis=1)))
    by_suffix, by_prefix = deep_shallow_order(group, right), deep_shallow_order(group, left)
    lcp_suffix, lcp_prefix = common_prefixes(group, right, by_suffix), common_prefixes(group, left, by_prefix)

    def runs(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(lcp < least)
        return out

    # equal phrases: of those in later documents every window is repeated
    a, b = runs(by_suffix, lcp_suffix, side), runs(by_prefix, lcp_prefix, side)
    order = np.lexsort((doc, size, before, b, a))
    key = np.stack([a, b, before, size])[:, order]
    lead = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
    first = np.empty(len(order), np.int64)
    first[order] = doc[order][np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    whole = first < doc
    found = [(doc[whole], low[whole], (low + size)[whole])]
    # windows of the others, by the number of bytes before the anchor
    last = size - window
    several = np.bincount(group[~whole], minlength=int(group.max()) + 1)[group] > 1
    rest = ~whole & several
    for o in range(side + 1):
        some = np.flatnonzero(rest & (before - o >= 0) & (before - o <= last))
        if len(some) < 2:
            continue
        a, b = runs(by_suffix, lcp_suffix, side - o)[some], runs(by_prefix, lcp_prefix, o)[some]
        order = np.lexsort((doc[some], b, a))
        a, b, d = a[order], b[order], doc[some][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        hit = some[order[d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))] < d]]
        start = (low + before)[hit] - o
        found.append((doc[hit], start, start + window))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _settle(window: int, n_ranges: int, n_buckets: int):
    """A range of anchors: its repeated spans, with those that are passed on."""

    def run(table: pa.Table) -> pa.Table:
        kernels.give_back()  # what the group before has left
        part = table["part"].to_numpy()
        out = [table.filter(pa.array(part > 0))]
        mine = table.filter(pa.array(part == 0))
        if mine.num_rows:
            doc, low, before, size, flat = [], [], [], [], []
            for docs, where, raw in zip(*(mine[c].to_pylist() for c in ("docs", "a", "b")), strict=True):
                doc.append(_undeltas(_unpacked(docs)))
                where, n = _unpacked(where), len(doc[-1])
                low.append(kernels.from_planes(where[: PLACE * n], PLACE).astype(np.int64))
                before.append(np.frombuffer(where, np.uint8, n, PLACE * n))
                size.append(np.frombuffer(where, np.uint8, n, (PLACE + 1) * n))
                flat.append(np.frombuffer(_unpacked(raw), np.uint8))
            del mine, table
            doc, low, before, size, flat = (np.concatenate(x) for x in (doc, low, before, size, flat))
            spans = repeated(doc, low, before.astype(np.int32), size.astype(np.int32), flat, window)
            del doc, low, before, size, flat
            if len(spans[0]):
                out.append(pa.Table.from_batches([_rows(_spans(*spans, n_buckets, n_ranges))]))
        return pa.concat_tables([t.cast(SENT) for t in out])

    return run


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
CUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool, keep: list[str], spread: bool):
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        kernels.give_back()
        told = [[_undeltas(_unpacked(x)) for x in spans["docs"].to_pylist()], *([kernels.from_planes(_unpacked(x), PLACE).astype(np.int64) for x in spans[c].to_pylist()] for c in ("a", "b"))]
        doc, start, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in told)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], (start + size)[order]
        out: dict[str, list] = {c: [] for c in CUT.names}
        for batch in texts.to_batches(max_chunksize=256):
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                kept, at, removed, runs, reach = [], 0, 0, 0, -1
                if doc_id is not None:
                    a, b = np.searchsorted(doc, doc_id, "left"), np.searchsorted(doc, doc_id, "right")
                    base = text_place(raw) if spread else 0
                    a, b = a + np.searchsorted(start[a:b], [base, base + len(raw)])
                    for s, e in zip((start[a:b] - base).tolist(), (end[a:b] - base).tolist(), strict=True):
                        if s > reach:
                            runs += 1
                        if s > at:
                            kept.append(raw[at:s])
                        removed += max(0, e - max(s, at))
                        at, reach = max(at, e), max(reach, e)
                kept.append(raw[at:])
                rest = b"".join(kept)
                for c, v in zip(CUT.names, (doc_id, len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest if with_text else None), strict=True):
                    out[c].append(v)
        cut = pa.table(out, schema=CUT)
        for c in keep:
            cut = cut.append_column(c, texts[c])
        return cut

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int, bool]:
    """Packed spans (bucket, docs, a, b) of ``docs`` (doc_id, text), the number of buckets, and whether an id has several texts."""
    known = docs.where("doc_id IS NOT NULL")
    spread = not known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(8, -(-total // BUCKET_BYTES)) | 1  # odd, so that ids with a common step spread
    n_ranges = max(32, -(-total // (SPACING * RANGE_PHRASES)))
    sent = known.mapInArrow(_send(window, n_ranges, n_buckets, spread), SENT_SQL)
    found = sent.groupBy("to").applyInArrow(_settle(window, n_ranges, n_buckets), SENT_SQL).where("part > 0")
    spans = written(found.select((F.col("part") - 1).alias("bucket"), "docs", "a", "b"), "spans")
    del sent, found
    forget_shuffles(docs.sparkSession)
    return spans, n_buckets, spread


def deduplicate_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns of ``keep``, and with ``with_text`` kept (the remaining bytes).

    Every byte of a ``window``-byte string that also starts in a document with a
    smaller id is removed; strings are judged on the input.  A null text is
    empty.  Texts shorter than the window keep everything.  Rows with a null id
    are neither sources nor cut.  Rows with one id don't count as earlier than
    each other, and each is cut where its own text is repeated.  An empty table gives no rows; other columns are ignored.
    """
    if not GRAM + 8 <= window <= 255 // 2:
        raise ValueError("window must be of 24 to 127 bytes")
    own = [F.col(c).alias(f"keep_{c}") for c in keep]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *own)
    spans, n_buckets, spread = repeated_spans(texts.select("doc_id", "text"), window)
    types = "".join(f", keep_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    bucketed = texts.withColumn("bucket", bucket_column(F.col("doc_id"), n_buckets))
    out = bucketed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cut(with_text, [f"keep_{c}" for c in keep], spread), CUT_SQL + types)
    out = out if with_text else out.drop("kept")
    return out.select(F.col("doc_id").alias(id_col), *[c for c in out.columns[1:] if not c.startswith("keep_")], *[F.col(f"keep_{c}").alias(c) for c in keep])
