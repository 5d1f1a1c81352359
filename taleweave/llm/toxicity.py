"""Toxicity of documents by a recurrent network over all their windows.

The network (``recurrent``) is trained on the driver from a bounded sample of
windows of labelled documents.  Every text is then read whole in tasks: all its
overlapping windows are scored, and the largest logit and the number of windows
give the document's probability by a logistic fit on labelled documents that the
network wasn't trained on.  Only texts are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm import kernels, recurrent
from taleweave.llm.scratch import written

WINDOW, STRIDE = 128, 96  # words
PIECE = 1 << 20  # bytes of a text that a task reads at a time
#: Bounds of what is fitted on: labelled documents of either kind, windows of them in all and of one, and bytes of a window.
TOXIC_DOCS, CLEAN_DOCS, TOXIC_WINDOWS, CLEAN_WINDOWS, MOST_WINDOWS, WINDOW_BYTES = 1500, 3000, 4000, 6000, 64, 1 << 14
EPOCHS = 8
CALIBRATED = 6  # every how many-th labelled document is kept for the logistic fit
ENOUGH = 8  # such documents of either kind; with fewer, all labelled ones serve
THRESHOLD = 0.3


def windows(n: int) -> list[tuple[int, int]]:
    """(first word, words) of all windows of a text of ``n`` words."""
    if not n:
        return []
    return [(k * STRIDE, min(WINDOW, n - k * STRIDE)) for k in range(max(1, -(-(n - WINDOW + STRIDE) // STRIDE)))]


def _of_texts(owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows of a slice of texts."""
    at = np.searchsorted(owner, np.arange(n_texts + 1))
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW + STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(n_texts), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = k * STRIDE
    return text, at[text] + first, np.minimum(WINDOW, n[text] - first)


def _long_text(net: recurrent.Network, data: np.ndarray) -> tuple[float, int]:
    """The largest logit and the number of windows of one long text, read in pieces that end between words."""
    best, total, begin, size = -np.inf, 0, 0, PIECE
    while True:
        end = min(begin + size, len(data))
        while end < len(data) and recurrent.CLEAN[data[end]] != 0x20:
            end += 1
        v, which, _, starts = recurrent.read_words(data[begin:end], np.array([0, end - begin]))
        own = windows(len(which))
        if end < len(data):
            own = [w for w in own if w[0] + WINDOW <= len(which)]  # others may go on
            if not own:
                size *= 2
                continue
        if own:
            first, length = (np.array(x) for x in zip(*own, strict=True))
            best, total = max(best, float(net.logits(v, which, first, length).max())), total + len(own)
        if end == len(data):
            return best, total
        # the next window begins a stride after the last; the words up to there are known
        begin, size = begin + int(starts[own[-1][0] + STRIDE]), PIECE


def score_texts(net: recurrent.Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit of all windows of each text, and their number; without words the network's base."""
    logit, count = [np.empty(0)], [np.empty(0, np.int64)]
    base = float(net.weights["base"][0])
    for first, end, data, offsets in kernels.slices(column, PIECE):
        if end == first + 1 and len(data) > 2 * PIECE:
            top, n = _long_text(net, data)
            logit.append(np.array([top if n else base]))
            count.append(np.array([n]))
            continue
        v, which, owner, _ = recurrent.read_words(data, offsets)
        text, begin, length = _of_texts(owner, end - first)
        top = np.full(end - first, -np.inf)
        np.maximum.at(top, text, net.logits(v, which, begin, length))
        n = np.bincount(text, minlength=end - first)
        logit.append(np.where(n > 0, top, base))
        count.append(n)
    return np.concatenate(logit), np.concatenate(count).astype(np.int64)


def tops(net: recurrent.Network, docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``top`` and ``n_windows``, the largest logit and the number of windows, in place of the text."""
    others = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, n = score_texts(net, batch[text_col])
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in others), pa.array(top, pa.float64()), pa.array(n, pa.int64())], [*others, "top", "n_windows"])
        kernels.give_back()

    return docs.select(*others, text_col).mapInArrow(read, ", ".join(f"`{x}` {kinds[x]}" for x in others) + ", top double, n_windows long")


@dataclass
class Model:
    """A network (None: no document is told from another) and the weights of the logistic fit: logit, log(1 + windows), 1."""

    net: recurrent.Network | None
    fit: tuple[float, float, float]

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``score`` in place of the text."""
        a, b, c = self.fit
        if self.net is None:
            return docs.drop(text_col).withColumn("score", F.lit(1 / (1 + float(np.exp(-c)))))
        read = tops(self.net, docs, text_col)
        return read.withColumn("score", 1 / (1 + F.exp(-(a * F.col("top") + b * F.log1p("n_windows") + c)))).drop("top", "n_windows")


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression (the last one, the constant, isn't shrunk), by Newton steps."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep, x.T @ (weight * (p - label)) + keep @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _window_texts(text_col: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, h, out = batch["label"].to_pylist(), batch["h"].to_pylist(), {"h": [], "label": [], "nth": [], "piece": []}
            for first, end, data, offsets in kernels.slices(batch[text_col], PIECE):
                _, _, owner, starts = recurrent.read_words(data, offsets)
                text, begin, length = _of_texts(owner, end - first)
                for t in np.unique(text).tolist():
                    own = np.flatnonzero(text == t)
                    if len(own) > MOST_WINDOWS:  # evenly spread over the text
                        own = own[np.linspace(0, len(own) - 1, MOST_WINDOWS).astype(np.int64)]
                    for k, (b, n) in enumerate(zip(begin[own].tolist(), length[own].tolist(), strict=True)):
                        stop = starts[b + n] if b + n < len(starts) and owner[b + n] == t else offsets[t + 1]
                        if stop - starts[b] <= WINDOW_BYTES:
                            for name, x in (("h", h[first + t]), ("label", label[first + t]), ("nth", k), ("piece", data[starts[b] : stop].tobytes().decode())):
                                out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("label", pa.int32()), ("nth", pa.int32()), ("piece", pa.string())]))

    return cut


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents whose id fulfils ``learn_from``.

    The sample is bounded by TOXIC_DOCS, CLEAN_DOCS, TOXIC_WINDOWS and
    CLEAN_WINDOWS; it goes by hashes, so reruns agree.  An id with several labels
    is toxic if one says so; null labels don't count.  Without documents of both
    kinds every score is the smoothed share of toxic ones.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(learn_from)
    known = written(known.groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label")).withColumn("h", F.xxhash64(id_col)), "labelled")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = known.where("label = 1").orderBy("h", id_col).limit(TOXIC_DOCS).unionByName(known.where("label = 0").orderBy("h", id_col).limit(CLEAN_DOCS))
    kept_apart = F.pmod(F.xxhash64(F.lit("apart"), id_col), F.lit(CALIBRATED)) == 0
    # at most TOXIC_DOCS + CLEAN_DOCS ids
    chosen = docs.select(id_col, text_col).join(F.broadcast(sample.select(id_col, "h", "label", kept_apart.alias("apart"))), id_col)
    chosen = written(chosen, "labelled-texts")
    counts = {(r["label"], r["apart"]): r["count"] for r in chosen.groupBy("label", "apart").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    flat = Model(None, (0.0, 0.0, float(np.log(prior / (1 - prior)))))
    pieces = written(chosen.where("NOT apart").select("h", "label", text_col).mapInArrow(_window_texts(text_col), "h long, label int, nth int, piece string"), "label-windows")
    order = ["h", "nth", "piece"]  # whole documents, until the bound is reached
    bounded = pieces.where("label = 1").orderBy(*order).limit(TOXIC_WINDOWS).unionByName(pieces.where("label = 0").orderBy(*order).limit(CLEAN_WINDOWS))
    table = bounded.toArrow()  # at most TOXIC_WINDOWS + CLEAN_WINDOWS windows of WINDOW_BYTES
    label = table["label"].to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        return flat
    net = _fitted(table["piece"].combine_chunks(), label, table["h"].to_numpy())
    if min(counts.get((k, True), 0) for k in (0, 1)) >= ENOUGH:
        chosen = chosen.where("apart")
    judged = tops(net, chosen.select("h", "label", text_col), text_col).orderBy("h", "top", "n_windows").limit(TOXIC_DOCS + CLEAN_DOCS).toArrow()
    own = judged["label"].to_numpy().astype(np.int64)
    if len(set(own.tolist())) < 2:
        return flat
    x = np.stack([judged["top"].to_numpy(), np.log1p(judged["n_windows"].to_numpy()), np.ones(len(own))], axis=1)
    weight = np.array([n_clean, n_toxic])[own] / np.bincount(own)[own]  # as many of either kind as there are
    a, b, c = logistic(x, own, weight / weight.mean())
    return Model(net, (float(a), float(b), float(c)))


def _fitted(pieces: pa.Array, label: np.ndarray, doc: np.ndarray) -> recurrent.Network:
    _, offsets, data = pieces.cast(pa.large_string()).buffers()
    offsets, data = np.frombuffer(offsets, np.int64)[: len(pieces) + 1], np.frombuffer(data, np.uint8)
    v, which, owner, _ = recurrent.read_words(data, offsets)
    at = np.searchsorted(owner, np.arange(len(pieces) + 1))
    mask = np.arange(WINDOW)[None, :] < np.diff(at)[:, None]
    tokens = which[np.minimum(at[:-1, None] + np.arange(WINDOW)[None, :], len(which) - 1)]
    return recurrent.fit(v, np.where(mask, tokens, tokens[:, :1]), mask, label, doc, EPOCHS)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD).

    ``held_out`` is a condition on the id; labels of such documents aren't used.
    A null text counts as empty; texts without words share one score.  A null id
    is never held out.  Repeated rows and ids are scored each by their own text.
    An empty table gives no rows.  Other columns are ignored.
    """
    held = F.coalesce(held_out, F.lit(False))
    model = train(docs, labels, ~held, id_col, text_col)
    scored = model.score(docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col)), text_col)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
