"""Quality rules by distribution divergence.

A text's histogram of character classes and of common words is compared with
the reference of its language by Jensen-Shannon distance.  References are sums
over all documents of the language that pass the base rules, taken again without
those far from the first sums, so they come from the corpus itself.  Texts and references too short to tell are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm import kernels
from taleweave.llm.frames import KEY, join_on, with_key
from taleweave.llm.scratch import written

# Frequent function words of written English, French, German and Spanish.
COMMON_WORDS = """
the of and to a in is that for it was on with be as by this are at from or an not have but they you his her which
de la le et les des en un une du que est pour qui dans par sur au plus ne se pas avec son il ce sont mais
der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
el los las por con una su para como más al lo pero sus o este sí porque esta entre cuando muy sin sobre
""".split()
#: Character classes, in the order of the histogram.
CLASSES = ("lower or digit", "upper", "blank", "line end", "stop", "exclamation", "quote or bracket", "symbol", "control", "beyond ASCII")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
MIN_CHARS = 200  # shorter texts aren't judged
MIN_REFERENCE_WORDS = 2000
SALTS = 32  # parts of a language in the join with its reference
#: Largest Jensen-Shannon distances (square root of the divergence in bits) that pass.
MAX_CLASS_DISTANCE = 0.16
MAX_WORD_DISTANCE = 0.42
#: Documents farther than this from the first references don't count for the final ones.
TRIM = np.array([0.14, 0.28])


def _class_table() -> np.ndarray:
    kind = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
    kind[:32] = kind[127] = CLASSES.index("control")
    kind[128:] = CLASSES.index("beyond ASCII")
    for chars, name in ((b"abcdefghijklmnopqrstuvwxyz0123456789", "lower or digit"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b" \t\x0b\x0c", "blank"), (b"\n\r", "line end"), (b".,;:?-", "stop"), (b"!", "exclamation"), (b"'\"()[]{}", "quote or bracket")):
        kind[list(chars)] = CLASSES.index(name)
    return kind


def vocabulary() -> list[str]:
    return list(dict.fromkeys(COMMON_WORDS))


N_BINS = len(CLASSES) + len(vocabulary()) + 1  # the last is for all other words
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.int64)[:n] if len(owner) else np.zeros(n, np.int64)


def _repeats(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items whose key occurs twice or more in their row, items that follow an equal one), as masks."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    same = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, later


def measure(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(MEASURES, histogram) of the rows, a slice at a time."""
    words_of = vocabulary()
    raw = "".join(words_of).encode()
    ends = np.cumsum([len(w.encode()) for w in words_of])
    hashes = kernels.span_hashes(np.frombuffer(raw, np.uint8), np.append(0, ends[:-1]), ends)
    by_hash = np.argsort(hashes)
    hashes = hashes[by_hash]
    kinds = _class_table()
    for first, end, data, offsets in kernels.slices(column):
        n = end - first
        if not len(data):
            yield np.zeros((n, len(MEASURES)), np.int64), np.zeros((n, N_BINS), np.int64)
            continue
        row_of = np.repeat(np.arange(n), np.diff(offsets))
        heads = (data & 0xC0) != 0x80
        kind = kinds[data]
        classes = np.bincount(row_of[heads] * len(CLASSES) + kind[heads], minlength=n * len(CLASSES)).reshape(n, -1)
        starts, ends_, owner = kernels.word_spans(data, offsets)
        out = np.zeros((n, len(MEASURES)), np.int64)
        hist = np.zeros((n, N_BINS), np.int64)
        hist[:, : len(CLASSES)] = classes
        gap = kernels.SEPARATOR[data]
        out[:, 1] = _per_row(row_of[heads & ~gap], n)
        out[:, 2] = _per_row(row_of[np.isin(data, np.frombuffer(SYMBOLS, np.uint8))], n)
        if len(starts):
            out[:, 0] = _per_row(owner, n)
            exact = kernels.span_hashes(data, starts, ends_)
            low = kernels.span_hashes(kernels.LOWER[data], starts, ends_)
            at = np.minimum(np.searchsorted(hashes, low), len(hashes) - 1)
            bin_ = np.where(hashes[at] == low, len(CLASSES) + by_hash[at], N_BINS - 1)
            hist += np.bincount(owner * N_BINS + bin_, minlength=n * N_BINS).reshape(n, N_BINS)
            windows, where = kernels.window_hashes(exact, owner, 3)
            if len(where):
                twice, _ = _repeats(owner[where], windows)
                covered = np.zeros(len(starts), bool)
                for k in range(3):
                    covered[where[twice] + k] = True
                out[:, 4] = _per_row(owner[covered], n)
            breaks = np.flatnonzero(data == 10) + 1
            line = np.unique(np.concatenate([offsets[:-1], breaks]))
            line = line[line < len(data)]
            stop = np.append(line[1:], len(data))
            stop = stop - (data[stop - 1] == 10)
            filled = np.concatenate([[0], np.cumsum(~gap)])
            own = filled[stop] > filled[line]
            line, stop = line[own], stop[own]
            of = np.searchsorted(offsets, line, "right") - 1
            _, later = _repeats(of, kernels.span_hashes(data, line, stop))
            out[:, 3] = _per_row(of[later], n)
        yield out, hist


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, the measures, base_failed and the histogram of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out, hist in measure(batch["text"]):
                n = len(out)
                failed = (out[:, 0] < MIN_WORDS) | (100 * out[:, 4] > MAX_REPEATED * out[:, 0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * N_BINS, N_BINS, dtype=np.int32)), pa.array(hist.ravel().astype(np.int32)))
                own = [batch[c].slice(at, n) for c in ("doc_id", "lang", *KEY)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, out.T), pa.array(failed), lists], ["doc_id", "lang", *KEY, *MEASURES, "base_failed", "bins"])
                at += n
            del batch
            kernels.give_back()

    rows = with_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id long, lang string, {', '.join(f'{m} long' for m in (*KEY, *MEASURES))}, base_failed boolean, bins array<int>")


def references(rows: DataFrame) -> DataFrame:
    """(lang, reference): the summed histogram of every language, one row each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, own = np.unique(np.array(batch["lang"].to_pylist(), dtype=object), return_inverse=True)
            sums = np.zeros((len(langs), N_BINS), np.int64)
            np.add.at(sums, own, batch["bins"].flatten().to_numpy().reshape(-1, N_BINS))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(langs, N_BINS), pa.string()), pa.array(np.tile(np.arange(N_BINS), len(langs)), pa.int32()), pa.array(sums.ravel(), pa.int64())], ["lang", "bin", "n"])

    parts = rows.where("NOT base_failed").select("lang", "bins").mapInArrow(add, "lang string, bin int, n long")
    sums = parts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return written(sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"]).alias("reference")), "references")


def with_reference(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with the reference of their language, null where it has none; a language's rows meet it in SALTS parts."""
    salted = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "bins"), F.lit(SALTS)).cast("int")), salted, ["lang", "salt"], "left").drop("salt")


def distances(bins: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's histogram to the reference; 0 where a side is empty."""
    total, whole = bins.sum(axis=1, keepdims=True), reference.sum()
    p = bins / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(whole, 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    out = np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0))
    return np.where((total[:, 0] > 0) & (whole > 0), out, 0)


def _far(batch: pa.RecordBatch) -> np.ndarray:
    """(class distance, word distance) of every row to its reference; NaN where a side is missing or too short to tell."""
    split, langs = len(CLASSES), np.array(batch["lang"].to_pylist(), dtype=object)
    bins, refs = batch["bins"].flatten().to_numpy().reshape(-1, N_BINS), batch["reference"]
    far = np.full((len(langs), 2), np.nan)
    known, first, own = np.unique(langs, return_index=True, return_inverse=True)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(known) + 1))
    for k, at in enumerate(first.tolist()):
        reference = refs[at].as_py()
        if reference is not None and sum(reference[split:]) >= MIN_REFERENCE_WORDS:
            mine, whole = order[cuts[k] : cuts[k + 1]], np.array(reference, dtype=np.float64)
            far[mine, 0] = distances(bins[mine, :split], whole[:split])
            far[mine, 1] = distances(bins[mine, split:], whole[split:])
    far[bins[:, :split].sum(axis=1) < MIN_CHARS] = np.nan
    return far


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows within ``TRIM`` of their reference, or not judged by it."""
    for batch in batches:
        keep = ~(_far(batch) > TRIM).any(axis=1)
        yield batch.select(["lang", "bins", "base_failed"]).filter(pa.array(keep))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distances.

    A null text has no words, so the base rules fail it.  A null language is a
    language of its own.  Every language has its own reference, however many there are.  Texts of fewer than
    ``MIN_CHARS`` characters, and languages with fewer than
    ``MIN_REFERENCE_WORDS`` words, are not judged by divergence (distance null).
    Repeated rows are judged alike; an empty table gives no rows; other columns
    are ignored.
    """
    rows = written(measured(docs, id_col, text_col, lang_col), "quality")
    near = with_reference(rows.where("NOT base_failed"), references(rows)).select("lang", "bins", "base_failed", "reference")
    refs = references(near.mapInArrow(_near, "lang string, bins array<int>, base_failed boolean"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _far(batch)
            failed = batch["base_failed"].to_numpy(zero_copy_only=False)
            kept = ~failed & ~(far[:, 0] > max_class) & ~(far[:, 1] > max_word)
            extra = [pa.array(kept), pa.array(far[:, 0], from_pandas=True), pa.array(far[:, 1], from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "lang", *KEY, *MEASURES, "base_failed")), *extra], ["doc_id", "lang", *KEY, *MEASURES, "base_failed", "kept", "class_distance", "word_distance"])

    out = with_reference(rows, refs).mapInArrow(judge, f"doc_id long, lang string, {', '.join(f'{m} long' for m in (*KEY, *MEASURES))}, base_failed boolean, kept boolean, class_distance double, word_distance double")
    return out.withColumnRenamed("doc_id", id_col)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and others) that ``judge_documents`` keeps, each judged by its own text."""
    judged = written(judge_documents(docs).where("NOT kept").select("doc_id", "lang", *KEY).distinct(), "rejected")
    rows = with_key(docs).withColumn("judged_lang", F.coalesce("lang", F.lit("")))
    return join_on(rows, judged.withColumnRenamed("lang", "judged_lang"), ["doc_id", "judged_lang", *KEY], "left_anti").select(*docs.columns)
