"""Token ids of whole texts by a byte-level BPE vocabulary of the tokenizers library.

A byte-level BPE splits a text into pieces by a fixed pattern and encodes each
piece on its own, so a piece's ids can be looked up once and used for all its
repeats.  Pieces are found for a slice of text at a time from code-point
classes; the library's model encodes each distinct piece, and a hit counts only
if the piece itself agrees.  Rows that hold code points whose class differs
between Unicode versions, or the text of an added token, are encoded whole by
the library, and so is everything if the file asks for anything but this split.
"""

from __future__ import annotations

import json
import os
import sys
import types
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from taleweave.llm import kernels

SPACE, LETTER, NUMBER, OTHER, UNSURE, UNKNOWN = 0, 1, 2, 3, 4, 5
#: Code points of white space below U+3001 that the splitting pattern knows in every version.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters after an apostrophe that form a piece with it.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
KEEP = 300_000  # pieces remembered by a worker
SLICE = 1 << 18  # bytes of text encoded at a time


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kind(code: int) -> int:
    if code in WHITE:
        return SPACE
    c = chr(code)
    now, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if now[0] != old[0] or now[0] == "Z" or code in (0x85, *range(0x1C, 0x20)):
        return UNSURE
    return {"L": LETTER, "N": NUMBER}.get(now[0], OTHER)


def byte_letters() -> np.ndarray:
    """The code point that a byte-level vocabulary writes for each byte: itself if it can be seen, else one past U+00FF in turn."""
    b = np.arange(256)
    seen = (b >= 0x21) & (b <= 0x7E) | (b >= 0xA1) & (b != 0xAD)
    return np.where(seen, b, 0xFF + np.cumsum(~seen)).astype("<u2")


def encoder(path: str) -> Encoder:
    """The worker process's encoder: loading the vocabulary takes longer than many a task."""
    kept = sys.modules.setdefault("taleweave_worker", types.ModuleType("taleweave_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


class Encoder:
    """Ids of texts, as ``Tokenizer.from_file(path)`` gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        split, model = told["pre_tokenizer"] or {}, told["model"]
        self.added = [t["content"] for t in told["added_tokens"]]
        known = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        known &= not any(told[k] for k in ("normalizer", "truncation", "padding"))
        known &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        known &= not any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        self.known = known and not any(c.isspace() for t in self.added for c in t)
        del told, model
        self.letters = byte_letters()
        self.kinds = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.n = 0
        self.start, self.size, self.code_start, self.code_size = (np.zeros(1 << 10, np.int64) for _ in range(4))
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0
        self.codes, self.codes_used = np.zeros(1 << 12, np.uint32), 0
        self.again = np.zeros(1 << 10, dtype=bool)  # pieces met in more than one slice

    def _keep_repeated(self) -> None:
        """Forget pieces met in one slice only; all of them if too many others are left."""
        slots = np.flatnonzero(self.again[: self.n])
        if 2 * len(slots) > KEEP:
            self._forget()
            return
        keep = self.again[self.slots]
        self.keys, self.slots = self.keys[keep], np.searchsorted(slots, self.slots[keep])
        for flat, start, size in (("flat", "start", "size"), ("codes", "code_start", "code_size")):
            n, upto = getattr(self, size)[slots], np.cumsum(getattr(self, size)[slots])
            at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(getattr(self, start)[slots] - (upto - n), n)
            setattr(self, flat, getattr(self, flat)[at])
            setattr(self, start, upto - n)
            setattr(self, size, n)
        self.n, self.used, self.codes_used = len(slots), len(self.flat), len(self.codes)
        self.again = np.zeros(max(1, self.n), dtype=bool)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids (uint32) of every row in order; a null text has none."""
        for first, end, data, offsets in kernels.slices(column, SLICE):
            if not self.known:
                for k in range(end - first):
                    yield self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8")])[0]
            elif len(data) > SLICE:  # one long text, in parts
                yield np.concatenate([ids for part in _parts(data) for ids in self._slice(1, part, np.array([0, len(part)]))])
            else:
                yield from self._slice(end - first, data, offsets)

    def _slice(self, n: int, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        if not len(data):
            yield from [np.empty(0, np.uint32)] * n
            return
        text = data.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = heads[offsets]
        kinds = self.kinds[codes]
        if (kinds == UNKNOWN).any():
            for c in np.unique(codes[kinds == UNKNOWN]).tolist():
                self.kinds[c] = _kind(c)
            kinds = self.kinds[codes]
        odd = np.zeros(n, dtype=bool)
        if (kinds == UNSURE).any():
            odd[np.searchsorted(bounds, np.flatnonzero(kinds == UNSURE), "right") - 1] = True
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                odd[np.searchsorted(bounds, at, "right") - 1] = True
                at = text.find(token, at + 1)
        starts = np.flatnonzero(self._starts(codes, kinds, bounds))
        ends = np.append(starts[1:], len(codes))
        if odd.any():
            keep = ~odd[np.searchsorted(bounds, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        ids, upto, wrong = self._ids(data, codes, starts, ends)
        if len(wrong):  # another piece has the same hash
            odd[np.searchsorted(bounds, wrong, "right") - 1] = True
        at = upto[np.searchsorted(starts, bounds)]
        for k in range(n):
            if odd[k]:
                yield self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8")])[0]
            else:
                yield ids[at[k] : at[k + 1]]

    @staticmethod
    def _starts(codes: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Marks the first code point of every piece."""
        n = len(codes)
        row_start = np.zeros(n + 1, dtype=bool)
        row_start[bounds] = True
        row_start = row_start[:n]
        space = kinds == SPACE
        start = row_start.copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # the last white space before a word stands alone, or joins the word if it is a blank
        start[:-1] |= space[:-1] & ~space[1:] & ~row_start[1:]
        start[1:] &= ~((codes[:-1] == 0x20) & ~space[1:] & ~row_start[1:])
        marks = np.flatnonzero((codes == 0x27) & start)
        if len(marks):
            ends_at = bounds[np.searchsorted(bounds, marks, "right")]
            for suffix in SUFFIXES:
                size = 1 + len(suffix)
                fit = marks + size <= ends_at
                for k, c in enumerate(suffix):
                    fit[fit] &= codes[marks[fit] + 1 + k] == ord(c)
                hit = marks[fit]
                start[hit + 1] = False
                after = hit[hit + size < n] + size
                # a blank after it keeps its own mark
                start[after] |= kinds[after] != SPACE
                if len(suffix) == 2:
                    start[hit + 2] = False
                marks, ends_at = marks[~fit], ends_at[~fit]
        return start

    def _ids(self, data: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in order, where each piece's ids begin (one more for the end), and starts of pieces that differ from the one remembered."""
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64), starts
        found, where, piece = np.unique(kernels.span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        if self.n + len(found) > KEEP:
            self._keep_repeated()
        at = np.searchsorted(self.keys, found)
        new = at == len(self.keys)
        new[~new] = self.keys[at[~new]] != found[~new]
        self.again[self.slots[at[~new]]] = True
        if new.any():
            self._learn(data, codes, found[new], starts[where[new]], ends[where[new]], at[new])
            at = np.searchsorted(self.keys, found)
        slots = self.slots[at][piece]
        size = ends - starts
        same = self.code_size[slots] == size
        if same.all():  # code point by code point
            upto = np.cumsum(size)
            mine = np.arange(upto[-1]) - np.repeat(upto - size, size)
            agree = self.codes[mine + np.repeat(self.code_start[slots], size)] == codes[mine + np.repeat(starts, size)]
            same = np.logical_and.reduceat(agree, upto - size)
        else:
            for i in np.flatnonzero(same).tolist():
                s = slots[i]
                same[i] = (self.codes[self.code_start[s] : self.code_start[s] + size[i]] == codes[starts[i] : ends[i]]).all()
        sizes = self.size[slots]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.start[slots] - upto[:-1], sizes) + np.arange(upto[-1])
        return self.flat[at], upto, starts[~same]

    def _learn(self, data: np.ndarray, codes: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> None:
        """Remember new pieces; ``at`` says where their keys go among the known ones."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters[data].tobytes().decode("utf-16-le")
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ids = [[t.id for t in tokenize(letters[a:b])] for a, b in zip(heads[starts].tolist(), heads[ends].tolist(), strict=True)]
        have, new, n_codes = self.n, len(keys), ends - starts
        sizes = np.fromiter(map(len, ids), np.int64, new)
        total, n = int(sizes.sum()), int(n_codes.sum())
        for name in ("start", "size", "code_start", "code_size", "again"):
            setattr(self, name, _room(getattr(self, name), have + new))
        self.flat, self.codes = _room(self.flat, self.used + total), _room(self.codes, self.codes_used + n)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        upto = np.cumsum(n_codes)
        self.codes[self.codes_used : self.codes_used + n] = codes[np.arange(n) + np.repeat(starts - (upto - n_codes), n_codes)]
        own = slice(have, have + new)
        self.size[own], self.code_size[own] = sizes, n_codes
        self.start[own], self.code_start[own] = self.used + np.cumsum(sizes) - sizes, self.codes_used + upto - n_codes
        self.used, self.codes_used, self.n = self.used + total, self.codes_used + n, have + new
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, np.arange(have, have + new))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about SLICE bytes.

    A cut lies between an ASCII letter and a blank or line end: no piece and no added token goes across it.
    """
    first = 0
    while len(data) - first > SLICE:
        step, cut = SLICE, 0
        while not cut and first + step // 2 < len(data):
            near = data[first + step // 2 : first + step + 1]
            letter = ((near[:-1] | 0x20) >= 0x61) & ((near[:-1] | 0x20) <= 0x7A)
            ok = np.flatnonzero(letter & ((near[1:] == 0x20) | (near[1:] == 0x0A)))
            cut = first + step // 2 + int(ok[-1]) + 1 if len(ok) else 0
            step *= 2
        if not cut:
            break
        yield data[first:cut]
        first = cut
    yield data[first:]
