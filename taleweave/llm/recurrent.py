"""A bidirectional gated recurrent network with attention pooling, in numpy.

A window of words is read in both directions.  A word enters as the vector of
its own bucket beside the mean vector of its character runs, so unseen words with
known beginnings, endings or stems are still told apart.  The states at all words
are weighed by a small attention network, and their sum gives one number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from taleweave.llm import kernels

U64 = np.uint64
WORDS, RUNS = 1 << 13, 1 << 14  # buckets of words and of character runs
LENGTHS = (3, 4, 5, 6)  # of runs, in bytes, with a mark at both ends of a word
LEAST, DECAY, RATE, WARM = 200, 1e-5, 0.01, 0.4
D_WORD, D_RUN, HIDDEN, ATTENTION = 8, 16, 12, 8

#: Bytes of words in lower case (letters, digits and all beyond ASCII); all others separate.
CLEAN = np.full(256, 0x20, dtype=np.uint8)
CLEAN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
CLEAN[65:91] = np.arange(97, 123)


@dataclass
class Vocabulary:
    """Distinct words: the bucket of each and the buckets of its character runs (those of word i lie from at[i] to at[i + 1])."""

    word: np.ndarray
    run: np.ndarray
    at: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a slice of texts; of every word in order which one it is, its text and where it starts."""
    low = CLEAN[data]
    starts, ends, owner = kernels.word_spans(low, offsets)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Vocabulary(none, none, np.zeros(1, np.int64)), none, none, none
    hashes = kernels.span_hashes(low, starts, ends)
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    # words side by side, each between marks
    room = n + 2
    begin = np.cumsum(room) - room
    letters = np.empty(int(room.sum()), dtype=U64)
    of = np.repeat(np.arange(len(n)), room)
    place = np.arange(len(letters)) - begin[of]
    inside = (place > 0) & (place <= n[of])
    letters[inside] = low[(s[of] + place - 1)[inside]]
    letters[~inside] = np.where(place[~inside] == 0, 1, 2)
    runs, owners = [], []
    for size in LENGTHS:
        h, at = kernels.window_hashes(letters, of, size)
        runs.append((kernels.mix(h + U64(size)) % U64(RUNS)).astype(np.int64))
        owners.append(of[at])
    run, own = np.concatenate(runs), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    vocabulary = Vocabulary((distinct % U64(WORDS)).astype(np.int64), run[order], np.searchsorted(own[order], np.arange(len(n) + 1)))
    return vocabulary, which, owner, starts


def _runs_of(v: Vocabulary, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of some words, one after the other, and where those of each begin."""
    n = v.at[words + 1] - v.at[words]
    first = np.cumsum(n) - n
    at = np.repeat(v.at[words] - first, n) + np.arange(int(n.sum()))
    return v.run[at], first


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of successive rows; no part is empty, as every word has three bytes or more with its marks."""
    return np.add.reduceat(rows, first, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int) -> Network:
        r = np.random.default_rng(seed)
        d, h = D_WORD + D_RUN, HIDDEN
        shapes = {"word": (WORDS, D_WORD, 0.1), "run": (RUNS, D_RUN, 0.3), "inputs": (2, d, 3 * h, d**-0.5), "states": (2, h, 3 * h, h**-0.5), "look": (2, h, ATTENTION, h**-0.5), "weigh": (ATTENTION, 0.3), "out": (2, h, h**-0.5)}
        w = {k: (r.standard_normal(s[:-1]) * s[-1]).astype(np.float32) for k, s in shapes.items()}
        w |= {"gates": np.zeros((2, 3 * h), np.float32), "tilt": np.zeros(ATTENTION, np.float32), "base": np.zeros(1, np.float32)}
        return Network(w)

    def vectors(self, v: Vocabulary, words: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Input vectors of some words of a vocabulary."""
        w = self.weights
        run, first = _runs_of(v, words)
        n = (v.at[words + 1] - v.at[words]).astype(np.float32)[:, None]
        x = np.concatenate([w["word"][v.word[words]], _sums(w["run"][run], first) / n], axis=1)
        return x, (run, n)

    def forward(self, gates: np.ndarray, tokens: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> tuple[np.ndarray, tuple]:
        """Logits of windows.  ``gates`` (2, words, 3 h) holds what each word adds to the gates, ``tokens`` (n, t) the words, ``mask`` what is no padding."""
        w, h = self.weights, HIDDEN
        n, t = tokens.shape
        states = np.empty((t, 2, n, h), np.float32)
        now = np.zeros((2, n, h), np.float32)
        g = np.empty((2, n, 3 * h), np.float32)
        columns = np.ascontiguousarray(tokens.T)
        for k in range(t):
            a, b = k, t - 1 - k
            np.take(gates[0], columns[a], axis=0, out=g[0])
            np.take(gates[1], columns[b], axis=0, out=g[1])
            u = np.matmul(now, w["states"])
            zr = sigmoid(g[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            step = new + z * (now - new)
            if mask is not None:
                m = np.stack([mask[:, a], mask[:, b]])[..., None]
                step = np.where(m, step, now)
            if keep is not None:
                keep.append((now, z, r, new, u[..., 2 * h :]))
            now = step
            states[a, 0], states[b, 1] = now[0], now[1]
        seen = np.tanh(states[:, 0] @ w["look"][0] + states[:, 1] @ w["look"][1] + w["tilt"])
        e = seen @ w["weigh"]
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-1e9))
        share = np.exp(e - e.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tdnh->dnh", share, states, optimize=True)
        logit = np.einsum("dnh,dh->n", pooled, w["out"]) + w["base"][0]
        return logit, (states, seen, share, pooled)

    def gradients(self, v: Vocabulary, tokens: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted logistic loss of some windows, and its derivatives."""
        w, h = self.weights, HIDDEN
        words, local = np.unique(tokens, return_inverse=True)
        local = local.reshape(tokens.shape)
        x, (run, n_runs) = self.vectors(v, words)
        gates = np.matmul(x[None], w["inputs"]) + w["gates"][:, None]
        keep: list = []
        logit, (states, seen, share, pooled) = self.forward(gates, local, mask, keep)
        p = sigmoid(logit)
        weight = weight / weight.sum()
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
        d = (weight * (p - label)).astype(np.float32)
        out: dict[str, np.ndarray] = {"base": d.sum(keepdims=True), "out": np.einsum("n,dnh->dh", d, pooled)}
        d_pooled = d[None, :, None] * w["out"][:, None]
        d_share = np.einsum("dnh,tdnh->tn", d_pooled, states, optimize=True)
        d_states = share[:, None, :, None] * d_pooled[None]
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        out["weigh"] = np.einsum("tn,tna->a", d_e, seen)
        d_seen = d_e[..., None] * w["weigh"] * (1 - seen**2)
        out["tilt"] = d_seen.sum(axis=(0, 1))
        out["look"] = np.einsum("tdnh,tna->dha", states, d_seen, optimize=True)
        d_states += np.einsum("tna,dha->tdnh", d_seen, w["look"], optimize=True)
        d_gates = np.zeros_like(gates)
        d_u = np.zeros_like(w["states"])
        back = np.ascontiguousarray(w["states"].transpose(0, 2, 1))
        t = tokens.shape[1]
        carry = np.zeros_like(keep[0][0])
        per_step = np.empty((t, 2, tokens.shape[0], 3 * h), np.float32)
        for k in range(t - 1, -1, -1):
            before, z, r, new, u = keep[k]
            a, b = k, t - 1 - k
            m = np.stack([mask[:, a], mask[:, b]])[..., None]
            dh = carry + np.stack([d_states[a, 0], d_states[b, 1]])
            live = np.where(m, dh, 0)
            d_new = live * (1 - z) * (1 - new**2)
            d_z = live * (before - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_h = np.concatenate([d_z, d_r, d_new * r], axis=2)
            per_step[a, 0], per_step[b, 1] = np.concatenate([d_z[0], d_r[0], d_new[0]], axis=1), np.concatenate([d_z[1], d_r[1], d_new[1]], axis=1)
            d_u += np.matmul(before.transpose(0, 2, 1), d_h)
            carry = np.where(m, live * z, dh) + np.matmul(d_h, back)
        out["states"] = d_u
        order = np.argsort(local.T.ravel(), kind="stable")
        firsts = np.searchsorted(local.T.ravel()[order], np.arange(len(words)))
        for side in range(2):
            d_gates[side] = _sums(per_step[:, side].reshape(-1, 3 * h)[order], firsts)
        out["gates"] = d_gates.sum(axis=1)
        out["inputs"] = np.matmul(x.T[None], d_gates)
        d_x = np.einsum("dwg,dig->wi", d_gates, w["inputs"], optimize=True)
        out["word"] = _scattered(WORDS, v.word[words], d_x[:, :D_WORD])
        each = np.repeat(d_x[:, D_WORD:] / n_runs, n_runs[:, 0].astype(np.int64), axis=0)
        out["run"] = _scattered(RUNS, run, each)
        return loss, out

    def logits(self, v: Vocabulary, which: np.ndarray, first: np.ndarray, length: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Logits of windows of a sequence of words, each ``length`` words from ``first``."""
        out = np.empty(len(first), np.float32)
        if not len(first):
            return out
        w = self.weights
        x, _ = self.vectors(v, np.arange(len(v.word)))
        gates = np.matmul(x[None], w["inputs"]) + w["gates"][:, None]
        order = np.argsort(-length, kind="stable")
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            t = int(length[own[0]])
            mask = np.arange(t)[None, :] < length[own][:, None]
            at = np.minimum(first[own][:, None] + np.arange(t)[None, :], len(which) - 1)
            out[own] = self.forward(gates, which[at], None if mask.all() else mask)[0]
        return out


def _scattered(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(at, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1).astype(np.float32)


def fit(v: Vocabulary, tokens: np.ndarray, mask: np.ndarray, label: np.ndarray, doc: np.ndarray, epochs: int, least: int = LEAST, batch: int = 128, rate: float = RATE, decay: float = DECAY, seed: int = 1) -> Network:
    """A network trained by Adam with a falling rate on windows of labelled documents, for ``least`` steps or more.

    A document's label holds for one of its windows at least, so after a first
    part, WARM, of the epochs, in which every window counts, an epoch is made of
    the window of each document that scores most, and of as many others of clean
    documents.  Both labels weigh the same in all.
    """
    net = Network.new(seed)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(x) for k, x in net.weights.items()}
    square = {k: np.zeros_like(x) for k, x in net.weights.items()}
    length = mask.sum(axis=1)
    whole, firsts = tokens[mask], np.cumsum(length) - length  # padding is at the ends
    clean = np.flatnonzero(label == 0)
    progress, done = 0.0, 0
    n_docs = len(np.unique(doc))
    rounds = max(epochs, -(-least * batch // (2 * n_docs)))
    for r in range(rounds):
        if r < WARM * rounds:
            own = np.arange(len(label))
        else:
            logit = net.logits(v, whole, firsts, length)
            by = np.lexsort((-logit, doc))
            own = by[np.r_[True, doc[by][1:] != doc[by][:-1]]]
            own = np.union1d(own, rng.choice(clean, min(len(clean), len(own)), replace=False))
        share = np.bincount(label[own], minlength=2) / len(own)
        weight = 0.5 / np.maximum(share, 1e-9)
        # windows of like length go together, in an order of batches that changes
        own = own[np.argsort(length[own] + 16 * rng.random(len(own)), kind="stable")]
        parts = [own[i : i + batch] for i in range(0, len(own), batch)]
        for i, k in enumerate(rng.permutation(len(parts))):
            part = parts[k]
            t = int(length[part].max())
            _, g = net.gradients(v, tokens[part, :t], mask[part, :t], label[part].astype(np.float32), weight[label[part]].astype(np.float32))
            done += 1
            progress = (r + i / len(parts)) / rounds
            norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
            step = rate * min(1.0, done / 20) * 0.5 * (1 + np.cos(np.pi * progress))
            for name, x in g.items():
                x = x * np.float32(min(1.0, 5 / max(norm, 1e-12))) + decay * net.weights[name]
                mean[name] += 0.1 * (x - mean[name])
                square[name] += 0.01 * (x * x - square[name])
                net.weights[name] -= (step * (mean[name] / (1 - 0.9**done)) / (np.sqrt(square[name] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return net
