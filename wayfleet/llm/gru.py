"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a step are a word's embedding, the mean embedding of its hashed character 3- and 4-grams,
and two fixed features: how strongly the word, and the strongest of its character grams, went with
label 1 in the training texts. A text is scored as the largest score of its overlapping windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfleet.llm.common import coded, raw, words

WINDOW, STRIDE = 32, 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
BUCKETS = 1 << 15
CHUNK = 4096
#: Distinct words whose inputs are held at once.
FORMS = 10_000


def plain(distinct: pa.Array) -> pa.Array:
    return pc.utf8_trim(distinct, characters=".,;:!?\"'()[]{}<>*#$%&|-_")


def grams(forms: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3 and 4 letters: the buckets of all words' character grams in a row (with marks around a word), and their number per word."""
    data, off = raw(forms)
    n = len(forms)
    size = np.diff(off) + 2
    to = np.concatenate([[0], np.cumsum(size)])
    marked = np.full(to[-1], 2, dtype=np.uint64)
    marked[to[1:] - 1] = 3
    marked[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = data
    out = []
    for k in (3, 4):
        count = np.maximum(size - k + 1, 0)
        at = np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        h = np.full(len(at), k, dtype=np.uint64)
        for i in range(k):
            h = (h + marked[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((h >> np.uint64(49)).astype(np.int32), count))
    return out


def stretched(ufunc: np.ufunc, values: np.ndarray, count: np.ndarray, empty: float) -> np.ndarray:
    """ufunc reduced over stretches of so many values."""
    out = np.full((len(count), *values.shape[1:]), empty, dtype=values.dtype)
    if len(values):
        out[count > 0] = ufunc.reduceat(values, (np.cumsum(count) - count)[count > 0], axis=0)
    return out


def odds(hits: np.ndarray, others: np.ndarray, n_hits: int, n_others: int) -> np.ndarray:
    """Log odds of label 1 less a standard error towards 0, about -4 to 6."""
    lo = np.log((hits + 0.5) / (n_hits + 1)) - np.log((others + 0.5) / (n_others + 1))
    error = np.sqrt(1 / (hits + 0.5) + 1 / (others + 0.5))
    return (np.sign(lo) * np.maximum(0, np.abs(lo) - error)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: list[str], word_odds: np.ndarray, char_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        dims, h2 = WORD_DIM + CHAR_DIM + 2, 2 * HIDDEN
        near = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.word_odds, self.char_odds = np.append(word_odds, 0).astype(np.float32), char_odds
        block = np.kron(np.ones((1, 3)), np.kron(np.eye(2), np.ones((HIDDEN, HIDDEN)))).astype(np.float32)
        self.block = block  # gates in the order z, r, n, each forward then backward; the directions don't mix
        self.p = {
            "word": near(len(vocabulary) + 1, WORD_DIM, by=0.1), "char": near(BUCKETS, CHAR_DIM, by=0.1),
            "w": near(dims, 3 * h2, by=dims**-0.5), "b": np.zeros(3 * h2, dtype=np.float32), "u": near(h2, 3 * h2, by=HIDDEN**-0.5) * block,
            "a": near(h2, ATTEND, by=h2**-0.5), "a0": np.zeros(ATTEND, dtype=np.float32), "v": near(ATTEND, by=ATTEND**-0.5), "o": near(h2, by=h2**-0.5), "o0": np.full(1, -1, dtype=np.float32),
        }
        self.p["word"][-1] = 0

    def inputs(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """The words' input vectors, their numbers in the vocabulary, and their grams."""
        n = len(forms)
        number = np.fromiter((self.number.get(w, len(self.number)) for w in forms.to_numpy(zero_copy_only=False)), dtype=np.int64, count=n)
        own = grams(forms)
        total, count, top = np.zeros((n, CHAR_DIM), dtype=np.float32), np.zeros(n), np.zeros(n, dtype=np.float32)
        for bucket, m in own:
            total += stretched(np.add, self.p["char"][bucket], m, 0)
            top = np.maximum(top, stretched(np.maximum, self.char_odds[bucket], m, 0))
            count += m
        x = np.concatenate([self.p["word"][number], total / np.maximum(count, 1)[:, None], self.word_odds[number][:, None], top[:, None]], axis=1)
        return x.astype(np.float32), number, own

    def gates(self, forms: pa.Array) -> np.ndarray:
        """What the words add to the gates; one more row for padding."""
        out = np.zeros((len(forms) + 1, 6 * HIDDEN), dtype=np.float32)
        for at in range(0, len(forms), FORMS):
            out[at : at + FORMS][: len(forms) - at] = self.inputs(forms.slice(at, FORMS))[0] @ self.p["w"] + self.p["b"]
        return out

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows: index has each step's row of gates, the last row being padding behind the words."""
        p, (n, steps), pad = self.p, index.shape, len(gates) - 1
        h2 = 2 * HIDDEN
        z3 = np.concatenate([np.tile([True] * HIDDEN + [False] * HIDDEN, 3)])
        h = np.zeros((n, h2), dtype=np.float32)
        states = np.zeros((steps, n, h2), dtype=np.float32)
        saved = []
        for t in range(steps):
            ahead, back = index[:, t], index[:, steps - 1 - t]
            x = np.where(z3, gates[ahead], gates[back])
            live = np.repeat(np.stack([ahead != pad, back != pad], axis=1), HIDDEN, axis=1)
            g = h @ p["u"]
            zr = sigmoid(x[:, : 2 * h2] + g[:, : 2 * h2])
            z, r = zr[:, :h2], zr[:, h2:]
            c = np.tanh(x[:, 2 * h2 :] + r * g[:, 2 * h2 :])
            new = np.where(live, c + z * (h - c), h)
            if keep:
                saved.append((h, z, r, c, g[:, 2 * h2 :], live))
            h = new
            states[t, :, :HIDDEN] = h[:, :HIDDEN]
            states[steps - 1 - t, :, HIDDEN:] = h[:, HIDDEN:]
        e = np.tanh(states @ p["a"] + p["a0"])
        score = np.where((index != pad).T, e @ p["v"], -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        return pooled @ p["o"] + p["o0"][0], {"saved": saved, "states": states, "e": e, "weight": weight, "pooled": pooled} if keep else {}

    def gradients(self, index: np.ndarray, pad: int, s: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of each step's gates (steps, n, 6 HIDDEN) in reading order."""
        p, (n, steps), h2 = self.p, index.shape, 2 * HIDDEN
        d = {"o": s["pooled"].T @ dlogit, "o0": np.array([dlogit.sum()])}
        dpooled = dlogit[:, None] * p["o"]
        dstates = s["weight"][:, :, None] * dpooled
        dweight = (s["states"] * dpooled).sum(2)
        dscore = s["weight"] * (dweight - (s["weight"] * dweight).sum(0))
        d["v"] = np.einsum("tnk,tn->k", s["e"], dscore)
        de = dscore[:, :, None] * p["v"] * (1 - s["e"] ** 2)
        d["a0"] = de.sum((0, 1))
        d["a"] = np.einsum("tnh,tnk->hk", s["states"], de)
        dstates = dstates + de @ p["a"].T
        du = np.zeros_like(p["u"])
        dgates = np.zeros((steps, n, 3 * h2), dtype=np.float32)
        dh = np.zeros((n, h2), dtype=np.float32)
        ahead = np.tile([True] * HIDDEN + [False] * HIDDEN, 3)
        for t in reversed(range(steps)):
            h, z, r, c, gn, live = s["saved"][t]
            dh = dh + np.concatenate([dstates[t, :, :HIDDEN], dstates[steps - 1 - t, :, HIDDEN:]], axis=1)
            own = np.where(live, dh, 0)
            dc = own * (1 - z) * (1 - c**2)
            dz = own * (h - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=1)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dg
            dh = np.where(live, own * z, dh) + dg @ p["u"].T
            dgates[t][:, ahead] = dx[:, ahead]
            dgates[steps - 1 - t][:, ~ahead] += dx[:, ~ahead]
        d["u"] = du * self.block
        return d, dgates


def windows(starts: np.ndarray, code: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Index rows of all texts' overlapping windows, and each window's text. A text without words has none."""
    n = np.diff(starts)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = starts[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    end = starts[row + 1]
    out = np.full((len(row), WINDOW), pad, dtype=np.int32)
    for step in range(WINDOW):  # column by column, as whole tables of places would take several times the result
        inside = at < end
        out[inside, step] = code[at[inside]]
        at += 1
    return out, row


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    """Per text (lower case, no nulls) the largest probability of its windows; 0 without words."""
    flat, starts = words(texts)
    code, distinct = coded(flat)
    gates = net.gates(plain(distinct))
    index, row = windows(starts, code, len(distinct))
    out = np.zeros(len(texts))
    for at in range(0, len(index), CHUNK):
        np.maximum.at(out, row[at : at + CHUNK], sigmoid(net.run(gates, index[at : at + CHUNK])[0].astype(np.float64)))
    return out


def trained(texts: list[str], labels: np.ndarray, rounds: int = 5, batch: int = 256, rate: float = 0.05, min_texts: int = 3, min_steps: int = 40, dropped: float = 0.5) -> Network:
    """A network fitted to texts in lower case. Each round finds every text's strongest windows and takes steps on them, twice through or `min_steps`. dropped: the share of embeddings left out at random in a step, so that the fixed features are learnt as well."""
    flat, starts = words(pa.array(texts, pa.large_string()))
    code, distinct = coded(flat)
    forms = plain(distinct)
    again, forms = coded(forms)
    code = again[code]
    del flat, distinct, again
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    pair = np.unique(row * len(forms) + code)
    one = labels[pair // len(forms)] == 1
    hits, others = (np.bincount(pair[m] % len(forms), minlength=len(forms)) for m in (one, ~one))
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    common = np.flatnonzero(hits + others >= min_texts)
    word_odds = odds(hits[common], others[common], n1, n0)
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    own = grams(forms)
    text_of, form_of = pair // len(forms), pair % len(forms)
    blocks = np.searchsorted(text_of, np.arange(0, len(texts) + 50, 50))  # of 50 texts, to bound what is held at once
    for bucket, m in own:
        begin = np.cumsum(m) - m
        for lo, hi in zip(blocks[:-1], blocks[1:], strict=True):
            reps, forms_here = m[form_of[lo:hi]], form_of[lo:hi]
            at = np.repeat(begin[forms_here] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            both = np.unique(np.repeat(text_of[lo:hi] * BUCKETS, reps) + bucket[at])
            for label in (0, 1):
                seen[label] += np.bincount(both[labels[both // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
    del pair, one, both, own, row, text_of, form_of
    pa.default_memory_pool().release_unused()
    net = Network([forms[int(i)].as_py() for i in common], word_odds, odds(seen[1], seen[0], n1, n0))
    index, text = windows(starts, code, len(forms))
    rng = np.random.default_rng(11)
    squares = {k: np.full(v.shape, 1e-8, dtype=np.float32) for k, v in net.p.items()}

    def step(name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        squares[name][rows] += gradient**2
        net.p[name][rows] -= rate * gradient / np.sqrt(squares[name][rows])

    # the first round picks windows by the fixed features, later ones by the network
    strength = np.full(len(forms) + 1, -1, dtype=np.float32)
    for at in range(0, len(forms), FORMS):
        x = net.inputs(forms.slice(at, FORMS))[0]
        strength[at : at + len(x)] = np.maximum(x[:, -2], x[:, -1])
    found = np.concatenate([strength[index[at : at + CHUNK]].max(1) for at in range(0, len(index), CHUNK)])
    for _ in range(rounds):
        order = np.lexsort((found, text))
        last = np.append(text[order][1:] != text[order][:-1], True)
        best = order[last]
        negative = np.flatnonzero(labels[text] == 0)
        pick = np.concatenate([best, rng.choice(negative, min(len(best), len(negative)), replace=False)]) if len(negative) else best
        for _ in range(max(2, -(-min_steps // -(-len(pick) // batch)))):
            rng.shuffle(pick)
            for at in range(0, len(pick), batch):
                own_index, y = index[pick[at : at + batch]], labels[text[pick[at : at + batch]]].astype(np.float32)
                used, where = np.unique(own_index, return_inverse=True)
                where = where.reshape(own_index.shape)
                real = used < len(forms)
                if real.all():  # no padding in this batch
                    used = np.append(used, len(forms))
                taken = forms.take(pa.array(used[:-1]))
                x, number, gram = net.inputs(taken)
                keep = np.repeat(rng.random((len(x), 2)) >= dropped, [WORD_DIM, CHAR_DIM], axis=1) / (1 - dropped)
                x[:, : WORD_DIM + CHAR_DIM] *= keep
                gates = np.zeros((len(used), 6 * HIDDEN), dtype=np.float32)
                gates[:-1] = x @ net.p["w"] + net.p["b"]
                logit, saved = net.run(gates, where, keep=True)
                error = (sigmoid(logit) - y) / len(y)
                dense, dsteps = net.gradients(where, len(used) - 1, saved, error.astype(np.float32))
                dgates = np.zeros_like(gates)
                np.add.at(dgates, where.T.ravel(), dsteps.reshape(-1, dsteps.shape[-1]))
                dgates = dgates[:-1]
                dx = dgates @ net.p["w"].T
                dx[:, : WORD_DIM + CHAR_DIM] *= keep
                dense |= {"w": x.T @ dgates, "b": dgates.sum(0)}
                total = np.maximum(sum(m for _, m in gram), 1)
                dchar = dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / total[:, None]
                for name, g in dense.items():
                    step(name, np.asarray(g, dtype=np.float32))
                rows, at_row = np.unique(number, return_inverse=True)
                g = np.zeros((len(rows), WORD_DIM), dtype=np.float32)
                np.add.at(g, at_row, dx[:, :WORD_DIM])
                known = rows < len(net.number)
                step("word", g[known], rows[known])
                for bucket, m in gram:
                    rows, at_row = np.unique(bucket, return_inverse=True)
                    g = np.zeros((len(rows), CHAR_DIM), dtype=np.float32)
                    np.add.at(g, at_row, np.repeat(dchar, m, axis=0))
                    step("char", g, rows)
        gates = net.gates(forms)
        found = np.concatenate([net.run(gates, index[at : at + CHUNK])[0] for at in range(0, len(index), CHUNK)])
    return net
