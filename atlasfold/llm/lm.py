"""LM scoring: a causal self-attention model over subword ids, trained and run in numpy.

Words become subword ids (a public byte-level vocabulary, a blank before each
word), every text ends in an end token. The most frequent ids are classes of
their own, the rest share one and are told apart by their corpus frequency.
Classes are the leaves of a tree of three levels, ``b`` branches each, and
``b`` follows the number of ids that the corpus has.

The model attends from each id to the ids before it (a causal head with
relative positions), and the attended state makes the distribution of the next
id, level by level: the logits of a node's branches are log probabilities of
the corpus, given the last id, plus the state times the node's weights.
So each level is a softmax over ``b`` branches, their product a distribution
over ids, and the pairs of all training texts carry what is local.

Nothing is learnt from a sample. Words, ids and pairs are counted in every
training text. Weights are trained in ``ROUNDS`` rounds over the cluster: in
each, every training text gives every ``ROUNDS``-th of its windows, others in
every round, so that all windows of all training texts are seen, each once;
each task takes gradient steps from the common weights over its own, and the
next common weights are the mean of the tasks', by their windows.

Scoring cuts texts into overlapping windows: a block of ``BLOCK`` ids is
scored once, its queries masked to the ids before them in the block and the
block ahead of it. All blocks of a slice of texts go through in batches.

Texts are split into ids once: these are written to the shared folder, and counting, training and scoring read them there.

The unigram base needs each word's count in the whole training corpus. Words
that make more than a ``HEAVY``-th of all tokens (so ``HEAVY`` of them at most)
are broadcast; all others meet their counts in a shuffled join, which by the
same bound has no hot key: a rare word has a row per document at most, and
under N / HEAVY rows.

Defined results: null and wordless texts have the end token only; rows with null
ids are training rows; repeated rows and ids keep their rows; without training rows the
scores are those of a uniform model and base_score is 0; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Numbers, cut, slices, utf8

#: Widths of queries and keys, and of the state; ids of a window's own block; branches of a node at most.
KEY, WIDTH, BLOCK, MOST_BRANCHES = 8, 8, 32, 15
ROUNDS, BATCH, RATE = 3, 256, 0.02
#: Targets under one node that are scored at a time.
CHUNK = 2048
#: Weight of an id's own frequency against the pairs that begin with the last id.
SMOOTH = 5.0
HEAVY = 1_000_000
#: Pairs that a task counts at a time, and bytes of ids that it scores together (more of text are split).
PAIRS, SLICE = 1 << 22, 1 << 20
#: Bounds of weights; with them no exponential overflows.
BOUNDS = {"q": 4.0, "k": 4.0, "far": 10.0, "v": 3.0, "u0": 3.0, "u1": 3.0, "u2": 3.0}


class Subwords:
    """Ids of words by a byte-level BPE file of ranks. A bounded table numbers the words that came up and keeps what was worked out."""

    def __init__(self, path: str, heavy: dict[bytes, float] | None = None, entries: int = 300_000):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        self.size = len(ranks) + 1
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for x, i in ranks.items() if x.startswith(b" ")]] = True
        self.heavy, self.entries = heavy or {}, entries
        self._clear()

    def _clear(self) -> None:
        """An empty table: the end, then words by number, with where their ids are and what heavy says of them (nan: nothing)."""
        self.numbers = Numbers()
        self.numbers[None] = 0  # the end
        self.names: list[bytes | None] = [None]
        self.flat = np.array([self.end], self.kind)
        self.first, self.sizes, self.weight = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1)

    def _learn(self) -> None:
        """Work out the fresh words: those without odd white space in one go, parted again at the ids that open a word."""
        words = self.numbers.take_fresh()
        plain = [w.decode("utf-8", "replace") for w in words]
        joined = " ".join(plain)
        sizes = np.zeros(len(words), np.int64)
        first = np.zeros(len(words), np.int64)
        odd: list[int] = []
        if len(split := joined.split()) != len(plain) or split != plain:
            odd = [i for i, x in enumerate(plain) if x.split() != [x]]
            joined = " ".join(x for x in plain if x.split() == [x])
        rest = np.delete(np.arange(len(words)), odd)
        ids = np.array(self.encoding.encode_ordinary(f" {joined}") if len(rest) else [], self.kind)
        at = np.flatnonzero(self.opens[ids])
        first[rest], sizes[rest] = at, np.diff(np.append(at, len(ids)))
        parts, n = [self.flat, ids], len(ids)
        for i in odd:
            own = np.array(self.encoding.encode_ordinary(f" {plain[i]}"), self.kind)
            first[i], sizes[i] = n, len(own)
            n += len(own)
            parts.append(own)
        self.first = np.concatenate([self.first, first + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate(parts)
        self.weight = np.concatenate([self.weight, np.fromiter(map(self.heavy.get, words, repeat(np.nan)), float, len(words))])
        self.names += words

    def words(self, texts: list[list[bytes]]) -> np.ndarray:
        """The number of each word of the texts, 0 after each text."""
        if len(self.names) > self.entries:
            self._clear()
        n = sum(map(len, texts)) + len(texts)
        out = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(x for own in texts for x in (own, (None,)))), np.int64, n)
        if self.numbers.fresh:
            self._learn()
        return out

    def texts(self, texts: list[list[bytes]], words: np.ndarray | None = None) -> list[np.ndarray]:
        """Each text's ids, the end at last."""
        words = self.words(texts) if words is None else words
        own = self.sizes[words]
        to = np.cumsum(own)
        ids = self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.first[words] - to + own, own)]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        return np.split(ids, to[ends])[:-1]

    def rare(self, texts: list[list[bytes]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Of each text: how many of its words are heavy, the sum of their weights, and its other words and how often it has each."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        weight = self.weight[words]
        light = np.isnan(weight)
        known = np.add.reduceat(~light, starts, dtype=np.int64) - 1  # the end counts as heavy here
        base = np.add.reduceat(np.where(light, 0.0, weight), starts)
        at = np.flatnonzero(light)
        doc = np.searchsorted(starts, at, "right") - 1
        pairs, times = np.unique(doc * len(self.names) + words[at], return_counts=True)
        offsets = pa.array(np.searchsorted(pairs // len(self.names), np.arange(len(texts) + 1)).astype(np.int32))
        names = pa.array(list(map(self.names.__getitem__, (pairs % len(self.names)).tolist())), pa.binary())
        return known, base, pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


class Classes:
    """Which class an id has, and the log10 share of ids in the class of the rest."""

    def __init__(self, counts: np.ndarray, end: int):
        seen = int((counts > 0).sum())
        self.branches = min(MOST_BRANCHES, max(2, math.ceil((seen + 1) ** (1 / 3) - 1e-9)))
        self.n = self.branches**3
        top = [i for i in np.argsort(-counts, kind="stable")[: self.n - 1].tolist() if counts[i] > 0]
        rest = self.n - 1
        self.of = np.full(len(counts), rest, np.int32)
        self.of[top] = np.arange(len(top))
        self.end = int(self.of[end])
        self.within, own = np.zeros(len(counts)), self.of == rest
        self.within[own] = np.log10((counts[own] + 0.1) / (counts[own] + 0.1).sum())


class Pairs:
    """Counts of pairs of classes as they travel, sparse, and the tables that a worker makes of them once."""

    def __init__(self, classes: Classes, keys: np.ndarray, counts: np.ndarray):
        self.classes, self.keys, self.counts, self._logs = classes, keys, counts, None

    def __getstate__(self):
        return self.classes, self.keys, self.counts

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def logs(self) -> list[np.ndarray]:
        if self._logs is None:
            n = self.classes.n
            dense = np.zeros(n * n, np.float32)
            dense[self.keys] = self.counts
            self._logs = tables(dense.reshape(n, n), self.classes.branches)
            self.keys = self.counts = None
        return self._logs

    def model(self, weights: np.ndarray | None = None) -> Attention:
        out = Attention(self.classes.n, self.classes.branches, self.logs)
        if weights is not None:
            out.set_flat(weights)
        return out


def tables(counts: np.ndarray, b: int) -> list[np.ndarray]:
    """Log probabilities given the last class, of the branches of the root [last, b], of its branches' [node, last, b] and of theirs [node, last, b]; from counts [last, next]."""
    single = counts.sum(0, dtype=np.float64) + 0.5
    single = (single / single.sum()).astype(np.float32)
    n = len(counts)
    out = [np.empty((n, b), np.float32), np.empty((b, n, b), np.float32), np.empty((b * b, n, b), np.float32)]
    for at in range(0, n, 256):  # a few rows at a time, so that little is held twice
        p = counts[at : at + 256] + np.float32(SMOOTH) * single
        p /= p.sum(1, keepdims=True)
        p = p.reshape(-1, b, b, b)
        some = slice(at, at + len(p))
        above = p.sum(3)
        out[0][some] = np.log(above.sum(2))
        out[1][:, some] = np.log(above).transpose(1, 0, 2)
        out[2][:, some] = np.log(p).reshape(-1, b * b, b).transpose(1, 0, 2)
    return out


def blocks(texts: list[np.ndarray], end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets in rows of BLOCK, each text after a row of padding; which rows have text."""
    sizes = np.array([len(t) for t in texts])
    rows = -(-sizes // BLOCK) + 1
    first = (np.cumsum(rows) - rows + 1) * BLOCK
    flat_in = np.full(rows.sum() * BLOCK, pad, np.int32)
    flat_to = flat_in.copy()
    for t, at in zip(texts, first.tolist(), strict=True):
        flat_to[at : at + len(t)] = t
        flat_in[at] = end
        flat_in[at + 1 : at + len(t)] = t[:-1]
    real = np.ones(rows.sum(), bool)
    real[np.cumsum(rows) - rows] = False
    return flat_in.reshape(-1, BLOCK), flat_to.reshape(-1, BLOCK), np.flatnonzero(real)


#: Query t of a block sees keys 0 to BLOCK + t of the block before and its own; how far back each lies.
_BACK = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
_NEVER = np.float32(-1e9)


class Attention:
    """A causal head whose state shifts the logits of the next class, level by level."""

    def __init__(self, classes: int, branches: int, logs: list[np.ndarray], seed: int = 7):
        g = np.random.default_rng(seed)
        self.pad, self.b, self.logs, self._upper = classes, branches, logs, None
        #: Which columns of a node's branches, of three levels side by side, are of which level.
        self.level = np.kron(np.eye(3), np.ones(branches)).astype(np.float32)
        self._kept: dict[str, np.ndarray] = {}
        f = lambda *s: g.normal(0, 0.3, s).astype(np.float32)
        z = lambda *s: np.zeros(s, np.float32)
        b = branches
        self.p = {"q": f(classes + 1, KEY), "k": f(classes + 1, KEY), "v": f(classes + 1, WIDTH), "far": z(2 * BLOCK), "u0": z(1, WIDTH, b), "u1": z(b, WIDTH, b), "u2": z(b * b, WIDTH, b)}

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.p.values()])

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0
        for k, w in self.p.items():
            self.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    @property
    def upper(self) -> np.ndarray:
        """``logs`` of the first two levels side by side, a row for each branch of the root and last class; both are read at once."""
        if self._upper is None:
            first, second = self.logs[:2]
            self._upper = np.concatenate([np.broadcast_to(first, second.shape), second], 2).reshape(-1, 2 * self.b)
        return self._upper

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What classes give to attention: scaled queries and a one; keys and, for padding, a number that hides it, values and a one; and what places add, key by query."""
        p = self.p
        one, hides = np.ones((self.pad + 1, 1), np.float32), np.zeros((self.pad + 1, 1), np.float32)
        hides[self.pad] = _NEVER
        mask = np.where(_BACK < 0, _NEVER, p["far"][np.maximum(_BACK, 0)]).astype(np.float32)
        return np.concatenate([p["q"] * np.float32(KEY**-0.5), one], 1), np.concatenate([p["k"], hides, p["v"], one], 1), np.ascontiguousarray(mask.T)

    def _room(self, name: str, *shape: int, kind=np.float32) -> np.ndarray:
        """An array to write into, kept from call to call: fresh memory of this size costs more than the sums in it."""
        size = math.prod(shape)
        if name not in self._kept or self._kept[name].size < size:
            self._kept[name] = np.empty(size, kind)
        return self._kept[name][:size].reshape(shape)

    def _taken(self, name: str, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows of a table by number, in the room of that name."""
        return table.take(ids, 0, out=self._room(name, *ids.shape, *table.shape[1:], kind=table.dtype), mode="clip")

    def _turned(self, x: np.ndarray) -> np.ndarray:
        """Each matrix transposed and stored so: products with it on the right are some three times as fast."""
        out = self._room("turned", len(x), *x.shape[:0:-1])
        out[...] = x.transpose(0, 2, 1)
        return out

    def _by_class(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of rows, of an even number of columns, by class; in pairs, as complex numbers, which halves the places."""
        half = rows.shape[-1] // 2
        out = np.zeros((self.pad + 1, half), np.complex64)
        places = np.arange(out.size).reshape(out.shape)
        np.add.at(out.ravel(), self._taken(f"places{half}", places, ids).ravel(), rows.view(np.complex64).ravel())
        return out.view(np.float32)

    def gradients(self, keys: np.ndarray, own: np.ndarray, to: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of some blocks; keys: two blocks of inputs a row."""
        n = len(own)
        query, both, mask = self._tables()
        q, both = self._taken("q", query, own), self._taken("both", both, keys)
        k, v = both[..., : KEY + 1], both[..., KEY + 1 :]
        a = np.matmul(k, self._turned(q), out=self._room("a", n, 2 * BLOCK, BLOCK))  # attention before it is divided by its sum, key by query
        a += mask
        np.exp(a, out=a)
        o = np.matmul(a.transpose(0, 2, 1), v, out=self._room("o", n, BLOCK, WIDTH + 1))
        over = 1 / o[..., WIDTH:]
        o = np.multiply(o[..., :WIDTH], over, out=self._room("whole", n, BLOCK, WIDTH))
        d_state, out = self._tree(o.reshape(-1, WIDTH), own.ravel(), to.ravel())
        # the sum's own slope is one more column, met by the ones beside v
        do = self._room("do", n, BLOCK, WIDTH + 1)
        np.multiply(d_state.reshape(o.shape), over, out=do[..., :WIDTH])
        o *= do[..., :WIDTH]
        np.negative(o @ np.ones(WIDTH, np.float32), out=do[..., WIDTH])
        ds = np.matmul(v, self._turned(do), out=self._room("ds", *a.shape))
        ds *= a
        d = self._room("d", n, 2 * BLOCK, KEY + WIDTH)
        np.matmul(ds, q[..., :KEY], out=d[..., :KEY])
        np.matmul(a, do[..., :WIDTH], out=d[..., KEY:])
        d = self._by_class(keys, d)
        out["k"], out["v"] = d[:, :KEY], d[:, KEY:]
        d = np.matmul(ds.transpose(0, 2, 1), k[..., :KEY], out=self._room("d", n, BLOCK, KEY))
        out["q"] = self._by_class(own, d) * np.float32(KEY**-0.5)
        out["far"] = np.bincount(np.maximum(_BACK.T, 0).ravel(), np.ones(n, np.float32) @ ds.reshape(n, -1), 2 * BLOCK)
        return out

    def _nodes(self) -> np.ndarray:
        """Weights of all three levels side by side, for each node of the last."""
        p, b = self.p, self.b
        return np.concatenate([np.repeat(p["u0"], b * b, 0), np.repeat(p["u1"], b, 0), p["u2"]], 2)

    def _tree(self, state: np.ndarray, last: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients by the states (none where there is no target) and by the weights of the nodes. Targets under one node of the last level stand together."""
        b, u = self.b, self._nodes()
        node = (to // b).astype(np.int16)
        edges = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=b * b)[: b * b])])
        some = np.flatnonzero(np.diff(edges)).tolist()
        at = np.argsort(node, kind="stable")[: edges[-1]]
        node, last, to, n = node.take(at).astype(np.int64), last.take(at), to.take(at), len(at)
        edges = edges.tolist()
        parts = [slice(edges[g], edges[g + 1]) for g in some]
        own, z, each = self._taken("state", state, at), self._room("z", n, 3 * b), self._room("each", n + 1, WIDTH)
        d = np.zeros_like(u)
        tasks = list(zip([own[i] for i in parts], [z[i] for i in parts], [each[i] for i in parts], [u[g] for g in some], [d[g] for g in some], strict=True))
        for x, out, _, w, _ in tasks:
            np.dot(x, w, out)
        z[:, : 2 * b] += self._taken("logs", self.upper, node // b * self.pad + last)
        z[:, 2 * b :] += self._taken("logs", self.logs[2].reshape(-1, b), node * self.pad + last)
        np.exp(z, out=z)
        z *= np.matmul(np.float32(1 / n) / (z @ self.level.T), self.level, out=self._room("logs", n, 3 * b))
        flat, start = z.reshape(-1), np.arange(0, n * 3 * b, 3 * b)
        for pick in (to // (b * b), b + to // b % b, 2 * b + to % b):
            flat[start + pick] -= np.float32(1 / n)
        for x, own, out, w, into in tasks:
            np.dot(own, w.T, out)
            np.dot(x.T, own, into)
        each[n] = 0  # of places without a target
        where = np.full(len(state), n)
        where[at] = np.arange(n)
        mid = d[..., : 2 * b].reshape(b, b, WIDTH, 2 * b).sum(1)
        return each.take(where, 0), {"u0": mid[..., :b].sum(0, keepdims=True), "u1": mid[..., b:], "u2": d[..., 2 * b :]}

    def train(self, groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float) -> int:
        """Adam over groups of (keys, own, to); how many blocks there were."""
        flat = self.flat()
        most = np.concatenate([np.full(w.size, BOUNDS[k], np.float32) for k, w in self.p.items()])
        ends = np.cumsum([w.size for w in self.p.values()])[:-1]
        self.p = {k: x.reshape(w.shape) for (k, w), x in zip(self.p.items(), np.split(flat, ends), strict=True)}  # views of flat
        m, s, d, size = (np.zeros_like(flat) for _ in range(4))
        parts = dict(zip(self.p, np.split(d, ends), strict=True))
        seen = 0
        for step, group in enumerate(groups, 1):
            seen += len(group[0])
            for k, x in self.gradients(*group).items():
                parts[k].reshape(x.shape)[...] = x
            d *= np.float32(0.1)
            m *= np.float32(0.9)
            m += d
            d *= d
            s *= np.float32(0.99)
            s += d
            np.sqrt(s, out=size)
            size *= np.float32((1 - 0.99**step) ** -0.5)
            size += np.float32(1e-8)
            np.divide(m, size, out=size)
            size *= np.float32(rate / (1 - 0.9**step))
            flat -= size
            np.minimum(flat, most, out=flat)
            np.maximum(flat, -most, out=flat)
        return seen

    def states(self, x: np.ndarray) -> np.ndarray:
        """The state at each place of all rows of blocks but the first."""
        query, table, mask = self._tables()
        out = np.empty((len(x) - 1, BLOCK, WIDTH), np.float32)
        for at in range(0, len(out), 64):
            q, both = self._taken("q", query, x[at + 1 : at + 65]), self._taken("both", table, x[at : at + 65])
            # two blocks a row, so most stand in two rows
            both = np.lib.stride_tricks.as_strided(both, (len(q), 2 * BLOCK, both.shape[2]), both.strides, writeable=False)
            s = np.matmul(both[..., : KEY + 1], self._turned(q), out=self._room("a", len(q), 2 * BLOCK, BLOCK))
            s += mask
            np.exp(s, out=s)
            o = np.matmul(s.transpose(0, 2, 1), both[..., KEY + 1 :], out=self._room("o", len(q), BLOCK, WIDTH + 1))
            np.divide(o[..., :WIDTH], o[..., WIDTH:], out=out[at : at + len(q)])
        return out.reshape(-1, WIDTH)

    def scores(self, texts: list[np.ndarray], end: int) -> np.ndarray:
        """Sum of log10 p over each text's classes: every one is scored once, those under one node together."""
        x, y, _ = blocks(texts, end, self.pad)
        b = self.b
        state, last, to = self.states(x), x[1:].ravel(), y[1:].ravel()
        node = (to // b).astype(np.int16)
        edges = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=b * b)[: b * b])])
        has = np.argsort(node, kind="stable")[: edges[-1]]
        state, last, to = state.take(has, 0), last.take(has), to.take(has)
        starts, level = np.arange(0, CHUNK * 3 * b, 3 * b), np.ascontiguousarray(self.level.T)
        out, nodes = np.empty(len(has), np.float32), self._nodes()
        for g in range(b * b):
            top, mid = g // b, g % b
            upper, lower = self.upper[top * self.pad : (top + 1) * self.pad], self.logs[2][g]
            for i in range(edges[g], edges[g + 1], CHUNK):
                j = min(edges[g + 1], i + CHUNK)
                own = last[i:j]
                z = np.matmul(state[i:j], nodes[g], out=self._room("z", j - i, 3 * b))
                z[:, : 2 * b] += self._taken("logs", upper, own)
                z[:, 2 * b :] += self._taken("logs", lower, own)
                pick = z[:, top] + z[:, b + mid] + z.reshape(-1).take(starts[: j - i] + (to[i:j] - (g - 2) * b))
                total = np.log(np.exp(z, out=z) @ level)
                out[i:j] = pick - total[:, 0] - total[:, 1] - total[:, 2]
        each = np.zeros(x.size)
        each[has + BLOCK] = out
        whole = each.reshape(-1, BLOCK).sum(1) / math.log(10)
        rows = -(-np.array([len(t) for t in texts]) // BLOCK) + 1
        return np.add.reduceat(whole, np.cumsum(rows) - rows)


def _words(part: pa.RecordBatch) -> list[list[bytes]]:
    return [t.translate(LOWER).split() for t in utf8(part, "_text")]


def _ids(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows, and each row's ids from column ids."""
    for batch in batches:
        for part in slices(batch, "ids", SLICE):
            yield part, [np.frombuffer(x, kind) for x in part.column("ids").to_pylist()]


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``train`` (column _text), added up before the shuffle in bounded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            held.clear()
            yield from table.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                # Arrow's white space is that of bytes.split; at a text's ends it leaves empty words
                words = pc.ascii_split_whitespace(pc.ascii_lower(part.column("_text"))).flatten().cast(pa.binary())
                found = pc.value_counts(words.filter(pc.greater(pc.binary_length(words), 0)))
                held.append(pa.table([found.field("values"), found.field("counts")], ["word", "c"]))
                if sum(map(len, held)) > 1_000_000:
                    yield from flush()
        if held:
            yield from flush()

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of rows (key, n); keys are ids or pairs of classes, so their number is bounded whatever the corpus."""
    table = found.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return table.column("key").to_numpy(), table.column("n").to_numpy()


def id_counts(coded: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """How often each id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, texts in _ids(batches, kind):
            total += np.bincount(np.concatenate(texts), minlength=size)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(total[keys])], ["key", "n"])

    keys, n = _summed(coded.mapInArrow(run, "key int, n long"))
    out = np.zeros(size, np.int64)
    out[keys] = n
    return out


def pair_counts(coded: DataFrame, classes: Classes, kind: np.dtype) -> Pairs:
    """Counts of (last, next) classes over all texts; before a text's first id stands its end."""
    sent, n = coded.sparkSession.sparkContext.broadcast(classes), classes.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        total = np.zeros(n * n, np.int32)  # a task has under 2^31 ids
        held, size = [], 0

        def count():
            keys = np.sort(np.concatenate(held))
            held.clear()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total[keys[first]] += np.diff(np.append(first, len(keys))).astype(np.int32)

        for _, texts in _ids(batches, kind):
            x = classes.of[np.concatenate(texts)]
            before = np.concatenate([[classes.end], x[:-1]])
            before[np.cumsum([len(t) for t in texts])[:-1]] = classes.end
            held.append(before.astype(np.int32) * np.int32(n) + x)
            size += len(x)
            if size > PAIRS:
                count()
                size = 0
        if held:
            count()
        keys = np.flatnonzero(total)
        for at in range(0, len(keys), 500_000):
            some = keys[at : at + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["key", "n"])

    keys, times = _summed(coded.mapInArrow(run, "key int, n long"))
    return Pairs(classes, keys, times.astype(np.float32))


def windows(ids: np.ndarray, end: int, share: int = ROUNDS) -> list[tuple[int, bytes]]:
    """The windows that a text gives to each round: every ``share``-th block, from a place that its ids give, with the inputs ahead.

    A window is the block's ids after the id before them, and before that the block ahead of it; the first block has none.
    """
    whole = np.concatenate([np.array([end], ids.dtype), ids])
    start = zlib.crc32(ids.tobytes())
    out = []
    for which in range(ROUNDS):
        for j in range((which - start) % share, -(-len(ids) // BLOCK), share):
            out.append((which, whole[max(0, j - 1) * BLOCK : (j + 1) * BLOCK + 1].tobytes()))
    return out


def unpacked(found: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of classes as inputs of two blocks, those of the block itself, and its targets."""
    x = np.full((len(found), 2 * BLOCK + 1), pad, np.int32)
    ends = np.empty(len(found), np.int64)
    for i, w in enumerate(found):
        at = BLOCK if len(w) <= BLOCK + 1 else 0  # a first block has nothing ahead
        x[i, at : at + len(w)] = w
        ends[i] = at + len(w) - 1
    to = x[:, BLOCK + 1 :].copy()
    keys = x[:, : 2 * BLOCK]
    inside = ends < 2 * BLOCK
    keys[np.flatnonzero(inside), ends[inside]] = pad  # a text's last id is no input
    return keys, keys[:, BLOCK:], to


def in_round(texts: list[np.ndarray], ids: list[np.ndarray], end: int, pad: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``unpacked`` gives of the windows of a round, of some texts at once. ``texts``: classes; ``ids``: what ``windows`` starts by."""
    x, y, real = blocks(texts, end, pad)
    sizes = np.array([-(-len(t) // BLOCK) for t in texts])
    number = np.arange(len(real)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat([zlib.crc32(t.tobytes()) for t in ids], sizes)
    some = real[number % ROUNDS == which]
    return np.concatenate([x[some - 1], x[some]], 1), x[some], y[some]


def train(given: DataFrame, pairs, kind: np.dtype, batch_size: int = BATCH) -> np.ndarray:
    """The weights after ROUNDS of steps; see the module. ``given``: the ids of every text, or (rounds, windows) cut from them; ``pairs``: a broadcast."""
    spark = given.sparkSession
    c = pairs.value.classes
    weights, by_ids = Attention(c.n, c.branches, []).flat(), "ids" in given.columns
    for which in range(ROUNDS):
        sent, rate = spark.sparkContext.broadcast(weights), RATE * 0.5**which

        def run(batches: Iterator[pa.RecordBatch], sent=sent, which=which, rate=rate) -> Iterator[pa.RecordBatch]:
            classes, model = pairs.value.classes, pairs.value.model(sent.value)

            def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                if by_ids:
                    for _, ids in _ids(batches, kind):
                        yield in_round([classes.of[t] for t in ids], ids, classes.end, model.pad, which)
                    return
                for batch in batches:
                    own = batch.column("windows").flatten().filter(pc.equal(batch.column("rounds").flatten(), which))
                    yield unpacked([classes.of[np.frombuffer(w, kind)] for w in own.to_pylist()], model.pad)

            def groups():
                held, n = [], 0
                for part in found():
                    held.append(part)
                    n += len(part[0])
                    if n >= 16 * batch_size:
                        yield from parts(held)
                        held, n = [], 0
                if n:
                    yield from parts(held)

            def parts(held):
                keys, own, to = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.random.default_rng(len(own)).permutation(len(own))
                for at in range(0, len(own), batch_size):
                    some = order[at : at + batch_size]
                    yield keys[some], own[some], to[some]

            n = model.train(groups(), rate)
            if n:
                yield row(n, model.flat().astype(np.float64) * n)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for batch in batches:
                for a, w in zip(batch.column("n").to_pylist(), batch.column("w"), strict=True):
                    n, total = n + a, total + np.frombuffer(w.as_buffer(), np.float64)
            if n:
                yield row(n, total)

        def row(n: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "w"])

        schema = "n long, w binary"
        found = given.mapInArrow(run, schema)
        # tasks' weights are added up in about as many tasks as each of those then has rows
        few = max(1, math.isqrt(found.rdd.getNumPartitions()))
        n, total = 0, 0.0
        for r in found.repartition(few).mapInArrow(add, schema).toLocalIterator():
            n, total = n + r.n, total + np.frombuffer(r.w, np.float64)
        if n:
            weights = (total / n).astype(np.float32)
    return weights


def score(docs: DataFrame, held_out, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held_out``: a boolean column expression; rows of which it is false are learnt from.
    ``path``: a file of byte-level BPE ranks on every node.
    """
    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("_id"), held_out.alias("_held"), F.col(text_col).alias("_text"))
    learnt = cols.where(~F.col("_held"))
    counts = cut(word_counts(learnt.select("_text")), "words")
    ends = learnt.count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total.n or 0) + ends, total.v + (ends > 0)
    common = spark.sparkContext.broadcast({bytes(r.word): math.log10(r.c + 0.1) for r in counts.where(F.col("c") * HEAVY > n).toLocalIterator()})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path, common.value)
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                texts = _words(part)
                words = subwords.words(texts)
                ids = subwords.texts(texts, words)
                known, base, rare, times = subwords.rare(texts, words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_held"), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(known), pa.array(base), rare, times, pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["_id", "_held", "n", "known", "base", "rare", "times", "ids"],
                )

    coded = cols.mapInArrow(code, f"_id {id_kind}, _held boolean, n long, known long, base double, rare array<binary>, times array<int>, ids binary")
    # the number of a row is written with it
    coded = cut(coded.withColumn("_row", F.monotonically_increasing_id()), "coded")
    subwords = Subwords(path)
    kind, learnt = subwords.kind, coded.where(~F.col("_held"))
    own = learnt.select("ids")
    classes = Classes(id_counts(own, subwords.size, kind), subwords.end)
    pairs = spark.sparkContext.broadcast(pair_counts(own, classes, kind))
    sent = spark.sparkContext.broadcast(train(own, pairs, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model = pairs.value.classes, pairs.value.model(sent.value)
        for part, ids in _ids(batches, kind):
            found = model.scores([classes.of[t] for t in ids], classes.end) + np.array([classes.within[t].sum() for t in ids])
            keep = [c for c in part.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found)], [*keep, "score"])

    rest = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    found = coded.select("_row", "_id", "_held", "n", "known", "base", rest.alias("_rest"), "ids")
    found = found.mapInArrow(run, f"_row long, _id {id_kind}, _held boolean, n long, known long, base double, _rest long, score double")
    # rare words meet their counts; one that training lacks has c = 0, so log10(0.1)
    each = coded.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("word"), F.col("x.times").alias("m"))
    light = counts.where(F.col("c") * HEAVY <= n)
    met = each.join(light, "word").groupBy("_row").agg(F.sum("m").cast("long").alias("_k"), F.sum(F.col("m") * (F.log10(F.col("c") + 0.1) + 1)).alias("_b"))
    whole = found.join(met, "_row", "left")
    base = F.col("base") + math.log10(ends + 0.1) - F.col("_rest") + F.coalesce("_b", F.lit(0.0)) - F.col("n") * F.lit(math.log10(n + 0.1 * (v + 1)))
    return whole.select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("_k", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
