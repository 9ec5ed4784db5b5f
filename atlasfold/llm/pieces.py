"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Text becomes characters after one leading blank; an agenda of adjacent pairs
that are pieces is worked off best first, left to right among equals. With
dropout, a candidate that comes up is skipped if a hash keyed by the seed and
the candidate falls under the rate; merges that stay open are found again
from the pairs that later merges make. Characters without a piece become byte
pieces, and so does the mark that stands for a blank when a text holds it
literally; hence every segmentation decodes to the very text.

No piece crosses from a non-blank to a blank or a line end, so texts are cut
there. Every occurrence of a chunk draws for itself: its key is a hash of
seed, text and position, and each candidate is skipped or not by a hash of
that key and the candidate. What comes out depends on the chunk and on which
of its candidates are skipped, so occurrences of a slice that agree in both
are worked once. Equal texts are segmented equally, and results don't depend
on partitions.

Defined results: null and empty texts have no pieces and decode to the empty
text; repeated rows and ids keep their rows; empty tables give none; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, slices

MARK = "▁"
RATE, SEED = 0.1, 0
#: Characters of a chunk that arrays handle; longer ones have an agenda of their own.
WIDE = 64
#: Candidates of a chunk whose draws fit one word; occurrences of chunks with more are worked one by one.
MASK = 64
NONE = np.iinfo(np.int32).max
_M64 = (1 << 64) - 1


class Codec:
    """One SentencePiece BPE model file."""

    def __init__(self, path: str, seed: int = SEED, rate: float = RATE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.rank[piece.replace(MARK, " ")] = (-model.get_score(i), i)
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces, so texts might not decode")
        # characters that no piece has right after a letter or digit: texts are cut before them too
        follow = {b for p in self.rank for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
        cuts = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in follow and c != "_")
        word = rf" *[^\W_]+(?=[{re.escape(cuts)}])|" if cuts else ""
        self.chunk = re.compile(rf"{word} *[^ \n]+| +|\n")
        self.seed, self.limit = seed, int(rate * (1 << 32))
        #: Keys that an occurrence may have.
        self.variants = (1 << 63) - 1 if rate else 1
        self.longest = max(map(len, self.rank))
        self.spots: dict[str, list[int] | None] = {}
        # the same pieces as arrays: their order, and the pairs of pieces that make one
        ranks = {x: k for k, x in enumerate(sorted({r for r, _ in self.rank.values()}))}
        self.n = n
        self.size_of = np.zeros(n, np.uint64)
        for p, (_, i) in self.rank.items():
            self.size_of[i] = len(p)
        pairs = sorted((self.rank[p[:k]][1] * n + self.rank[p[k:]][1], ranks[r], i) for p, (r, i) in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank)
        self.pair_keys, self.pair_rank, self.pair_id = (np.array([x[j] for x in pairs], d) for j, d in ((0, np.int64), (1, np.int32), (2, np.int32)))
        # where each pair is: a sparse table by a hash of the pair, the next free slot if one is taken
        self.shift = np.uint64(64 - max(4, (8 * len(pairs)).bit_length()))
        self.slots = np.full((1 << 64 - int(self.shift)) + 64, -1, np.int32)
        left = np.arange(len(pairs), dtype=np.int32)
        at = self._slot(self.pair_keys)
        self.probes = 0
        while len(left):
            free = self.slots[at[left] + self.probes] < 0
            slot, first = np.unique(at[left[free]] + self.probes, return_index=True)
            self.slots[slot] = left[free][first]
            left = left[self.slots[at[left] + self.probes] != left]
            self.probes += 1
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, (_, i) in self.rank.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i

    def _keys(self, variants: np.ndarray) -> np.ndarray:
        """The keys of occurrences' draws: well mixed, the seed in them."""
        x = variants.astype(np.uint64) ^ np.uint64(xxhash.xxh64_intdigest(b"draws", self.seed & _M64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _skips(self, keys: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Whether candidates (place << 20 plus size) are skipped under keys."""
        h = (keys + spots) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(32) < np.uint64(self.limit)

    def _candidates(self, chunk: str) -> list[int] | None:
        """Every candidate that may come up in a chunk; None if there are over MASK or it is too long for arrays."""
        n, rank = len(chunk), self.rank
        if n > WIDE:
            return None
        out = [(i << 20) + m for m in range(2, min(n, self.longest) + 1) for i in range(n - m + 1) if chunk[i : i + m] in rank]
        return out if len(out) <= MASK else None

    def _spots(self, chunk: str) -> list[int] | None:
        """The candidates, from a bounded table."""
        found = self.spots.get(chunk, 0)
        if found == 0:
            if len(self.spots) > 200_000:
                self.spots.clear()
            found = self.spots[chunk] = self._candidates(chunk)
        return found

    def _masks(self, names: list[str], which: np.ndarray, variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences of chunks: which candidates are skipped, as bits, and whether those are all there is to know."""
        # a chunk that occurs once shares nothing
        often = (np.bincount(which, minlength=len(names)) > 1).tolist()
        spots = [self._spots(c) if x else None for c, x in zip(names, often, strict=True)]
        sizes = np.array([-1 if x is None else len(x) for x in spots], np.int64)
        first = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        flat = np.array([y for x in spots if x for y in x] or [0], np.uint64)
        keys, own, at = self._keys(variants), sizes[which], first[which]
        masks = np.zeros(len(which), np.uint64)
        left = np.flatnonzero(own > 0)
        for k in range(MASK):
            left = left[own[left] > k]
            if not len(left):
                break
            skipped = self._skips(keys[left], flat[at[left] + k])
            masks[left[skipped]] |= np.uint64(1 << k)
        return masks, own >= 0

    def segment(self, chunk: str, variant: int) -> tuple[int, ...]:
        """The ids of one chunk."""
        rank, limit = self.rank, self.limit
        if not limit and chunk in rank and len(chunk) == 1:
            return (rank[chunk][1],)
        syms: list[str] = list(chunk)
        n = len(syms)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = [(r[0], i, syms[i] + syms[i + 1]) for i in range(n - 1) if (r := rank.get(syms[i] + syms[i + 1]))]
        heapify(agenda)
        key = int(self._keys(np.array([variant], np.uint64))[0]) if limit else 0
        while agenda:
            _, i, joined = heappop(agenda)
            left = syms[i]
            if not left:
                continue
            j = after[i]
            if j >= n or left + syms[j] != joined:
                continue
            if limit:
                h = (key + (i << 20) + len(joined)) * 0x9E3779B97F4A7C15 & _M64
                h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & _M64
                if h >> 32 < limit:
                    continue
            syms[i] = joined
            syms[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get(both := joined + syms[k]):
                    heappush(agenda, (r[0], i, both))
            if (b := before[i]) >= 0 and (r := rank.get(both := syms[b] + joined)):
                heappush(agenda, (r[0], b, both))
        out: list[int] = []
        for s in syms:
            if s:
                if r := rank.get(s):
                    out.append(r[1])
                else:
                    out.extend(self.byte_ids[x] for x in s.encode())
        return tuple(out)

    def segment_many(self, chunks: list[str], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many chunks, one after another, and how many each has: the same agendas, all rows a step at a time."""
        n = len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        parts: list[np.ndarray | None] = [None] * n
        counts = np.zeros(n, np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char_id[points]
        ends = np.cumsum(sizes)
        unknown = np.concatenate([[0], np.cumsum(symbols < 0)])
        odd = (unknown[ends] - unknown[ends - sizes] > 0) | (sizes > WIDE)
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(self.segment(chunks[i], int(variants[i])), np.int32)
            counts[i] = len(parts[i])
        flat, at = [], []
        low = 0
        for high in (4, 8, 12, 20, 36, WIDE):
            own = np.flatnonzero(~odd & (sizes > low) & (sizes <= high))
            low = high
            for k in range(0, len(own), 40_000):
                some = own[k : k + 40_000]
                grid = self._agendas(chunks, some, sizes[some], symbols, (ends - sizes)[some], variants)
                kept = grid >= 0
                counts[some] = kept.sum(1)
                flat.append(grid[kept])
                at.append(some)
        # back into the order of the chunks
        total = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(total[-1], np.int32)
        for ids, some in zip(flat, at, strict=True):
            c = counts[some]
            first = np.cumsum(c) - c
            out[np.arange(len(ids)) + np.repeat(total[some] - first, c)] = ids
        for i in np.flatnonzero(odd).tolist():
            out[total[i] : total[i + 1]] = parts[i]
        return out, counts

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one; equal scores have equal ranks) and id of the piece that two symbols make."""
        want = a.astype(np.int64) * self.n + b
        want[(a < 0) | (b < 0)] = -1
        flat = want.ravel()
        slot = self._slot(flat)
        found = self.slots[slot]
        right = self.pair_keys[found] == flat
        far = np.flatnonzero((found >= 0) & ~right)
        for k in range(1, self.probes):
            if not len(far):
                break
            near = self.slots[slot[far] + k]
            found[far] = near
            right[far] = self.pair_keys[near] == flat[far]
            far = far[(near >= 0) & ~right[far]]
        return np.where(right, self.pair_rank[found], NONE).reshape(want.shape), self.pair_id[found].reshape(want.shape)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _agendas(self, chunks, some, sizes, symbols, starts, variants) -> np.ndarray:
        """Symbols of each row when its agenda is done; -1 where there is none."""
        rows, width = len(some), int(sizes.max())
        place = np.arange(width)
        inside = place < sizes[:, None]
        sym = np.full((rows, width + 1), -1, np.int32)
        sym[:, :width][inside] = symbols[(starts[:, None] + place)[inside]]
        after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (rows, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
        order = np.full((rows, width + 1), NONE, np.int32)
        makes = np.zeros((rows, width + 1), np.int32)
        order[:, :width], makes[:, :width] = self._lookup(sym[:, :width], sym[:, 1:])
        if self.limit:
            keys = self._keys(variants[some])
        live = np.arange(rows)
        while len(live):
            i = order[live].argmin(1)
            open_ = order[live, i] < NONE
            live, i = live[open_], i[open_]
            r, made = live, makes[live, i]
            if self.limit:
                skip = self._skips(keys[r], (i.astype(np.uint64) << np.uint64(20)) + self.size_of[made])
                order[r[skip], i[skip]] = NONE
                go = ~skip
                r, i, made = r[go], i[go], made[go]
            j = after[r, i]
            k = after[r, j]
            sym[r, i] = made
            sym[r, j] = -1
            after[r, i] = k
            before[r, k] = i
            order[r, j] = NONE
            order[r, i], makes[r, i] = self._lookup(made, sym[r, k])
            b = before[r, i]
            has = b >= 0
            r, b = r[has], b[has]
            order[r, b], makes[r, b] = self._lookup(sym[r, b], made[has])
        return sym[:, :width]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts, one after another, and how many each has. Every distinct chunk and set of skipped candidates is worked once."""
        chunks: list[str] = []
        sizes = []
        salts = np.zeros(len(texts), np.uint64)
        for t, text in enumerate(texts):
            found = self.chunk.findall(f" {text}") if text else []
            chunks += found
            sizes.append(len(found))
            if self.variants > 1:
                salts[t] = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)
        sizes = np.asarray(sizes, np.int64)
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        number = Numbers()
        which = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes) - sizes
        names = number.fresh
        if self.variants > 1:
            at = (np.arange(len(chunks)) - np.repeat(starts, sizes)).astype(np.uint64)
            variants = np.repeat(salts, sizes) + at * np.uint64(0x9E3779B97F4A7C15)
            masks, known = self._masks(names, which, variants)
            # occurrences with too many candidates are told apart by their keys
            marks = np.where(known, masks, variants)
            order = np.lexsort((marks, which))
            new = np.concatenate([[True], (which[order][1:] != which[order][:-1]) | (marks[order][1:] != marks[order][:-1])])
            firsts = order[new]
            index = np.empty(len(which), np.int64)
            index[order] = np.cumsum(new) - 1
            ids, counts = self.segment_many([chunks[i] for i in firsts.tolist()], variants[firsts])
        else:
            index = which
            ids, counts = self.segment_many(names, np.zeros(len(names), np.uint64))
        first = np.cumsum(counts) - counts
        own = counts[index]
        to = np.cumsum(own)
        out = ids[np.arange(to[-1]) + np.repeat(first[index] - to + own, own)]
        edges = np.concatenate([[0], to])
        return out, edges[starts + sizes] - edges[starts]

    def encode(self, text: str) -> np.ndarray:
        """The text's ids."""
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of any segmentation."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode()[1:]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: float = RATE) -> DataFrame:
    """``id_col``, ids (array of int) and intact (whether they decode to the text) of every row; ``path``: a model file on every node."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, seed, rate)
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [x or "" for x in part.column("_text").to_pylist()]
                found, sizes = codec.encode_many(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                intact = [codec.decode(found[a:b].tolist()) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([part.column("_id"), ids, pa.array(intact, pa.bool_())], ["_id", "ids", "intact"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>, intact boolean")
    return out.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text of every row of ids; null ids are an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([codec.decode(x or ()) for x in part.column("_ids").to_pylist()], pa.string())], ["_id", "text"])

    out = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {kind}, text string")
    return out.withColumnRenamed("_id", id_col)
