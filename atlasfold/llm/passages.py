"""Substring dedup: repeated paragraphs and passages across documents, by MinHash banding.

Two kinds of paragraph are taken from every text. Lines of at least
``MIN_LINE`` words are the natural ones. Windows of ``MIN_RUN`` words are the
others, so that a passage pasted into the middle of a line is found to its
very ends wherever it stands. Not all windows are sent: the least ``GRAM``-word
hash of every window is (the later of equals), and equal windows have equal
ones. Where such a hash occurs in several documents, windows that hold it are
spelt out and meet on a 64-bit hash of their own: all of them at the ends of a
row of shared hashes, one for each hash within the row. Neighbouring hashes lie
at most MIN_RUN - GRAM + 1 words apart, so these windows overlap and cover the
row. Every word that goes thus lies in a window that another document has, and
repeats go to their ends, except where two repeats with different partners touch.

Lines also get a MinHash signature over five-word shingles, with bands tuned to
a recall at the similarity; lines that collide in a band are verified by exact
Jaccard, and verified links are clustered by components.

In a band's bucket every line is verified against the commonest one first,
which joins most near copies for a row each. Buckets that still span several
components are cut into blocks of bounded size, and pairs of blocks go to
tasks that compare across components in memory: an upper bound on the
similarity from bit maps discards nearly all, the rest are verified exactly,
and only links that join two components come out. So no link of a bucket is
lost and no bucket's pairs are listed.

Of every cluster that spans documents, the occurrences in the smallest doc id
stay and the others go: every paragraph has at least ``MIN_RUN`` words. A row
is known by its id and a hash of its text, so rows that share an id lose each
its own ranges.

Defined results: null, empty and wordless texts have no paragraph; repeats
within one document only are left alone; rows with equal ids count as one
document, whatever their texts; rows with a null id never lose text and never make others
lose it; empty tables give no rows; other columns are carried along or
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, remove_cuts, slices, unused, utf8
from .components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.98
MIN_LINE, MIN_RUN = 15, 15
#: Words of the hashes that stand for a window; each window has MIN_RUN - GRAM + 1 of them.
GRAM = 8
#: Lines of a block, and 64-bit words of the bit map that bounds their similarity.
BLOCK, MAP_WORDS = 2048, 8
#: Shingles of a block.
BLOCK_SHINGLES = 1 << 18
#: Bytes of text whose lines are taken at a time, and hashes of lines that a task remembers.
LINES_BYTES, SEEN = 1 << 20, 250_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd multipliers of the polynomial hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 48) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall at the similarity with ``most`` hashes."""
    for rows in range(most, 0, -1):
        n = next((b for b in range(1, most // rows + 1) if 1 - (1 - similarity**rows) ** b >= recall), None)
        if n:
            return n, rows
    raise ValueError("no banding reaches this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash for each run of n word hashes; of fewer, one for all of them."""
    n = min(n, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(BASE) + words[j : len(words) - n + 1 + j]
    return _mix(out)


class Sliced:
    """Words of several texts in one row of hashes, and where lines lie in it."""

    def __init__(self, texts: list[bytes]):
        flat: list[bytes] = []
        starts, line_at, line_to = [], [], []
        for t in texts:
            starts.append(len(flat))
            for line in t.translate(LOWER).split(b"\n"):
                own = line.split()
                if len(own) >= MIN_LINE:
                    line_at.append(len(flat))
                    line_to.append(len(flat) + len(own))
                flat += own
        self.starts = np.asarray([*starts, len(flat)], np.int64)
        self.words = word_hashes(flat)
        self.lines = np.asarray([line_at, line_to], np.int64)

    def grams(self) -> np.ndarray:
        """(2, n): ranges of the GRAM-word runs that stand for windows, the least hash of each (the later of equals)."""
        n, k = len(self.words), MIN_RUN - GRAM + 1
        if n < MIN_RUN:
            return np.zeros((2, 0), np.int64)
        at = np.arange(n - GRAM + 1)
        h = self.hashes(np.stack([at, at + GRAM]), 2)
        few = len(h) - k + 1
        best, place = h[:few].copy(), at[:few].copy()
        for j in range(1, k):
            less = h[j : j + few] <= best
            best = np.where(less, h[j : j + few], best)
            place = np.where(less, at[j : j + few], place)
        starts = np.arange(few)
        chosen = np.unique(place[self.owner(starts) == self.owner(starts + MIN_RUN - 1)])
        return np.stack([chosen, chosen + GRAM])

    def windows(self, shared: np.ndarray) -> np.ndarray:
        """(2, n): ranges of windows around shared grams, given by where they start: all that hold the first or last gram of a row of shared ones, else the one that starts with the gram."""
        every = self.grams()[0]
        own = self.owner(every)
        has = np.isin(every, shared)
        # a gram's neighbours in its text, shared too
        beside = np.zeros((2, len(every)), bool)
        beside[0, 1:] = has[:-1] & (own[1:] == own[:-1])
        beside[1, :-1] = has[1:] & (own[1:] == own[:-1])
        inner = has & beside[0] & beside[1]
        ends = every[has & ~inner]
        lo = self.starts[self.owner(ends)]
        hi = self.starts[self.owner(ends) + 1] - MIN_RUN
        first, last = np.maximum(ends - (MIN_RUN - GRAM), lo), np.minimum(ends, hi)
        mark = np.zeros(len(self.words) + 1, np.int64)
        real = first <= last
        np.add.at(mark, first[real], 1)
        np.add.at(mark, last[real] + 1, -1)
        within = every[inner]
        within = within[within + MIN_RUN <= self.starts[self.owner(within) + 1]]
        at = np.union1d(np.flatnonzero(np.cumsum(mark) > 0), within)
        return np.stack([at, at + MIN_RUN])

    def hashes(self, spans: np.ndarray, kind: int) -> np.ndarray:
        """A 64-bit hash of each span's words, told apart by kind and length."""
        n = len(self.words)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.words * _powers(BASE, n))]) if n else np.zeros(1, np.uint64)
        inverse = _powers(INVERSE, n + 1)
        value = (prefix[spans[1]] - prefix[spans[0]]) * inverse[spans[0]]
        return _mix(value ^ _mix((spans[1] - spans[0]).astype(np.uint64) * np.uint64(2) + np.uint64(kind)))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def signatures(self, some: np.ndarray, n: int) -> np.ndarray:
        """MinHash of the given lines, (lines, n)."""
        at, to = self.lines[:, some]
        sizes = to - at - SHINGLE + 1
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        index = np.arange(sizes.sum()) - np.repeat(first - at, sizes)
        s = shingle_hashes(self.words)[index]
        out = np.empty((len(at), n), np.uint64)
        for k in range(n):
            out[:, k] = np.minimum.reduceat(s * np.uint64(2 * k * BASE % (1 << 64) | 1) ^ _mix(np.full(1, k + 1, np.uint64)), first)
        return out

    def band_keys(self, some: np.ndarray, n: int, rows: int) -> np.ndarray:
        """The n band keys of each of the given lines, one after another."""
        if not len(some):
            return np.zeros(0, np.uint64)
        sig = self.signatures(some, n * rows).reshape(len(some), n, rows)
        key = np.zeros((len(some), n), np.uint64) + _mix(np.arange(1, n + 1, dtype=np.uint64))
        for r in range(rows):
            key = _mix(key * np.uint64(BASE) + sig[:, :, r])
        return key.ravel()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text) of the rows with an id; t tells apart texts of one id."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.hash(F.col(text_col)).alias("t"), F.col(text_col).alias("_text"))


def _spans(part: pa.RecordBatch, s: Sliced, spans: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The text of each span, and columns id, t, at, to."""
    doc = s.owner(spans[0])
    take, base = pa.array(doc), s.starts[doc]
    return doc, [part.column("id").take(take), part.column("t").take(take), pa.array((spans[0] - base).astype(np.int32)), pa.array((spans[1] - base).astype(np.int32))]


def lines(docs: DataFrame, id_col: str, text_col: str, bands_rows: tuple[int, int]) -> DataFrame:
    """(id, t, at, to, h, keys): each line's range of words, hash and band keys; no keys for lines that a task has just seen."""
    kind = docs.schema[id_col].dataType.simpleString()
    n, rows = bands_rows

    def one(part: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch | None:
        s = Sliced(utf8(part, "_text"))
        count = s.lines.shape[1]
        if not count:
            return None
        h = s.hashes(s.lines, 1)
        fresh = [i for i in np.unique(h, return_index=True)[1].tolist() if int(h[i]) not in seen]
        if len(seen) > SEEN:
            seen.clear()
        seen.update(h[fresh].tolist())
        fresh = np.sort(np.asarray(fresh, np.int64))
        sizes, none = np.zeros(count, np.int64), np.ones(count, bool)
        sizes[fresh], none[fresh] = n, False
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        keys = pa.ListArray.from_arrays(offsets, pa.array(s.band_keys(fresh, n, rows).view(np.int64)), mask=pa.array(none))
        return pa.RecordBatch.from_arrays([*_spans(part, s, s.lines)[1], pa.array(h.view(np.int64)), keys], ["id", "t", "at", "to", "h", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "_text", LINES_BYTES):
                if (made := one(part, seen)) is not None:
                    yield made

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {kind}, t int, at int, to int, h long, keys array<long>")


def _several(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash and document, where each hash begins in it, and whether several documents have it."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    return order, first, doc[first] != doc[last]


def _known(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of grams of a slice: those that several of its documents have, but for one of two documents each, which speak for the rest."""
    out = np.zeros(len(h), bool)
    if len(h):
        order, first, several = _several(h, doc)
        sizes = np.diff(np.append(first, len(h)))
        out[order] = np.repeat(several, sizes)
        out[order[first]] = out[order[first + sizes - 1]] = False
    return out


def grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, id, at, known) of the grams that stand for windows.

    known: whether the gram's neighbours in a slice of texts tell that several documents have it, and other rows of it
    tell the rest; its h is then one of its own, so that a common gram's rows don't meet.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def one(part: pa.RecordBatch) -> pa.RecordBatch | None:
        s = Sliced(utf8(part, "_text"))
        spans = s.grams()
        if not spans.shape[1]:
            return None
        doc, (ids, _, at, _) = _spans(part, s, spans)
        h = s.hashes(spans, 2)
        known = _known(h, part.column("id").dictionary_encode().indices.to_numpy()[doc])
        h[known] = _mix(h[known] + np.flatnonzero(known).astype(np.uint64) * np.uint64(BASE))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, at, pa.array(known)], ["h", "id", "at", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                if (made := one(part)) is not None:
                    yield made

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"h long, id {kind}, at int, known boolean")


def _meet(rows: DataFrame, out_cols: list[str], known_other: bool) -> DataFrame:
    """Rows (h, id, ..., known) that share their h with another id, in order of h; those that are known come out whatever they meet.

    Rows are passed on as they come: the first document's are held until there is a second one. With ``known_other`` the
    least document's rows don't come out, and a column other names it for the rest.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join(f"{c} {kind if c == 'other' else rows.schema[c].dataType.simpleString()}" for c in out_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        held_out = False  # whether the held rows' hash has several documents, so that they themselves are out already
        for batch in batches:
            done = 0
            if held is not None:
                done = held.num_rows if held_out else 0
                batch = pa.concat_batches([held, batch])
            h = batch.column("h").to_numpy()
            if not len(h):
                continue
            known = batch.column("known").to_numpy(zero_copy_only=False)
            doc = batch.column("id").dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(first, len(h)))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            out = np.repeat(several, sizes)
            if known_other:
                out &= doc != np.repeat(doc[first], sizes)
            out |= known
            out[:done] = False
            if known_other:
                least = batch.column("id").take(pa.array(np.repeat(first, sizes)))
                batch = batch.set_column(batch.schema.get_field_index("other"), "other", pc.if_else(pa.array(known), batch.column("other"), least))
            yield batch.filter(pa.array(out)).select(out_cols)
            # the last hash may go on: a row of its first document and one of another stand for it, or all there are of its only one
            held_out = bool(several[-1]) or bool(known[-1])
            at = first[-1]
            held = batch.take(pa.array([at, at + int(np.argmax(doc[at:] != doc[at]))])) if several[-1] else batch.slice(at)

    return rows.repartition("h").sortWithinPartitions("h", *(["id"] if known_other else [])).mapInArrow(run, schema)


def _around(docs: DataFrame, id_col: str, text_col: str, needs: DataFrame) -> DataFrame:
    """Windows around shared grams (kind 0: id, t, at, to, h, known, other) and words of wanted lines (kind 1: h, words).

    ``needs``: (id, ats, hs), words where shared grams start and hashes of wanted lines. known: whether a document of
    a lesser id in the same slice has the window; it is other then, and h one of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["kind", "id", "t", "at", "to", "h", "known", "other", "words"]

    def near(part: pa.RecordBatch, s: Sliced) -> pa.RecordBatch | None:
        ats = part.column("ats")
        own = np.repeat(np.arange(part.num_rows), np.diff(ats.offsets.to_numpy()))
        flat = ats.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        inside = flat < (s.starts[1:] - s.starts[:-1])[own]
        spans = s.windows(flat[inside] + s.starts[own[inside]])
        n = spans.shape[1]
        if not n:
            return None
        doc, columns = _spans(part, s, spans)
        h = s.hashes(spans, 3)
        ids = part.column("id")
        order, first, _ = _several(h, pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)[doc])
        least = np.empty(n, np.int64)
        least[order] = np.repeat(doc[order[first]], np.diff(np.append(first, n)))
        codes = ids.dictionary_encode().indices.to_numpy()
        known = codes[least] != codes[doc]
        h[known] = _mix(h[known] + np.flatnonzero(known).astype(np.uint64) * np.uint64(BASE))
        none = pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *columns, pa.array(h.view(np.int64)), pa.array(known), ids.take(pa.array(least)), none], names)

    def wanted(part: pa.RecordBatch, s: Sliced) -> pa.RecordBatch | None:
        asked = part.column("hs").flatten().to_numpy(zero_copy_only=False)
        if not len(asked):
            return None
        h = s.hashes(s.lines, 1).view(np.int64)
        h, at = np.unique(h, return_index=True)
        has = np.flatnonzero(np.isin(h, asked))
        words = [s.words[s.lines[0, i] : s.lines[1, i]].tobytes() for i in at[has].tolist()]
        n = len(has)
        none = [pa.nulls(n, part.schema.field("id").type), *(pa.nulls(n, pa.int32()) for _ in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *none, pa.array(h[has]), pa.nulls(n, pa.bool_()), none[0], pa.array(words, pa.binary())], names)

    def one(part: pa.RecordBatch) -> list[pa.RecordBatch]:
        s = Sliced(utf8(part, "_text"))
        return [made for made in (near(part, s), wanted(part, s)) if made is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield from one(part)

    cols = _keyed(docs, id_col, text_col).join(needs, "id").select("id", "t", "_text", "ats", "hs")
    return cols.mapInArrow(run, f"kind int, id {kind}, t int, at int, to int, h long, known boolean, other {kind}, words binary")


def _colliding(rows: DataFrame) -> DataFrame:
    """(key, h, pivot) of the rows whose key has several different lines; pivot: the line that most tasks sent, the least of equals."""
    each = rows.groupBy("key", "h").agg(F.count("*").alias("n"))
    pivots = each.groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct("n", F.bitwise_not("h").alias("h"))).alias("p")).where("m > 1")
    return each.select("key", "h").join(pivots.select("key", F.bitwise_not("p.h").alias("pivot")), "key")


def _sets(words: DataFrame) -> DataFrame:
    """(h, shingles) of lines given as (h, words): distinct five-word shingle hashes, in order."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(np.frombuffer(w, np.uint64))).view(np.int64) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(sets, pa.list_(pa.int64()))], ["h", "shingles"])

    return words.mapInArrow(shingles, "h long, shingles array<long>").dropDuplicates(["h"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def line_clusters(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): lines linked by similarity, by hash. ``met``: lines that collide, ``sets``: their shingles."""
    first = met.where("h != pivot").select(F.greatest("h", "pivot").alias("a"), F.least("h", "pivot").alias("b")).distinct()
    links = cut(_verified(first, sets, similarity), "verified")
    found = components(links)
    more = cut(_across(met, found, sets, similarity), "across")
    if not more.limit(1).count():
        return found
    # what is known already goes in as stars, which settle in fewer rounds than the links
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _across(met: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components that share a bucket, enough of them to join what is linked."""
    placed = met.select("key", "h").join(found, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    placed = cut(placed, "placed")
    spans = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    left = placed.join(spans.select("key", "n"), "key").join(sets, "h")
    # as many blocks as hold BLOCK lines, or BLOCK_SHINGLES shingles, each on average
    weight = left.groupBy("key").agg(F.sum(F.size("shingles")).alias("w"))
    left = left.join(weight, "key").withColumn("n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)))
    block = F.pmod(F.xxhash64("h", "key"), F.col("n")).cast("int")
    lists = [F.collect_list(F.struct("h", "root", "shingles")).alias("s")]
    blocks = left.groupBy("key", block.alias("block")).agg(*lists).select("key", "block", F.col("s.h").alias("h"), F.col("s.root").alias("root"), F.col("s.shingles").alias("shingles"))
    blocks = cut(blocks, "blocks")
    one, two = (blocks.select("key", F.col("block").alias(f"{k}b"), F.col("h").alias(f"{k}h"), F.col("root").alias(f"{k}r"), F.col("shingles").alias(f"{k}s")) for k in "xy")
    return one.join(two, "key").where("xb <= yb").drop("key").mapInArrow(_linker(similarity), "a long, b long").distinct()


def _linker(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for xb, xh, xr, xs, yb, yh, yr, ys in zip(*(batch.column(k) for k in ("xb", "xh", "xr", "xs", "yb", "yh", "yr", "ys")), strict=True):
                one = _block(xh, xr, xs)
                for i, j in _cross_links(one, one if xb == yb else _block(yh, yr, ys), similarity):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _block(h, root, shingles) -> tuple[list[int], list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes, roots, shingle sets, their sizes and bit maps."""
    sets = [np.asarray(x.values) for x in shingles.values]
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets).view(np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    bits = np.zeros((len(sets), MAP_WORDS), np.uint64)
    np.bitwise_or.at(bits, (row, (flat % np.uint64(64 * MAP_WORDS) // np.uint64(64)).astype(np.int64)), np.uint64(1) << flat % np.uint64(64))
    return h.values.to_pylist(), root.values.to_pylist(), sets, sizes, bits


def _cross_links(x, y, similarity: float) -> list[tuple[int, int]]:
    """Pairs of lines of two blocks that link two components not joined yet; every pair across components is bounded, and verified if it may link."""
    (xh, xr, xs, xn, xb), (yh, yr, ys, yn, yb) = x, y
    up: dict[int, int] = {}

    def find(r):
        while (t := up.get(r, r)) != r:
            r = t
        return r

    out = []
    xroot, yroot = np.array(xr), np.array(yr)
    for at in range(0, len(xh), 256):
        some = slice(at, at + 256)
        apart = np.bitwise_count(xb[some, None, :] ^ yb[None, :, :]).sum(2, dtype=np.int64)
        both = xn[some, None] + yn[None, :]
        # the sets differ in at least as many shingles as their maps in bits
        may = (both - apart >= similarity * (both + apart)) & (xroot[some, None] != yroot[None, :])
        for i, j in np.argwhere(may).tolist():
            i += at
            a, b = find(xr[i]), find(yr[j])
            if a != b:
                shared = len(np.intersect1d(xs[i], ys[j], assume_unique=True))
                if shared >= similarity * (xn[i] + yn[j] - shared):
                    up[max(a, b)] = min(a, b)
                    out.append((xh[i], yh[j]))
    return out


def _found(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> DataFrame:
    """(id, t, at, to, other): ranges of words that go, and a document of a lesser id that has their text or one like it."""
    own = cut(lines(docs, id_col, text_col, bands(similarity, recall)), "lines")
    met = cut(_colliding(own.select(F.explode("keys").alias("key"), "h")), "met")
    # what is needed of a text: its shared grams, and the lines that it lends to be verified
    lent = own.select("h", "id").join(met.select("h").distinct(), "h").groupBy("h").agg(F.min("id").alias("id"))
    shared = _meet(grams(docs, id_col, text_col), ["id", "at"], False)
    needs = shared.select("id", "at", F.lit(None).cast("long").alias("h")).union(lent.select("id", F.lit(None).cast("int"), "h"))
    needs = needs.groupBy("id").agg(F.collect_list("at").alias("ats"), F.collect_list("h").alias("hs"))
    around = cut(_around(docs, id_col, text_col, needs), "around", "kind")
    windows = _meet(around.where("kind = 0").select("h", "id", "t", "at", "to", "known", "other"), ["id", "t", "at", "to", "other"], True)
    sets = cut(_sets(around.where("kind = 1").select("h", "words")), "sets")
    near = line_clusters(met, sets, similarity)
    by_hash = own.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    # a root is a node of its own cluster
    placed = near.withColumnRenamed("node", "h").union(near.select("root", "root").distinct())
    linked = by_hash.join(placed, "h", "left").where("lo != hi or root is not null")
    linked = cut(linked.select("h", F.coalesce("root", "h").alias("cluster"), "lo", "hi"), "linked")
    least = linked.groupBy("cluster").agg(F.min("lo").alias("other"), F.max("hi").alias("hi")).where("other != hi").select("cluster", "other")
    gone = own.join(linked.select("h", "cluster").join(least, "cluster"), "h").where("id != other").select("id", "t", "at", "to", "other")
    found = cut(windows.union(gone), "found")
    remove_cuts(own, met, around, sets, near, linked)
    return found


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(``id_col``, at, to, other): ranges of words of repeated paragraphs, all but those of the least id, and a document of a lesser id that has their text or one like it."""
    return _found(docs, id_col, text_col, similarity, recall).select(F.col("id").alias(id_col), "at", "to", "other")


def _runs(spans: DataFrame) -> DataFrame:
    """``spans`` (keys, at, to) as (keys, runs): each text's touching ranges joined, an array of structs run_at and run_to in order."""
    keys = [c for c in spans.columns if c not in ("at", "to")]
    # ranges that start together are one, hence a text has one for each word at most
    widest = spans.groupBy(*keys, "at").agg(F.max("to").alias("to"))
    own = widest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("s"))
    schema = own.select(*keys, F.col("s").cast("array<struct<run_at:int,run_to:int>>").alias("runs")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for ranges in batch.column("s"):
                flat = ranges.values
                at, to = (flat.field(k).to_numpy() for k in range(2))
                reach = np.maximum.accumulate(to)
                new = np.flatnonzero(np.concatenate([[True], at[1:] > reach[:-1]]))
                runs.append([{"run_at": a, "run_to": b} for a, b in zip(at[new].tolist(), reach[[*(new[1:] - 1), -1]].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("run_at", pa.int32()), ("run_to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(runs, kind)], [*keys, "runs"])

    return own.mapInArrow(run, schema)


def strip(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the given ranges of words; a blank or line end stays where one was."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in sorted(runs):
        out.append(text[last : at[a][0]])
        last = at[b][0] if b < len(at) else len(text)
    return b"".join([*out, text[last:]])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from their texts; texts that lose their last word go. ``count_col`` is made to fit."""
    gone = _found(docs, id_col, text_col, similarity, RECALL).select("id", "t", "at", "to")
    own, key, other = (unused(docs, x) for x in ("_cut", "_cut_id", "_cut_text"))
    runs = _runs(gone).select(F.col("id").alias(key), F.col("t").alias(other), F.col("runs").alias(own))
    cols, schema = docs.columns, docs.schema
    place = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                cuts = part.column(own).to_pylist()
                texts = part.column(place).to_pylist()
                keep = [True] * len(texts)
                for i, c in enumerate(cuts):
                    if c:
                        left = strip(texts[i].encode(), [(x["run_at"], x["run_to"]) for x in c])
                        texts[i], keep[i] = left.decode(), bool(left.split())
                arrays = [part.column(k) for k in range(len(cols))]
                arrays[place] = pa.array(texts, pa.string())
                if count_col in cols:
                    k = cols.index(count_col)
                    arrays[k] = pa.array([len(t) if c else n for t, c, n in zip(texts, cuts, arrays[k].to_pylist(), strict=True)], arrays[k].type)
                yield pa.RecordBatch.from_arrays(arrays, cols).filter(pa.array(keep, pa.bool_()))

    met = (F.col(id_col) == F.col(key)) & (F.hash(F.col(text_col)) == F.col(other))
    return docs.join(runs, met, "left").select(*cols, own).mapInArrow(run, schema)
