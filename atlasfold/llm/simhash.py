"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 4 bits exactly if some value lies
within 2 bits of both. Every distinct fingerprint therefore stands for all
its variants within half the radius, variants are shuffled, and fingerprints
that meet on a variant are verified and linked.

The shuffle is on variants in a compact form: all variants of a fingerprint
that share their leading ``bits`` travel as one row (prefix, fingerprint) and
are spelt out where they arrive, so 1 + bits + bits*(bits-1)/2 rows move in
place of 2081. ``bits`` follows the number of fingerprints, so that a prefix
has a bounded number of variants whatever the size of the input.

Members of a colliding variant are pairwise within the radius by the triangle
inequality, so a chain along them loses no component: links stay linear in
the members and no group's pairs are listed.

``keep_one`` looks for texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Such texts' bits differ too often for one ball of
64 bits, so it keeps several independent fingerprints a text ("lanes"), cut to
as many bits as keep chance meetings few, with as many lanes as reach RECALL
for a pair at 0.8 exactly. Balls are met in every lane; colliding pairs that
don't differ over all lanes as chance does join texts to crowds, and inside a
crowd every pair is settled on its shingles (``crowds``) before any is let go.

Defined results: null, empty and wordless texts have fingerprint zero and are
linked like any other; repeated rows and ids keep their rows; a null id takes
part but never names a component unless the component has no other id (then
null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, remove_cuts, slices, unused, utf8
from .components import components
from .crowds import SIMILARITY, forest, links_within

SEED = 42
RADIUS = 4
#: Variants that one prefix is meant to have at most, on average.
PREFIX_VARIANTS = 1 << 20
#: The near-copy search: chance to meet a pair that has SIMILARITY exactly, and what is added to the
#: logarithm of the number of texts for the bits of a lane.
RECALL, MARGIN = 0.98, 16
MIN_BITS, MAX_LANES = 34, 96


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of word shingles: a bit is set if over half the shingle hashes set it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *stops[: n - 1].tolist()]
    ends = (stops[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # very long texts: bounded bit tables
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col``, fp (long) and t (a hash of the text, which tells apart rows of one id) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([fingerprint(x, shingle) for x in utf8(part, "_text")], pa.int64()), part.column("t")], ["_id", "fp", "t"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("t"))
    return out.mapInArrow(run, f"_id {kind}, fp long, t long").withColumnRenamed("_id", id_col)


def differing(similarity: float) -> float:
    """Share of bits that differ, on average, between texts of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def lane_shape(n: int) -> tuple[int, int]:
    """(bits, lanes) that meet a pair at SIMILARITY with chance RECALL among ``n`` texts."""
    bits = min(64, max(MIN_BITS, math.ceil(math.log2(max(1, n))) + MARGIN))
    p = differing(SIMILARITY)
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    return bits, min(MAX_LANES, math.ceil(math.log(1 - RECALL) / math.log(1 - meets)))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text in ascending order; a text of fewer words is one shingle, one of none has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *stops[: n - 1].tolist()]
    ends = (stops[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def sketch(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """One 64-bit fingerprint a lane: of the hashes as they are, then of them mixed anew for each further lane."""
    out = np.zeros(lanes, np.int64)
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            h = hashes[at : at + 65_536]
            if lane:
                h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0]
    return out


def masks(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``most`` (0 to 2) bits set, fewest first."""
    one = np.uint64(1) << np.arange(width, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2:
        i, j = np.triu_indices(width, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def prefix_bits(n: int, width: int = 64, least: int = 2) -> int:
    """Leading bits, ``least`` or more, so that a prefix has about PREFIX_VARIANTS variants of ``n`` fingerprints."""
    return min(24, max(least, math.ceil(math.log2(max(1, n) * len(masks(width, 2)) / PREFIX_VARIANTS))))


def meet(prefix: int, fps: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between distinct fingerprints whose leading ``width`` bits share a variant under ``prefix``.

    From chains along each variant's members, the links that a forest needs. Bits beyond ``width`` must agree as they do
    for texts at SIMILARITY, give or take three standard deviations. The links tell what is connected within the radius;
    whether two texts are alike is for those to settle who read what is connected.
    """
    whole = np.sort(fps)  # the same hubs under every prefix, so most links are found anew, not others beside them
    fps = whole >> np.uint64(64 - width)
    low = np.uint64(width - bits)
    tail = np.uint64((1 << (width - bits)) - 1)
    away = np.bitwise_count((fps >> low) ^ np.uint64(prefix))
    spelt, owner = [], []
    for d in range(RADIUS // 2 + 1):
        own = np.flatnonzero(away == d)
        if len(own):
            m = masks(width - bits, RADIUS // 2 - d)
            spelt.append(((fps[own] & tail)[:, None] ^ m[None, :]).ravel())
            owner.append(np.repeat(own, len(m)))
    if not spelt:
        return whole[:0], whole[:0]
    variants = np.concatenate(spelt)
    del spelt
    # which variants occur twice: sort the bare values, mark the repeated ones in a small table, then look closely at those
    order = np.sort(variants)
    twice = order[1:][order[1:] == order[:-1]]
    del order
    if not len(twice):
        return whole[:0], whole[:0]
    mark = np.zeros(1 << 20, bool)
    mark[(twice & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    near = np.flatnonzero(mark[(variants & np.uint64((1 << 20) - 1)).astype(np.int64)])
    owners = np.concatenate(owner)[near]
    keys = variants[near]
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    same = keys[1:] == keys[:-1]
    a, b = owners[:-1][same], owners[1:][same]
    pairs = np.unique(np.minimum(a, b) * np.int64(len(fps)) + np.maximum(a, b))
    a, b = pairs // len(fps), pairs % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b])
    p, rest = differing(SIMILARITY), 64 - width
    right = (near <= RADIUS) & (np.bitwise_count(whole[a] ^ whole[b]) - near <= rest * p + 3 * math.sqrt(rest * p * (1 - p)))  # the verification
    a, b = a[right], b[right]
    needed = forest(a, b, len(fps))
    return whole[a[needed]], whole[b[needed]]


def links(distinct: DataFrame, bits: int, width: int = 64) -> DataFrame:
    """(lane, a, b): fingerprints within the radius, enough of them for every component.

    ``distinct`` has column fp, of whose bits the first ``width`` count, and may have column lane (under 128); lanes don't meet.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(bits, RADIUS // 2)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                lane = batch.column("lane").slice(at, 20_000).to_numpy(zero_copy_only=False).astype(np.int32) << 24
                to = ((fps >> np.uint64(64 - bits))[:, None] ^ flips[None, :]).astype(np.int32) | lane[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), pa.array(np.repeat(fps, len(flips)).view(np.int64))], ["prefix", "fp"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, fps in _runs(batches):
            a, b = meet(prefix & (1 << 24) - 1, fps, bits, width)
            if len(a):
                lane = pa.array(np.full(len(a), prefix >> 24, np.int32))
                yield pa.RecordBatch.from_arrays([lane, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["lane", "a", "b"])

    lane = F.col("lane") if "lane" in distinct.columns else F.lit(0)
    sent = distinct.select(lane.alias("lane"), "fp").mapInArrow(send, "prefix int, fp long")
    return sent.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(receive, "lane int, a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The fingerprints of each prefix, from rows in order of prefix."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        prefix = batch.column("prefix").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        edges = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            if now is not None and prefix[i] != now:
                yield now, np.concatenate(held)
                held = []
            now = int(prefix[i])
            held.append(fps[i:j].copy())
    if held:
        yield now, np.concatenate(held)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """_id, fp, t and keep of every row; keep: the least id, and the least t of that, of the row's component (null without an id)."""
    found = cut(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", shingle), "fingerprints")
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "t")))
    distinct = cut(found.groupBy("fp").agg(first.alias("_least")), "distinct")
    reached = components(links(distinct, prefix_bits(distinct.count())))
    # the least id of each component, then of each fingerprint in it
    rooted = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("keep"))
    named = cut(rooted.select("fp", "root").join(least, "root").select("fp", "keep"), "named")
    remove_cuts(distinct, reached)
    return found.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col``, fp and component_id (the least id reachable over links, its own included) of every row."""
    return _grouped(docs, id_col, text_col, shingle).select(F.col("_id").alias(id_col), "fp", F.col("keep._id").alias("component_id"))


def _sketches(texts: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """t, n (distinct shingles) and sk (a long a lane) of every row of (t, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                own = [(len(h), sketch(h, lanes)) for h in (shingle_hashes(x, shingle) for x in utf8(part, "_text"))]
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array([n for n, _ in own], pa.int64()), pa.array([sk for _, sk in own], pa.list_(pa.int64()))], ["t", "n", "sk"])

    return texts.mapInArrow(run, "t long, n long, sk array<long>")


def _colliding(sk: DataFrame, bits: int) -> DataFrame:
    """(a, b), a > b: texts that meet in a lane. Texts of one fingerprint are a class, which its least text stands for in the balls."""
    lanes = sk.select("t", F.posexplode("sk").alias("lane", "fp"))
    classes = cut(lanes.groupBy("lane", "fp").agg(F.min("t").alias("least"), F.count("*").alias("n")), "classes")
    within = lanes.join(classes.where("n > 1"), ["lane", "fp"]).select(F.col("t").alias("a"), F.col("least").alias("b"))
    n = classes.groupBy("lane").count().agg(F.max("count")).first()[0] or 0
    met = links(classes, prefix_bits(n, bits, 6), bits)
    named = classes.select("lane", "fp", "least")
    across = met.join(named.select("lane", F.col("fp").alias("a"), F.col("least").alias("x")), ["lane", "a"])
    across = across.join(named.select("lane", F.col("fp").alias("b"), F.col("least").alias("y")), ["lane", "b"])
    pairs = within.union(across.select("x", "y")).where("a != b")
    out = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "colliding")
    remove_cuts(classes)
    return out


def _agreeing(pairs: DataFrame, sk: DataFrame, lanes: int) -> DataFrame:
    """The pairs whose distance over all lanes is nearer to that at SIMILARITY than to chance, which is half the bits."""
    most = math.floor(64 * lanes * (differing(SIMILARITY) + 0.5) / 2)
    both = pairs.join(sk.select(F.col("t").alias("a"), F.col("sk").alias("x")), "a").join(sk.select(F.col("t").alias("b"), F.col("sk").alias("y")), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    return both.where(apart <= most).select("a", "b")


def similar(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """(node, root) of every text that is in a component with another, by links of SIMILARITY or more.

    ``texts`` has distinct t (a hash) and _text. What meets in a lane and agrees over all is joined to crowds, however
    thinned; inside a crowd all texts are compared, so a pair is lost only if no lane meets it, which for one at
    SIMILARITY has the chance 1 - RECALL, and nothing else joins its crowds.
    """
    bits, lanes = lane_shape(texts.count())
    sk = cut(_sketches(texts, shingle, lanes), "sketches")
    met = _colliding(sk, bits)
    pairs = cut(_agreeing(met, sk, lanes), "pairs")
    crowds = components(pairs)
    ends = [pairs.groupBy(F.col(end).alias("t")).agg(F.count("*").alias("n")) for end in ("a", "b")]
    degree = ends[0].union(ends[1]).groupBy("t").agg(F.sum("n").alias("degree"))
    # a component lists what is not its root
    members = crowds.select(F.col("node").alias("t"), F.col("root").alias("crowd")).union(crowds.select("root").distinct().selectExpr("root", "root as crowd"))
    members = members.join(degree, "t").join(sk.select("t", "n"), "t")
    found = links_within(members, texts, lambda text: shingle_hashes(text, shingle))
    remove_cuts(met, sk, pairs, crowds)
    out = components(found)
    remove_cuts(found)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of ``docs`` of every component of similar texts: of the least id, and of that the text whose hash is least.

    Rows are known by id and text, so a row goes only if its own text is in a component that another row stands for.
    Rows with a null id all stay and stand for no one else. Of rows with equal id and text one stays. A null text is an
    empty one; texts without words are alike.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("_text")).where("_id is not null")
    distinct = cut(rows.groupBy("t").agg(F.first("_text").alias("_text")), "texts")
    reached = similar(distinct, shingle)
    # a hot root's rows are counted down by partial sums; equal rows are one
    each = rows.select("_id", "t").groupBy("t").agg(F.min("_id").alias("_least"))
    rooted = cut(each.join(reached.withColumnRenamed("node", "t"), "t", "left").select("t", "_least", F.coalesce("root", "t").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("_least").alias("_id"), "t")).alias("keep"))
    named = cut(rooted.select("t", "root").join(least, "root").select("t", "keep"), "named")
    found = cut(rows.select("_id", "t").join(named, "t"), "grouped")
    remove_cuts(distinct, reached, rooted, named)
    row, text = unused(docs, "_row_id"), unused(docs, "_row_text")
    gone = found.where("_id != keep._id or t != keep.t").select(F.col("_id").alias(row), F.col("t").alias(text)).distinct()
    kept = docs.join(gone, (F.col(id_col) == F.col(row)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(text)), "left_anti")
    # a shuffle of the texts, only where a row that stays is repeated
    if not found.where("_id = keep._id and t = keep.t").groupBy("_id", "t").count().where("count > 1").limit(1).count():
        return kept
    named = kept.where(F.col(id_col).isNotNull()).withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).dropDuplicates([id_col, text]).drop(text)
    return named.unionByName(kept.where(F.col(id_col).isNull()))
