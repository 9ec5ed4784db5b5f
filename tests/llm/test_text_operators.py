"""Decontamination, toxicity, token counts, pieces and LM scores against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from atlasfold.llm import decontaminate, lm, pieces, token_counts, toxicity

ODD = [None, "", " ", "\n\n", "x", "same words here", "same words here", "a  b\t\n c\x0bd", "Ünï cödé 漢字 😀", "▁ mark ▁", "<|endoftext|> in <|endoftext|>", "word " * 3000]


def rows(df):
    return [r.asDict() for r in df.collect()]


# decontamination


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(low))
    out = {}
    for d, t in docs:
        own, hit, ids = words(t), set(), set()
        for i, x in items:
            w = words(x)
            for k in range(max(1, len(w) - width + 1)) if w else ():
                p = w[k : k + width]
                for at in range(len(own) - len(p) + 1):
                    if own[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        ids.add(str(i))
        out[d] = (len(own), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_contamination_is_brute_force(spark, make, block):
    g = random.Random(1)
    say = lambda n: " ".join(g.choice("ab cd EF gh,ij é".split()) for _ in range(n))
    items = [(1, say(14)), (2, "Lone, word-pair"), (3, None), (4, "..."), (5, say(10)), (5, say(12)), (10, "é")]
    docs = [(i, t) for i, t in enumerate([say(40) + " " + items[0][1] + "!" + say(9), "a LONE word pair b", say(300), items[4][1], *ODD])]
    found = decontaminate.contamination(make(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    want = brute_contamination(docs, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in rows(found)} == want
    texts = dict(docs)
    for r in rows(found):  # spans lie in the original text and hold as many words
        held = [decontaminate.words(texts[r["doc_id"]][a:b].encode()) for a, b in r["spans"]]
        assert sum(map(len, held)) == r["n_hit"]


def test_contamination_of_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in rows(decontaminate.contamination(make(["a b"]), none))] == [0]
    assert rows(decontaminate.contamination(make([]), none)) == []
    assert decontaminate.clean(make(["a b", None]), none).count() == 2


def test_clean_drops_only_contaminated(spark, make):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = make(["x One, two three four five six seven eight nine ten y", "one two three four five six seven eight nine", None])
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows(kept)) == [1, 2]


# toxicity


def toxic_texts(n, seed):
    g = random.Random(seed)
    syl = "an on er th re in ti ou ha st".split()
    word = lambda: "".join(g.choice(syl) for _ in range(g.randint(1, 4)))
    texts, labels = [], []
    for _ in range(n):
        s = [" ".join(word() for _ in range(g.randint(4, 12))) for _ in range(g.randint(2, 9))]
        bad = g.random() < 0.3
        if bad:
            k = g.randrange(len(s))
            s[k] = f"you {g.choice(['Xidiot', 'xclown!', 'xlosers'])} {s[k]}"
        texts.append(". ".join(s) + ".")
        labels.append(int(bad))
    return texts, labels


def test_toxicity_learns_and_locates():
    model = toxicity.fit(*toxic_texts(600, 1))
    texts, labels = toxic_texts(300, 2)
    got = [int(s >= 0.5) for s in model.scores(texts)]
    assert np.mean(np.array(got) == labels) > 0.97
    for t, y in zip(texts, labels, strict=True):
        for a, b, p in model.spans(t) if y else ():
            assert p >= 0.5 and re.search("idiot|clown|loser", t[a:b].lower())


def test_noisy_or_is_its_definition():
    model = toxicity.Model({"=bad": 3.0, "=worse": 5.0}, -4.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    assert math.isclose(model.score("Bad one. fine here! worse bad"), 1 - (1 - p(-1)) * (1 - p(-4)) * (1 - p(4)), rel_tol=1e-9)


def test_toxicity_of_odd_rows(spark, make):
    texts, labels = toxic_texts(200, 3)
    docs = make([*texts, *ODD])
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_on(docs, table)
    found = rows(toxicity.scores(docs, model))
    assert len(found) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in found)
    nothing = toxicity.fit_on(docs, table.limit(0))
    assert {r["score"] for r in rows(toxicity.scores(docs, nothing))} == {0.0}
    assert toxicity.scores(make([]), model).count() == 0


# token counts


def random_texts(n, seed):
    g = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", "\t", " \n ", "'s", "'ll", "don't", "é", "漢", "😀", "12", "3.4", "!!", "¿", "\xa0", " ", "\x1c", "\x85", "_", "<|endoftext|>", "ing", "-", "²", "ǅ", "́"]
    return ["".join(g.choice(parts) for _ in range(g.randint(0, 60))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark, make, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = random_texts(3000, 1) + [x or "" for x in ODD]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    library = token_counts.Library(path)
    table = token_counts.PreTokens(library.special)
    tokens, sizes, special = table.of(texts)
    pieces = np.array(library.pieces(table.names))
    assert len(set(table.names)) == len(table.names)
    assert (np.bincount(np.repeat(np.arange(len(texts)), sizes), pieces[tokens], len(texts)) + special).tolist() == want
    some = [*ODD, *texts[:50]]
    found = {r["doc_id"]: r for r in rows(token_counts.token_counts(make(some), path))}
    for i, x in enumerate(some):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert found[i] == {"doc_id": i, "n_bytes": len((x or "").encode()), "n_tokens": n, "over_limit": n > 1024}
    monkeypatch.setattr(token_counts, "HEAVY", 300)  # so that both ways of the join are taken
    assert {r["doc_id"]: r for r in rows(token_counts.token_counts(make([*some, *some]), path))} == found | {i + len(some): r | {"doc_id": i + len(some)} for i, r in found.items()}
    assert token_counts.token_counts(make([]), path).count() == 0


# pieces


@pytest.fixture(scope="module")
def model_path():
    return P.path("piece_bpe_32k.model")


def test_plain_pieces_are_the_librarys(model_path):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    c = pieces.Codec(model_path, rate=0.0)
    for t in random_texts(1500, 2):
        assert c.encode(t).tolist() == m.encode(t)


def test_dropout_agendas_agree_and_decode(model_path):
    c = pieces.Codec(model_path, seed=3, rate=0.3)
    texts = [*random_texts(300, 4), *[x or "" for x in ODD], "x" * 300, "tokenization " * 20]
    chunks = list(dict.fromkeys(k for t in texts for k in c.chunk.findall(f" {t}")))
    which = np.arange(len(chunks)) % c.variants
    ids, counts = c.segment_many(chunks, which)
    ends = np.cumsum(counts)
    for k, v, e, n in zip(chunks, which, ends, counts, strict=True):
        assert tuple(ids[e - n : e]) == c.segment(k, int(v))
    for t in texts:
        assert c.decode(c.encode(t).tolist()) == t
    plain = pieces.Codec(model_path, rate=0.0)
    assert len(c.encode("tokenization " * 20)) > len(plain.encode("tokenization " * 20))
    assert c.encode(texts[5]).tolist() != pieces.Codec(model_path, seed=4, rate=0.3).encode(texts[5]).tolist() or len(texts[5]) < 8
    assert c.encode("some words").tolist() == pieces.Codec(model_path, seed=3, rate=0.3).encode("some words").tolist()


def test_occurrences_draw_for_themselves(model_path):
    c = pieces.Codec(model_path, seed=3, rate=0.1)
    word = " tokenization"
    ids, counts = c.encode_many([(word * 3000)[1:]])
    n = len(c.chunk.findall(word * 3000))
    salt = xxhash.xxh64_intdigest((word * 3000)[1:].encode(), 3)
    keys = [(salt + i * 0x9E3779B97F4A7C15) % (1 << 64) for i in range(n)]
    own = [c.segment(word, k) for k in keys]
    assert [x for o in own for x in o] == ids.tolist() and counts.tolist() == [len(ids)]
    assert len(set(own)) > 4
    skipped = [c._skips(c._keys(np.array([k], np.uint64)), np.array([s], np.uint64))[0] for k in keys[:1000] for s in (2, 3, (5 << 20) + 2)]
    assert 0.08 < np.mean(skipped) < 0.12


def test_pieces_round_trip_in_spark(make, model_path):
    docs = make(ODD)
    found = pieces.encode(docs, model_path, rate=0.2)
    assert all(r["intact"] for r in rows(found))
    back = {r["doc_id"]: r["text"] for r in rows(pieces.decode(found, model_path))}
    assert back == {i: x or "" for i, x in enumerate(ODD)}
    assert pieces.encode(make([]), model_path).count() == 0


# LM scores


def corpus(n, seed):
    g = random.Random(seed)
    kinds = ["an on er th re in".split(), "la que ción os el ar".split(), "ch ei sch un ge ver".split()]
    out = []
    for _ in range(n):
        syl = g.choice(kinds)
        out.append(" ".join("".join(g.choice(syl) for _ in range(g.randint(1, 3))) for _ in range(g.randint(5, 80))))
    return out


def test_lm_base_is_brute_force_and_model_beats_it(spark, make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "HEAVY", 300)  # so that both kinds of words occur
    texts = [*corpus(300, 1), *ODD]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    found = {r["doc_id"]: r for r in rows(lm.score(make(texts), held, P.path("byte_bpe_50k.tiktoken")))}
    words = lambda t: (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    c = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        own = [*words(t), None]
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    apart = [found[i] for i in range(300) if found[i]["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def some_model(g, branches=4):
    n = branches**3
    a = lm.Attention(n, branches, lm.tables(g.integers(0, 5, (n, n)).astype(np.float32), branches))
    for k in ("u0", "u1", "u2", "far"):
        a.p[k] = g.normal(0, 0.5, a.p[k].shape).astype(np.float32)
    return a


def brute_logs(a, x, to, i):
    """log p of the class at place i, from its own block's inputs up to i and the block before."""
    first = max(0, i // lm.BLOCK * lm.BLOCK - lm.BLOCK)
    ids = x[first : i + 1]
    k = a.p["k"][ids] @ a.p["q"][x[i]] * lm.KEY**-0.5 + a.p["far"][i - first - np.arange(len(ids))]
    w = np.exp(k - k.max())
    state = (w / w.sum()) @ a.p["v"][ids]
    total, b = 0.0, a.b
    for level, u in enumerate(("u0", "u1", "u2")):
        node = to // b ** (3 - level)
        z = (a.logs[0][x[i]] if level == 0 else a.logs[level][node, x[i]]) + state @ a.p[u][node]
        z = z - np.log(np.exp(z).sum())
        total += z[to // b ** (2 - level) % b]
    return total


def test_lm_windows_score_each_token_once():
    g = np.random.default_rng(0)
    a = some_model(g)
    texts = [g.integers(0, 50, n) for n in (1, 31, 32, 33, 200)]
    end = 60
    for t, s in zip(texts, a.scores(texts, end), strict=True):
        x = np.concatenate([[end], t[:-1]])
        assert math.isclose(s, sum(brute_logs(a, x, t[i], i) for i in range(len(t))) / math.log(10), rel_tol=1e-4)


def test_lm_is_a_distribution():
    g = np.random.default_rng(0)
    a = some_model(g)
    x = g.integers(0, a.pad, 40)
    assert math.isclose(sum(math.exp(brute_logs(a, x, to, 37)) for to in range(a.pad)), 1, rel_tol=1e-5)
    c = lm.Classes(np.arange(5000), 4999)
    assert c.branches == lm.MOST_BRANCHES and math.isclose((10 ** c.within[c.of == c.n - 1]).sum(), 1, rel_tol=1e-9)
    assert len(set(c.of[np.argsort(-np.arange(5000))[: c.n - 1]].tolist())) == c.n - 1


def test_lm_gradients_are_differences():
    g = np.random.default_rng(1)
    a = some_model(g, 3)
    x, y, real = lm.blocks([g.integers(0, 27, n) for n in (5, 70)], 3, a.pad)
    keys, own, to = np.concatenate([x[real - 1], x[real]], 1), x[real], y[real]
    texts = [y[1][:5], np.concatenate([*y[3:5], y[5][:6]])]
    loss = lambda: -a.scores(texts, 3).sum() * math.log(10) / 75
    found = a.gradients(keys, own, to)
    for k, d in found.items():
        at = np.unravel_index(np.argmax(np.abs(d)), d.shape)
        kept = a.p[k][at]
        a.p[k][at] = kept + 0.02
        up = loss()
        a.p[k][at] = kept - 0.02
        assert math.isclose((up - loss()) / 0.04, d[at], rel_tol=0.03), k
        a.p[k][at] = kept


def test_lm_subwords_are_the_librarys():
    sw = lm.Subwords(P.path("byte_bpe_50k.tiktoken"), {b"the": 2.0, b"12": 3.0}, entries=50)
    texts = [(x or "").encode().split() for x in [*random_texts(400, 5), *ODD]]
    for at in range(0, len(texts), 10):
        some = texts[at : at + 10]
        for own, got in zip(some, sw.texts(some), strict=True):
            assert got.tolist() == [i for w in own for i in sw.encoding.encode_ordinary(f" {w.decode()}")] + [sw.end]
        known, base, rare, times = sw.rare(some, sw.words(some))
        for own, k, b, r, n in zip(some, known, base, rare.to_pylist(), times.to_pylist(), strict=True):
            c = collections.Counter(own)
            assert (k, b) == (c[b"the"] + c[b"12"], 2.0 * c.pop(b"the", 0) + 3.0 * c.pop(b"12", 0)) and dict(zip(r, n, strict=True)) == c


def test_lm_trains_on_every_text_and_learns_from_the_context(spark):
    g = np.random.default_rng(2)
    texts = [np.concatenate([g.integers(0, 30, g.integers(1, 300)) + 30 * (i % 2), [60]]).astype(np.uint16) for i in range(400)]
    pad = 64
    for t in texts[:40]:  # as many windows as there are blocks, each the block that all blocks of the text have
        x, y, real = lm.blocks([t], 60, pad)
        want = [(np.concatenate([x[r - 1], x[r]]).tolist(), y[r].tolist()) for r in real]
        found = [np.frombuffer(w, np.uint16) for which, w in lm.windows(t, 60, 1) if which == 0]
        keys, own, to = lm.unpacked(found, pad)
        assert list(zip(keys.tolist(), to.tolist(), strict=True)) == want and (own == keys[:, lm.BLOCK :]).all()
    # a text gives a round every share-th of its blocks, one share of them or one more
    assert all(abs(sum(which == k for which, _ in lm.windows(t, 60, 3)) - len(t) / lm.BLOCK / 3) < 1.4 for t in texts for k in range(lm.ROUNDS))
    given = [lm.windows(t, 60, 1) for t in texts]
    given = spark.createDataFrame([([r for r, _ in g], [bytearray(w) for _, w in g]) for g in given], "rounds array<int>, windows array<binary>").repartition(3)
    df = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary").repartition(3)
    kind = np.dtype(np.uint16)
    counts = lm.id_counts(df, 61, kind)
    assert counts.tolist() == np.bincount(np.concatenate(texts), minlength=61).tolist()
    classes = lm.Classes(counts, 60)
    pairs = lm.pair_counts(df, classes, kind)
    x = [classes.of[t] for t in texts]
    own = collections.Counter((a, b) for t in x for a, b in zip([classes.end, *t.tolist()], t.tolist(), strict=False))
    assert dict(zip(pairs.keys.tolist(), pairs.counts.tolist(), strict=True)) == {a * classes.n + b: n for (a, b), n in own.items()}
    nothing = lm.Pairs(classes, np.zeros(0, np.int64), np.zeros(0, np.float32))
    weights = lm.train(given, spark.sparkContext.broadcast(nothing), kind, batch_size=8)
    before, after = (nothing.model(w).scores(x, classes.end).sum() for w in (None, weights))
    assert after > 0.86 * before


def test_lm_sees_every_window_of_every_training_text_once(spark, make, monkeypatch):
    from pyspark.sql import functions as F

    g = np.random.default_rng(3)
    texts = [g.integers(0, 60, n).astype(np.uint16) for n in (1, 31, 32, 33, 64, 65, 700)]
    same = [t.astype(np.int32) for t in texts]
    seen = collections.Counter()
    for which in range(lm.ROUNDS):
        keys, own, to = lm.in_round(same, texts, 60, 64, which)
        assert (own == keys[:, lm.BLOCK :]).all()
        want = [np.frombuffer(w, np.uint16) for t in texts for r, w in lm.windows(t, 60) if r == which]
        for a, b in zip(lm.unpacked(want, 64), (keys, own, to), strict=True):
            assert a.tolist() == b.tolist()
        seen.update(map(tuple, np.concatenate([keys, to], 1).tolist()))
    x, y, real = lm.blocks(same, 60, 64)
    assert seen == collections.Counter(map(tuple, np.concatenate([x[real - 1], x[real], y[real]], 1).tolist()))
    # and the query gives training the ids of all texts that it learns from
    given, real_train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda df, *a: given.append(df) or real_train(df, *a))
    lm.score(make(["a b c", "d e", None]), F.col("doc_id") == 1, P.path("byte_bpe_50k.tiktoken"))
    assert given[0].columns == ["ids"] and given[0].count() == 2


def test_lm_steps_write_into_kept_memory():
    """Steps of 256 blocks after the first take little fresh memory, and what earlier, larger ones left there doesn't show."""
    g = np.random.default_rng(5)
    a, b = (some_model(np.random.default_rng(6), 6) for _ in range(2))
    x, y, real = lm.blocks([g.integers(0, a.pad, n) for n in (*range(1, 90), 5000)], 3, a.pad)
    keys, own, to = np.concatenate([x[real - 1], x[real]], 1)[:256], x[real][:256], y[real][:256]
    assert len(own) == 256
    a.gradients(keys, own, to)
    for some in (slice(0, 7), slice(90, 256), slice(3, 4)):
        fresh = some_model(np.random.default_rng(6), 6).gradients(keys[some], own[some], to[some])
        assert all(np.allclose(d, fresh[k], atol=1e-9) for k, d in a.gradients(keys[some], own[some], to[some]).items())
    texts = [g.integers(0, 200, n) for n in (3, 70, 1)]
    assert np.allclose(a.scores(texts, 3), b.scores(texts, 3), rtol=1e-6)
    tracemalloc.start()
    a.gradients(keys, own, to)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20


def test_lm_counts_words_as_bytes_split(spark, make):
    texts = [*ODD, "  A a\x0bb\x1cB c\x00 \u00a0d\u0085 ", "\t", "x\r\n\ty\x0cZ\x1fq z\u2003z"]
    found = {bytes(r["word"]): r["c"] for r in lm.word_counts(make(texts).selectExpr("text _text")).collect()}
    assert found == collections.Counter(w for t in texts for w in (t or "").encode().translate(lm.LOWER).split())


def test_lm_without_training_rows(spark, make):
    from pyspark.sql import functions as F

    path = P.path("byte_bpe_50k.tiktoken")
    (r,) = rows(lm.score(make(["a b"]), F.lit(True), path))
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert lm.score(make([]), F.lit(False), path).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
