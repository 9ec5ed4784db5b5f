"""Ranked search, licence scans and the divergence audit against brute force, on small tables with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from atlasfold.llm import divergence, licenses, queries, ranking
from atlasfold.llm.license_rules import BASE, WORTH, rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " \n", "...", "x", "same words", "same words", "Ünï Cödé 漢字 42", "word " * 120_000]


def rows(df):
    return [r.asDict() for r in df.collect()]


def terms(text, pattern=TERM):
    return pattern.findall((text or "").translate(LOW))


# ranked search


def brute_search(docs, items, k):
    """(item place, rank, doc place, score) by the definition, every document scored against every item."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = set()
    for item, text in set(items):
        found = []
        for doc, c in own:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, text, rank, doc, score) for rank, (_, _, doc, score) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_search_is_brute_force(spark, make, block, monkeypatch):
    g = random.Random(1)
    vocabulary = [f"w{int(g.paretovariate(0.6))}" for _ in range(3000)]
    say = lambda n: " ".join(g.choice(vocabulary) for _ in range(n))
    docs = list(enumerate([say(g.randint(1, 90)) for _ in range(400)] + ["w1 w2 w3 rare"] * 30 + ODD))
    docs += [(None, "w1 w2 w3 rare"), (3, "w1 W2, w5 w5"), (3, "w1 W2, w5 w5")]
    items = [(i, say(g.randint(3, 40))) for i in range(20)] + [(5, "rare w1"), (5, "rare w1"), (None, "W7 w7 w7"), (50, None), (51, "?"), (52, "unheard of"), (53, docs[7][1])]
    monkeypatch.setattr(ranking, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranking, "ITEM_BYTES", 300)
    index = ranking.build(make(docs))
    asked = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 as rank", "'a' as slot", "2 as doc_id")
    found = rows(ranking.search(index, asked, k=7))
    want = brute_search(docs, items, 7)
    assert sorted(map(repr, ((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found))) == sorted(map(repr, ((i, rank, d, s) for i, _, rank, d, s in want)))


def test_search_of_nothing(spark, make):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(ranking.search(ranking.build(make([])), asked)) == []
    index = ranking.build(make(["a b", None]))
    assert rows(ranking.search(index, asked.limit(0))) == [] and ranking.search(index, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_bytes_bound_impacts_from_above():
    g = np.random.default_rng(1)
    tf, m = g.integers(1, 10**6, 10_000), g.integers(25, 10**5, 10_000)
    exact = ranking.impact(tf, m)
    level = -(-exact // ranking.STEP)
    assert level.max() <= 255 and (level * ranking.STEP >= exact).all() and ((level - 1) * ranking.STEP < exact).all()


# licences

NOTICES = {
    "All rights reserved.": {"reserved"},
    "Released under the MIT License.": {"mit"},
    "licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "http://www.apache.org/licenses/LICENSE-2.0.txt": {"apache-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "under the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1": {"gpl", "lgpl-2.1"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "(CC BY-SA)": {"cc-by", "cc-by-sa"},
    "https://creativecommons.org/licenses/by-nc-nd/3.0/": {"cc-by-nc-nd-3.0"},
    "// SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0"},
    "SPDX-License-Identifier: MPL-2.0": {"mpl-2.0"},
    "BSD 3-Clause": {"bsd-3-clause"},
    "Copyright (c) 2020 Someone": set(),
    "permit me a commercial break, or a bsdlike apachean": set(),
}


def brute_detect(text):
    return [(i, *m.span()) for i, (*_, p) in enumerate(rules()) for m in re.finditer(rf"(?<![^ ])(?:{p})(?![^ ])", text)]


def brute_settle(found):
    """Quadratic: each detection, in order of priority, against all that stay."""
    kept = []
    for x in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if not any(k[1] <= x[1] and x[2] <= k[2] or x[1] <= k[1] and k[2] <= x[2] for k in kept):
            kept.append(x)
    return sorted(kept)


def brute_scan(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = sorted(i for phrase, _ in BASE for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())
    base = sorted({label for phrase, label in BASE if f" {phrase} " in f" {' '.join(own)} "})
    found = brute_detect(" ".join(own))
    kept = brute_settle([x for x in found if rules()[x[0]][0] != "base"])
    worth = {}
    for kind, label in [rules()[x[0]][:2] for x in kept] + [("base", x) for x in base]:
        worth[label] = max(worth.get(label, 0), WORTH[kind])
    labels = sorted({rules()[x[0]][1] for x in kept if rules()[x[0]][0] != "hint"} | set(base))
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), 1.0 - math.prod(1 - x for x in worth.values())


def test_known_notices():
    assert len(rules()) > 300
    for text, want in NOTICES.items():
        assert licenses.scan(licenses.words(text.encode()))[2] == want, text
        assert set(filter(None, brute_scan(text)[5].split(","))) == want, text


def test_keywords_gate_without_loss():
    g = random.Random(2)
    whole = [x for _, _, _, pattern in rules() for x in [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", pattern)).split("|")[0].replace("licen[sc]e", "license").replace("?", "")]]
    for _ in range(60):
        text = " ".join(x for _ in range(12) for x in (g.choice(whole), g.choice(["a", "the", "gpl", "mit"])))
        text = " ".join(text.split())
        assert sorted(licenses.detect(text)) == sorted(brute_detect(text))
        found = [(g.randrange(9), a, a + g.randrange(1, 30)) for a in (g.randrange(200) for _ in range(60))]
        assert sorted(licenses.settle(found)) == brute_settle(found)


def test_query_of_licences_is_brute_force(spark, make, tmp_path):
    g = random.Random(3)
    texts = [*ODD, *NOTICES, *(" ".join(g.choice([*NOTICES, "and", "cc by", "ALL rights  reserved", "words"]) for _ in range(g.randint(1, 9))) for _ in range(80)), "all rights reserved " * 30_000]
    docs = [*enumerate(texts), (None, "cc by"), (1, "MIT license"), (1, "MIT license")]
    make(docs).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    cache = {t: brute_scan(t) for _, t in docs}
    got = sorted(repr((r["doc_id"], *(round(r[c], 9) if c == "score" else r[c] for c in names))) for r in rows(queries.op12_licenses(spark, str(tmp_path))))
    assert got == sorted(repr((i, *cache[t][:-1], round(cache[t][-1], 9))) for i, t in docs)
    found = rows(licenses.detections(make(docs)).select("doc_id", "spans").where("doc_id > 1"))
    for r in found:
        text = dict(docs)[r["doc_id"]]
        if len(text or "") > 10_000:
            continue
        for s in r["spans"]:
            kind, label, _, pattern = rules()[s["rule"]]
            assert label == s["label"] and re.fullmatch(pattern, " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text[s["start"] : s["stop"]].translate(LOW))))
            assert len(TERM.findall(text[: s["start"]])) == s["first_word"]
    assert rows(licenses.detections(make([]))) == []


# divergence


def brute_audit(docs, least=3, top=200):
    """docs: (text, lang, source)."""
    docs = [(terms(t, LETTERS), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {x[1] for x in docs}:
        own = [(w, s) for w, x, s in docs if x == lang]
        df = Counter(t for w, _ in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        groups = {s: Counter(t for w, x in own if x == s for t in w if df[t] >= least) for s in {s for _, s in own}}
        everything = sum(groups.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in groups.items()}
        q = {t: 1 + 10**9 * (everything[t] + 1) // (sum(everything.values()) + len(kept)) for t in kept}
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            own_terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own_terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("light", "tile", "held"), [(6, 128, 64), (2, 4, 3), (0, 3, 1), (100, 5, 2)])
def test_audit_is_brute_force(spark, light, tile, held):
    g = random.Random(4)
    vocabulary = [f"w{chr(97 + int(g.paretovariate(0.5)) % 26)}{chr(97 + g.randrange(26))}É1" for _ in range(900)]
    say = lambda n: " ".join(g.choice(vocabulary) for _ in range(n))
    docs = [(say(g.randint(1, 60)), g.choice(["en", "de"]), f"s{min(int(g.paretovariate(0.7)), 11)}") for _ in range(300)]
    docs += [(t, "fr", f"s{i}") for i, t in enumerate(ODD)] + [("ab ab", None, None), ("ab", None, "x"), ("AB1ab", "", ""), (None, "xx", "lonely"), ("solo solo", "en", "noterms")]
    table = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "cast(null as int) as doc_id")
    found = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows(divergence.audit(table, top=20, light=light, tile=tile, held=held)))
    assert found == brute_audit(docs, top=20)


def test_audit_of_nothing_and_of_nothing_kept(spark):
    table = spark.createDataFrame([], "text string, lang string, source string")
    assert rows(divergence.audit(table)) == []
    few = spark.createDataFrame([("a b", "en", "s1"), ("a c", "en", "s2")], "text string, lang string, source string")
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in rows(divergence.audit(few))) == [("s1", "s2", 0, 1), ("s2", "s1", 0, 1)]


def test_chances_pass_a_long_exactly(spark):
    n, total = [0, 8_999_999_999, 9_000_000_000, 10**12], [10, 10**10, 10**10, 10**13]
    want = [1 + 10**9 * (a + 1) // (b + 7) for a, b in zip(n, total, strict=True)]
    assert divergence._chances(np.array(n), np.array(total), 7).tolist() == want
    df = spark.createDataFrame(list(zip(n, total, strict=True)), "n long, total long").selectExpr("*", "7L as terms").withColumn("p", divergence.chance("n", "total", "terms"))
    assert [r["p"] for r in rows(df)] == want
