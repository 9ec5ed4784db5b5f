"""The registered queries over the smallest tables: against SQL where there is SQL, row by row in count otherwise; and the pipeline's stages."""

import os
import random
from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest
from test_corpus_operators import say
from test_text_operators import brute_contamination

import corpus_pipeline
from atlasfold.llm import pieces, queries

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
needs = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


def rows(df):
    return [r.asDict() for r in df.collect()]


@needs
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries.queries()[name](spark, str(SF))
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name in queries.oracle_sql():
        found = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, got)) == sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in found.fetchall())
    elif name != "op9_passages":
        assert len(got) == con.execute("select count(*) from documents").fetchall()[0][0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    g = random.Random(1)
    d = tmp_path_factory.mktemp("tables")
    items = [(i, say(g, 14)) for i in range(3)]  # short of a run, so that the passages stage leaves the leaks to the next
    docs, labels, plant = [], [], {"toxic": set(), "copy": set(), "leak": set(), "repeat": set()}
    shared = say(g, 80)

    def add(text, kind=None):
        i = len(docs)
        docs.append((i, text, "en", "src1", len(text)))
        if kind:
            plant[kind].add(i)
        return i

    for k in range(240):
        t = "\n".join(say(g, g.randint(20, 60)) + "." for _ in range(4))
        bad = k % 6 == 0
        i = add(t + (f" You xidiot xclown {say(g, 3)}." if bad else ""), "toxic" if bad else None)
        labels.append((i, 1, int(bad)))
        if not bad and k % 10 == 1:
            add(t, "copy")
        if not bad and k % 25 == 2:
            add(say(g, 50) + " " + items[k % 3][1] + " " + say(g, 50), "leak")
        if k % 40 == 3:
            i = add(f"{say(g, 60)} {shared} {say(g, 60)}")
            plant["repeat"].add(i)
    plant["repeat"].discard(min(plant["repeat"]))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), {x[0]: x[1] for x in docs}, items, plant


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def test_stages_take_effect_and_keep_the_rest(spark, tables):
    d, texts, items, plant = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, set(texts)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        before = {r["doc_id"]: r["text"] for r in rows(docs)}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            path = f"{d}/{name}.parquet"
            out.write.parquet(path)
            out = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in rows(out)}
        if name == "toxicity":
            assert len(plant["toxic"] & set(after)) <= 1 and set(after) >= left - plant["toxic"]
        elif name == "simhash":
            sets = {i: shingles(t) for i, t in before.items()}
            gone = set(before) - set(after)
            assert gone >= plant["copy"] and all(any(alike(sets[i], sets[j]) >= 0.8 for j in before if j != i) for i in gone)
            assert all(alike(sets[i], sets[j]) < 0.8 for i in after for j in after if i < j)
        elif name == "passages":
            assert set(after) == set(before) and all(after[i]["text"] == before[i] for i in before if i not in plant["repeat"])
            assert all(len(after[i]["text"]) < len(before[i]) - 100 for i in plant["repeat"] & set(after))
        elif name == "decontamination":
            hit = {i for i, (_, n, _) in brute_contamination(before.items(), items).items() if n}
            assert hit == plant["leak"] & set(before) and set(after) == set(before) - hit
        else:
            codec = pieces.Codec(P.path("piece_bpe_32k.model"))
            assert {i: codec.decode(r["ids"]) for i, r in after.items()} == before and all(r["intact"] for r in after.values())
        docs, left = out, set(after)


def test_run_chains_the_stages(spark, tables):
    d, texts, _, plant = tables
    found = {r["doc_id"] for r in rows(corpus_pipeline.run(spark, d))}
    assert found <= set(texts) - plant["copy"] - plant["leak"] and len(found) >= len(texts) - sum(map(len, plant.values()))
