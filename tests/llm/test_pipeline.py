"""The pipeline, stage by stage, against plain Python; and op1 to op10 on whole small tables against DuckDB."""

import glob
import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotelake.llm import mixing, queries, sentencepiece_fst, simhash
from quotelake.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = materialize(spark, spark.read.parquet(f"{small}/documents.parquet"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(spark, stage(spark, out[-1], small)))
    return [d.toPandas() for d in out]


def test_stages_are_named_and_keep_their_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert all(list(d.columns) == list(stages[0].columns) for d in stages[:-1])


def test_filters_keep_rows_as_they_were(stages):
    first = dict(zip(stages[0]["doc_id"], stages[0]["text"], strict=True))
    for d in stages[1:3]:
        assert all(first[i] == t for i, t in zip(d["doc_id"], d["text"], strict=True))
    assert 0 < len(stages[2]) < len(stages[1]) < len(stages[0])


def test_near_copies_go_and_others_stay(stages):
    before, after = stages[1], set(stages[2]["doc_id"])
    shingles = {}
    for i, t in zip(before["doc_id"], before["text"], strict=True):
        w = WORD.findall(t.lower())
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(shingles)
    like = {i: 0.0 for i in ids}
    for a in ids:
        for b in ids:
            if b < a:
                s = len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
                like[a] = max(like[a], s)
    assert all(i not in after for i in ids if like[i] >= 0.85)
    assert all(i in after for i in ids if like[i] < 0.5)


def test_repeated_passages_go(stages):
    first = {}
    for i, t in zip(stages[2]["doc_id"], stages[2]["text"], strict=True):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    after = dict(zip(stages[3]["doc_id"], stages[3]["text"], strict=True))
    for i, t in zip(stages[2]["doc_id"], stages[2]["text"], strict=True):
        w = WORD.findall(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        assert WORD.findall(after.get(i, "")) == kept
        if not gone:
            assert after[i] == t


def test_mix_meets_targets_and_tokens_follow(stages):
    mixed = stages[4]
    assert mixed["doc_id"].value_counts().max() <= 2 and set(mixed["doc_id"]) <= set(stages[3]["doc_id"])
    words = lambda d: sum(len(WORD.findall(t)) for t in d["text"])
    assert abs(words(mixed) / words(stages[3]) - 1.5) < 0.2
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    text = dict(zip(mixed["doc_id"], mixed["text"], strict=True))
    assert len(stages[5]) == len(mixed)
    assert all(list(ids) == sp.encode(text[i]) for i, ids in zip(stages[5]["doc_id"], stages[5]["ids"], strict=True))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.queries()[name](spark, small).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # a nullable column of integers may come as floats
    plain = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[columns].astype(object).to_numpy().tolist()), key=repr)
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def brute_components(texts):
    """Smallest id reachable by pairs of similarity 0.8 or more of distinct five-word shingles, by an inverted index in plain Python."""
    sets = {}
    for i, t in texts.items():
        words = WORD.findall((t or "").encode().lower().decode())  # A-Z only
        sets[i] = frozenset(" ".join(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([" ".join(words)])
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = 0
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                pairs += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}, pairs


def test_near_dedup_misses_no_pair_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, pairs = brute_components({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark, docs.select("doc_id", "text"), 0.8).collect()}
    assert got == want and pairs > 80


@pytest.mark.parametrize("rows", [[], [(1, None, "en", None, 0)], [(None, None, None, None, None), (None, "", "en", "s", 0), (3, "  ", "fr", "s", 2), (3, "  ", "fr", "s", 2), (4, "word " * 80, "en", None, 400), (5, "word " * 80, "en", "t", 400)]])
def test_stages_on_empty_and_odd_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = materialize(spark, stage(spark, docs, str(tmp_path)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() <= 2 * before
    assert docs.columns[:2] == ["doc_id", "n_tokens"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_mixing_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "s" if i % 3 else None, 1, 2, 3) for i in range(60)], "doc_id long, text string, source string, __rate int, __copies int, __size int")
    mixed = mixing.mix_documents(spark, docs)
    assert mixed.columns == docs.columns and {(r["__rate"], r["__copies"], r["__size"]) for r in mixed.collect()} == {(1, 2, 3)}
    sizes = docs.select("doc_id", "source", F.lit(3).cast("long").alias("size"), "__rate")
    assert {r["__rate"] for r in mixing.mix_sources(spark, sizes).collect()} == {1}
