"""The pipeline against a plain reimplementation of its stages, and on odd and empty tables."""

import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    def make(rows, labels):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/sf/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/sf/labels.parquet")
        return f"{tmp_path}/sf"

    return make


def test_stages_take_effect(spark, tables):
    rng = random.Random(1)
    shared = words(rng, 70)
    texts = {i: words(rng, rng.randint(60, 200)) for i in range(200)}
    for i in range(0, 200, 4):  # toxic, and marked so
        w = texts[i].split()
        for k in range(4):
            w.insert(10 * k, rng.choice(["dolt", "you dolt", "wretch"]))
        texts[i] = " ".join(w)
    kept = dict(texts)
    for i in range(0, 200, 4):
        del kept[i]
    texts |= {300: texts[3], 301: texts[3], 302: "few words", 303: " ".join(f"{w}#*" for w in texts[5].split()), 304: None, 305: "", 306: "z " * 30_000, 307: words(rng, 20_000)}
    kept[307] = texts[307]
    head = {308: words(rng, 60), 309: words(rng, 65)}
    texts |= {i: f"{h}\n{shared}" for i, h in head.items()}
    kept |= {308: texts[308], 309: head[309] + "\n"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(308, texts[308], "en", "s", 1)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    sf = tables(rows, labels)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == COLUMNS, name
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and docs.count() == len(kept)
    out = corpus_pipeline.run(spark, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in kept.items()}
    lengths: dict[int, int] = {}
    for r in out:
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) == r["ids_crc32"]
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(x) for i, x in want.items()}
    assert len({r["sequence_id"] for r in out}) <= -(-sum(lengths.values()) // 4096) + 1


def test_clean_documents_stay_whole(spark, tables):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(60, 150)), "en", "s", 1) for i in range(40)] + [(None, words(rng, 80), "en", "s", 1)]
    sf = tables(rows, [])
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert sorted((re.sub("None", "", str(r["doc_id"])), r["text"]) for r in docs.collect()) == sorted((str(i) if i is not None else "", t) for i, t, *_ in rows)


def test_rows_that_share_an_id_and_extra_columns(spark, tables):
    """Several texts under one id, and columns with the stages' own names, against a plain reimplementation."""
    rng = random.Random(3)
    a, b, c, shared = words(rng, 80), words(rng, 90), words(rng, 100), words(rng, 70)
    rows = [(1, a), (5, a), (5, b), (5, b), (6, f"{c}\n{shared}"), (7, f"{words(rng, 60)}\n{shared}"), (7, words(rng, 60)), (None, a), (8, None)]
    kept = [(1, a), (5, b), (6, rows[4][1]), (7, rows[5][1][: -len(shared)]), (7, rows[6][1]), (None, a)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    sf = tables(rows, [])
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.selectExpr("*", "'x' AS root", "1 AS variant", "'y' AS __id", "2 AS __hash", "3 AS start")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert sorted(((r["doc_id"] or 0), r["text"], r["root"], r["start"]) for r in docs.collect()) == sorted((i or 0, t, "x", 3) for i, t in kept)


def test_empty_tables(spark, tables):
    out = corpus_pipeline.run(spark, tables([], []))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "piece"]
