"""Top-k search, SimHash components and repeated passages against brute force, and on odd inputs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import ball_tree, simhash, substring_dedup
from lorekeep.llm.components import components

DOCS = "doc_id long, text string"


def brute_top(vectors, queries, k):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in whole:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(10_000, 1000), (40, 3)])
def test_top_k_is_exact(spark, shard_rows, block_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    base[50:120] = base[50]  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows[7] = (7, None)
    rows[10] = (10, [None, *rows[10][1][1:]])
    rows[20] = (20, [float("nan"), *rows[20][1][1:]])
    rows[30] = (30, [float("inf"), *rows[30][1][1:]])
    rows += [rows[40], (900, [1.0, 2.0]), (910, [3.0, 1.0])]  # a repeated row, and vectors of another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "rank": F.lit("x"), "dim": F.lit(0)})
    got = ball_tree.top_k(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard_rows, block_rows=block_rows)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, [i for i, _ in rows if i % 10 == 0], 5)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []


def test_tree_prunes_and_keeps_scores_beyond_doubles():
    x = np.array([[2**40, 1], [2**40, 2], [-(2**40), 5]])
    tree = ball_tree.build(np.arange(3), x)
    best, ids = ball_tree.search(tree, np.array([9]), np.array([[2**20, 1]]), 2, np.full(1, ball_tree.NONE))
    assert best.tolist() == [[2**60 + 2, 2**60 + 1]] and ids.tolist() == [[1, 0]]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    names = {i: i for i in fps}

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                names[b] = a
    return {i: root(i) for i in ids}


def near_texts(n):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(200)]
        out.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(200)] = "x"
            out.append(" ".join(base))
    return out


@pytest.mark.parametrize("bucket", [1, 24])
def test_simhash_components(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "JOINED_BUCKET", bucket)
    texts = [*near_texts(20), None, "", " \t ", "one", "One", "one two", "a b\tc\x0bd", "a b c D", "é à x", "É à x", "same text here again", "same text here again"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"fp": F.lit(1), "node": F.lit("n"), "component": F.lit(2)})
    got = {r["doc_id"]: r for r in simhash.report(df).collect()}
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_links_of_many_close_fingerprints(spark, monkeypatch):
    """A bucket beyond the joined size: the stars over cleared bits connect what all pairs would."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(26), rng.randint(0, 5))) for _ in range(120)}
    monkeypatch.setattr(simhash, "JOINED_BUCKET", 4)
    rows = [(i, simhash.signed(x)) for i, x in enumerate(sorted(fps))]
    found = components(simhash.links(spark.createDataFrame(rows, "node long, fp long"))).collect()
    want = brute_components({i: x % 2**64 for i, x in rows})
    assert {r["node"]: r["component"] for r in found} | {i: i for i in want if i not in {r["node"] for r in found}} == want


def test_one_of_each_keeps_columns_and_one_row(spark):
    text = "a long enough text to be itself"
    rows = [(3, text, "p"), (1, text, "q"), (1, text, "q"), (2, "another text altogether", "r"), (None, text, "s")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __gone string"))
    assert kept.columns == ["doc_id", "text", "__gone"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.one_of_each(empty).count() == 0 and simhash.report(empty).count() == 0


def test_one_of_each_judges_rows_that_share_an_id(spark):
    """Against a plain reimplementation: of each component the row with the smallest id and text hash, once."""
    a, b, c = (f"{x} long text of its own, unlike any of the others here {x} {x}" for x in ("alpha", "beta", "gamma"))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (7, c, 4), (7, b, 5), (6, c, 6), (None, c, 7), (8, None, 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"root": F.lit("r"), "fp": F.lit(0)})
    assert {(r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()} == {(1, a), (5, b), (6, c), (None, c), (8, None)}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 5
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.report(df).collect()}
    assert got[(5, f"{fingerprint(a):016x}")] == 1 and got[(5, f"{fingerprint(b):016x}")] == 5 and got[(7, f"{fingerprint(c):016x}")] == 6


def test_a_very_long_text_has_the_fingerprint_of_all_its_words(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_002))
    got = simhash.report(spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
    period = fingerprint(" ".join(text.split()[:5002]))  # the words recur, and so the hashes' shares are those of one period
    assert {r["fingerprint"] for r in got if r["doc_id"] == 1} == {f"{period:016x}"}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def cartesian_windows(values, t):
    """All nodes of the Cartesian tree (leftmost minimum) whose interval has t places or more."""
    out, todo = set(), [(0, len(values) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 < t:
            continue
        c = min(range(a, b + 1), key=lambda i: (values[i], i))
        out.add((a, c, b))
        todo += [(a, c - 1), (c + 1, b)]
    return out


def test_compact_windows_are_the_tree_nodes():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 2**63, size=500).astype(np.uint64)
    starts = np.array([0, 200, 210, 500])
    text, left, c, right, _ = substring_dedup.compact_windows(g, starts, 13, 4)
    from lorekeep.llm.textvec import mix

    h = mix(g ^ mix(np.array([5], dtype=np.uint64))[0])
    h = (h >> np.uint64(9)).tolist()  # the lowest bits hold the place
    for k in range(3):
        own = {(int(a), int(m), int(b)) for d, a, m, b in zip(text, left, c, right) if d == k}
        assert own == {(max(a, m - 12), m, min(b, m + 12)) for a, m, b in cartesian_windows(h[starts[k] : starts[k + 1]], 13)}


def passage(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(9)
    shared, near, short = passage(rng, 60), passage(rng, 120), passage(rng, 30)
    changed = near.split()
    changed[60] = "CHANGED"
    rows = []
    for i in range(40):
        parts = [passage(rng, rng.randint(80, 200)), passage(rng, 90)]
        if i % 4 == 0:
            parts.insert(1, shared)
        if i in (5, 9):
            parts.insert(1, near if i == 5 else " ".join(changed))
        if i % 2:
            parts.append(short)
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "few words only"), (None, shared), (103, rows[3][1]), (103, rows[3][1])]
    df = spark.createDataFrame(rows, DOCS).withColumns({"pair": F.lit(1), "sig": F.lit(2), "cells": F.lit(3)})
    found = substring_dedup.repeated_passages(df).collect()
    assert {r["doc_id"] for r in found} == {4, 8, 12, 16, 20, 24, 28, 32, 36, 9, 103}
    text = dict(rows)
    for r in found:
        own, src = text[r["doc_id"]].lower().split()[r["start"] : r["stop"]], text[r["source_id"]].lower().split()[r["source_start"] : r["source_stop"]]
        grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        assert len(own) >= 50 and len(grams(own) & grams(src)) >= 0.8 * len(grams(own) | grams(src))
    for i in range(4, 40, 4):
        where = text[i].lower().split().index(shared.split()[0])
        assert any(r["doc_id"] == i and r["start"] <= where and r["stop"] >= where + 60 for r in found)


def test_equal_passages_are_found_among_interleaved_versions(spark):
    rng = random.Random(7)
    rows = []
    for group in range(6):
        head, tail = passage(rng, 22), passage(rng, 22)
        versions = [f"{head} {passage(rng, 6)} {tail}" for _ in range(8)]
        for k, text in enumerate(versions * 2):
            rows.append((100 * group + k, f"{passage(rng, 60)}\n{text}\n{passage(rng, 60)}"))
    found = {(r["doc_id"], r["source_id"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(100 * g + k + 8, 100 * g + k) for g in range(6) for k in range(8)} <= found


def test_passages_with_words_put_in_are_found_whole(spark):
    rng = random.Random(8)
    short, long = passage(rng, 95).split(), passage(rng, 300).split()
    rows = []
    for k, (w, at, more) in enumerate([(short, 48, 8), (long, 260, 40)]):
        put_in = [*w[:at], *passage(rng, more).split(), *w[at:]]
        rows += [(10 * k + i, f"{passage(rng, 70)}\n{' '.join(x)}\n{passage(rng, 70)}") for i, x in enumerate((w, put_in))]
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: (r["start"], r["stop"]) for i, r in found.items()} == {1: (70, 173), 11: (70, 410)}
    assert found[1]["similarity"] == pytest.approx(87 / 103)


@pytest.mark.parametrize("times", [(10, 30), (5, 30), (30, 10)])
def test_longer_stretches_of_a_repeated_line_are_covered(spark, times):
    rng = random.Random(6)
    line = passage(rng, 12)
    rows = [(i, "\n".join([passage(rng, 70), *[line] * n, passage(rng, 70)])) for i, n in enumerate(times)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    covered = {w for r in found for w in range(r["start"], r["stop"])}
    assert covered == set(range(70, 70 + 12 * times[1]))


def test_cut_passages_leaves_the_first_and_counts_characters(spark):
    rng = random.Random(4)
    shared = passage(rng, 70)
    a, b, c = passage(rng, 20), passage(rng, 20), "short and clean é"
    rows = [(1, f"{a}\n{shared}\nstop", 5, "x"), (2, f"{b}\n{shared}\nEnd here", 6, "y"), (3, c, len(c), "z"), (None, None, None, None)]
    out = substring_dedup.cut_passages(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __spans string"))
    assert out.columns == ["doc_id", "text", "n_chars", "__spans"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == c and got[None]["text"] is None
    assert got[2]["text"] == f"{b}\nEnd here" and got[2]["n_chars"] == len(got[2]["text"])


def test_rows_that_share_an_id_are_cut_each_at_its_own_places(spark):
    rng = random.Random(14)
    shared, other, tail = passage(rng, 70), passage(rng, 80), passage(rng, 10)
    first = (1, f"{passage(rng, 60)}\n{shared}")
    repeats, clean = f"{tail}\n{shared}", f"zz {other}"
    for texts in ([repeats, clean], [clean, repeats], [clean, repeats, repeats]):
        rows = [first, *((2, t) for t in texts), (3, None)]
        got = sorted((r["doc_id"], r["text"] or "") for r in substring_dedup.cut_passages(spark.createDataFrame(rows, DOCS)).collect())
        assert got == sorted([first, *((2, f"{tail}\n" if t == repeats else t) for t in texts), (3, "")])


@pytest.mark.parametrize("local,hot", [(64, "all"), (2, "none"), (2, "all")])
def test_how_rows_are_dealt_out_changes_nothing(spark, monkeypatch, local, hot):
    """Links that a batch makes by itself, and frames dealt out one by one, cover what the plain way covers."""
    rng = random.Random(15)
    line, shared = passage(rng, 14), [passage(rng, 70) for _ in range(3)]
    rows = []
    for i in range(60):
        middle = shared[i % 5] if i % 5 < 3 else passage(rng, 30)
        rows.append((i, f"{passage(rng, 60)}\n{line}\n{middle}\n{passage(rng, 60)}"))
    df = spark.createDataFrame(rows, DOCS).coalesce(2)
    want = {5 * k + j for k in range(1, 12) for j in range(3)}
    t = substring_dedup.PASSAGE_WORDS - substring_dedup.SHINGLE + 1
    documents = substring_dedup.distinct_documents(df, "doc_id", "text")
    often = substring_dedup.hot_signatures(documents, 60, t, least=1 if hot == "all" else 1000)
    assert bool(often) == (hot == "all")
    monkeypatch.setattr(substring_dedup, "LOCAL_GROUP", local)
    found = substring_dedup.repeated_passages(df, hot=often).collect()
    assert {r["doc_id"] for r in found} == want
    for i in want:  # a row's source may have a part of the passage only; one at least has all of it
        where = rows[i][1].split().index(shared[i % 5].split()[0])
        assert any(r["doc_id"] == i and r["start"] <= where and r["stop"] >= where + 70 for r in found)


def test_recall_of_near_passages_against_all_pairs(spark):
    """Versions of one passage, each with words of its own, in documents that interleave: of the documents that all pairs
    show to repeat an earlier passage at a similarity of 0.8, at least 0.9 are found."""
    rng = random.Random(16)
    versions = []
    for group in range(6):
        base = passage(rng, 150).split()
        for _ in range(10):
            own = list(base)
            for at in rng.sample(range(150), rng.choice([1, 1, 2])):
                own[at] = passage(rng, 1)
            versions.append((group, own))
    rng.shuffle(versions)
    rows = [(i, f"{passage(rng, 50)}\n{' '.join(v)}\n{passage(rng, 50)}") for i, (_, v) in enumerate(versions)]
    grams = [{tuple(v[k : k + 5]) for k in range(146)} for _, v in versions]
    alike = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8
    want = {i for i in range(len(rows)) if any(versions[j][0] == versions[i][0] and alike(i, j) for j in range(i))}
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect() if r["n_words"] >= 100}
    assert len(want) >= 45 and found <= set(range(len(rows))) and len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("families,members,few", [(8, 2, 16), (20, 4, 4)])
def test_versions_between_others_are_found_as_all_pairs_find_them(spark, monkeypatch, families, members, few):
    """Versions of one passage, shuffled: families differ in two words, members in one more. Every word that all pairs of
    texts show to repeat is found, by pairs of a signature and, where it has more than ``few`` anchors, by classes."""
    monkeypatch.setattr(substring_dedup, "FEW", few, raising=False)
    rng = random.Random(families // 8)

    def changed(words, at):
        return [passage(rng, 1) if k in at else w for k, w in enumerate(words)]

    base, versions = passage(rng, 56).split(), []
    for _ in range(families):
        family = changed(base, rng.sample(range(56), 2))
        versions += [changed(family, [rng.choice([0, 1, 54, 55, rng.randrange(56)])] if m else []) for m in range(members)]
    rng.shuffle(versions)
    rows = [(i, " ".join([passage(rng, 60), *v, passage(rng, 60)])) for i, v in enumerate(versions)]
    g = [substring_dedup.text_shingles([x.encode()])[0].astype(np.uint32).view(np.int32) for _, x in rows]
    want = {(i, w) for i in range(len(rows)) for j in range(i) for a, b, *_ in substring_dedup.passages(g[i], g[j], 0, 46, 0.8) for w in range(a, b + 5)}
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert want and want <= {(r["doc_id"], w) for r in found for w in range(r["start"], r["stop"])}


def test_versions_that_all_differ_are_linked_in_proportion(spark):
    """Versions of one passage, each with changes of its own at few places, so that many share a change: links are only made
    where they add to what others show, and every word that all pairs show to repeat is found."""
    rng = random.Random(18)
    base, t = passage(rng, 60).split(), 46
    other = [passage(rng, 2).split() for _ in base]
    rows = [(i, " ".join([rng.choice(other[k]) if rng.random() < 0.03 else w for k, w in enumerate(base)])) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).coalesce(4)
    assert substring_dedup.near_links(df.withColumn("variant", F.lit(0).cast("long")), t, 5).count() <= 9 * len(rows)
    g = [substring_dedup.text_shingles([x.encode()])[0].astype(np.uint32).view(np.int32) for _, x in rows]
    want = {(i, w) for i in range(len(rows)) for j in range(i) for a, b, *_ in substring_dedup.passages(g[i], g[j], 0, t, 0.8) for w in range(a, b + 5)}
    found = substring_dedup.repeated_passages(df).collect()
    assert want and want <= {(r["doc_id"], w) for r in found for w in range(r["start"], r["stop"])}


def test_no_passages_in_nothing(spark):
    assert substring_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_words_hash_alike_wherever_they_stand():
    from lorekeep.llm.textvec import Words, shingles

    w = Words([b"", b" Alpha beta\tgamma ", "é alpha\x0bBETA gamma".encode(), b"x" * 5000])
    assert np.diff(w.first).tolist() == [0, 3, 4, 1]
    h = w.hashes()
    assert h[0] == h[4] and h[1] == h[5] and h[2] == h[6] and len(set(h.tolist())) == 5
    assert shingles(h, 3)[0] == shingles(h, 3)[4]


def test_signatures_that_batches_cut_are_linked(spark):
    """Batches of a few rows: equal frames that lie in several of them are found by the frame itself."""
    rng = random.Random(17)
    shared = passage(rng, 60)
    rows = [(i, f"{passage(rng, 20)}\n{shared}\n{passage(rng, 20)}") for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS).coalesce(1), hot=[]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i for i in range(1, 40) if any(r["doc_id"] == i and r["start"] <= 20 and r["stop"] >= 80 for r in found)} == set(range(1, 40))
    own, more, src = substring_dedup.joined_runs([np.array([1, 1, 1, 1]), np.zeros(4, int), np.array([7, 5, 6, 9])], [np.zeros(4, int), np.zeros(4, int), np.array([3, 1, 2, 5])])
    assert own[2].tolist() == [5, 9] and more.tolist() == [2, 0] and src[2].tolist() == [1, 5]


def test_similarity_of_passages_is_that_of_their_different_shingles():
    rng, held = np.random.default_rng(3), 0
    for k in range(200):
        kinds = (60, 10_000)[k % 2]  # with repeats, and nearly without
        shared = rng.integers(0, kinds, 60)
        own, src = (np.concatenate([rng.integers(0, kinds, n), shared, rng.integers(0, kinds, n)]) for n in rng.integers(0, 40, 2))
        src[rng.integers(0, len(src), 4)] = kinds
        found = substring_dedup.passages(own, src, int(rng.integers(-20, 20)), 30, 0.8)
        held += bool(found)
        for a, b, sa, sb, alike in found:
            x, y = set(own[a : b + 1].tolist()), set(src[sa : sb + 1].tolist())
            assert alike == len(x & y) / len(x | y) >= 0.8
    assert held > 100


def test_a_stretch_counts_whole_on_any_diagonal():
    line = np.arange(12)
    own, src = (np.concatenate([before + np.arange(70), np.tile(line, n), before + np.arange(100, 170)]) for before, n in ((1000, 30), (2000, 10)))
    for shift in range(-120, 300, 12):
        found = substring_dedup.passages(own, src, shift, 46, 0.8)
        assert {w for a, b, *_ in found for w in range(a, b + 1)} == set(range(70, 430)), shift


def test_partners_that_share_too_little_are_left_alone_though_shingles_repeat(monkeypatch):
    t, calls = 46, []
    n = 2 * t + substring_dedup.ANCHOR
    rng = np.random.default_rng(4)
    passages = substring_dedup.passages
    monkeypatch.setattr(substring_dedup, "passages", lambda *x: calls.append(1) or passages(*x))
    edge = substring_dedup.EDGE
    own = rng.integers(1, 1 << 30, n)
    own[5] = own[9]  # a repeat
    wide = np.concatenate([np.zeros(edge, dtype=np.int64), own, np.zeros(edge, dtype=np.int64)])
    others = np.repeat(wide[None], 50, axis=0)
    others[:, edge : edge + n : 2] = rng.integers(1, 1 << 30, (50, (n + 1) // 2))  # each second shingle is another
    others[7] = wide
    src = [np.arange(50), np.zeros(50, dtype=np.int64), np.zeros(50, dtype=np.int64)]
    row, at = substring_dedup.partners([np.array([99]), np.array([0]), np.array([0])], wide[None], np.zeros((1, n + 4), dtype=bool), src, others, t)
    assert (row.tolist(), at.tolist()) == ([0], [7]) and len(calls) <= 2


@pytest.mark.parametrize("places", [substring_dedup.CLASS_PLACES, 500])
def test_classes_of_many_documents_are_told_apart_together(monkeypatch, places):
    import pyarrow as pa

    t, rng, calls = 46, np.random.default_rng(5), []
    rows = []
    for i in range(200):
        c = int(rng.integers(0, 300))
        place = np.arange(max(0, c - t), c + t + substring_dedup.ANCHOR)
        h = place - c + (0 if i % 3 else 10_000 * i)
        on = rng.random(len(place)) < 0.97
        rows.append({"doc_id": i, "variant": i % 2, "asked": [{"sig": 5, "c": c}, {"sig": 6, "c": c + 1}], "got": [{"place": int(p), "h": int(x)} for p, x in zip(place[on], h[on], strict=True)]})
    item = lambda *names: pa.list_(pa.struct([(x, pa.int64()) for x in names]))
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), ("asked", item("sig", "c")), ("got", item("place", "h"))]))
    result = lambda b: [r for x in substring_dedup.class_rows(b, t) for r in x.to_pylist()]
    single = [r for k in range(len(batch)) for r in result(batch.slice(k, 1))]
    assert len(single) > 300
    mix = substring_dedup.mix
    monkeypatch.setattr(substring_dedup, "mix", lambda x: calls.append(1) or mix(x))
    monkeypatch.setattr(substring_dedup, "CLASS_PLACES", places)
    assert result(batch) == single
    assert places == 500 or len(calls) <= 2 * (2 * t + substring_dedup.ANCHOR)
