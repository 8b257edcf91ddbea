"""Retrieval, store, graph and analytics on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import embed
from lorekeep.functions import text as T
from lorekeep.operators import analytics as A
from lorekeep.operators import graph as G
from lorekeep.operators import resolve as R
from lorekeep.operators import retrieval as S
from lorekeep.operators import store as K

CHUNK = "chunk_id long, file_path string, content string, token_count int, signal_meta string, embedding array<double>"
EDGE = "from_node string, to_node string, kind string, weight double, metadata string"
NODE = "id string, kind string, label string, source_path string, metadata string, line_number int"


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, k, 1.0, "{}") for a, b, k in rows], EDGE)


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, k, label, p, "{}", 0) for i, k, label, p in rows], NODE)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i + 1, f"d{i}.md", f"filler text number {i} about the weather and gardens", 10, "{}", [math.cos(0.08 * (i + 1)), math.sin(0.08 * (i + 1)), 0.0, 0.0]) for i in range(11)]
    rows.append((12, "h.md", "the computeHash function hashes a file", 10, "{}", [0.0, 0.0, 0.0, 1.0]))
    return spark.createDataFrame(rows, CHUNK)


def test_hybrid_finds_a_literal_that_vectors_miss(corpus):
    q = [1.0, 0.0, 0.0, 0.0]
    assert [r["chunk_id"] for r in S.search_chunks(corpus, q, 4).collect()] == [1, 2, 3, 4]
    assert S.hybrid_search(corpus, q, "computeHash", 4).first()["chunk_id"] == 12
    assert [r["chunk_id"] for r in S.hybrid_search(corpus, q, '*()"', 4).collect()] == [1, 2, 3, 4]


def test_equal_scores_go_by_id_and_copies_fold(spark):
    rows = [(i, f"f{i}.md", "same words", 5, "{}", [1.0, 0.0]) for i in (3, 1, 2)]
    out = S.search_chunks(spark.createDataFrame(rows, CHUNK), [1.0, 0.0], 5).collect()
    assert [(r["chunk_id"], r["duplicate_paths"]) for r in out] == [(1, ["f2.md", "f3.md"])]


def test_rerank_and_its_failures(corpus):
    class Backwards:
        def scores(self, query, texts):
            return list(range(len(texts)))

    class Short:
        def scores(self, query, texts):
            return [1.0]

    class Broken:
        def scores(self, query, texts):
            raise TimeoutError

    q = [1.0, 0.0, 0.0, 0.0]
    order = lambda r: [x["chunk_id"] for x in S.hybrid_search(corpus, q, "weather", 3, rerank=r).collect()]
    plain = order(None)
    assert order(embed.reranked("q", Backwards())) != plain
    assert order(embed.reranked("q", Short())) == order(embed.reranked("q", Broken())) == plain


@pytest.mark.parametrize("rows,budget,kept", [([(400, "")] * 4, 1000, 2), ([(400, "")] * 5, 0, 5), ([(100, "")], -1, 1), ([(500, ""), (500, ""), (1, "")], 1000, 2), ([(0, "one two three")] * 3, 9, 2), ([(500, ""), (0, "one two three"), (500, "")], 505, 2), ([], 1000, 0), ([(400, ""), (700, ""), (100, "")], 600, 1)])
def test_token_budget(spark, rows, budget, kept):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows, 1)], "rank int, token_count int, content string")
    assert S.token_budget(df, budget).count() == kept


def test_boost(spark):
    metas = ['{"inline_labels":["warning","note"],"risk_markers":["unsafe"]}', "{}", "", "no json", '{"todos":["a"],"rationale":["b"]}', '{"risk_markers":["a","b","c","d","e","f"]}']
    df = spark.createDataFrame([(m,) for m in metas], "m string").select(T.metadata_boost(F.col("m")).alias("b"))
    assert [round(r["b"], 6) for r in df.collect()] == [0.6, 0, 0, 0, 0.1, 1.0]


def test_paths(spark):
    e = edges_of(spark, [("doc:a", "doc:b", "m"), ("doc:b", "doc:c", "m"), ("doc:a", "doc:d", "m"), ("file:a|b.go", "file:a,b.go", "m"), ("file:a,b.go", "file:a>b.go", "m"), ("file:a>b.go", "file:a_b%c.go", "m"), ("x", "p", "m"), ("x", "o", "m"), ("o", "z", "m"), ("p", "z", "m")])
    path = lambda a, b, d=6: [(r["from_node"], r["to_node"]) for r in G.shortest_path(e, a, b, d).orderBy("step").collect()]
    assert path("doc:a", "doc:c") == [("doc:a", "doc:b"), ("doc:b", "doc:c")]
    assert len(path("file:a|b.go", "file:a_b%c.go")) == 3
    assert path("doc:a", "doc:a") == path("doc:c", "doc:a") == path("doc:a", "doc:c", 1) == []
    assert path("x", "z") == [("x", "o"), ("o", "z")]


def test_neighbors_bind_kinds_both_ways(spark):
    e = edges_of(spark, [("Child", "Base", "inherits"), ("Child", "Iface", "inherits"), ("Child", "Base", "call"), ("User", "Child", "call")])
    count = lambda *a: G.neighbors(e, "Child", *a).count()
    assert (count("out"), count("out", ["inherits"]), count("out", ["none"]), count("both", ["inherits"]), count("in")) == (3, 2, 0, 2, 1)


def test_orphans_affected_and_related(spark):
    n = nodes_of(spark, [("sym:Base", "symbol", "Base", "base.py"), ("sym:A", "symbol", "A", "child_a.py"), ("sym:B", "symbol", "B", "child_b.py"), ("sym:X", "symbol", "X", "x.py"), ("sym:In", "symbol", "In", "base.py"), ("doc:1", "document", "D", "d")])
    e = edges_of(spark, [("sym:A", "sym:Base", "inherits"), ("sym:B", "sym:Base", "inherits"), ("sym:In", "sym:Base", "call")])
    assert {r["source_path"] for r in G.affected_paths(n, e, "base.py").collect()} == {"child_a.py", "child_b.py"}
    assert {r["id"] for r in G.orphans(n, e, ["symbol"]).collect()} == {"sym:X"}
    docs = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], "id string, title string")
    shared = edges_of(spark, [("doc:1", "doc:2", "shared_code_ref"), ("doc:3", "doc:1", "shared_code_ref"), ("doc:1", "doc:3", "mentions")])
    assert [r["id"] for r in G.related_documents(docs, shared, "1").collect()] == ["3", "2"]


def test_find_and_resolve(spark):
    n = nodes_of(spark, [("sym:a.B", "symbol", "100% b_c", "x/Y.go"), ("file:q", "code_file", "q", "q"), ("sym:q", "symbol", "zz", None)])
    ids = lambda q: [r["id"] for r in G.find_nodes(n, q).collect()]
    assert ids("0% B") == ["sym:a.B"] and ids("b%c") == [] and ids("y.GO") == ["sym:a.B"] and ids("file:q")[0] == "file:q"
    assert G.resolve_node(n, "a.B") == "sym:a.B"
    with pytest.raises(G.Ambiguous):
        G.resolve_node(n, "q")
    with pytest.raises(KeyError):
        G.resolve_node(n, "nothing here")


def triangles(spark):
    e = edges_of(spark, [(f"doc:{p}{a}", f"doc:{p}{b}", "mentions") for p in "ab" for a, b in ((1, 2), (2, 3), (3, 1))] + [("doc:a1", "doc:b1", "shared_code_ref")])
    return nodes_of(spark, [(f"doc:{p}{k}", "document", f"{p}{k}", "") for p in "ab" for k in (1, 2, 3)]), e


def test_two_triangles(spark):
    n, e = triangles(spark)
    c = A.communities(n, e)
    groups = {}
    for r in c.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [["doc:a1", "doc:a2", "doc:a3"], ["doc:b1", "doc:b2", "doc:b3"]]
    top = A.surprising(e, c).collect()
    assert [(r["from_node"], r["to_node"]) for r in top] == [("doc:a1", "doc:b1")] and abs(top[0]["score"] - 1 / 3) < 1e-6
    gods = A.god_nodes(n, e)
    assert [r["id"] for r in gods.collect()][:2] == ["doc:a1", "doc:b1"]
    asked = [r["kind"] for r in A.questions(gods, c, A.surprising(e, c), A.community_labels(c, e, n)).collect()]
    assert asked == ["god_pair", "bridge", "cluster_tour", "cluster_tour"]


def test_communities_of_known_and_of_random_graphs(spark):
    import random

    # cliques in a ring; a node without edges; loops, repeated and reversed edges; an edge of an unknown node
    cliques = [(f"c{k}n{a}", f"c{k}n{b}") for k in range(6) for a in range(5) for b in range(a)]
    ring = [(f"c{k}n0", f"c{(k + 1) % 6}n1") for k in range(6)]
    rng = random.Random(7)
    chance = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    extra = [("c0n0", "c0n0"), ("c0n0", "c0n1"), ("c0n1", "c0n0"), ("c0n0", "unknown")]
    names = sorted({x for pair in cliques for x in pair}) + ["alone"] + [f"r{x}" for x in range(40)]
    e = edges_of(spark, [(a, b, "mentions") for a, b in cliques + ring + extra + [(f"r{a}", f"r{b}") for a, b in chance]])
    got = {r["id"]: r["community"] for r in A.communities(nodes_of(spark, [(x, "document", x, "") for x in names]), e).collect()}
    assert sorted(got) == sorted(names) and got["alone"] == "alone"
    assert all(got[x] == f"{x[:2]}n0" for x in names if x[0] == "c")
    assert all(min(x for x in got if got[x] == c) == c for c in set(got.values()))
    pairs = cliques + ring + [(f"r{a}", f"r{b}") for a, b in chance]
    degree, between = {}, {}
    for a, b in pairs:
        for x in (a, b):
            degree[got[x]] = degree.get(got[x], 0) + 1
        if got[a] != got[b]:
            key = tuple(sorted((got[a], got[b])))
            between[key] = between.get(key, 0) + 1
    m = len(pairs)
    assert all(w / m - degree[a] * degree[b] / (2 * m * m) <= 1e-5 for (a, b), w in between.items())  # no two would gain as one


def test_communities_without_edges(spark):
    n, e = triangles(spark)
    assert {(r["id"], r["community"]) for r in A.communities(n, e.where("false")).collect()} == {(r["id"], r["id"]) for r in n.collect()}
    assert A.communities(n.where("false"), e).count() == 0


def test_greedy_clusters_follow_the_order(spark):
    rows = [("aaa", [1.0, 0.0]), ("bbb", [0.0, 1.0]), ("ccc", [1.0, 0.0]), ("ddd", [0.0, 0.0]), ("eee", None)]
    got = {r["id"]: r["anchor"] for r in A.greedy_clusters(spark.createDataFrame(rows, "id string, embedding array<double>"), 0.85).collect()}
    assert got == {"aaa": "aaa", "bbb": "bbb", "ccc": "aaa", "ddd": "ddd", "eee": "eee"}


def test_store(spark, tmp_path):
    s = K.Store(spark, f"file://{tmp_path}/store")
    assert s.read("t") is None
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    s.write(t=one)
    s.write(t=K.upsert(s.read("t"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]), u=one)
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")] and s.read("u").count() == 2
    rows = spark.createDataFrame([("a", "b", "k", 0.0, "", 1), ("a", "b", "k", 2.0, "{}", 2), ("a", "c", "k", 0.0, "", 1)], EDGE + ", seq int")
    assert sorted((r["to_node"], r["weight"], r["metadata"]) for r in K.upsert_edges(rows, "seq").collect()) == [("b", 2.0, "{}"), ("c", 1.0, "{}")]


def test_model_swap_is_refused():
    meta = embed.check_model({}, "a", 4)
    assert embed.check_model(meta, "a", 4) == meta
    for model, dim in (("b", 4), ("a", 8)):
        with pytest.raises(ValueError):
            embed.check_model(meta, model, dim)


def test_embedding_retries_and_falls_back():
    class Flaky(embed.HashEmbedder):
        calls = 0

        def embed_batch(self, texts):
            self.calls += 1
            if self.calls == 1:
                raise embed.Busy
            if len(texts) > 1 or texts == ["bad"]:
                raise ValueError
            return super().embed_batch(texts)

    out = embed.embed_all(Flaky(4), ["x", "bad", "y"], sleep=lambda s: None)
    assert [v is None for v in out] == [False, True, False]


def test_generated_banners(spark):
    cases = ["// Code generated by x. DO NOT EDIT.\npackage a", "﻿// Code generated by x. DO NOT EDIT.\r\n", "// @generated\n", "# Generated by x. DO NOT EDIT.", "<!-- Generated by x -->", "x" * 1100 + "\n// @generated\n", "plain"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", T.is_generated(F.col("c")).alias("g"))
    assert [r["g"] for r in df.orderBy("i").collect()] == [True] * 5 + [False] * 2


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(T.token_estimate(F.lit(s))) for s in ("", "x", "a b c", "a b　c d")] == [0, 1, 4, 5]
    assert one(T.slug(F.lit("  What is: the Point? "))) == "what-is-the-point"
    assert one(T.match_query(F.lit('search_docs "compute*" ()'))) == '"search_docs" OR "compute"'
    assert one(T.answer(F.lit("a" * 250 + ". " + "b" * 100))) == "a" * 250 + "."
    assert one(T.display_id(F.lit("sym:a.b"))) == "a.b" and one(T.short_name(F.lit("a.b.C"))) == "C" and one(T.package_of(F.lit("C"))) == ""
    assert one(T.has_path_prefix(F.lit("gen/go/x"), F.lit("gen/go"))) and not one(T.has_path_prefix(F.lit("gen/gox"), F.lit("gen/go")))


def test_implementations_outside_the_tree_do_not_count(spark):
    n = spark.createDataFrame([("sym:p.S.Go", "symbol", "a.proto", '{"input_type":"X"}'), ("sym:p.SServer.Go", "symbol", "elsewhere/x.go", "{}"), ("sym:p.SClient.go", "symbol", "lib/x.dart", "{}")], "id string, kind string, source_path string, metadata string")
    m = spark.createDataFrame([("a.proto", "go", "gen")], "proto_path string, lang string, prefix string")
    assert {r["from_node"] for r in R.implements_rpc(n, m).collect()} == {"sym:p.SClient.go"}
    assert R.implements_rpc(n).count() == 2


def test_signals_and_references_come_from_the_tables(spark, tmp_path):
    import duckdb

    from lorekeep.plans.queries import ORACLES, QUERIES

    text = "plain\nx = 1  # TODO: fix\nsee internal/a/b.go here"
    spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 2, "why: rows repeat")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "<p>\nrun cmd/x.rs now</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("table_rationale_signals") == {("doc", 1, 0, 1, "todo", "todo", "fix"), ("conversation", 5, 2, 0, "rationale", "why", "rows repeat")}
    files = {r for r in run("table_code_refs") if r[2] == "file"}
    assert files == {("doc:1", "internal/a/b.go", "file", 2), ("page:7", "cmd/x.rs", "file", 1)}
    assert {("internal/a/b.go", "go"), ("cmd/x.rs", "rust")} <= run("table_languages")
    con = duckdb.connect()
    for name in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert all(run(name) == set(con.sql(ORACLES[name]).fetchall()) for name in ("table_rationale_signals", "table_code_refs", "table_languages"))


def test_reranking_of_vector_searches(corpus):
    class Backwards:
        def scores(self, query, texts):
            assert len(texts) <= 20
            return list(range(len(texts)))

    class Broken:
        def scores(self, query, texts):
            raise TimeoutError

    q = [1.0, 0.0, 0.0, 0.0]
    order = lambda r: [x["chunk_id"] for x in S.search_chunks(corpus, q, 3, rerank=r).collect()]
    assert order(None) == [1, 2, 3] == order(embed.reranked("q", Broken()))
    assert order(embed.reranked("q", Backwards())) == [10, 9, 8]  # of ten fetched


def test_word_index_gives_what_the_texts_give(spark):
    texts = ["Das Öl über dem Haus, Öl!", "search_docs finds docs", "docs search", "über alles", "", None, "search docs search-docs"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    for query in ("öl", "search_docs", "docs über", "nothing", "*()", "ÜBER öl search_docs"):
        a, b = (sorted((r["chunk_id"], round(r["score"], 9)) for r in x.collect()) for x in (S.bm25(docs, query, 9), S.bm25_indexed(*S.word_index(docs), query, 9)))
        assert a == b, query
    assert {r["chunk_id"] for r in S.bm25(docs, "search_docs", 9).collect()} == {1, 6}


def test_ranks_go_by_exact_values(spark):
    rows = [(1, [1.0 + 4e-8, 0.0]), (2, [1.0 + 2e-8, 0.0]), (3, [2.0, 0.0])]
    near = S.knn(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), [1.0, 0.0], 2)
    assert [r["chunk_id"] for r in near.collect()] == [2, 1]


def test_store_pointers(spark, tmp_path):
    s = K.Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1,)], "id int")
    s.write(t=one, chunks=one)
    s.write(documents=spark.createDataFrame([("a", "h")], "file_path string, content_hash string"))
    assert s.version() == 2 and "documents" not in s.tables(1) and set(s.tables()) == {"t", "chunks", "documents"}
    s.clear_vectors()
    assert s.read("chunks") is None and s.read("documents").first()["content_hash"] == "" and s.read("t").count() == 1


def test_kinds_and_incident_edges(spark):
    e = edges_of(spark, [("a", "b", "call"), ("c", "a", "call"), ("a", "d", "import")])
    assert G.of_kind(e, "call").count() == 2 and G.incident(e, "a").count() == 3
    assert {r["kind"]: (r["others"], r["n"]) for r in G.explain(e, "a", most=1).collect()} == {"call": (["b"], 2), "import": (["d"], 1)}
    n = spark.createDataFrame([("x", "symbol", '{"Buf_Gen":1}'), ("y", "symbol", "{}")], "id string, kind string, metadata string")
    assert [r["id"] for r in G.of_kind(n, "symbol", "buf_gen").collect()] == ["x"]


def test_code_references_follow_the_rules(spark):
    from lorekeep.plans.queries import code_references

    text = "see internal/auth/auth.go and cmd/ here\n`internal/store/` or *.md **bold** a/\nagain internal/auth/auth.go, then internal/x/*.go\nhttp://host.org/ and **/*.ts *it* x/y.json"
    found = lambda patterns=None: {(r["path"], r["ref_type"], r["line"]) for r in code_references(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", patterns).collect()}
    assert found() == {("internal/auth/auth.go", "file", 0), ("cmd/", "directory", 0), ("internal/store/", "directory", 1), ("internal/x/*.go", "pattern", 2), ("**/*.ts", "pattern", 3), ("x/y.json", "file", 3)}
    assert ("x/y.json", "file", 3) not in found(["*.go"]) and ("internal/auth/auth.go", "file", 0) in found(["*.go"])


def test_greedy_clusters_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 3)))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    want, anchors = {}, []
    for i, v in rows:
        u = np.array(v) / np.linalg.norm(v)
        hit = next((a for a, w in anchors if u @ w >= 0.9), None)
        want[i] = i if hit is None else hit
        anchors += [(i, u)] if hit is None else []
    for block in (7, 512):
        assert {r["id"]: r["anchor"] for r in A.greedy_clusters(df, 0.9, block=block).collect()} == want
