"""Retrieval: exact vector search, BM25, rank fusion, signal ranking, duplicate folding, token budgets.

Rankings go by exact values, with the id as the last key; what is shown may be rounded by the caller. Top-k uses ORDER BY with LIMIT, which Spark runs as a top-k in each task and a
merge of k rows from each; folding and budgets work on such short lists, where a window over one partition is bounded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import content_hash, metadata_boost, word_count

#: What the reference ranks with.
RRF_K = 60
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
SIGNAL_WEIGHT = 0.10
FOLD_WINDOW = 20
RERANK_TOP = 20


def over_fetch(limit: int) -> int:
    return max(3 * limit, 10)


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Of double precision; the query is a literal of its dimension's size."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    if metric == "l2":
        return F.sqrt(add(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    dot = add(F.zip_with(v, q, lambda a, b: a * b))
    norms = F.sqrt(add(F.transform(v, lambda a: a * a))) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.lit(1.0) - F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(key, distance) of the k nearest; vectors of another length don't count."""
    near = vectors.where(F.size(vector) == len(query)).select(key, distance(F.col(vector), query, metric).alias("distance"))
    return near.orderBy("distance", key).limit(k)


#: A token is a run of letters and digits of any language, in small letters.
LETTERS = r"\p{L}\p{N}"


def phrases(query: str) -> list[list[str]]:
    """The words between white space, each as the tokens that follow each other in it, each once, in order."""
    found = [re.findall(r"[^\W_]+", w.lower()) for w in query.split()]
    return [list(x) for x in sorted({tuple(x) for x in found if x})]


def word_index(docs: DataFrame, key: str = "chunk_id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): term, key and the term's places in the text; and each text's number of tokens. Kept as tables,
    postings by term, a search reads its words' rows only."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[^{LETTERS}]+"), lambda x: x != "")
    rows = docs.select(key, F.posexplode(tokens).alias("at", "term"))
    postings = rows.groupBy("term", key).agg(F.sort_array(F.collect_list("at")).alias("places"))
    return postings, docs.select(key, F.size(tokens).alias("length"))


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def bm25_indexed(postings: DataFrame, lengths: DataFrame, query: str, k: int, key: str = "chunk_id") -> DataFrame:
    """(key, score) of the k best, from the kept index. A phrase's places are those where its tokens follow each other."""
    asked = phrases(query)
    if not asked:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    found = None
    for i, tokens in enumerate(asked):
        rows = None
        for j, token in enumerate(tokens):
            own = postings.where(F.col("term") == token).select(key, _shifted("places", j).alias(f"p{j}"))
            rows = own if rows is None else rows.join(own, key).select(key, F.array_intersect("p0", f"p{j}").alias("p0"))
        part = rows.select(key, F.lit(i).alias("phrase"), F.size("p0").alias("tf")).where("tf > 0")
        found = part if found is None else found.unionByName(part)
    figures = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    counts = found.groupBy("phrase").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(counts), "phrase").join(lengths, key).join(F.broadcast(figures))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # summed in the order of the phrases, so that equal texts have equal scores
    parts = rows.select(key, "phrase", part.alias("part")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("phrase", "part"))).alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part"])
    return parts.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def bm25(docs: DataFrame, query: str, k: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, score) of the k best without a kept index: one pass for the corpus figures, which are one row, and one over
    the texts that have a word. ``bm25_indexed`` gives the same rows from the index."""
    asked = phrases(query)
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # a text without the phrase's first token is not searched by its pattern
    patterns = [f"(?<![{LETTERS}])" + f"[^{LETTERS}]+".join(tokens) + f"(?![{LETTERS}])" for tokens in asked]
    tf = [F.when(F.col("low").contains(tokens[0]), F.regexp_count("low", F.lit(p))).otherwise(0).alias(f"tf{i}") for i, (tokens, p) in enumerate(zip(asked, patterns, strict=True))]
    counted = docs.select(key, low.alias("low")).select(key, F.regexp_count("low", F.lit(f"[{LETTERS}]+")).alias("length"), *tf)
    # the corpus figures are a single row, which a scalar subquery would be in SQL
    figures = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(asked))))
    hit = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(asked)))).join(F.broadcast(figures))
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"tf{i}")
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hit.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """A bounded list with its rank, from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(key, rrf) of all rows of ranked lists."""
    all_rows = None
    for one in lists:
        part = one.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    return all_rows.groupBy(key).agg(F.sum("part").alias("rrf"))


def signal_rank(rows: DataFrame, base: Column, meta: str = "signal_meta", weight: float = SIGNAL_WEIGHT) -> DataFrame:
    """``rows`` with ``final``: the base score and the signals' boost, weighted."""
    return rows.withColumn("final", (1 - weight) * base + weight * metadata_boost(F.col(meta)))


def fold_duplicates(rows: DataFrame, path: str = "file_path", content: str = "content", window: int = FOLD_WINDOW) -> DataFrame:
    """Of ranked rows (``rank``) with equal content among the first ``window``, the best stays and lists the others' paths."""
    head = rows.where(F.col("rank") <= window).withColumn("hash", content_hash(F.col(content)))
    same = Window.partitionBy("hash").orderBy("rank")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = head.withColumn("paths", F.collect_list(path).over(whole)).withColumn("nth", F.row_number().over(same))
    return listed.where("nth = 1").withColumn("duplicate_paths", F.array_distinct(F.slice("paths", 2, window))).drop("paths", "nth", "hash")


def approximate_tokens(tokens: Column, content: Column) -> Column:
    """The stored count, or words by 0.75 where it is zero."""
    return F.when(tokens > 0, tokens.cast("long")).otherwise(F.floor(word_count(content) / F.lit(0.75)).cast("long"))


def token_budget(rows: DataFrame, budget: int, tokens: str = "token_count", content: str = "content") -> DataFrame:
    """The prefix of ranked rows whose running sum is within the budget; all rows for no budget."""
    if budget <= 0:
        return rows
    prefix = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(approximate_tokens(F.col(tokens), F.col(content))).over(prefix)
    return rows.withColumn("running", running).where(F.col("running") <= budget).drop("running")


def search_chunks(chunks: DataFrame, query: list[float], limit: int = 5, metric: str = "l2", rerank=None, top: int = RERANK_TOP) -> DataFrame:
    """Vector search, signal ranking, folding, limit. ``rerank`` takes and returns the ranked frame of the first ``top``
    (``limit`` at least) folded rows; where it fails, the order stays."""
    near = knn(chunks, query, over_fetch(limit), metric)
    rows = signal_rank(near.join(chunks.drop("embedding"), "chunk_id"), 1 - F.col("distance"))
    out = fold_duplicates(ranked(rows, F.desc("final"), "chunk_id"))
    if rerank is not None:
        out = rerank(ranked(out.orderBy("rank").limit(max(top, limit)).drop("rank"), F.desc("final"), "chunk_id"))
    return out.orderBy("rank").limit(limit)


def hybrid_search(chunks: DataFrame, query: list[float], text: str, limit: int = 5, metric: str = "l2", rerank=None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Vector and BM25 lists fused by rank, then signal ranking, folding, limit. ``index`` is the kept (postings, lengths);
    without one the texts are searched. ``rerank`` takes and returns the ranked frame; a text without words leaves the
    vector list alone."""
    k = over_fetch(limit)
    by_vector = ranked(knn(chunks, query, k, metric), "distance", "chunk_id")
    by_words = ranked(bm25_indexed(*index, text, k) if index else bm25(chunks, text, k), F.desc("score"), "chunk_id")
    fused = reciprocal_rank_fusion([by_vector, by_words])
    rows = signal_rank(fused.join(chunks.drop("embedding"), "chunk_id"), F.col("rrf"))
    out = ranked(rows, F.desc("final"), "chunk_id")
    if rerank is not None:
        out = rerank(out)
    return fold_duplicates(out).orderBy("rank").limit(limit)


def referenced_paths(documents: DataFrame, refs: DataFrame, code_files: DataFrame) -> DataFrame:
    """(file_path, paths): the code files that each document refers to."""
    pairs = documents.select(F.col("id").alias("doc_id"), "file_path").join(refs, "doc_id")
    named = pairs.join(code_files.select(F.col("id").alias("code_file_id"), F.col("file_path").alias("code_path")), "code_file_id")
    return named.groupBy("file_path").agg(F.sort_array(F.collect_set("code_path")).alias("paths"))


def summaries_or_bodies(rows: DataFrame, include_body: bool = False) -> DataFrame:
    body = F.lit(include_body) | (F.coalesce("summary", F.lit("")) == "")
    return rows.withColumn("shown", F.when(body, F.col("content")).otherwise(F.col("summary")))
