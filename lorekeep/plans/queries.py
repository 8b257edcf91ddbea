"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows.

Documents are the knowledge base, embeddings their vectors (by equal id), pages the HTML source, conversations the
question source; the star schema is the property graph (keys are nodes, foreign keys typed edges).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import analytics as A
from lorekeep.operators import graph as G
from lorekeep.operators import resolve as R
from lorekeep.operators import retrieval as S
from lorekeep.operators import store as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- lookups ---


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'")
def list_documents(spark, d):
    return t(spark, d, "documents").where("lang = 'en' AND source = 'src3'").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def get_document(spark, d):
    return t(spark, d, "documents").where("doc_id = 7").select("doc_id", "text")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (3, 5, 8, 100000000)")
def expand_chunks(spark, d):
    return t(spark, d, "documents").where(F.col("doc_id").isin(3, 5, 8, 100000000)).select("doc_id", "text")


@query("SELECT count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT lang) AS n_langs FROM documents")
def status_totals(spark, d):
    return t(spark, d, "documents").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.countDistinct("lang").alias("n_langs"))


def part_nodes(spark, d):
    return t(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("source_path"))


@query(r"""SELECT 'part:' || p_partkey AS id, p_name AS label FROM part
  WHERE 'part:' || p_partkey = 'Brand#1' OR p_name ILIKE '%Brand#1%' OR p_brand ILIKE '%Brand#1%'
  ORDER BY 'part:' || p_partkey <> 'Brand#1', p_name, 'part:' || p_partkey LIMIT 10""")
def find_nodes(spark, d):
    return G.find_nodes(part_nodes(spark, d), "Brand#1", 10).select("id", "label")


# --- text ---

SQL_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, CASE WHEN trunc(len({SQL_WORDS.format('text')}) / 0.75) = 0 AND strlen(text) > 0 THEN 1 ELSE CAST(trunc(len({SQL_WORDS.format('text')}) / 0.75) AS BIGINT) END AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id FROM documents WHERE trunc(len({SQL_WORDS.format('text')}) / 0.75) >= 50")
def min_token_filter(spark, d):
    return t(spark, d, "documents").where(T.token_estimate(F.col("text")) >= 50).select("doc_id")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(r"""WITH t AS (SELECT 'doc' AS source, doc_id AS id, 0 AS turn, string_split(text, chr(10)) AS ls FROM documents
  UNION ALL SELECT 'conversation', conv_id, turn, string_split(text, chr(10)) FROM conversations),
l AS (SELECT source, id, turn, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM t),
m AS (SELECT *, lower(regexp_extract(line, '(?i)\b(TODO|FIXME|HACK|WHY|NOTE)\b:?\s*(.*)$', 1)) AS marker, trim(regexp_extract(line, '(?i)\b(TODO|FIXME|HACK|WHY|NOTE)\b:?\s*(.*)$', 2)) AS detail FROM l)
SELECT source, id, turn, line_no, CASE WHEN marker IN ('todo', 'fixme', 'hack') THEN 'todo' ELSE 'rationale' END AS kind, marker, detail FROM m WHERE marker <> ''""")
def table_rationale_signals(spark, d):
    """The signals of every line of the documents and conversations."""
    docs = t(spark, d, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), "text")
    said = t(spark, d, "conversations").select(F.lit("conversation").alias("source"), F.col("conv_id").alias("id"), "turn", "text")
    lines = docs.unionByName(said).select("source", "id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marker, kind, detail = T.rationale(F.col("line"))
    return lines.select("source", "id", "turn", "line_no", kind.alias("kind"), marker.alias("marker"), detail.alias("detail")).where("marker <> ''")


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1)) AS term FROM documents")
def bold_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(T.bold_terms(F.col("text"))).alias("term"))


@query("SELECT conv_id, turn, regexp_matches(lower(trim(text)), '^(how|what|why|where|when) ') OR contains(text, '?') AS asks FROM conversations WHERE role = 'user'")
def question_shaped(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_shaped(F.col("text")).alias("asks"))


@query("SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM part")
def slugify(spark, d):
    return t(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(translate(text, '"*()^{}[]', ''), '[\\s]+'), lambda x: x <> ''), lambda w: '"' || w || '"'), ' OR ') AS match_query FROM conversations WHERE role = 'user'""")
def fts_query(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.match_query(F.col("text")).alias("match_query"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<!--\\s*([^>]*?)\\s*-->', 1)) AS comment FROM pages")
def html_comments(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(T.tag_texts(F.col("html"), r"<!--\s*([^>]*?)\s*-->")).alias("comment"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(T.tag_texts(F.col("html"), '<a href="([^"]*)"')).alias("link"))


def code_references(rows: DataFrame, key: str, text: str, patterns: list[str] | None = None) -> DataFrame:
    """(key, path, ref_type, line): first mention of each path in a text. ``patterns`` are the files that count, by what
    comes with their last dot; without them all of ``T.REFERENCED`` do. A folder that the line has as part of an address,
    or whose only part is shorter than three letters, is none, nor is a glob that is emphasis."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))

    def marked(nth: int, ref_type: str, pattern: str):
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(nth).alias("nth"), F.lit(ref_type).alias("ref_type"), x.alias("path")))

    kinds = [("file", T.FILE_REFERENCE), ("directory", T.DIRECTORY_REFERENCE), ("pattern", T.GLOB_REFERENCE)]
    found = F.flatten(F.array(*(marked(n, k, p) for n, (k, p) in enumerate(kinds))))
    flat = lines.select(key, "line", "content", F.explode(found).alias("r")).select(key, "line", "content", "r.*")
    path, bare = F.col("path"), F.regexp_replace("path", "/$", "")
    listed = T.matches_patterns(path, patterns) if patterns is not None else path.rlike(rf"\.(?:{T.REFERENCED})$")
    address = F.col("content").contains(F.concat(F.lit("http://"), path)) | F.col("content").contains(F.concat(F.lit("https://"), path))
    emphasis = path.rlike(r"^\*\*(?:$|[^/])") | path.rlike(r"^\*[A-Za-z]")
    kept = F.when(F.col("ref_type") == "file", listed if patterns is not None else F.lit(True)).when(F.col("ref_type") == "directory", ~address & (bare.contains("/") | (F.length(bare) >= 3))).otherwise(~emphasis & (path.contains("/") | listed))
    return flat.where(kept).groupBy(key, "path").agg(F.min(F.struct("line", "nth", "ref_type")).alias("m")).select(key, "path", F.col("m.ref_type").alias("ref_type"), F.col("m.line").alias("line"))


def marked_sql(nth: int, ref_type: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT id, line, content, {nth} AS nth, '{ref_type}' AS ref_type, unnest(regexp_extract_all(content, '{quoted}', 1)) AS path FROM l"


CODE_REFS_SQL = rf"""WITH t AS (SELECT 'doc:' || doc_id AS id, string_split(text, chr(10)) AS ls FROM documents UNION ALL SELECT 'page:' || page_id, string_split(html, chr(10)) FROM pages),
l AS (SELECT id, CAST(unnest(range(len(ls))) AS INT) AS line, unnest(ls) AS content FROM t),
f AS ({marked_sql(0, "file", T.FILE_REFERENCE)} UNION ALL {marked_sql(1, "directory", T.DIRECTORY_REFERENCE)} UNION ALL {marked_sql(2, "pattern", T.GLOB_REFERENCE)}),
k AS (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY line, nth) AS place FROM f
  WHERE CASE ref_type WHEN 'file' THEN true
    WHEN 'directory' THEN NOT contains(content, 'http://' || path) AND NOT contains(content, 'https://' || path) AND (contains(path[:-2], '/') OR length(path) > 3)
    ELSE NOT regexp_matches(path, '^\*\*($|[^/])') AND NOT regexp_matches(path, '^\*[A-Za-z]') AND (contains(path, '/') OR regexp_matches(path, '\.({T.REFERENCED})$')) END),
r AS (SELECT id, path, ref_type, line FROM k WHERE place = 1)
"""


@query(CODE_REFS_SQL + "SELECT * FROM r")
def table_code_refs(spark, d):
    """The references of every document and page."""
    docs = t(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = t(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return code_references(docs.unionByName(pages), "id", "text")


@query(CODE_REFS_SQL + f""", x(ext, language) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.LANGUAGES.items())})
SELECT path, coalesce(language, 'unknown') AS language FROM (SELECT DISTINCT path FROM r) LEFT JOIN x ON ext = lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1))""")
def table_languages(spark, d):
    """The language of every path that a document or page names."""
    return table_code_refs(spark, d).select("path").distinct().select("path", T.language(F.col("path")).alias("language"))


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 2) AS matches FROM part""")
def match_patterns(spark, d):
    path = F.concat(F.lit("a.b/x"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (".go", ".md", ".py", ""))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return t(spark, d, "part").select("p_partkey", T.matches_patterns(path, ["*.go", "docs/*.py"]).alias("matches"))


def chunk_lines_of(rows: DataFrame, most: int = 512) -> DataFrame:
    """(doc_id, chunk_index, content, token_count): lines gathered until the next would go over ``most`` tokens."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("n"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def step(acc, line):
        n = T.word_count(line).cast("long")
        full = (F.floor((acc["n"] + n) / 0.75) > most) & (acc["now"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["now"] == ""), line).otherwise(F.concat(acc["now"], F.lit("\n"), line)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    whole = F.aggregate(lines, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return rows.select("doc_id", F.posexplode(whole).alias("chunk_index", "content")).withColumn("token_count", T.token_estimate(F.col("content")))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, line, n FROM (
    SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) AS n FROM (
      SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')),
  c AS (SELECT doc_id, i, n AS total, 0 AS chunk FROM l WHERE i = 1
    UNION ALL SELECT l.doc_id, l.i, CASE WHEN floor((c.total + l.n) / 0.75) > 512 THEN l.n ELSE c.total + l.n END,
      CASE WHEN floor((c.total + l.n) / 0.75) > 512 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN l ON l.doc_id = c.doc_id AND l.i = c.i + 1)
SELECT doc_id, CAST(chunk AS INT) AS chunk_index, count(*) AS n_lines, CAST(greatest(trunc(sum(n) / 0.75), 1) AS BIGINT) AS token_count FROM c JOIN l USING (doc_id, i) GROUP BY ALL""")
def chunk_lines(spark, d):
    made = chunk_lines_of(t(spark, d, "documents"))
    return made.select("doc_id", "chunk_index", F.size(F.split("content", "\n")).cast("long").alias("n_lines"), "token_count")


# --- retrieval ---


def chunks(spark, d):
    """Documents as chunks with their vectors and signals."""
    lists = T.signal_lists(F.col("text"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), lists.alias("s"))
    docs = docs.select("chunk_id", "file_path", "content", F.lit(0).alias("token_count"), F.to_json(F.struct("s.inline_labels", "s.risk_markers")).alias("signal_meta"))
    return docs.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


def first_vector(spark, d) -> list[float]:
    return list(t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


L2 = "list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def nearest_sql(distance: str) -> str:
    return f"SELECT chunk_id, round(distance, 6) AS distance FROM (SELECT e.vec_id AS chunk_id, {distance} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, chunk_id LIMIT 15)"


def shown(rows: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Ranked by exact values, shown with few digits."""
    return rows.withColumn(column, F.round(column, digits))


@query(nearest_sql(L2))
def knn_l2(spark, d):
    return shown(S.knn(t(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"), first_vector(spark, d), 15), "distance")


@query(nearest_sql("1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"))
def knn_cosine(spark, d):
    return shown(S.knn(t(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"), first_vector(spark, d), 15, "cosine"), "distance")


def bm25_sql(words: list[str], table: str, key: str, text: str, k: int) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    parts = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return rf"""(WITH w AS (SELECT {key} AS chunk_id, list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}),
    c AS (SELECT chunk_id, len(w) AS length, {tf} FROM w), f AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM c)
    SELECT chunk_id, {parts} AS score FROM c, f WHERE {some} ORDER BY score DESC, chunk_id LIMIT {k})"""


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {bm25_sql(['thing', 'this', 'tion'], 'documents', 'doc_id', 'text', 30)}")
def bm25_topk(spark, d):
    return shown(S.bm25(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "this thing tion", 30), "score")


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {bm25_sql(['thing', 'this', 'tion'], 'documents', 'doc_id', 'text', 30)}")
def bm25_indexed(spark, d):
    """The same from the word index, as a store keeps it."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return shown(S.bm25_indexed(*S.word_index(docs), "this thing tion", 30), "score")


RRF_SQL = f"""WITH v AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM (SELECT e.vec_id AS chunk_id, {L2} AS distance FROM embeddings e JOIN documents ON doc_id = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, chunk_id LIMIT 15)),
b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM {bm25_sql(['thing', 'this', 'tion'], '(SELECT doc_id, text FROM documents JOIN embeddings ON doc_id = vec_id)', 'doc_id', 'text', 15)}),
r AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT * FROM v UNION ALL SELECT * FROM b) GROUP BY chunk_id)"""
BOOST_SQL = """x AS (SELECT doc_id AS chunk_id, list_transform(regexp_extract_all(text, '\\*\\*([^*\\n]+)\\*\\*', 1), lambda s: lower(trim(regexp_replace(s, ':\\s*$', '')))) AS terms FROM documents),
y AS (SELECT chunk_id, list_distinct(list_filter(list_transform(terms, lambda s: CASE WHEN s IN ('warn', 'warning', 'caution') THEN 'warning' WHEN s IN ('note', 'info', 'tip') THEN 'note' WHEN s IN ('decision', 'important', 'input', 'output', 'example', 'todo', 'fixme', 'default', 'prerequisite', 'requirement') THEN s END), lambda s: s IS NOT NULL)) AS labels,
  list_distinct(list_filter(list_transform(terms, lambda s: CASE WHEN s IN ('deprecated', 'unsafe', 'experimental') THEN s WHEN s IN ('breaking', 'breaking change') THEN 'breaking-change' WHEN s = 'unstable' THEN 'experimental' WHEN s IN ('do not run', 'do-not-run') THEN 'do-not-run' END), lambda s: s IS NOT NULL)) AS risks FROM x),
boost AS (SELECT chunk_id, least(100, 30 * len(list_filter(labels, lambda s: s IN ('warning', 'decision', 'important'))) + 10 * len(list_filter(labels, lambda s: s NOT IN ('warning', 'decision', 'important'))) + 20 * len(risks)) / 100.0 AS boost FROM y)"""


@query(RRF_SQL + " SELECT chunk_id, round(rrf, 9) AS rrf FROM r")
def rrf_merge(spark, d):
    c, q = chunks(spark, d), first_vector(spark, d)
    return shown(S.reciprocal_rank_fusion([S.ranked(S.knn(c, q, 15), "distance", "chunk_id"), S.ranked(S.bm25(c, "this thing tion", 15), F.desc("score"), "chunk_id")]), "rrf", 9)


@query("WITH " + BOOST_SQL + " SELECT chunk_id, CAST(boost AS DOUBLE) AS boost FROM boost")
def signal_boost(spark, d):
    lists = T.signal_lists(F.col("text"))
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), T.metadata_boost(F.to_json(F.struct(lists["inline_labels"].alias("inline_labels"), lists["risk_markers"].alias("risk_markers")))).alias("boost"))
    return rows


@query("WITH " + BOOST_SQL + f""" SELECT k.chunk_id, round(0.9::DOUBLE * (1 - distance) + 0.1::DOUBLE * boost, 6) AS final FROM (SELECT e.vec_id AS chunk_id, {L2} AS distance FROM embeddings e JOIN documents ON doc_id = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, chunk_id LIMIT 15) k JOIN boost USING (chunk_id)""")
def signal_rerank(spark, d):
    c = chunks(spark, d)
    near = S.knn(c, first_vector(spark, d), 15)
    return S.signal_rank(near.join(c.drop("embedding"), "chunk_id"), 1 - F.col("distance")).select("chunk_id", F.round("final", 6).alias("final"))


@query("SELECT doc_id, kept_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept_id FROM documents) WHERE doc_id <> kept_id")
def dedup_by_hash(spark, d):
    """Every document whose text an earlier one has, with that one: a minimum by content, and a row for each copy."""
    rows = t(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))
    kept = rows.groupBy("h").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").select("h", "kept_id")
    return rows.join(kept, "h").where("doc_id <> kept_id").select("doc_id", "kept_id")


@query(f"""WITH r AS (SELECT k.chunk_id, row_number() OVER (ORDER BY score DESC, k.chunk_id) AS rank, trunc(len({SQL_WORDS.format('text')}) / 0.75) AS tokens FROM {bm25_sql(['thing', 'this', 'tion'], 'documents', 'doc_id', 'text', 30)} k JOIN documents ON doc_id = k.chunk_id),
s AS (SELECT chunk_id, sum(tokens) OVER (ORDER BY rank) AS running FROM r) SELECT chunk_id FROM s WHERE running <= 4000""")
def token_budget(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit(0).alias("token_count"))
    best = S.ranked(S.bm25(docs, "this thing tion", 30), F.desc("score"), "chunk_id")
    return S.token_budget(best.join(docs, "chunk_id"), 4000).select("chunk_id")


@query("WITH RECURSIVE " + RRF_SQL.removeprefix("WITH ") + ", " + BOOST_SQL + """, f AS (SELECT chunk_id, 0.9::DOUBLE * rrf + 0.1::DOUBLE * boost AS final FROM r JOIN boost USING (chunk_id)),
k AS (SELECT f.chunk_id, final, row_number() OVER (ORDER BY final DESC, f.chunk_id) AS rank, sha256(text) AS h FROM f JOIN documents ON doc_id = f.chunk_id),
u AS (SELECT min(rank) AS rank FROM k WHERE rank <= 20 GROUP BY h)
SELECT chunk_id, round(final, 6) AS final FROM k JOIN u USING (rank) ORDER BY rank LIMIT 5""")
def hybrid_search(spark, d):
    return S.hybrid_search(chunks(spark, d), first_vector(spark, d), "this thing tion", 5).select("chunk_id", F.round("final", 6).alias("final"))


@query("WITH " + BOOST_SQL + f""", k AS (SELECT e.vec_id AS chunk_id, {L2} AS distance FROM embeddings e JOIN documents ON doc_id = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, chunk_id LIMIT 15),
s AS (SELECT k.chunk_id, 0.9::DOUBLE * (1 - distance) + 0.1::DOUBLE * boost AS final, sha256(text) AS h FROM k JOIN boost USING (chunk_id) JOIN documents ON doc_id = k.chunk_id),
o AS (SELECT *, row_number() OVER (ORDER BY final DESC, chunk_id) AS rank FROM s), u AS (SELECT min(rank) AS rank FROM o GROUP BY h)
SELECT chunk_id, round(final, 6) AS final FROM o JOIN u USING (rank) ORDER BY rank LIMIT 5""")
def search_chunks(spark, d):
    return S.search_chunks(chunks(spark, d), first_vector(spark, d), 5).select("chunk_id", F.round("final", 6).alias("final"))


# --- store ---


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0")
def hash_gate(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("stale")).otherwise(T.content_hash(F.col("text"))).alias("content_hash"))
    return K.changed(docs, old, "doc_id", "text").select("doc_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return K.latest(t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'placeholder' ELSE c_name END AS label FROM customer")
def placeholder_upsert(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return K.upsert_placeholders(rows.where("id % 3 <> 0"), rows.withColumn("label", F.lit("placeholder")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, d):
    gone = t(spark, d, "orders").where("o_orderstatus = 'F'")
    left = K.without(t(spark, d, "orders"), gone, o_orderkey="o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(left, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT l_suppkey AS from_node, l_partkey AS to_node, 'supplies' AS kind, max(l_orderkey) AS last_order FROM lineitem GROUP BY ALL")
def edge_upsert(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_node"), F.col("l_partkey").alias("to_node"), F.lit("supplies").alias("kind"), F.col("l_orderkey").alias("last_order"))
    return K.latest(rows, ["from_node", "to_node", "kind"], "last_order")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE substr(text, 1, 10) || '.' END AS summary FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) OR doc_id % 2 = 0 UNION ALL SELECT doc_id, 'cached' FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def summary_cache(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    cache = docs.where("doc_id % 2 = 0").select(T.content_hash(F.col("embedding_text")).alias("content_hash"), F.lit("cached").alias("summary")).distinct()
    filled, _ = K.fill_summaries(docs, cache, lambda c: F.concat(F.substring(c, 1, 10), F.lit(".")))
    return filled.select("doc_id", "summary")


# --- graph ---


def star_edges(spark, d) -> DataFrame:
    def edge(rows, a, b, kind, pa, pb):
        return rows.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("from_node"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("to_node"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"))

    return (
        edge(t(spark, d, "nation"), "n_nationkey", "n_regionkey", "in_region", "n:", "r:")
        .unionByName(edge(t(spark, d, "supplier"), "s_suppkey", "s_nationkey", "based_in", "s:", "n:"))
        .unionByName(edge(t(spark, d, "customer"), "c_custkey", "c_nationkey", "lives_in", "c:", "n:"))
        .unionByName(edge(t(spark, d, "orders"), "o_orderkey", "o_custkey", "ordered_by", "o:", "c:"))
    )


def star_nodes(spark, d) -> DataFrame:
    def node(rows, key, name, kind, p):
        return rows.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("label"))

    return (
        node(t(spark, d, "region"), "r_regionkey", "r_name", "region", "r:")
        .unionByName(node(t(spark, d, "nation"), "n_nationkey", "n_name", "nation", "n:"))
        .unionByName(node(t(spark, d, "supplier"), "s_suppkey", "s_name", "supplier", "s:"))
        .unionByName(node(t(spark, d, "customer"), "c_custkey", "c_name", "customer", "c:"))
        .unionByName(node(t(spark, d, "orders"), "o_orderkey", "o_orderkey", "order", "o:"))
    )


EDGES_SQL = """e AS (SELECT 'n:' || n_nationkey AS from_node, 'r:' || n_regionkey AS to_node, 'in_region' AS kind FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'based_in' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'lives_in' FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'ordered_by' FROM orders)"""
NODES_SQL = """n AS (SELECT 'r:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'order', CAST(o_orderkey AS VARCHAR) FROM orders)"""


def three(edges):
    return edges.select("from_node", "to_node", "kind")


@query(f"WITH {EDGES_SQL} SELECT from_node, to_node, kind FROM e WHERE from_node = 'n:3'")
def neighbors_out(spark, d):
    return three(G.neighbors(star_edges(spark, d), "n:3", "out"))


@query(f"WITH {EDGES_SQL} SELECT from_node, to_node, kind FROM e WHERE to_node = 'n:3'")
def neighbors_in(spark, d):
    return three(G.neighbors(star_edges(spark, d), "n:3", "in"))


@query(f"WITH {EDGES_SQL} SELECT from_node, to_node, kind FROM e WHERE (from_node = 'n:3' OR to_node = 'n:3') AND kind IN ('based_in', 'in_region')")
def neighbors_both(spark, d):
    return three(G.neighbors(star_edges(spark, d), "n:3", "both", ["based_in", "in_region"]))


@query(f"WITH {EDGES_SQL} SELECT kind, string_agg(o, ',' ORDER BY o) AS others, count(*) AS n FROM (SELECT kind, CASE WHEN from_node = 'n:3' THEN to_node ELSE from_node END AS o FROM e WHERE from_node = 'n:3' OR to_node = 'n:3') GROUP BY kind")
def explain_node(spark, d):
    return G.explain(star_edges(spark, d), "n:3").select("kind", F.array_join("others", ",").alias("others"), "n")


@query(f"WITH {EDGES_SQL} SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM e UNION ALL SELECT to_node FROM e WHERE from_node <> to_node) GROUP BY id")
def degree(spark, d):
    return G.degrees(star_edges(spark, d))


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, g AS (SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM e UNION ALL SELECT to_node FROM e WHERE from_node <> to_node) GROUP BY id) SELECT g.id, degree, label, kind FROM g JOIN n USING (id) ORDER BY degree DESC, g.id LIMIT 10")
def god_nodes(spark, d):
    return A.god_nodes(star_nodes(spark, d), star_edges(spark, d))


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT id, kind FROM n WHERE kind IN ('customer', 'supplier') AND NOT EXISTS (SELECT 1 FROM e WHERE to_node = id OR (from_node = id AND e.kind = 'none'))")
def orphans(spark, d):
    edges = star_edges(spark, d).where("kind = 'ordered_by'")
    return G.orphans(star_nodes(spark, d), edges, ["customer", "supplier"]).select("id", "kind")


@query("SELECT DISTINCT 'nation' || s_nationkey AS source_path FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)))")
def affected_paths(spark, d):
    brand = t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    parts = t(spark, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("source_path"))
    suppliers = t(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("source_path"))
    edges = t(spark, d, "lineitem").select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("from_node"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("to_node"))
    return G.affected_paths(parts.unionByName(suppliers), edges, brand)


@query("SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey")
def shared_ref(spark, d):
    return G.shared_references(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT l_partkey, min(l_orderkey) AS first, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey")
def shared_ref_groups(spark, d):
    return G.shared_groups(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT c_nationkey AS doc_id, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS paths FROM customer GROUP BY c_nationkey")
def referenced_paths(spark, d):
    docs = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("file_path"))
    refs = t(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("code_file_id"))
    files = refs.select(F.col("code_file_id").alias("id"), F.col("code_file_id").alias("file_path")).distinct()
    return S.referenced_paths(docs, refs, files).select(F.col("file_path").alias("doc_id"), F.array_join("paths", ",").alias("paths"))


@query("SELECT 1 AS step, 'o:' || o_orderkey AS from_node, 'c:' || o_custkey AS to_node, 'ordered_by' AS kind FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT 2, 'c:' || c_custkey, 'n:' || c_nationkey, 'lives_in' FROM customer WHERE c_custkey = (SELECT arg_min(o_custkey, o_orderkey) FROM orders) UNION ALL SELECT 3, 'n:' || n_nationkey, 'r:' || n_regionkey, 'in_region' FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = (SELECT arg_min(o_custkey, o_orderkey) FROM orders))")
def shortest_path(spark, d):
    first = t(spark, d, "orders").orderBy("o_orderkey").select("o_orderkey", "o_custkey").first()
    nation = t(spark, d, "customer").where(F.col("c_custkey") == first[1]).first()["c_nationkey"]
    region = t(spark, d, "nation").where(F.col("n_nationkey") == nation).first()["n_regionkey"]
    return G.shortest_path(star_edges(spark, d), f"o:{first[0]}", f"r:{region}").drop("weight")


@query("SELECT id, min(depth) AS depth FROM (SELECT 'r:1' AS id, 0 AS depth UNION ALL SELECT 'n:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'o:' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) GROUP BY id")
def k_hop(spark, d):
    return G.k_hop(star_edges(spark, d), ["r:1"], 3, backward=True)


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n FROM e GROUP BY kind")
def edge_kind_counts(spark, d):
    return A.edge_kind_counts(star_edges(spark, d))


COMMUNITY_SQL = """m AS (SELECT 'n:' || n_nationkey AS id, n_regionkey AS community FROM nation UNION ALL SELECT 's:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'p:' || p_partkey, p_partkey % 5 FROM part)"""


def by_region(spark, d):
    nations = t(spark, d, "nation")
    s = t(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("n_regionkey").cast("long").alias("community"))
    n = nations.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").cast("long").alias("community"))
    p = t(spark, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") % 5).alias("community"))
    return n.unionByName(s).unionByName(p)


def supply_edges(spark, d):
    rows = t(spark, d, "lineitem").select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("from_node"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("to_node"), F.concat(F.lit("flag"), F.col("l_returnflag")).alias("kind")).distinct()
    return rows


SUPPLY_SQL = "e AS (SELECT DISTINCT 's:' || l_suppkey AS from_node, 'p:' || l_partkey AS to_node, 'flag' || l_returnflag AS kind FROM lineitem)"


@query(f"""WITH {SUPPLY_SQL}, {COMMUNITY_SQL}, k AS (SELECT kind, count(*) AS c FROM e GROUP BY kind), z AS (SELECT community, count(*) AS size FROM m GROUP BY community)
SELECT e.from_node, e.to_node, e.kind, a.community AS from_community, b.community AS to_community, round(1.0::DOUBLE / c / greatest(least(za.size, zb.size), 2), 9) AS score
FROM e JOIN m a ON a.id = from_node JOIN m b ON b.id = to_node JOIN k ON k.kind = e.kind JOIN z za ON za.community = a.community JOIN z zb ON zb.community = b.community
WHERE a.community <> b.community ORDER BY score DESC, e.from_node, e.to_node, e.kind LIMIT 10""")
def surprising_connections(spark, d):
    return A.surprising(supply_edges(spark, d), by_region(spark, d))


@query(f"""WITH {SUPPLY_SQL}, {COMMUNITY_SQL}, g AS (SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM e UNION ALL SELECT to_node FROM e) GROUP BY id),
r AS (SELECT community, m.id, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, m.id) AS nth, count(*) OVER (PARTITION BY community) AS size FROM m LEFT JOIN g ON g.id = m.id)
SELECT community, size, id AS label FROM r WHERE nth = 1""")
def community_labels(spark, d):
    member = by_region(spark, d)
    return A.community_labels(member, supply_edges(spark, d), member.select("id", F.col("id").alias("label")))


# --- resolvers: symbols, files and imports whose names the tables' keys make up ---


def text_of(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


C = F.col


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, 'sym:p' || p_size || '.Svc' || (p_partkey % 7) AS s FROM part)
SELECT s || 'Server.Do' || k AS from_node, s || '.Do' || k AS to_node, 'implements_rpc' AS kind FROM p WHERE k % 2 = 0 AND NOT (n % 2 = 0 AND k % 3 = 0)
UNION ALL SELECT s || 'Client.do' || k, s || '.Do' || k, 'implements_rpc' FROM p WHERE k % 5 = 0""")
def implements_rpc(spark, d):
    """Every part is an rpc; half have a Go server, some of them outside of the generator's folder, a fifth a Dart client."""
    p = t(spark, d, "part").select(C("p_partkey").alias("k"), C("p_size").alias("n"), text_of("sym:p", C("p_size"), ".Svc", C("p_partkey") % 7).alias("s"))
    node = lambda rows, id_, path, meta="{}": rows.select(id_.alias("id"), F.lit("symbol").alias("kind"), path.alias("source_path"), F.lit(meta).alias("metadata"))
    proto = text_of("api/p", C("n"), ".proto")
    nodes = node(p, text_of(C("s"), ".Do", C("k")), proto, '{"input_type":"R"}')
    nodes = nodes.unionByName(node(p.where("k % 2 = 0"), text_of(C("s"), "Server.Do", C("k")), F.when(C("k") % 3 == 0, F.lit("other/x.go")).otherwise(F.lit("gen/go/x.go"))))
    nodes = nodes.unionByName(node(p.where("k % 5 = 0"), text_of(C("s"), "Client.do", C("k")), F.lit("lib/x.dart")))
    manifest = p.where("n % 2 = 0").select(proto.alias("proto_path"), F.lit("go").alias("lang"), F.lit("gen/go").alias("prefix")).distinct()
    return three(R.implements_rpc(nodes, manifest))


@query("""WITH r AS (SELECT DISTINCT s_nationkey AS n, s_suppkey % 40 AS k FROM supplier), z AS (SELECT k, count(*) AS m FROM r GROUP BY k),
c AS (SELECT 'sym:n' || c_nationkey || '.C' || c_custkey AS from_node, c_nationkey AS n, c_custkey % 60 AS k FROM customer)
SELECT from_node, 'sym:n' || r.n || '.S' || r.k AS to_node, '{}' AS metadata FROM c JOIN r ON r.n = c.n AND r.k = c.k
UNION ALL SELECT from_node, 'sym:n' || r.n || '.S' || r.k, CASE WHEN m > 1 THEN '{"ambiguous_resolution":"true"}' ELSE '{}' END FROM c JOIN r ON r.k = c.k JOIN z ON z.k = c.k
  WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.n = c.n AND x.k = c.k)
UNION ALL SELECT from_node, 'sym:S' || k, '{"unresolved":"true"}' FROM c WHERE k NOT IN (SELECT k FROM r)""")
def fqn_resolution(spark, d):
    """Every customer's class inherits a bare name, which suppliers' classes of its nation or of others have."""
    real = t(spark, d, "supplier").select(text_of("sym:n", C("s_nationkey"), ".S", C("s_suppkey") % 40).alias("id")).distinct()
    child = t(spark, d, "customer").select(text_of("sym:n", C("c_nationkey"), ".C", C("c_custkey")).alias("id"), text_of("sym:S", C("c_custkey") % 60).alias("bare"))
    node = lambda rows, held: rows.select("id", F.lit("symbol").alias("kind"), F.lit(held).alias("is_placeholder"))
    nodes = node(real, False).unionByName(node(child, False)).unionByName(node(child.select(C("bare").alias("id")).distinct(), True))
    edges = child.select(C("id").alias("from_node"), C("bare").alias("to_node"), F.lit("inherits").alias("kind"), F.lit(1.0).alias("weight"), F.lit('{"unresolved":"true"}').alias("metadata"))
    return R.resolve_names(edges, nodes).select("from_node", "to_node", "metadata")


@query("""WITH o AS (SELECT 'sym:f' || o_orderkey AS from_node, o_custkey % 50 AS k, o_custkey % 3 AS m, (o_custkey % 50) IN (SELECT n_nationkey FROM nation) AS known FROM orders),
x AS (SELECT *, CASE m WHEN 0 THEN 'public.t' || k WHEN 1 THEN 'public.t' || k || '.col' ELSE 'nowhere' || k END AS target_name FROM o)
SELECT from_node, target_name, CASE WHEN m = 1 AND known THEN 'sym:public.t' || k ELSE 'sym:' || target_name END AS to_node, m = 2 OR NOT known AS unresolved FROM x""")
def body_references(spark, d):
    """Every order is a function that names a table, a column, or nothing that there is."""
    k, m = (C("o_custkey") % 50).cast("string"), C("o_custkey") % 3
    target = F.when(m == 0, F.concat(F.lit("public.t"), k)).when(m == 1, F.concat(F.lit("public.t"), k, F.lit(".col"))).otherwise(F.concat(F.lit("nowhere"), k))
    edges = t(spark, d, "orders").select(text_of("sym:f", C("o_orderkey")).alias("from_node"), target.alias("target_name"), F.lit("read").alias("op"))
    nodes = t(spark, d, "nation").select(text_of("sym:public.t", C("n_nationkey")).alias("id"))
    return R.resolve_body_references(edges, nodes).select("from_node", "target_name", "to_node", "unresolved")


@query("""SELECT 'file:pkg' || p_size || '/x' || p_partkey || '_test.go' AS from_node, 'file:pkg' || p_size || '/x' || p_partkey || '.go' AS to_node FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'file:tests/test_y' || p_partkey || '.py', 'file:y' || p_partkey || '.py' FROM part WHERE p_partkey % 15 = 0""")
def test_links(spark, d):
    p = t(spark, d, "part")
    files = p.select(text_of("pkg", C("p_size"), "/x", C("p_partkey"), ".go").alias("path"))
    files = files.unionByName(p.where("p_partkey % 2 = 0").select(text_of("pkg", C("p_size"), "/x", C("p_partkey"), "_test.go").alias("path")))
    files = files.unionByName(p.where("p_partkey % 3 = 0").select(text_of("tests/test_y", C("p_partkey"), ".py").alias("path")))
    files = files.unionByName(p.where("p_partkey % 5 = 0").select(text_of("y", C("p_partkey"), ".py").alias("path")))
    return R.test_edges(files).select("from_node", "to_node")


@query("""WITH i AS (SELECT 'src/a' || p_partkey || '.ts' AS path, p_partkey % 20 AS k FROM part WHERE p_partkey % 4 <> 0)
SELECT path, './m' || k AS specifier, 'src/m' || k || CASE WHEN k < 10 THEN '.ts' WHEN k <= 12 THEN '.js' ELSE '/index.tsx' END AS target FROM i WHERE k <= 16""")
def module_resolution(spark, d):
    n = t(spark, d, "nation").select(C("n_nationkey").alias("k"))
    file = lambda low, high, end: n.where(C("k").between(low, high)).select(text_of("src/m", C("k"), end).alias("path"))
    files = file(0, 9, ".ts").unionByName(file(5, 12, ".js")).unionByName(file(13, 16, "/index.tsx"))
    specifier = F.when(C("p_partkey") % 4 == 0, F.lit("react")).otherwise(text_of("./m", C("p_partkey") % 20))
    return R.resolve_modules(t(spark, d, "part").select(text_of("src/a", C("p_partkey"), ".ts").alias("path"), specifier.alias("specifier")), files)


@query("""WITH c AS (SELECT 'sym:c' || c_custkey AS from_node, 'sym:n' || c_nationkey AS to_node, c_nationkey AS n, c_custkey % 5 = c_nationkey % 5 AS a, c_nationkey % 2 = 0 AS b, c_custkey % 5 AS k FROM customer)
SELECT from_node, to_node, concat_ws(',', CASE WHEN a THEN 'lib' || n || '.T' || k END, CASE WHEN b THEN 'lib' || n || '.U' END) AS resolved FROM c WHERE a OR b""")
def type_variables(spark, d):
    arg = lambda name: F.struct(name.alias("name"), text_of("lib", C("c_nationkey")).alias("module"))
    pending = t(spark, d, "customer").select(text_of("sym:c", C("c_custkey")).alias("from_node"), text_of("sym:n", C("c_nationkey")).alias("to_node"), F.array(arg(text_of("T", C("c_custkey") % 5)), arg(F.lit("U"))).alias("type_args"))
    n = t(spark, d, "nation")
    variables = n.select(text_of("lib", C("n_nationkey")).alias("module"), text_of("T", C("n_nationkey") % 5).alias("name")).unionByName(n.where("n_nationkey % 2 = 0").select(text_of("lib", C("n_nationkey")).alias("module"), F.lit("U").alias("name")))
    return R.resolve_type_variables(pending, variables).select("from_node", "to_node", F.array_join("resolved", ",").alias("resolved"))


# --- by kind, related, shown ---


@query(f"WITH {NODES_SQL} SELECT id, label FROM n WHERE kind = 'nation'")
def nodes_by_kind(spark, d):
    return G.of_kind(star_nodes(spark, d), "nation").select("id", "label")


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment ILIKE '%build%'")
def nodes_with_metadata(spark, d):
    nodes = t(spark, d, "customer").select(text_of("c:", C("c_custkey")).alias("id"), F.lit("customer").alias("kind"), F.to_json(F.struct(C("c_mktsegment").alias("segment"))).alias("metadata"))
    return G.of_kind(nodes, "customer", "build").select("id")


@query(f"WITH {EDGES_SQL} SELECT from_node, to_node, kind FROM e WHERE kind = 'based_in'")
def edges_by_kind(spark, d):
    return three(G.of_kind(star_edges(spark, d), "based_in"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title FROM supplier WHERE s_nationkey = (SELECT arg_min(s_nationkey, s_suppkey) FROM supplier) AND s_suppkey > (SELECT min(s_suppkey) FROM supplier)")
def related_documents(spark, d):
    """Suppliers are documents, and share a file with the first of their nation."""
    s = t(spark, d, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    edges = s.join(first, "s_nationkey").where("s_suppkey <> first").select(text_of("doc:", C("first")).alias("from_node"), text_of("doc:", C("s_suppkey")).alias("to_node"), F.lit("shared_code_ref").alias("kind"))
    docs = s.select(C("s_suppkey").cast("string").alias("id"), C("s_name").alias("title"))
    return G.related_documents(docs, edges, str(s.agg(F.min("s_suppkey")).first()[0]))


@query(f"WITH {EDGES_SQL} SELECT id, round(least(18.0, 4.0 + 2.5 * ln(1 + degree)), 6) AS radius FROM (SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM e UNION ALL SELECT to_node FROM e WHERE from_node <> to_node) GROUP BY id)")
def node_radius(spark, d):
    return G.degrees(star_edges(spark, d)).select("id", F.round(T.node_radius(C("degree")), 6).alias("radius"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'sym:' WHEN 'N' THEN 'file:' ELSE 'key:' END || l_partkey AS target FROM lineitem")
def target_ids(spark, d):
    kind = F.when(C("l_returnflag") == "A", "call").when(C("l_returnflag") == "N", "mentions").otherwise("config-key")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.target_id(kind, C("l_partkey").cast("string"), F.lit(None).cast("string")).alias("target"))


# --- iterative ---


@query()
def louvain(spark, d):
    return A.communities(star_nodes(spark, d), star_edges(spark, d))


@query()
def greedy_clusters(spark, d):
    return A.greedy_clusters(t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), 0.85)


# --- extensions beyond the reference: the event stream ---


@query("SELECT CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    w = t(spark, d, "events").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n")


@query("SELECT CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) - 300 * k AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1")
def ext_sliding(spark, d):
    w = t(spark, d, "events").groupBy(F.window("ts", "10 minutes", "5 minutes")).agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("window_start"), "n")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def ext_session(spark, d):
    s = t(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_timestamp("w.start").alias("session_start"), "n")
