"""Questions that history answers: scan, cluster, answer, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.embed import Embedder, embedding
from lorekeep.functions.text import answer, question_shaped, slug
from lorekeep.operators.analytics import greedy_clusters

THRESHOLD = 0.85


def questions_from(rows: DataFrame) -> DataFrame:
    """(id, question, detail) of the rows (id, title, detail) that ask something."""
    return rows.where(question_shaped(F.col("title"))).select("id", F.trim("title").alias("question"), F.col("detail"))


def conversation_questions(conversations: DataFrame) -> DataFrame:
    """What users ask, with the answer that comes next."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(turn).alias("next"), F.lead("role").over(turn).alias("next_role"))
    asked = rows.where("role = 'user'").select(F.format_string("%012d/%06d", "conv_id", "turn").alias("id"), F.col("text").alias("title"), F.when(F.col("next_role") == "assistant", F.col("next")).otherwise(F.lit("")).alias("detail"))
    return questions_from(asked)


def entries(questions: DataFrame, embedder: Embedder, threshold: float = THRESHOLD) -> DataFrame:
    """(slug, question, answer, n): one for each cluster of like questions; the answer is the first that is not empty.
    Slugs that meet again get a number."""
    vectors = questions.withColumn("embedding", embedding(embedder, F.col("question")))
    clusters = greedy_clusters(vectors, threshold)
    rows = questions.join(clusters, "id")
    groups = rows.groupBy("anchor").agg(F.min(F.struct("id", "question")).alias("q"), F.min(F.when(F.trim("detail") != "", F.struct("id", "detail"))).alias("a"), F.count("*").alias("n"))
    made = groups.where("a IS NOT NULL").select("anchor", F.col("q.question").alias("question"), answer(F.trim("a.detail")).alias("answer"), "n").withColumn("slug", slug(F.col("question")))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("anchor"))
    return made.withColumn("nth", nth).select(F.when(F.col("nth") > 1, F.concat("slug", F.lit("-"), F.col("nth").cast("string"))).otherwise(F.col("slug")).alias("slug"), "question", "answer", "n")


def as_markdown(rows: DataFrame) -> DataFrame:
    """(file_name, content)."""
    return rows.select(F.concat("slug", F.lit(".md")).alias("file_name"), F.concat(F.lit("---\ntitle: "), F.concat(F.lit('"'), F.regexp_replace("question", '"', '\\\\"'), F.lit('"')), F.lit("\ntype: faq\n---\n\n# "), "question", F.lit("\n\n"), "answer", F.lit("\n")).alias("content"))
