"""Similarity joins of texts by their distinct words, exact, by prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import words_of


def similar(left: DataFrame, right: DataFrame, threshold: float = 0.5, left_id: str = "doc_id", right_id: str = "item_id") -> DataFrame:
    """left_id, right_id, jaccard of pairs whose distinct words have a Jaccard similarity of at least ``threshold``.

    Words are ordered by how many rows of ``right`` have them. Two sets that are similar enough share a word among the
    first (1 - threshold) of either, so only those words are joined: common words meet no one.
    """
    side = lambda df, name, key: df.select(F.col(key).alias(name), words_of(F.col("text")).alias(f"{name}_words")).filter(F.size(f"{name}_words") > 0)
    a, b = side(left, "a", left_id), side(right, "b", right_id)
    often = b.select(F.explode("b_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        words = df.select(name, F.size(f"{name}_words").alias("size"), F.explode(f"{name}_words").alias("word")).join(often, "word", "left")
        ranked = words.groupBy(name, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("all"))
        head = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
        return ranked.select(name, F.explode(F.slice("all", 1, head)).alias("w")).filter("w.n > 0").select(name, "w.word")

    pairs = prefix(a, "a").join(prefix(b, "b"), "word").select("a", "b").distinct()
    met = pairs.join(a, "a").join(b, "b")
    score = F.size(F.array_intersect("a_words", "b_words")) / F.size(F.array_union("a_words", "b_words"))
    return met.select(F.col("a").alias(left_id), F.col("b").alias(right_id), score.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def contained(left: DataFrame, right: DataFrame, threshold: float = 0.8, left_id: str = "doc_id", right_id: str = "item_id") -> DataFrame:
    """left_id, right_id, overlap: pairs where ``left`` has at least the share ``threshold`` of the distinct words of ``right``.

    Words are ordered by how many rows of ``right`` have them: at least one of the first (1 - threshold) of a row's words,
    and one more, must be there.
    """
    a = left.select(F.col(left_id).alias("a"), words_of(F.col("text")).alias("a_words"))
    b = right.select(F.col(right_id).alias("b"), words_of(F.col("text")).alias("b_words")).filter(F.size("b_words") > 0)
    wanted = b.select("b", F.size("b_words").alias("size"), F.explode("b_words").alias("word"))
    often = wanted.groupBy("word").agg(F.count("*").alias("n"))
    ranked = wanted.join(often, "word").groupBy("b", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("all"))
    head = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    keys = ranked.select("b", F.explode(F.slice("all", 1, head)).alias("w")).select("b", "w.word")
    # texts are read once for the words that keys need, and once more for the pairs that met
    met = a.select("a", F.explode("a_words").alias("word")).join(keys, "word").select("a", "b").distinct().join(a, "a").join(b, "b")
    score = F.size(F.array_intersect("a_words", "b_words")) / F.size("b_words")
    return met.select(F.col("a").alias(left_id), F.col("b").alias(right_id), score.alias("overlap")).filter(F.col("overlap") >= threshold)
