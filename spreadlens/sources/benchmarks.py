"""Benchmark rows in the common question form (A5) and seeded subsets of them.

Every benchmark has columns of its own; each function maps them to ``question,
choices, reference_answer, dataset, topic_label, type`` with column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import md5_int
from ..functions.text import CHOICE_LETTERS, extract_after_hashes, extract_boxed

COLUMNS = ["question", "choices", "reference_answer", "dataset", "topic_label", "type"]


def _common(df: DataFrame, dataset: str, question: Column, answer: Column, topic: Column | str = "",
            choices: Column | None = None, kind: Column | str = "") -> DataFrame:
    def text(c):
        return F.lit(c) if isinstance(c, str) else F.coalesce(c, F.lit(""))

    return df.select(question.alias("question"), (F.lit(None).cast("array<string>") if choices is None else choices).alias("choices"),
                     answer.cast("string").alias("reference_answer"), F.lit(dataset).alias("dataset"),
                     text(topic).alias("topic_label"), text(kind).alias("type"))


#: How each benchmark's own columns become a question.
MAPPINGS = {
    "gsm8k": lambda d: _common(d, "gsm8k", F.col("question"), extract_after_hashes("answer"), "math"),
    "nq_open": lambda d: _common(d, "nq_open", F.col("question"), F.to_json("answer")),
    "truthfulqa": lambda d: _common(d, "truthfulqa", F.col("question"), F.col("best_answer"), F.col("category")),
    "triviaqa": lambda d: _common(d, "triviaqa", F.col("question"), F.col("answer.value")),
    "defan": lambda d: _common(d, "defan", F.col("question"), F.col("answer"), F.col("domain"), kind=F.col("type")),
    "mmlu": lambda d: _common(d, "mmlu", F.col("question"), F.get(F.array(*map(F.lit, CHOICE_LETTERS)), F.col("answer")), F.col("subject"),
                              F.col("choices")),
    "math": lambda d: _common(d, "math", F.col("problem"), extract_boxed("solution"), F.col("type")),
    "halueval": lambda d: _common(d, "halueval", F.concat(F.lit("Context: "), F.col("knowledge"), F.lit("\n\nQuestion: "), F.col("question")),
                                  F.col("right_answer")),
}


def all_questions(raw: dict[str, DataFrame]) -> DataFrame:
    """The questions of all benchmarks in ``raw`` (name to rows), one table keyed by ``dataset``."""
    out = None
    for name, rows in raw.items():
        q = MAPPINGS[name](rows)
        out = q if out is None else out.unionByName(q)
    return out


def seeded_subset(questions: DataFrame, by: str, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """The first ``size`` rows of each group in the order of md5 draws (all rows of a smaller group).

    Spark keeps at most ``size`` rows of a group in each task before the shuffle.
    """
    w = Window.partitionBy(by).orderBy(md5_int(F.lit(seed), F.col(id_col)), F.col(id_col))
    return questions.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= size).drop("_rk")
