"""Questions from facts about a repository, their choice and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# How many questions of each type are wanted.
QUOTAS = (("symbol_definition", 10), ("make_target", 10), ("readme_command", 5))


# The texts of questions by type.
def question(kind: Column, name: Column, description: Column, symbol_kind: Column) -> Column:
    noun = F.when(symbol_kind == "class", "class").otherwise("function")
    return (
        F.when(kind == "symbol_definition", F.concat(F.lit("Which file defines the "), noun, F.lit(" `"), name, F.lit("`? Reply with only the repo-relative path.")))
        .when(kind == "make_target", F.concat(F.lit('Which `make` target is described as: "'), description, F.lit('"? Reply with only the target name.')))
        .when(kind == "readme_command", F.concat(F.lit('What command is shown for: "'), description, F.lit('"? Reply with only the command line.')))
        .when(kind == "file_contains", F.concat(F.lit('Which file contains the project fact: "'), description, F.lit('"? Reply with only the repo-relative path.')))
    )


def symbol_facts(symbols: DataFrame) -> DataFrame:
    """``name, symbol_kind, path`` of public top-level functions and classes whose (kind, name) is theirs alone; names have four characters at least."""
    s = symbols.where(F.col("kind").isin("function", "class") & (F.col("parent") == F.col("module")) & ~F.startswith("name", F.lit("_")) & (F.length("name") >= 4))
    n = F.count(F.lit(1)).over(Window.partitionBy("kind", "name"))
    return s.withColumn("n", n).where("n = 1").select("name", F.col("kind").alias("symbol_kind"), "path")


def choose(facts: DataFrame, trials: int = 25, seed: int = 0) -> DataFrame:
    """``trials`` facts (question_type, expected_answer, ...) in seeded order: up to each type's quota, then the rest; of equal (type, answer) the first.

    The order comes from a hash of seed and fact, so it is the same in every
    run and on every partitioning.
    """
    order = F.xxhash64(F.lit(seed), "question_type", "expected_answer")
    f = facts.withColumn("_o", order)
    names = [c for c in f.columns if c not in ("question_type", "expected_answer")]
    f = f.groupBy("question_type", "expected_answer").agg(F.min(F.struct("_o", *[c for c in names if c != "_o"])).alias("x")).select("question_type", "expected_answer", "x.*")
    place = F.row_number().over(Window.partitionBy("question_type").orderBy("_o", "expected_answer"))
    quota = F.coalesce(F.create_map(*[F.lit(v) for q in QUOTAS for v in q])[F.col("question_type")], F.lit(0))
    f = f.withColumn("_late", F.when(place <= quota, 0).otherwise(1)).orderBy("_late", "_o", "expected_answer").limit(trials)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_late", "_o", "expected_answer"))
    return f.withColumn("number", number.cast("long")).drop("_late", "_o")


def summary(answers: DataFrame, group: str) -> DataFrame:
    """``group, questions, exact_match, answered_rate, average_latency, failures, incorrect`` of rows (group, question_id, answer, accepted, kind, latency, error)."""
    ok = text.answer_is_right(F.coalesce("answer", F.lit("")), F.col("accepted"), F.col("kind"))
    a = answers.withColumn("ok", ok).withColumn("said", F.trim(F.coalesce("answer", F.lit(""))) != "")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    wrong = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("question_id")))), ",")
    return a.groupBy(group).agg(F.count(F.lit(1)).alias("questions"), rate("ok").alias("exact_match"), rate("said").alias("answered_rate"), rate("latency").alias("average_latency"), F.count("error").alias("failures"), wrong.alias("incorrect"))


def direct_answers(questions: DataFrame, pool: DataFrame, top: int = 10) -> DataFrame:
    """``question_id, name, overlap``: for each question the pool rows (name, tokens) that share most words with it, by overlap, then name."""
    q = questions.select("question_id", F.explode(text.task_terms("question")).alias("t"))
    p = pool.select("name", F.explode("tokens").alias("t"))
    n = q.join(p, "t").groupBy("question_id", "name").agg(F.count(F.lit(1)).alias("overlap"))
    best = Window.partitionBy("question_id").orderBy(F.desc("overlap"), "name")
    return n.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).drop("r")
