"""Context for question answering: recent turns, retrieved pairs, message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_QUESTION = 3


def worth_asking(question: Column) -> Column:
    return F.length(F.trim(question)) > LEAST_QUESTION


def last_turns(messages: DataFrame, conv: str, turn: str, n: int, roles: list[str] | None = None) -> DataFrame:
    """The last n turns of each conversation, of the roles given."""
    rows = messages.filter(F.col("role").isin(roles)) if roles else messages
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).filter(F.col("_n") <= n).drop("_n")


def context_block(pairs: DataFrame, by: str, order: str, question: str, answer: str) -> DataFrame:
    """(by, context): question and answer of each row, in order, with a blank line between."""
    text = F.concat(F.lit("Pergunta: "), question, F.lit("\nResposta: "), answer)
    rows = pairs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("x"))
    return rows.select(by, F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("context"))


def message_list(system: str, context: Column, history: Column, question: Column) -> Column:
    """array<struct<role, content>>: system, context if any, history of user and assistant, the question."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    kept = F.coalesce(F.filter(history, lambda m: m["role"].isin("user", "assistant")), none)
    return F.concat(one("system", F.lit(system)), F.when(F.coalesce(context, F.lit("")) != "", one("system", context)).otherwise(none), kept, one("user", question))


def marked_answer(answer: Column, used_context: Column) -> Column:
    return F.when(used_context, F.concat(F.lit("* "), answer)).otherwise(answer)


def chunks(faq: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(key, chunk_no, chunk): the question, then each non-blank trimmed line of the answer."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return faq.select(key, F.posexplode(F.concat(F.array(F.col(question)), F.coalesce(lines, F.array().cast("array<string>")))).alias("chunk_no", "chunk"))


def token_total(answers: DataFrame, usage: str, by: list[str] = ()) -> DataFrame:
    """Tokens used; answers without a count are none."""
    return answers.groupBy(*by).agg(F.sum(F.coalesce(usage, F.lit(0))).cast("long").alias("tokens"))
