"""From ordered transcript rows to exchanges (user turn and what answers it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_turns(rows: DataFrame, session: str, line: str, role: str = "role", text: str = "text") -> DataFrame:
    """(session, turn number, line_start, line_end, user_message, assistant_message).

    A user row opens a turn; the rows up to the next user row belong to it and their texts are joined by a blank line.
    Turns without a reply, and rows before the first user row, are dropped.
    """
    is_user = F.col(role) == "user"
    n = F.sum(F.when(is_user, 1).otherwise(0)).over(Window.partitionBy(session).orderBy(line))
    reply = F.when(~is_user, F.struct(F.col(line).alias("l"), F.col(text).alias("t")))
    grouped = rows.withColumn("n", n).where("n > 0").groupBy(session, "n").agg(
        F.min(line).alias("line_start"), F.max(line).alias("line_end"), F.max(F.when(is_user, F.col(text))).alias("user_message"),
        F.array_sort(F.collect_list(reply)).alias("replies"),
    )
    joined = F.array_join(F.transform("replies", lambda r: r["t"]), "\n\n")
    return grouped.where(F.size("replies") > 0).select(session, "n", "line_start", "line_end", "user_message", joined.alias("assistant_message"))


def latest_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in this order (monotone ingest: higher generation, then longer, wins)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def lines_between(rows: DataFrame, line: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The inclusive slice of lines that a reader asks for."""
    out = rows if first is None else rows.where(F.col(line) >= first)
    return out if last is None else out.where(F.col(line) <= last)


def byte_prefix(rows: DataFrame, session: str, line: str, text: str, limit: int) -> DataFrame:
    """The lines that lie wholly in the first ``limit`` bytes of their transcript."""
    used = F.sum(F.octet_length(text) + 1).over(Window.partitionBy(session).orderBy(line))
    return rows.withColumn("bytes_through", used).where(F.col("bytes_through") <= limit)
