"""Folding recent turns of a conversation into one self-contained question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.plans.skew import position_in_group, with_halo

# Limits and the wording of the folded question.
MAX_QUESTION, MAX_LINE, HISTORY = 500, 120, 5
HEADER, SUFFIX, USER, ASSISTANT = "Ngữ cảnh trước đó:\n", "Câu hỏi hiện tại: ", "Tôi", "Trợ lý"
BLOCK = 4096


def summarize_text(content: Column | str) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.nullif(F.trim(F.replace(content, F.lit("📎"), F.lit("CV:"))), F.lit(""))


def summarize_message() -> Column:
    """One line per message by ``kind``; null for errors and messages without context.

    Reads ``kind, error, content, answer`` and the arrays ``job_titles, sql_rows, skills,
    missing_skills``.
    """
    empty = F.array().cast("array<string>")

    def first(column: str, n: int) -> Column:
        return F.array_join(F.slice(F.coalesce(F.col(column), empty), 1, n), ", ")

    kind = F.col("kind")
    agent = (
        F.when(F.size(F.coalesce("job_titles", empty)) > 0, F.concat(F.lit("tìm được job: "), first("job_titles", 4)))
        .when(F.size(F.coalesce("sql_rows", empty)) > 0, F.concat(F.lit("kết quả thống kê: ["), first("sql_rows", 3), F.lit("]")))
        .otherwise(F.col("answer"))
    )
    return F.when(
        ~F.coalesce(F.col("error"), F.lit(False)),
        F.when(kind == "text", summarize_text("content"))
        .when(kind == "agent", agent)
        .when(kind == "cv_match", F.concat(F.lit("CV có skill "), first("skills", 8), F.lit("; job hợp: "), first("job_titles", 4)))
        .when(kind == "cv_gap", F.concat(F.lit("CV còn thiếu: "), first("missing_skills", 6))),
    )


def fold_context(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, query)`` for every user turn of ``(conv_id, turn, role, text, summary)``.

    The previous five messages are added oldest first; the oldest are dropped until everything fits.
    A conversation is cut into blocks that overlap by five messages, so its length does not matter.
    """
    who = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    has_summary = F.coalesce(F.col("summary"), F.lit("")) != ""
    line = F.when(has_summary, F.concat(F.lit("- "), who, F.lit(": "), T.shorten("summary", MAX_LINE)))
    # Only the short line travels; the text itself is needed for user turns alone.
    slim = messages.select("conv_id", "turn", line.alias("_line"), F.when(F.col("role") == "user", T.shorten(F.coalesce("text", F.lit("")), MAX_QUESTION)).alias("_q"))
    placed = position_in_group(slim, ["conv_id"], [F.asc("turn")], F.floor(F.col("turn") / BLOCK))
    blocks = with_halo(placed, F.col("position"), BLOCK, HISTORY)
    before = Window.partitionBy("conv_id", "_block").orderBy("position").rowsBetween(-HISTORY, -1)
    turns = blocks.withColumn("_lines", F.collect_list("_line").over(before)).where("_q is not null and not _copy")
    suffix = F.concat(F.lit(SUFFIX), F.col("_q"))

    def kept(dropped: Column) -> Column:
        return F.array_join(F.slice("_lines", dropped + 1, F.size("_lines")), "\n")

    fitting = F.filter(
        F.sequence(F.lit(0), F.size("_lines")),
        lambda d: F.lit(len(HEADER)) + F.length(kept(d)) + 1 + F.length(suffix) <= MAX_QUESTION,
    )
    dropped = F.get(fitting, F.lit(0))
    bare = (F.size("_lines") == 0) | (F.length(suffix) >= MAX_QUESTION) | dropped.isNull() | (dropped >= F.size("_lines"))
    return turns.select(
        "conv_id", "turn",
        F.when(bare, F.col("_q")).otherwise(F.concat(F.lit(HEADER), kept(dropped), F.lit("\n"), suffix)).alias("query"),
    )
