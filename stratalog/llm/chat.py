"""Chat formatting with Spark expressions alone.

The template of a conversation is a sequence of blocks

    <|im_start|>ROLE<|im_sep|>TEXT<|im_next|>TEXT...<|im_end|>\\n

Adjacent turns of one role share a block; ``<|im_next|>`` keeps their border. Every control string begins with
``<|``. Inside roles and texts ``<|`` becomes ``<\\|``, and ``<`` with k backslashes before ``|`` gets one more, so
no text can contain a control string and taking one backslash away restores the text exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _split(text: Column, control: str) -> Column:
    return F.split(text, "\\Q" + control + "\\E")


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans`` (start from 0, length; in code points).

    Turns are ordered by turn number, then role, then text; null numbers come first. A null role or text is
    empty. Rows with a null conversation id form one conversation. Repeated rows are repeated turns. An empty
    table gives an empty table. Other columns are ignored. A conversation is one output row, so it must fit a row.
    """
    ordered = turns.groupBy(F.col(conv).alias(conv)).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    # Borders of the runs of one role: the positions where a run begins, and the position after the last turn.
    borders = ordered.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", F.greatest(i - 1, F.lit(0))).role),
        ),
    )
    merged = borders.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("turns", s).role.alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                    lambda t: escape(t.text),
                ).alias("texts"),
            ),
        ),
    )
    none = F.lit(False)
    # A block as segments: its head, its texts with borders between, its end. Only texts can carry loss.
    segments = merged.withColumn(
        "segments",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(F.struct(F.concat(F.lit(START), escape(b.role), F.lit(SEP)).alias("s"), none.alias("loss"))),
                    F.flatten(
                        F.transform(
                            b.texts,
                            lambda t, i: F.array(
                                F.struct(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")).alias("s"), none.alias("loss")),
                                F.struct(t.alias("s"), b.role.isin(list(loss_roles)).alias("loss")),
                            ),
                        )
                    ),
                    F.array(F.struct(F.lit(END).alias("s"), none.alias("loss"))),
                ),
            )
        ),
    )
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x.s)).alias("at"),
            F.when(
                x.loss,
                F.concat(acc.spans, F.array(F.struct(acc.at.alias("start"), F.length(x.s).cast("long").alias("length")))),
            )
            .otherwise(acc.spans)
            .alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    return segments.select(
        conv,
        F.array_join(F.transform("segments", lambda x: x.s), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    blocks = _split(formatted, END)
    return F.flatten(
        F.transform(
            F.filter(blocks, lambda b: b != ""),
            lambda b: F.transform(
                _split(F.get(_split(b, SEP), F.lit(1)), NEXT),
                lambda t: F.struct(
                    unescape(F.substr(F.get(_split(b, SEP), F.lit(0)), F.lit(len(START) + 1))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))
        ),
        "",
    )
