"""Chat formatting: turns to one training string per conversation, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackline.llm.text import let


@dataclass(frozen=True)
class Template:
    """Control strings of a chat template; all of them start with ``<|``.

    A block is ``start role (text | learn) text (next text)* end``.  ``learn`` instead
    of ``text`` puts the block under the loss mask.
    """

    start: str = "<|start|>"
    text: str = "<|text|>"
    learn: str = "<|learn|>"
    next: str = "<|next|>"
    end: str = "<|end|>"
    learned_roles: tuple[str, ...] = ("assistant",)


#: A control string of this or a common other template: opening character,
#: backslashes put there by escaping, and the rest that makes it one.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])(\\*)\\(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Put one backslash inside every control string; ``unescape`` takes it out."""
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row (conv_id, formatted) per conversation of ``turns`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first; ties by role and text, so that reruns
    agree.  Repeated rows are repeated turns.  Null roles and texts count as empty;
    rows with a null conv_id form one conversation.  Adjacent turns of one role share
    a block.  Other columns are ignored; an empty table gives no rows.

    A formatted conversation is one value and so must fit a task, however the rest is
    dealt.  Texts are escaped before the shuffle.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    learned = role.isin(*template.learned_roles)
    piece = F.struct(
        F.col("turn"),
        escape(role).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.when(learned, F.lit(template.learn)).otherwise(F.lit(template.text)).alias("mark"),
    )
    gathered = turns.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces")
    )
    first = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit(None).cast("string").alias("role"),
    )

    def append(state: Column, turn: Column) -> Column:
        opened = F.concat(F.lit(template.start), turn.role, turn.mark, turn.text)
        part = (
            F.when(state.role.isNull(), opened)
            .when(state.role == turn.role, F.concat(F.lit(template.next), turn.text))
            .otherwise(F.concat(F.lit(template.end), opened))
        )
        return F.struct(
            F.concat(state.parts, F.array(part)).alias("parts"), turn.role.alias("role")
        )

    def joined(state: Column) -> Column:
        return F.concat(F.array_join(state.parts, ""), F.lit(template.end))

    return gathered.select(
        "conv_id", F.aggregate("pieces", first, append, joined).alias("formatted")
    )


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse ``formatted`` back: conv_id, and turns as array of (role, text, learned)."""

    def literal(control: str) -> str:
        return control.replace("|", r"\|")

    def turns_of(block: Column) -> Column:
        return let(F.substring_index(block, template.end, 1), of_body)

    def of_body(body: Column) -> Column:
        parts = F.split(body, f"{literal(template.text)}|{literal(template.learn)}", 2)
        return let(F.struct(parts.alias("parts"), F.contains(body, F.lit(template.learn)).alias("learned")), of_parts)

    def of_parts(found: Column) -> Column:
        texts = F.split(F.element_at(found.parts, 2), literal(template.next), -1)
        return let(
            F.struct(unescape(F.element_at(found.parts, 1)).alias("role"), found.learned.alias("learned")),
            lambda head: F.transform(
                texts,
                lambda text: F.struct(
                    head.role.alias("role"), unescape(text).alias("text"), head.learned.alias("learned")
                ),
            ),
        )

    blocks = F.split("formatted", literal(template.start), -1)
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turns_of)).alias("turns"),
    )
