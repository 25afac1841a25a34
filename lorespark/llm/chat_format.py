r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its text under the loss mask. Turns that no assistant turn
follows stand in one more row without a mask, so the output holds every turn.

A turn is `### Role: text</turn>` and a line break. Inside roles and texts a
backslash is written `\b`, three hashes `\h` and the end mark `\e`, so the marks
never occur inside; reading back undoes it exactly. system, user and assistant
are written with a capital; any other role is written as it is behind `\r`, with
its colons as `\c`.

Built-in functions only. A conversation is gathered in one row, for each example
holds its preceding turns; conversations themselves spread over all tasks.

Defined cases: null text and null role are empty; turns are ordered by turn
number (null first), then role, then text, and repeated rows are turns of their
own; rows without a conversation id are one conversation with a null id; columns
other than the four are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
#: Written form of what may not occur inside a text, in the order of escaping; reading back goes the other way.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), (END, "\\e")]
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def role_title(role: Column) -> Column:
    titled = F.concat(F.lit("\\r"), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for name, title in ROLES.items():
        titled = F.when(role == name, title).otherwise(titled)
    return titled


def title_role(title: Column) -> Column:
    role = unescape(F.replace(F.substring(title, F.lit(3), F.length(title)), F.lit("\\c"), F.lit(":")))
    for name, shown in ROLES.items():
        role = F.when(title == shown, name).otherwise(role)
    return role


def format_conversations(turns: DataFrame, target_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`id_col`, `example` (from 0), `is_last`, `formatted`, `loss_start` and `loss_length` (code points from 0; null without a target)."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    written = turns.select(F.col(id_col), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text")).select(
        id_col,
        F.struct(
            "_turn",
            "_role",
            "_text",
            F.concat(F.lit(HEAD), role_title(F.col("_role")), F.lit(": ")).alias("opening"),
            escape(F.col("_text")).alias("body"),
        ).alias("_piece"),
    )
    gathered = written.groupBy(id_col).agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    places = F.filter(F.sequence(F.lit(1), F.size("_pieces")), lambda at: (F.element_at("_pieces", at)["_role"] == target_role) | (at == F.size("_pieces")))
    examples = gathered.select(id_col, "_pieces", F.posexplode(places).alias("example", "_at"))
    target = F.element_at("_pieces", F.col("_at"))
    before = F.aggregate(
        F.slice("_pieces", F.lit(1), F.col("_at") - 1), F.lit(0).cast("long"), lambda total, piece: total + F.length(piece["opening"]) + F.length(piece["body"]) + len(END) + 1
    )
    has_target = target["_role"] == target_role
    return examples.select(
        id_col,
        F.col("example").cast("long").alias("example"),
        (F.col("_at") == F.size("_pieces")).alias("is_last"),
        F.array_join(F.transform(F.slice("_pieces", F.lit(1), F.col("_at")), lambda piece: F.concat(piece["opening"], piece["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.when(has_target, before + F.length(target["opening"])).alias("loss_start"),
        F.when(has_target, F.length(target["body"]).cast("long")).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted text."""
    parts = F.split(formatted, END + "\n", -1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda part: F.struct(
            title_role(F.substring(F.substring_index(part, ": ", 1), F.lit(len(HEAD) + 1), F.length(part))).alias("role"),
            unescape(F.substring(part, F.length(F.substring_index(part, ": ", 1)) + 3, F.length(part))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask as it was before formatting; empty without a mask."""
    return F.coalesce(unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int"))), F.lit(""))


def digests(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the examples of each conversation."""
    turns = read_turns(F.col("formatted"))
    read = examples.select(
        id_col,
        "example",
        F.length("formatted").cast("long").alias("_chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("_loss"),
        F.when(F.col("is_last"), F.size(turns).cast("long")).alias("_turns"),
        F.when(F.col("is_last"), F.sha2(F.array_join(F.transform(turns, lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), ""), 256)).alias("_digest"),
    )
    losses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "_loss"))), lambda one: one["_loss"]), "")
    return (
        read.groupBy(id_col)
        .agg(F.max("_turns").alias("n_turns"), F.max("_digest").alias("turns_sha256"), losses.alias("_losses"), F.sum("_chars").alias("formatted_chars"))
        .select(id_col, "n_turns", "turns_sha256", F.length("_losses").cast("long").alias("loss_chars"), F.sha2("_losses", 256).alias("loss_sha256"), "formatted_chars")
    )
