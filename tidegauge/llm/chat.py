"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it as context, only its text under
the loss mask. A turn reads [INST]role[/INST]text</s>. Control strings inside roles and texts are
escaped: a backslash is doubled, and one is put behind the first character of a control string; undoing
it drops each backslash that isn't doubled. Marked texts can so be split and restored exactly.

An example holds its whole conversation up to the target, so a conversation must fit one row, and
output grows with the square of its turns: that is the method. Conversations are otherwise independent.

Cases: null text or role counts as empty; rows of one turn number are all kept, ordered by turn, role and
text; a conversation that doesn't end with an assistant gets a last example without loss, so that no turn
is lost; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
CONTROL = r"<(/?s>|</?SYS>>)|\[(/?INST\])"
OPEN, SHUT, END = "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angled = F.regexp_replace(doubled, r"<(/?s>|</?SYS>>)", r"<\\$1")
    return F.regexp_replace(angled, r"\[(/?INST\])", r"[\\$1")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, example (from 0), target_turn (position from 0, null without loss),
    text, loss_start, loss_length (characters of text), last (whether this example holds every turn)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("t"))
    n = F.size("t")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("t", i)["role"] == target_role) | (i == n - 1))
    marked = F.transform("t", lambda x: F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(SHUT), x["body"], F.lit(END)))
    each = whole.select("conv_id", "t", marked.alias("m"), F.posexplode(targets).alias("example", "i"))
    turn = F.get("t", F.col("i"))
    trained = turn["role"] == target_role
    size = F.when(trained, F.length(turn["body"])).otherwise(0)
    text = F.array_join(F.slice("m", F.lit(1), F.col("i") + 1), "")
    return each.select("conv_id", "example", F.when(trained, F.col("i")).alias("target_turn"), text.alias("text"), size.alias("loss_length"), (F.col("i") == F.size("t") - 1).alias("last")).select(
        "conv_id", "example", "target_turn", "text", F.when(F.col("target_turn").isNotNull(), F.length("text") - len(END) - F.col("loss_length")).otherwise(0).alias("loss_start"), "loss_length", "last"
    )


def parsed(text: Column) -> Column:
    """Array of (role, text) that a formatted text holds."""
    marked = F.filter(F.split(text, END), lambda x: x != "")
    parts = F.transform(marked, lambda x: F.split(F.substr(x, F.lit(len(OPEN) + 1)), r"\[/INST\]"))
    return F.transform(parts, lambda x: F.struct(restored(x[0]).alias("role"), restored(x[1]).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from examples() alone: turns and loss text read back, characters formatted."""
    said = F.array_join(F.transform(parsed(F.col("text")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = restored(F.substr("text", F.col("loss_start") + 1, F.col("loss_length")))
    rows = formatted.select(
        "conv_id", "example", F.when(F.col("target_turn").isNotNull(), loss).otherwise("").alias("loss"), F.length("text").alias("chars"),
        F.when(F.col("last"), F.size(parsed(F.col("text")))).alias("n"), F.when(F.col("last"), F.sha2(said, 256)).alias("sha"),
    )
    whole = rows.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("sha").alias("sha"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("x"), F.sum("chars").alias("chars"))
    under = F.array_join(F.transform("x", lambda r: r["loss"]), "")
    return whole.select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), F.col("sha").alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars")
    )
