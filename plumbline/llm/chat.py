"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it as context, then the
reply, of which alone the characters are trainable. Turns after the last reply (or a
conversation without one) make a closing example that has no trainable characters, so the
output holds every turn.

The template is ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside roles and texts a
backslash is doubled and a backslash is put into every control string after its first
character, so none of them can occur there; ``unescape`` takes both back.

Defined results: null text and null role are empty; a null conv_id is a conversation like
others; turns are ordered by turn (null first), then role, then text; repeated rows are turns
of their own; an empty table gives no examples; other columns are ignored. A conversation is
one example's text at least, so it is gathered in one row; conversations aren't gathered
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<(?=\||/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (index of its last turn), text, loss_start (from 1) and loss_length,
    both 0 where nothing is trainable."""
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("said"),
    )
    convs = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    formed = convs.select(
        "conv_id",
        F.transform("said", lambda t: (t["role"] == trained_role)).alias("trained"),
        F.transform("said", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).alias("heads"),
        F.transform("said", lambda t: escape(t["text"])).alias("bodies"),
    )
    whole = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    last = F.size("trained") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda k: F.get("trained", k) | (k == last))
    one = formed.select("conv_id", "trained", "heads", "bodies", whole.alias("whole"), F.explode(ends).alias("example"))
    context = one.select(
        "conv_id", "example", F.get("trained", F.col("example")).alias("trained"),
        F.concat(F.array_join(F.slice("whole", 1, F.col("example")), ""), F.get("heads", F.col("example"))).alias("context"),
        F.get("bodies", F.col("example")).alias("reply"),
    )
    return context.select(
        "conv_id", "example", F.concat("context", "reply", F.lit(END)).alias("text"),
        F.when(F.col("trained"), F.length("context") + 1).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.length("reply")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(text: Column) -> Column:
    """An example's turns as structs of role and text, read from the formatted text."""
    blocks = bound(F.split(text, r"<\|turn\|>"), lambda a: F.slice(a, 2, F.size(a)))

    def turn(block: Column) -> Column:
        parts = F.split(F.substring_index(block, END, 1), r"<\|text\|>")
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))

    return F.transform(blocks, turn)


def loss_text(examples: DataFrame) -> Column:
    """What stands under an example's loss mask, unescaped."""
    return unescape(F.substring(examples["text"], examples["loss_start"].cast("int"), examples["loss_length"].cast("int")))
