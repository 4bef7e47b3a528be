"""Chat formatting: turns sorted, merged where adjacent turns have one role, and concatenated, by Spark expressions only.

Template: a block per run of turns of one role, `<|im_start|>ROLE` and a line feed, the run's texts with `<|im_sep|>`
between them, `<|im_end|>` and a line feed. A role is URL-encoded. Control strings inside of a text get one backslash
after their first character (one more where there are some), so that no text can open or close a block, and taking one
away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The strings that may not stand in a text as they are.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, SEP, END = CONTROL[:3]
TRAINED_ROLE = "assistant"


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


_REST = "|".join(sorted({_quoted(c[1:]) for c in CONTROL}, key=lambda c: (-len(c), c)))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", r"$1$2")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted), one row per conversation.

    Turns run by number, null numbers first; ties by role, then text. Null roles and texts count as empty. Rows of a null
    conversation id form one conversation. An empty table gives no rows; other columns are not read. A conversation is
    one row of the result, so its turns meet in one task; different conversations, however many, are spread.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    # adjacent turns of one role: a run starts where the role differs from the turn before
    starts = F.filter(F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())
    runs = sorted_turns.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        run = F.slice("turns", start + 1, stop - start)
        texts = F.array_join(F.transform(run, lambda t: escaped(t["text"])), SEP)
        return F.concat(F.lit(START), F.url_encode(F.get("turns", start)["role"]), F.lit("\n"), texts, F.lit(END + "\n"))

    return runs.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct (role, text), texts unescaped."""
    blocks = F.filter(F.split(formatted, _quoted(START), -1), lambda b: b != "")

    def of_block(b: Column) -> Column:
        role = F.url_decode(F.substring_index(b, "\n", 1))
        body = F.substring(b, F.instr(b, "\n") + 1, F.char_length(b))
        texts = F.split(F.substring(body, F.lit(1), F.char_length(body) - len(END) - 1), _quoted(SEP), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def chat_report(turns: DataFrame, **options) -> DataFrame:
    """What a reader finds in the formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Null texts and roles are empty, null ids one conversation; an empty table gives no rows. A very long text is escaped and
    read back whole.
    """
    read = format_chats(turns, **options).withColumn("turns", parsed(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == TRAINED_ROLE), lambda t: t["text"]), "")
    return read.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
