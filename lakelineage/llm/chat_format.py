r"""Chat formatting, by grouping and Spark expressions alone.

A conversation becomes

    ### <role>\n<text>[<part><text>]*</turn>\n

for each run of adjacent turns with one role: its texts are joined by ``<part>``. Inside roles and texts, ``\`` is
written ``\\``, ``</turn>`` ``\e``, ``<part>`` ``\p`` and ``###`` ``\h``; in roles a line feed is ``\n``. So control
strings stand only where the template put them, and :func:`read_back` restores every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, PART, END = "### ", "<part>", "</turn>\n"
#: Control strings and what stands for them, after ``\`` has become ``\\``.
ESCAPES = (("</turn>", "\\e"), (PART, "\\p"), ("###", "\\h"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, code in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: between two ``\\\\``, a backslash can only begin a code."""

    def plain(x: Column) -> Column:
        for control, code in (*ESCAPES, ("\n", "\\n")):
            x = F.replace(x, F.lit(code), F.lit(control))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``, the code points that training counts.

    ``turns``: ``conv_id``, ``turn``, ``role``, ``text`` and any more, which are not used. ``loss_spans`` are
    ``(start, end)`` of each text by ``trained_role``, end exclusive, in order.

    Defined cases: a null text or role is empty; turns are ordered by ``turn``, null first, then role and text, so ties
    have one order; repeated rows are separate turns; each row without a ``conv_id`` is a conversation of its own with
    a null id; an empty table gives an empty result. A conversation is one value of the result, so its turns meet in
    one task; no other rows do.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        "conv_id",
        alone.alias("_alone"),
        F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    # Adjacent turns of one role become one block (role, texts); the array is walked once.
    empty = F.array().cast("array<struct<role:string,parts:array<string>>>")

    def add(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        part = escape(t["text"])
        new = F.struct(t["role"].alias("role"), F.array(part).alias("parts"))
        more = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(part)).alias("parts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(more))).otherwise(F.concat(blocks, F.array(new)))

    blocks = chats.select("conv_id", F.aggregate("ts", empty, add).alias("blocks"))
    head = lambda b: F.concat(F.lit(HEAD), F.replace(escape(b["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    pieces = blocks.select(
        "conv_id",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(F.struct(head(b).alias("s"), F.lit(False).alias("loss"))),
                    F.flatten(
                        F.transform(
                            b["parts"],
                            lambda x, i: F.concat(
                                F.when(i > 0, F.array(F.struct(F.lit(PART).alias("s"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<s:string,loss:boolean>>")),
                                F.array(F.struct(x.alias("s"), (b["role"] == trained_role).alias("loss"))),
                            ),
                        )
                    ),
                    F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
                ),
            )
        ).alias("p"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def walk(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["s"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
        F.aggregate("p", start, walk, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        cut = F.locate("\n", block)
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD)))
        parts = F.split(F.substring(block, cut + 1, F.length(block)), PART, -1)
        return F.transform(parts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def digest(chats: DataFrame) -> DataFrame:
    """What reading the result of :func:`format_chats` gives back, one row per conversation."""
    read = chats.select("conv_id", read_back(F.col("formatted")).alias("ts"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("n"))
    whole = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
