"""Chat formatting with a grammar round trip.

A conversation is rendered as turns of the grammar

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>\\n" }

and the rendered text is parsed again by a deterministic parser. Where the
turns that come back differ from the source, because a text holds control
strings, the conflicting content is escaped and rendered again until they are
identical. Escaping puts a backslash behind the first character of a control
string, before any backslashes that are there already; reading back removes one.
So every text can be escaped, and escaped texts hold no control string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some template takes as control; none may stay bare in a text.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_TAILS = "|".join(f"{re.escape(x[0])}(?=\\\\*{re.escape(x[1:])})" for x in CONTROL)
_BARE = "|".join(re.escape(x) for x in CONTROL)
_ESCAPED = "|".join(f"(?<={re.escape(x[0])})\\\\(?=\\\\*{re.escape(x[1:])})" for x in CONTROL)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(f"({_TAILS})"), F.lit("$1\\\\"))


def unescape(c: Column) -> Column:
    """Removes one backslash from each escaped control string."""
    return F.regexp_replace(c, F.lit(_ESCAPED), F.lit(""))


def _role(c: Column) -> Column:
    """A role is one line: its line ends and backslashes are written as escapes."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_back(c: Column) -> Column:
    parts = F.split(c, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column) -> Column:
    """turns: array of struct(role, text), both already safe."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered text: array of struct(role, text, start, length).
    start and length are the span of the text as written, in code points. A text
    ends at the first end mark; what does not follow the grammar comes back as a
    turn that differs from any source (role null)."""
    pieces = F.split(formatted, re.escape(START))
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        rest = F.substring(p, F.length(role) + 2, F.length(p))
        text = F.substring_index(rest, END, 1)
        good = p == F.concat(role, F.lit("\n"), text, F.lit(END + "\n"))
        return F.struct(F.when(good, _role_back(unescape(role))).alias("role"), unescape(text).alias("text"), F.length(text).cast("long").alias("length"), (F.length(role) + 1).cast("long").alias("head"), F.length(p).cast("long").alias("whole"))

    parsed = F.transform(pieces, turn)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(parsed, zero, lambda a, p: F.struct((a["at"] + len(START) + p["whole"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + len(START) + p["head"])).alias("starts")), lambda a: a["starts"])
    return F.zip_with(parsed, starts, lambda p, s: F.struct(p["role"].alias("role"), p["text"].alias("text"), s.alias("start"), p["length"].alias("length")))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. One row per conversation: conv_id,
    formatted (the rendered text), turns (read back from it), loss_spans (array
    of start, length in code points: the assistant texts as written), escaped,
    round_trip (whether the turns that came back are the source).

    A null role or text counts as empty. Turns are ordered by turn (nulls
    first), then role and text; repeated rows stay repeated turns. A null
    conv_id is a conversation of its own. A conversation is one row of the
    result, so it is as large as its texts together. Other columns are not read.
    An empty table gives an empty result.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("rows")).select("conv_id", _plain(F.col("rows")).alias("source"))

    def safe(text) -> Column:
        return F.transform("source", lambda t: F.struct(_role(t["role"]).alias("role"), text(t["text"]).alias("text")))

    # First as it is; what does not come back whole, or leaves control strings bare, is escaped.
    bare = F.exists("source", lambda t: F.regexp_like(F.concat(t["text"], F.lit("\n"), t["role"]), F.lit(_BARE)))
    first = source.withColumn("formatted", render(safe(lambda x: x)))
    tried = first.withColumn("turns", parse(F.col("formatted"))).withColumn("escaped", bare | ~_plain(F.col("turns")).eqNullSafe(F.col("source")))
    both = lambda t: F.struct(escape(_role(t["role"])).alias("role"), escape(t["text"]).alias("text"))
    again = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.transform("source", both))).otherwise(F.col("formatted")))
    done = again.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("turns")))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return done.select("conv_id", "formatted", "turns", loss.alias("loss_spans"), "escaped", _plain(F.col("turns")).eqNullSafe(F.col("source")).alias("round_trip"))


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks for, read from formatted, turns and loss_spans."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    wide = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip", "escaped")
    return wide.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "round_trip", "escaped")
