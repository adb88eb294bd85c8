"""Chat formatting by a finite-state machine over roles. DataFrame functions only.

A declarative template names, for each role, the literals around its text and
whether the text is learnt. Turns run through the machine in order; it accepts
an optional system turn, then user and assistant in turn, and reports the first
turn that breaks the order. Each turn gives segments (literal or text) with a
loss flag. Characters that could start a control string are escaped inside
texts, so the formatted string always reads back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
#: role -> (state before -> state after). Other roles fit no state.
MACHINE = {"system": {"start": "system"}, "user": {"start": "user", "system": "user", "assistant": "user"}, "assistant": {"user": "assistant"}}
#: Roles whose texts are learnt; the literals are the same for all roles.
TEMPLATE = {"start": START, "middle": MIDDLE, "end": END, "loss": ("assistant",)}
_ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escaped(c: Column) -> Column:
    """No ``<`` or ``[`` is left, so no control string can stand in a text."""
    for plain, code in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _state_after(state: Column, role: Column) -> Column:
    out = F.lit("invalid")
    for name, moves in MACHINE.items():
        for before, after in moves.items():
            out = F.when((role == name) & (state == before), F.lit(after)).otherwise(out)
    return out


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: turns in order, and the machine's verdict.

    Null role and text count as empty; a null turn number comes first; equal
    turn numbers go by role, then text, and repeated rows all stay. A null
    conv_id is a conversation like any other.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    held = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("broken")),
        lambda a, t: F.struct(
            _state_after(a["state"], t["role"]).alias("state"),
            (a["n"] + 1).alias("n"),
            F.when((a["broken"] < 0) & (_state_after(a["state"], t["role"]) == "invalid"), a["n"]).otherwise(a["broken"]).alias("broken"),
        ),
    )
    return held.withColumn("_walk", walk).select(
        "conv_id", "turns", (F.col("_walk.broken") < 0).alias("valid"), F.col("_walk.broken").alias("first_broken_turn"), F.col("_walk.state").alias("last_state")
    )


def segments(convs: DataFrame, template: Mapping = TEMPLATE) -> DataFrame:
    """Adds ``segments``: array of (text, loss) in the order of the output."""
    learnt = list(template["loss"])
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda t: F.array(
        seg(F.concat(F.lit(template["start"]), escaped(t["role"]), F.lit(template["middle"])), F.lit(False)),
        seg(escaped(t["text"]), t["role"].isin(learnt)),
        seg(F.lit(template["end"]), F.lit(False)),
    )
    return convs.withColumn("segments", F.flatten(F.transform("turns", of_turn)))


def formatted(convs: DataFrame, template: Mapping = TEMPLATE) -> DataFrame:
    """(conv_id, valid, first_broken_turn, formatted, mask): the training string and its
    loss mask, as runs of (length in code points, loss) that cover the string."""
    return segments(convs, template).select(
        "conv_id",
        "valid",
        "first_broken_turn",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        F.transform("segments", lambda s: F.struct(F.char_length(s["text"]).alias("length"), s["loss"].alias("loss"))).alias("mask"),
    )


def read_back(out: DataFrame, template: Mapping = TEMPLATE) -> DataFrame:
    """Turns and learnt text, from the formatted string and its mask alone.

    The literals cut the string into consecutive pieces (start to middle, text,
    end). The mask's runs must be as many and as long, one by one, so that a
    run's offsets are those of its piece; else this raises. What is learnt are
    the pieces under runs with loss, whichever they are.
    """
    start, middle, end = (F.lit(template[k]) for k in ("start", "middle", "end"))
    cut = F.expr("split(formatted, '\\\\Q" + template["start"] + "\\\\E', -1)")

    def pieces(s: Column) -> Column:
        role = F.substring_index(s, template["middle"], 1)
        text = F.substring_index(F.substring_index(s, template["middle"], -1), template["end"], 1)
        tail = F.substr(s, F.char_length(role) + F.char_length(middle) + F.char_length(text) + 1)
        return F.array(F.concat(start, role, middle), text, tail)

    whole = F.flatten(F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut), F.lit(1)) - 1), pieces))
    bad = F.raise_error(F.lit("the loss mask does not fit"))
    under = lambda p, m: F.struct(p.alias("text"), F.when(F.char_length(p) == m["length"], m["loss"]).otherwise(bad).alias("loss"))
    fits = F.when(F.size("_p") == F.size("mask"), F.zip_with("_p", "mask", under)).otherwise(bad)
    back = out.withColumn("_p", whole).withColumn("_p", fits)
    role_of = lambda p: F.substr(p, F.char_length(start) + 1, F.char_length(p) - F.char_length(start) - F.char_length(middle))
    turn = lambda p, i: F.struct(
        unescaped(role_of(F.get("_p", i - 1)["text"])).alias("role"), unescaped(p["text"]).alias("text"), p["loss"].alias("loss"), (i % 3).alias("k"), (F.get("_p", i + 1)["text"] == end).alias("closed")
    )
    turns = F.filter(F.transform("_p", turn), lambda t: t["k"] == 1)
    turns = F.transform(turns, lambda t: F.when(t["closed"], F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss"))).otherwise(F.raise_error(F.lit("a turn has no end"))))
    learnt = F.concat_ws("", F.transform(F.filter("_p", lambda p: p["loss"]), lambda p: unescaped(p["text"])))
    return back.withColumn("turns", turns).withColumn("loss_text", learnt).drop("_p")


def digests(turns: DataFrame, template: Mapping = TEMPLATE) -> DataFrame:
    """Formats all conversations and digests what reads back."""
    back = read_back(formatted(conversations(turns), template), template)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_broken_turn").cast("long").alias("first_broken_turn"),
    )
