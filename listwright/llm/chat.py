"""Conversations to text segments with loss flags, by a template and a role machine. Native only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

# The codes hold neither a mark's first character nor, after a backslash, anything but their letter.
_CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    """Text in which no control string can stand; ``unescape`` gives it back exactly."""
    for plain, code in _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles carry loss, and which may follow which.

    ``follows`` is the machine: its state is the role last seen, "" at the start, and a turn
    is in order if its role is among those its state allows. ``final`` are states to end in.
    """

    begin: str = "### "
    between: str = ": "
    end: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("user", "assistant")


def _role(template: Template, role: Column) -> Column:
    """A role as it stands in a mark: known ones with a capital, others as they are, escaped."""
    known = sorted({r for rs in template.follows.values() for r in rs})
    return F.when(role.isin(known), F.initcap(role)).otherwise(F.concat(F.lit("?"), escape(role)))


def _read_role(role: Column) -> Column:
    return F.when(F.startswith(role, F.lit("?")), unescape(F.substr(role, F.lit(2)))).otherwise(F.lower(role))


def checked_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns with the machine's state before them and whether they may follow it.

    The state is the role of the turn before, so one sorted pass over a conversation is enough.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    allowed = F.create_map(*(
        x for k, v in template.follows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    state = F.lag("role", 1, "").over(order)
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("state", state)
    return turns.withColumn("in_order", F.coalesce(F.array_contains(F.try_element_at(allowed, "state"), F.col("role")), F.lit(False)))


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, place, role, in_order, segments)``: each turn as segments with a loss flag."""
    turns = checked_turns(conversations, template)
    mark = F.concat(F.lit(template.begin), _role(template, F.col("role")), F.lit(template.between))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return turns.select(
        "conv_id", "place", "role", "in_order",
        F.array(part(mark, no), part(escape(F.col("text")), F.col("role").isin(*template.loss_roles)), part(F.lit(template.end), no)).alias("segments"))


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, valid, bad_turns, segments, formatted)``, one row per conversation.

    ``valid`` says that the role machine took every turn and ended in a final state; turns out
    of order are formatted all the same. Null texts and roles count as empty, null turns come
    first, equal turns are ordered by role and text, and null is a conversation of its own.
    """
    turns = segments(conversations, template)
    rows = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "in_order", "segments"))).alias("turns"))
    last = F.element_at("turns", -1)
    bad = F.size(F.filter("turns", lambda t: ~t["in_order"]))
    return rows.select(
        "conv_id", ((bad == 0) & last["role"].isin(*template.final)).alias("valid"), bad.alias("bad_turns"),
        F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"),
    ).withColumn("formatted", F.concat_ws("", F.col("segments.text")))


def read_turns(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text, as ``array<struct<role, text>>``."""
    whole = F.filter(F.split(text, _plain(template.end)), lambda t: t != "")

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.begin) + 1))
        at = F.instr(body, template.between)
        return F.struct(
            _read_role(F.left(body, at - 1)).alias("role"),
            unescape(F.substr(body, at + len(template.between))).alias("text"))

    return F.transform(whole, turn)


def _plain(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_loss(parts: Column) -> Column:
    """The texts under the loss mask of an array of segments, unescaped."""
    return F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"]))
