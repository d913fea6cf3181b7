"""Preference formatting: chosen and rejected conversations with their shared prompt rendered once.

The longest common prefix of turns (role and text equal) becomes the prompt.
What follows on either side becomes a completion with spans of code points
that train: the texts and end marks of assistant turns; all else is masked.

Two forms. :func:`formatted` works on a row that holds both conversations.
:func:`compared` works on turns: the two sides meet turn by turn, by rank, and
the least rank that differs ends the prefix of the whole conversation, however
long. Only its output is paged into rows of ``SEGMENT`` turns, so no group is
unbounded; prefix, prompt and completions don't depend on the pages, whose texts
joined in order are those of the whole conversation (spans count from the start
of their own row's text).

Defined cases: null roles and texts are empty; of several rows for one turn the
least (role, text) counts; rows without conversation or turn number are left
out; equal conversations give two empty completions; a missing side is a
conversation without turns; very long turns and conversations of any length are
whole; columns that bear the name of a new one give way to it, others stay in
:func:`formatted` and are left out of :func:`compared`; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

#: Turns of one row of the output.
SEGMENT = 4096
END = "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def ranked(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, rank, t, total): one row a turn, numbered from 0 in the order of the turn numbers.

    Pages of ``SEGMENT`` consecutive turn numbers are numbered by themselves and
    shifted by the turns before them, so no window spans a whole conversation.
    """
    told = F.struct(F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    one = turns.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull()).groupBy(id_col, F.col(turn_col).alias("_n")).agg(F.min(told).alias("t"))
    one = materialise(one.select(id_col, "_n", F.floor(F.col("_n") / SEGMENT).cast("long").alias("_p"), "t"), "turns")
    w = Window.partitionBy(id_col)
    sizes = one.groupBy(id_col, "_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.select(id_col, "_p", before.alias("before"), F.sum("n").over(w).alias("total"))
    inside = F.row_number().over(Window.partitionBy(id_col, "_p").orderBy("_n")) - 1
    return one.withColumn("i", inside).join(at, [id_col, "_p"]).select(id_col, (F.col("before") + F.col("i")).alias("rank"), "t", "total")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))
    first = F.array_position(F.transform(pairs, lambda p: p["a"] == p["b"]), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(n).cast("long")


def _spans(turns: Column) -> Column:
    """Trained code points of the rendered turns: (start, end), end exclusive."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + 5  # <| |> and the line's end
        end = start + F.length(t["text"]) + len(END)
        span = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["out"], span).alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", shared: str | None = None) -> DataFrame:
    """``pairs`` with n_prefix and prompt; the two conversations become completions, with <name>_spans beside them.

    ``shared``: column of the number of leading turns that are prompt; by default those that agree.
    """
    none = F.array().cast(TURNS)
    a, b = F.coalesce(chosen, none), F.coalesce(rejected, none)
    rest = [c for c in pairs.columns if c not in (chosen, rejected, "n_prefix", "prompt", f"{chosen}_spans", f"{rejected}_spans")]
    text = lambda t: F.array_join(F.transform(t, rendered), "")
    tail = lambda t: F.slice(t, (F.col("n_prefix") + 1).cast("int"), F.size(t))
    cut = pairs.select(*rest, a.alias("a"), b.alias("b"), F.explode(F.array(F.col(shared) if shared else _prefix(a, b))).alias("n_prefix"))
    return cut.select(
        *rest,
        "n_prefix",
        text(F.slice("a", 1, F.col("n_prefix").cast("int"))).alias("prompt"),
        text(tail(F.col("a"))).alias(chosen),
        _spans(tail(F.col("a"))).alias(f"{chosen}_spans"),
        text(tail(F.col("b"))).alias(rejected),
        _spans(tail(F.col("b"))).alias(f"{rejected}_spans"),
    )


def compared(both: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, segment, chosen, rejected, whole, shared) from (id, rank, chosen, rejected): turns of either side by rank, null where a side has ended.

    ``whole`` is the length of the common prefix of the conversation, ``shared``
    the part of it in the row's page.
    """
    told = both.groupBy(id_col).agg(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("rank"))).alias("first"), (F.max("rank") + 1).alias("total"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "chosen", "rejected"))).alias("r")
    cut = both.groupBy(id_col, F.floor(F.col("rank") / SEGMENT).cast("long").alias("segment")).agg(listed)
    cut = cut.join(told.select(id_col, F.coalesce("first", "total").alias("whole")), id_col)
    side = lambda name: F.filter(F.transform("r", lambda x: x[name]), lambda x: x.isNotNull()).alias(name)
    inside = F.least(F.col("whole") - F.col("segment") * SEGMENT, F.size("r").cast("long"))
    return cut.select(id_col, "segment", side("chosen"), side("rejected"), "whole", F.greatest(inside, F.lit(0).cast("long")).alias("shared"))


def sampled(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, rank, chosen, rejected): each conversation against itself with its very last turn replaced by that of its neighbour (id xor 1)."""
    rows = materialise(ranked(turns, id_col), "ranked")
    last = materialise(rows.where("rank = total - 1"), "last-turns")
    other = last.select(F.col(id_col).bitwiseXOR(F.lit(1)).alias(id_col), F.col("t").alias("rejected"))
    ends = last.join(other, id_col, "left").select(id_col, "rank", F.col("t").alias("chosen"), "rejected")
    return rows.where("rank < total - 1").select(id_col, "rank", F.col("t").alias("chosen"), F.col("t").alias("rejected")).unionByName(ends)
