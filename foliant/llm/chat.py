"""Preference formatting in DataFrame expressions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text equal, by place) is
rendered once as the prompt; what follows is rendered for each side as its completion, with a loss mask that trains on
assistant turns alone. A turn is rendered as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break;
the marker's ``<|im_`` inside a role or text becomes ``< |im_``, so that a text can't end its own turn. A mask is run lengths
in code points, ``14x0,120x1,1x0``: of each turn the head, then the text with its end marker, then the line break.

Conversations of a table that names no pairs are paired by their first turns: among ``BLOCK`` consecutive ids, those with the
same first turn (role and text) two by two in order of id, then those left over two by two, the lesser id the chosen one. One
shuffle, by block of ids, brings all this together, so a first turn that is common to many rows makes no group of its own.

Defined results: turns are ordered by (turn, role, text), and repeated turns are kept; a null role or text renders as empty
but differs from an empty one when turns are compared; rows with a null pair or side, or null conversation, belong to no pair;
a pair with one side has an empty prompt and null columns for the other (``unpaired``); two equal conversations have empty
completions (``identical``); an empty table gives no rows; other input columns are not carried. A conversation is one row of the
result, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive conversation ids among which pairs are made; bounds what is sorted together.
BLOCK = 1024
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(_OPEN), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(_CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        trained = F.when(t["role"] == "assistant", "x1,").otherwise("x0,")
        return F.concat(F.char_length(_head(t)).cast("string"), F.lit("x0,"), F.char_length(_body(t)).cast("string"), trained, F.lit("1x0"))

    return F.array_join(F.transform(turns, runs), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text. One row per pair."""
    sides = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id")
    return _formatted(sides.agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, _turn()))).alias(f"_{s}") for s in ("chosen", "rejected")]))


def _turn() -> Column:
    return F.struct("turn", "role", "text")


def _formatted(both: DataFrame) -> DataFrame:
    """``both``: pair_id, and the ordered turns of each side in ``_chosen`` and ``_rejected``, empty where there are none."""
    equal = F.zip_with(
        "_chosen",
        "_rejected",
        lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]),
    )
    first_other = F.array_position(equal, False)
    placed = both.withColumn("_n", F.when(first_other == 0, F.size("_chosen")).otherwise(first_other - 1).cast("int"))
    rest = {s: F.slice(f"_{s}", F.col("_n") + 1, F.greatest(F.size(f"_{s}"), F.lit(1))) for s in ("chosen", "rejected")}
    return placed.select(
        "pair_id",
        F.when((F.size("_chosen") == 0) | (F.size("_rejected") == 0), "unpaired")
        .when((F.col("_n") == F.size("_chosen")) & (F.col("_n") == F.size("_rejected")), "identical")
        .otherwise("paired")
        .alias("status"),
        F.col("_n").cast("long").alias("n_prompt_turns"),
        _render(F.slice("_chosen", F.lit(1), F.col("_n"))).alias("prompt"),
        *[F.when(F.size(f"_{s}") > 0, _render(rest[s])).alias(s) for s in ("chosen", "rejected")],
        *[F.when(F.size(f"_{s}") > 0, _mask(rest[s])).alias(f"{s}_mask") for s in ("chosen", "rejected")],
    )


def format_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conversations``: conv_id, turn, role, text. One row per pair, under the chosen conversation's id as ``pair_id``."""
    known = conversations.where("conv_id is not null").select((F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("_block"), "conv_id", "turn", "role", "text")
    whole = known.repartition("_block").groupBy("_block", "conv_id").agg(F.sort_array(F.collect_list(_turn())).alias("_turns"))
    head = F.struct(F.col("_turns")[0]["role"].alias("role"), F.col("_turns")[0]["text"].alias("text"))
    alike = Window.partitionBy("_block", "_head")
    place, n = F.row_number().over(alike.orderBy("conv_id")), F.count(F.lit(1)).over(alike)
    ranked = whole.withColumn("_head", head).withColumn("_alike", place <= n - n % 2)
    in_group = Window.partitionBy("_block", "_alike", F.when(F.col("_alike"), F.col("_head"))).orderBy("conv_id")
    placed = ranked.select("_block", "conv_id", "_turns", F.row_number().over(in_group).alias("_place"), F.lag("conv_id").over(in_group).alias("_before"))
    chosen = F.col("_place") % 2 == 1
    sided = placed.select("_block", F.when(chosen, F.col("conv_id")).otherwise(F.col("_before")).alias("pair_id"), chosen.alias("_is_chosen"), "_turns")
    none = F.lit(None)
    sides = [F.coalesce(F.first(F.when(is_side, F.col("_turns")).otherwise(none), ignorenulls=True), F.slice(F.first("_turns"), 1, 0)) for is_side in (F.col("_is_chosen"), ~F.col("_is_chosen"))]
    return _formatted(sided.groupBy("_block", "pair_id").agg(sides[0].alias("_chosen"), sides[1].alias("_rejected")))
