"""Chat formatting in budgeted windows, in DataFrame operations only.

Turns of a conversation are laid out one after the other; prefix sums of their
tokens tell where each begins. A turn of more than half the budget is a window
of its own; the turns between two such are cut into windows wherever the prefix
sum passes a multiple of half the budget, so that no window of several turns
exceeds it; the budget is what the system turn and the history leave of the
tokens allowed. Every window but the first repeats the conversation's system turn
and the last turns before it, as many as the limits allow; repeated turns, and
all but the assistant's, are outside the loss mask.

Prefix sums are taken in two steps: within ranges of turns, dealt by range so
that a long conversation covers many tasks, and then over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
#: Tasks that share the turns of one conversation in a join.
SALTS = 8
BEGIN, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
#: What texts must not contain as it stands: first the escape itself, then what opens a control string.
ESCAPES = (("%", "%25"), ("<|", "%3C|"), ("[INST]", "%5BINST]"), ("[/INST]", "%5B/INST]"), ("<s>", "%3Cs>"), ("</s>", "%3C/s>"), ("<<SYS>>", "%3C%3CSYS>>"), ("<</SYS>>", "%3C%3C/SYS>>"))


def escape(text: Column) -> Column:
    """Reversible: a percent sign left in the result begins a code."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("%3C", "<"), ("%5B", "["), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_sums(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, tokens, ...) with number (from 1) and before, the tokens of earlier turns, in each conversation; by turn, role and text."""
    order = ["turn", "role", "text"]
    dealt = turns.repartitionByRange("conv_id", "turn").withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "turns")
    inside = W.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = dealt.withColumn("number", F.count(F.lit(1)).over(inside)).withColumn("through", F.sum("tokens").over(inside)).withColumn("long", F.sum("is_long").over(inside))
    earlier = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("is_long").alias("l"))
    base = totals.select(F.col("conv_id").alias("of"), F.col("range").alias("of_range"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"base_{c}") for c in "ntl"])
    out = local.join(base, local.conv_id.eqNullSafe(base.of) & (local.range == base.of_range))
    return out.select(*[c for c in turns.columns], (F.col("number") + F.col("base_n")).alias("number"), (F.col("through") + F.col("base_t") - F.col("tokens")).alias("before"), (F.col("long") + F.col("base_l") - F.col("is_long")).alias("long_before"))


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row for each window: conv_id, window, formatted, n_repeated (turns at its start that earlier windows have), loss (array of start, length in formatted, from 0), n_new, n_tokens.

    conversations has conv_id, turn, role, text. A null text or role counts as
    empty, null turns come first, a null conv_id is a conversation, too; rows
    that repeat a turn follow one another by role and text. A turn, or
    a system turn, beyond the budget is kept whole. Tokens are runs of other than
    white space, one for a text without any.
    Further columns aren't looked at; an empty table gives an empty result.
    """
    col = lambda name, kind: F.col(f"`{name}`").cast(kind)
    turns = conversations.select(col("conv_id", "long").alias("conv_id"), col("turn", "long").alias("turn"), F.coalesce(col("role", "string"), F.lit("")).alias("role"), F.coalesce(col("text", "string"), F.lit("")).alias("text"))
    # a turn without words counts as one token, so that a window has no more turns than tokens
    turns = turns.withColumn("tokens", F.greatest(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long"))
    systems = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("role", "text", "tokens"), F.struct("turn", "role", "text")).alias("s"))
    # a long conversation's turns are dealt over SALTS tasks, its system turn is copied for each
    systems = systems.select(F.col("conv_id").alias("of"), "s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    salt = F.pmod(F.hash("turn", "text"), F.lit(SALTS))
    room = F.greatest(F.lit(2), F.floor((F.lit(budget - history_tokens) - F.coalesce("s.tokens", F.lit(0))) / 2))
    turns = turns.join(systems, F.col("conv_id").eqNullSafe(F.col("of")) & (salt == F.col("of_salt")), "left").withColumn("room", room).drop("of", "s", "of_salt")
    turns = turns.withColumn("is_long", (F.col("tokens") > F.col("room")).cast("long"))
    placed = prefix_sums(turns)
    # a long turn, the short ones between two long ones, and among these each half budget, make a window
    slot = F.struct((2 * F.col("long_before") + F.col("is_long")).alias("a"), F.when(F.col("is_long") == 1, F.lit(0)).otherwise(F.floor(F.col("before") / F.col("room"))).alias("b"))
    placed = written(placed.select("conv_id", "role", "text", "tokens", "number", "before", slot.alias("slot")), "placed")
    marked = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(END))
    piece = lambda repeated: F.struct(F.lit(repeated).alias("order"), "number", marked.alias("marked"), F.when((F.col("role") == "assistant") & F.lit(repeated == 2), F.struct((F.length(escape(F.col("role"))) + len(BEGIN) + len(MIDDLE)).alias("start"), F.length(escape(F.col("text"))).alias("length"))).alias("loss"), F.col("tokens").alias("tokens"))
    fresh = placed.select("conv_id", "slot", piece(2).alias("piece"))
    starts = placed.groupBy("conv_id", "slot").agg(F.min("number").alias("first"), F.min("before").alias("at")).where("first > 1")
    same = lambda a, b: a.conv_id.eqNullSafe(b.conv_id)
    system = placed.where("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("role", "text", "tokens", "number"), "number").alias("s")).select("conv_id", "s.*")
    kept = starts.join(system, same(starts, system)).where("number < first").select(starts.conv_id, "slot", piece(0).alias("piece"))
    asked = starts.select(F.col("conv_id").alias("of"), F.col("slot").alias("for"), "at", F.explode(F.expr(f"sequence(greatest(first - {history_turns}, 1L), first - 1L)")).alias("wanted")) if history_turns else None
    parts = fresh.union(kept)
    if asked is not None:
        back = placed.join(asked, placed.conv_id.eqNullSafe(asked.of) & (placed.number == asked.wanted)).where(f"at - before <= {history_tokens} and role <> 'system'")
        parts = parts.union(back.select(placed.conv_id, F.col("for").alias("slot"), piece(1).alias("piece")))
    whole = parts.groupBy("conv_id", "slot").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct((acc.at + x.loss.start).alias("start"), x.loss.length.alias("length"))
        return F.struct((acc.at + F.length(x.marked)).alias("at"), F.when(x.loss.isNotNull(), F.concat(acc.out, F.array(here))).otherwise(acc.out).alias("out"))

    loss = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")), step, lambda acc: acc.out)
    repeated = F.size(F.filter("pieces", lambda x: x.order < 2))
    return whole.select("conv_id", F.element_at("pieces", -1).number.alias("window"), F.array_join(F.transform("pieces", lambda x: x.marked), "").alias("formatted"), repeated.alias("n_repeated"), loss.alias("loss"), (F.size("pieces") - repeated).alias("n_new"), F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests are of one string for each conversation, so that string is put together in one row.
    """
    turns = F.slice(F.split(F.regexp_replace("formatted", r"<\|end\|>$", ""), r"<\|end\|>", -1), F.col("n_repeated") + 1, F.col("n_new"))
    pair = lambda t: F.split(F.substring(t, len(BEGIN) + 1, F.length(t)), r"<\|text\|>", -1)
    said = F.array_join(F.transform(turns, lambda t: F.concat(unescape(pair(t)[0]), F.lit("\n"), unescape(pair(t)[1]), F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda x: unescape(F.substring("formatted", x.start + 1, x.length))), "")
    rows = formatted.select("conv_id", "window", "n_new", said.alias("said"), learnt.alias("learnt"), F.length("formatted").alias("chars"))
    both = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("all"), F.sum("n_new").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    text = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "")
    return both.select("conv_id", "n_turns", F.sha2(text("said").cast("binary"), 256).alias("turns_sha256"), F.length(text("learnt")).cast("long").alias("loss_chars"), F.sha2(text("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
