"""Chat formatting in budgeted windows.

A conversation's turns are laid into windows at turn borders: prefix sums of turn tokens say where the next window starts, so
that the new turns of each fit BUDGET less the system turn and the history (a longer turn has a window of its own, uncut).
Each further window repeats the system turn and at most HISTORY last turns that fit HISTORY_TOKENS; the loss mask covers each
assistant text once, where it is new. Control characters inside roles and texts are escaped, reversibly. Only built-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import WORD, hold, table

BUDGET, HISTORY, HISTORY_TOKENS, PER_TURN = 512, 2, 128, 4
#: Fixed pairs: a character that the template uses, and its escape. Escapes are undone in this order.
ESCAPES = [("<", "\\l"), (">", "\\g"), ("#", "\\h"), ("\\", "\\b")]
OPEN, MID, CLOSE = "<turn ", ">\n", "\n</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(MID), escape(turn["text"]), F.lit(CLOSE))


def format_conversations(df: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, windows) of ``df(conv_id, turn, role, text)``; a window has text, loss (start and length of each span, from 1)
    and n_context, the number of repeated turns at its head.

    Turns are ordered by turn, then role, then text; null roles and texts are empty; rows with a null conv_id are one
    conversation. Repeated rows are repeated turns. A conversation is formatted in one task, as its digest is.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    own = df.select("conv_id", F.struct("turn", role, text).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = hold(own, tokens=F.transform("turns", lambda t: F.regexp_count(t["text"], F.lit(WORD)) + PER_TURN), system=(F.get("turns", F.lit(0))["role"] == "system").cast("int"))
    head = F.when(F.col("system") == 1, F.get("tokens", F.lit(0))).otherwise(0)
    own = hold(own, room=F.greatest(F.lit(budget) - head - HISTORY_TOKENS, F.lit(1)))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("i"), zero.alias("sum"), zero.alias("open"), F.lit(0).alias("last"), F.lit("0").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        """One turn more. The state is copied at each step: starts are text there, of which a copy costs least."""
        full = (acc["sum"] + n - acc["open"] > F.col("room")) & (acc["i"] > acc["last"])
        return F.struct(
            (acc["i"] + 1).alias("i"), (acc["sum"] + n).alias("sum"), F.when(full, acc["sum"]).otherwise(acc["open"]).alias("open"), F.when(full, acc["i"]).otherwise(acc["last"]).alias("last"),
            F.when(full, F.concat(acc["starts"], F.lit(","), acc["i"].cast("string"))).otherwise(acc["starts"]).alias("starts"),
        )

    own = hold(own, starts=F.split(F.aggregate("tokens", start, step, lambda acc: acc["starts"]), ",").cast("array<int>"))

    def window(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        low = F.greatest(at - HISTORY, F.col("system"))
        recent = F.filter(
            F.when(at > low, F.sequence(low, at - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.aggregate(F.sequence(i, at - 1), F.lit(0), lambda a, j: a + F.get("tokens", j)) <= HISTORY_TOKENS,  # slices copy their whole array
        )
        repeated = F.concat(F.when((F.col("system") == 1) & (at > 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), recent)
        shown = F.concat(repeated, F.sequence(at, until - 1))
        return F.struct(F.transform(shown, lambda i: F.get("turns", i)).alias("turns"), F.size(repeated).alias("n_context"))

    own = hold(own, plan=F.transform("starts", window))
    pieces = F.transform("plan", lambda w: F.struct(F.transform(w["turns"], _render).alias("parts"), w["turns"].alias("turns"), w["n_context"].alias("n_context")))
    own = hold(own, pieces=pieces).select("conv_id", "pieces")

    def finish(w: Column) -> Column:
        ends = F.aggregate(w["parts"], F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        spans = F.transform(
            w["turns"],
            lambda t, i: F.when(
                (i >= w["n_context"]) & (t["role"] == "assistant"),
                F.struct((F.get(ends, i) + len(OPEN) + F.length(escape(t["role"])) + len(MID) + 1).alias("start"), F.length(escape(t["text"])).alias("length")),
            ),
        )
        return F.struct(F.array_join(w["parts"], "").alias("text"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"), w["n_context"].alias("n_context"))

    return own.select("conv_id", F.transform("pieces", finish).alias("windows"))


def read_back(windows: Column) -> Column:
    """The conversation's turns, each once, parsed from the text of its windows."""

    def parse(part: Column) -> Column:
        role = F.substring_index(part, ">", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(part, F.length(role) + len(MID) + 1)).alias("text"))

    def turns(w: Column) -> Column:
        parts = F.split(w["text"], CLOSE, -1)
        return F.transform(F.slice(parts, w["n_context"] + 1, F.size(parts) - 1 - w["n_context"]), parse)

    return F.flatten(F.transform(windows, turns))


def lost_text(windows: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.flatten(F.transform(windows, lambda w: F.transform(w["loss"], lambda s: unescape(F.substr(w["text"], s["start"], s["length"]))))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(r"select -7L conv_id, turn, role, r'\### Assistant: </turn> ok' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = hold(format_conversations(rows), out=F.col("windows")).select("conv_id", F.col("out").alias("windows"))
    out = hold(out, turns=read_back(F.col("windows")), loss=lost_text(F.col("windows")))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.length(w["text"])).alias("formatted_chars"), F.size("windows").cast("long").alias("n_windows"),
    )
