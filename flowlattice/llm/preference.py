"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of whole turns (same role, same text) is rendered once as the prompt; what follows it on either
side is that side's completion. A completion's mask covers it in runs `length:flag`, with flag 1 on what a model is to
learn, the texts of assistant turns and their end marks, and 0 on turn heads and on other turns.

Built-in functions only; the turns of one conversation meet in one row, as an example needs them whole.
"""

from pyspark.sql import functions as F

from flowlattice.llm import common

ANSWERING = "assistant"
# The marks around a turn.
HEAD_OPEN, HEAD_CLOSE, END = "<|", "|>\n", "<|end|>\n"


def turns_of(table, key, name):
    """(key, array of (turn, role, text)) per conversation; null roles and texts are empty, ties are ordered by role and text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return table.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias(name))


def _head(turn):
    return F.concat(F.lit(HEAD_OPEN), turn["role"], F.lit(HEAD_CLOSE))


def _rendered(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.char_length(_head(t)), F.lit(":0 "), F.char_length(t["text"]) + len(END), F.when(t["role"] == ANSWERING, ":1").otherwise(":0"))), " ")


def preference_examples(pairs, key="pair_id"):
    """One example per row of `pairs` (key, chosen, rejected: arrays of (turn, role, text) in order).

    A missing side is an empty conversation. Equal sides give empty completions; nothing is dropped. Turn numbers do not
    count for equality.
    """
    empty = F.array().cast(pairs.schema["chosen"].dataType)
    both = pairs.select(key, F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))

    def rest(side):
        return F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    return both.select(
        key, F.col("n").cast("bigint").alias("prompt_turns"), _rendered(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"), _mask(rest("chosen")).alias("chosen_mask"),
        _rendered(rest("rejected")).alias("rejected"), _mask(rest("rejected")).alias("rejected_mask"))


def pairs_of(chosen, rejected, key="pair_id"):
    """Pairs from two turn tables (key, turn, role, text); a conversation on one side only is paired with an empty one. Null keys pair with nothing."""
    return turns_of(chosen, key, "chosen").join(turns_of(rejected, key, "rejected"), key, "full")


def repeated_answer_pairs(conversations):
    """Pairs (conv_id, chosen, rejected) from plain conversations.

    Chosen is a conversation up to its last answer. Rejected ends in a poor answer instead: the previous answer once
    more, or an echo of the turn before where there is none. Conversations without an answer make no pair.
    """
    turns = F.col("turns")
    answers = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.element_at(turns, i)["role"] == ANSWERING)
    framed = turns_of(conversations, "conv_id", "turns").withColumn("answers", answers).where(F.size("answers") > 0)
    last = F.element_at("answers", -1)
    before = F.when(F.size("answers") > 1, F.element_at(F.col("answers"), F.greatest(F.size("answers") - 1, F.lit(1)))).otherwise(last - 1)
    framed = framed.withColumn("last", last).withColumn("before", before)
    final = F.element_at(turns, F.col("last"))
    poor = F.when(F.col("before") > 0, F.element_at(turns, F.greatest("before", F.lit(1)))["text"]).otherwise("")
    answer = F.struct(final["turn"].alias("turn"), final["role"].alias("role"), poor.alias("text"))
    return framed.select("conv_id", F.slice(turns, F.lit(1), F.col("last")).alias("chosen"),
                         F.concat(F.slice(turns, F.lit(1), F.col("last") - 1), F.array(answer)).alias("rejected"))


def op1_preference(spark, sf_dir):
    return preference_examples(repeated_answer_pairs(common.table(spark, sf_dir, "conversations")), "conv_id")


# DuckDB: rejected differs in the last answer only.
ORACLE_OP1 = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, max(n) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT l.conv_id, l.last, max(t.n) FILTER (WHERE t.role = 'assistant' AND t.n < l.last) AS earlier FROM l JOIN t USING (conv_id) GROUP BY ALL),
a AS (SELECT b.conv_id, b.last, f.text AS good, coalesce(p.text, '') AS poor FROM b
    JOIN t f ON f.conv_id = b.conv_id AND f.n = b.last
    LEFT JOIN t p ON p.conv_id = b.conv_id AND p.n = coalesce(b.earlier, b.last - 1)),
c AS (SELECT *, CASE WHEN good = poor THEN last ELSE last - 1 END AS shared FROM a)
SELECT c.conv_id, c.shared AS prompt_turns,
  coalesce(string_agg('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' ORDER BY t.n) FILTER (WHERE t.n <= c.shared), '') AS prompt,
  CASE WHEN good = poor THEN '' ELSE '<|assistant|>' || chr(10) || good || '<|end|>' || chr(10) END AS chosen,
  CASE WHEN good = poor THEN '' ELSE '14:0 ' || (length(good) + 8) || ':1' END AS chosen_mask,
  CASE WHEN good = poor THEN '' ELSE '<|assistant|>' || chr(10) || poor || '<|end|>' || chr(10) END AS rejected,
  CASE WHEN good = poor THEN '' ELSE '14:0 ' || (length(poor) + 8) || ':1' END AS rejected_mask
FROM c JOIN t ON t.conv_id = c.conv_id GROUP BY c.conv_id, c.shared, c.good, c.poor
"""
