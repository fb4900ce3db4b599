"""Chat formatting for preferences: the common turns of a chosen and a rejected conversation become one prompt, the rest of
each a completion with the spans that a loss may count.

All of it is DataFrame operations on one row a pair. A turn is rendered as START role, line feed, text, END, line feed. A
completion's mask lists the spans (start:end, code points, end exclusive) of its assistant texts with their END marks.

Turns of a conversation are ordered by turn, then role and text; a row that repeats counts once. A null role counts as
user, null texts as empty, null turns come first. Conversations whose id is null are one conversation. Equal
conversations give the whole as prompt and two empty completions; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|", "<|end|>\n"


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of struct(role, text) in order. Repeats go in partial aggregation, before the shuffle."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = df.select(F.col(id_col).alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t")).select("conv_id", F.expr("transform(t, x -> struct(x.role as role, x.text as text))").alias("turns"))


def with_other_reply(convs: DataFrame) -> DataFrame:
    """Pairs for conversations that carry no preference: conv_id, chosen (as it is), rejected (its last assistant text is
    that of the conversation whose id differs in the lowest bit; left out where there is none)."""
    last = "array_max(transform(turns, (x, i) -> if(x.role = 'assistant', i + 1, 0)))"
    convs = convs.withColumn("_last", F.expr(last))
    replies = convs.where("_last > 0").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("_for"), F.expr("turns[_last - 1].text").alias("_reply"))
    both = convs.join(replies, F.col("conv_id") == F.col("_for"), "left")
    rejected = "if(_last = 0, turns, slice(turns, 1, _last - 1) || if(_reply is null, array(), array(struct('assistant' as role, _reply as text))) || slice(turns, _last + 1, size(turns)))"
    return both.select("conv_id", F.col("turns").alias("chosen"), F.expr(rejected).alias("rejected"))


def formatted(pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """From id, chosen, rejected (arrays of struct(role, text)): id, prompt_turns, prompt, and chosen and rejected completions with their masks."""
    same = "aggregate(sequence(1, greatest(1, least(size(chosen), size(rejected)))), 0, (n, i) -> if(n = i - 1 and i <= size(chosen) and i <= size(rejected) and get(chosen, i - 1) <=> get(rejected, i - 1), i, n))"
    df = pairs.select(F.col(id_col), "chosen", "rejected", F.expr(same).alias("prompt_turns"))
    shown = "concat('{s}', x.role, '|>\n', x.text, '{e}')".format(s=START, e=END)
    out = [F.col(id_col), F.col("prompt_turns").cast("long").alias("prompt_turns"), F.expr(f"array_join(transform(slice(chosen, 1, prompt_turns), x -> {shown}), '')").alias("prompt")]
    for side in ("chosen", "rejected"):
        rest = f"slice({side}, prompt_turns + 1, size({side}))"
        spans = f"""aggregate({rest}, struct(0 as at, cast(array() as array<string>) as m), (a, x) -> struct(a.at + length({shown}) as at,
            if(x.role = 'assistant', array_append(a.m, concat(a.at + length(x.role) + {len(START) + 3}, ':', a.at + length({shown}))), a.m) as m)).m"""
        out += [F.expr(f"array_join(transform({rest}, x -> {shown}), '')").alias(side), F.expr(f"array_join({spans}, ',')").alias(f"{side}_mask")]
    return df.select(*out)


#: What formatted(with_other_reply(conversations(...))) returns, as DuckDB SQL over the table conversations.
SQL = r"""
WITH t AS (SELECT conv_id, list_transform(list_sort(list_distinct(list({'turn': turn, 'role': coalesce(role, 'user'), 'text': coalesce(text, '')}))), lambda x: {'role': x.role, 'text': x.text}) AS turns FROM conversations GROUP BY conv_id),
l AS (SELECT *, list_max(list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i ELSE 0 END)) AS last FROM t),
r AS (SELECT xor(conv_id, 1) AS partner, turns[last].text AS reply FROM l WHERE last > 0),
p AS (SELECT conv_id, turns AS c, CASE WHEN last = 0 THEN turns ELSE turns[1:last - 1] || CASE WHEN reply IS NULL THEN [] ELSE [{'role': 'assistant', 'text': reply}] END || turns[last + 1:] END AS d FROM l LEFT JOIN r ON r.partner = l.conv_id),
n AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(d)) + 1), lambda i: c[i] IS DISTINCT FROM d[i])[1] - 1, least(len(c), len(d))) AS k FROM p),
s AS (SELECT conv_id, k, c[1:k] AS a, c[k + 1:] AS b, d[k + 1:] AS e FROM n),
w AS (SELECT conv_id, k, list_transform(a, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS a, b, e,
  list_transform(b, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS bs, list_transform(e, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS es FROM s)
SELECT conv_id, k AS prompt_turns, coalesce(array_to_string(a, ''), '') AS prompt, coalesce(array_to_string(bs, ''), '') AS chosen,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN b[i].role = 'assistant' THEN (coalesce(length(array_to_string(bs[1:i - 1], '')), 0) + 14)::VARCHAR || ':' || length(array_to_string(bs[1:i], ''))::VARCHAR END), lambda x: x IS NOT NULL), ','), '') AS chosen_mask,
  coalesce(array_to_string(es, ''), '') AS rejected,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN e[i].role = 'assistant' THEN (coalesce(length(array_to_string(es[1:i - 1], '')), 0) + 14)::VARCHAR || ':' || length(array_to_string(es[1:i], ''))::VARCHAR END), lambda x: x IS NOT NULL), ','), '') AS rejected_mask
FROM w"""
