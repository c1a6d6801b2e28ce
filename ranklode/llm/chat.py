"""Chat formatting: cumulative snapshots of a conversation collapse into the longest.

Logs often hold a conversation again after every turn. Turns get a rolling hash: turn k's value
joins the hashes of all turns up to it, each with its place. A conversation whose last value is
among the inner values of another is a prefix of it and is dropped by an anti-join; of equal
conversations the one with the smallest conv_id stays. What is left is rendered.

Turns are in order of ``turn``, then role, then text, and count by their place in that order, so
gaps don't matter and repeated rows are turns. Null turns come first, null roles and texts count
as such (not as empty) and render empty; rows with a null conv_id are one conversation with a
null id, which comes after all others. Empty tables give empty results; extra columns are ignored.
The hash sums 60-bit numbers in two lanes without overflow, so a conversation is never gathered
to be hashed, and one that many share only costs its last values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"


def _said(c: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with place (from 1), two rolling hashes, and size (turns)."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(whole))
    digest = F.md5(F.concat_ws("\x1f", F.col("place").cast("string"), _said("role"), _said("text")))
    lane = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(20,0)")
    for k, a in (("h1", 1), ("h2", 16)):
        turns = turns.withColumn(k, F.sum(lane(a)).over(upto).cast("decimal(38,0)"))
    return turns


def maximal(conversations: DataFrame) -> DataFrame:
    """The turns (conv_id, place, turn, role, text) of the conversations that stay."""
    turns = prefixes(conversations)
    last = turns.filter("place = size").select("conv_id", "place", "h1", "h2")
    inner = turns.filter("place < size").select(F.col("place").alias("_p"), F.col("h1").alias("_1"), F.col("h2").alias("_2")).distinct()
    alike = lambda: (F.col("place") == F.col("_p")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))
    one = last.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("_keep"))  # equal ones meet before the shuffle
    first = one.join(inner, alike(), "left_anti").select("_keep")
    return turns.join(first, F.col("conv_id").eqNullSafe(F.col("_keep")), "left_semi").select("conv_id", "place", "turn", "role", "text")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of each conversation that stays. A conversation's own turns are
    the one thing gathered: they become one string."""
    turn = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("")), F.lit(TAIL), F.coalesce("text", F.lit("")), F.lit("\n" + END))
    one = maximal(conversations).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", turn.alias("t")))).alias("_t"))
    return one.select("conv_id", "n_turns", F.array_join(F.col("_t")["t"], "").alias("text"))


#: DuckDB SQL of ``rendered`` over conversations, comparing the turns themselves.
SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    coalesce('=' || role, '-') || chr(31) || coalesce('=' || text, '-') AS said,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS line FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(said ORDER BY place) AS said, string_agg(line, '' ORDER BY place) AS text FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT unnest(list_transform(range(1, n), lambda k: said[1:k])) AS said FROM c WHERE n > 1),
l AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.said = c.said)),
k AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY conv_id NULLS LAST) AS r FROM l)
SELECT conv_id, n::BIGINT AS n_turns, text FROM k WHERE r = 1
"""
