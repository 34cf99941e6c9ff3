"""Preference formatting of chosen and rejected conversations.  DataFrame operations only.

For each pair the longest common prefix of turns (same role and same text) is rendered once as the prompt; what
follows is rendered as the chosen and the rejected completion, each with the spans that carry loss: the texts
and end marks of assistant turns, as code points ``start:end`` in the completion, end exclusive.

Pairs come as two tables of turns (``format_pairs``), or are made of one table (``branches``): conversations with the
same first turn are paired in the order of their ids, each as chosen against the one before it as rejected; one that shares
its first turn with none before it is set against its own branch, which ends with an echo in place of its middle answer.
A conversation is one training example, so its turns are brought into one row; nothing wider is.

Defined results: null text is empty; a null role is ``user``; turns sort by number (none first), then role, then text, so
repeated rows and ties have a fixed order; in one table each turn without an id is a conversation by itself, of two
tables the turns without a key are one; a pair with one side only has an empty prompt and an empty completion
for the other; the marks' opening characters in a text are split by a blank, so that no text can forge a turn; very
long texts are rendered whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import materialize, pick

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def turns(rows: DataFrame, key: str, out: str) -> DataFrame:
    """One row per key: its turns in order, as an array of (role, text)."""
    r = pick(rows, key, "turn", "role", "text")
    one = F.struct(F.col("turn").alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_ = F.sort_array(F.collect_list(one))
    return r.groupBy(key).agg(F.transform(sorted_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(out))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that two arrays share."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), F.greatest(shorter, F.lit(0))), lambda x: x["a"] == x["b"])
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(shorter).cast("int")


def _header(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit(CLOSE))


def render(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(_header(t), _body(t))), "")


def loss_spans(ts: Column) -> Column:
    """start:end of each assistant turn's text and end mark in the rendered turns, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.char_length(_header(t))
        end = begin + F.char_length(_body(t))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(ts, start, step)["spans"], ",")


def preferences(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(key, n_prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss) from two arrays of turns a row."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(key, F.coalesce(F.col(chosen), empty).alias("_c"), F.coalesce(F.col(rejected), empty).alias("_r"))
    p = p.withColumn("_n", common_prefix(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    return p.select(
        key,
        F.col("_n").alias("n_prompt_turns"),
        render(F.slice(F.col("_c"), F.lit(1), F.col("_n"))).alias("prompt"),
        render(rest("_c")).alias("chosen"),
        render(rest("_r")).alias("rejected"),
        loss_spans(rest("_c")).alias("chosen_loss"),
        loss_spans(rest("_r")).alias("rejected_loss"),
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Preference rows from two tables of turns (key, turn, role, text)."""
    a, b = turns(chosen, key, "chosen"), turns(rejected, key, "rejected").withColumnRenamed(key, "_key")
    both = a.join(b, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    return preferences(both.withColumn(key, F.coalesce(key, "_key")), key)


def echoed(ts: Column) -> Column:
    """The turns up to the middle answer, whose text is that of the turn before it (none: empty)."""
    answers = F.filter(F.transform(ts, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    at = F.get(answers, F.floor((F.size(answers) - 1) / 2).cast("int"))
    echo = F.struct(F.lit("assistant").alias("role"), F.when(at > 0, F.get(ts, at - 1)["text"]).otherwise("").alias("text"))
    return F.when(F.size(answers) > 0, F.concat(F.slice(ts, F.lit(1), at), F.array(echo))).otherwise(ts)


def before(keys: DataFrame, group: str, key: str) -> DataFrame:
    """``keys`` with ``prior``: the key before each row's in its group, null for a group's first.

    Rows are dealt out by range of (group, key), so a group of any size is spread over tasks; what a range's first row
    needs from the ranges before it is a table with one row a range.
    """
    width = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keys.repartitionByRange(width, group, key).withColumn("part", F.spark_partition_id()), "ranged")
    here = F.struct(F.col(group).alias("g"), F.col(key).alias("k"))
    ends = ranged.groupBy("part").agg(F.max(here).alias("end"))
    ends = ends.select("part", F.lag("end").over(W.orderBy("part")).alias("end"))  # one row a range
    rows = ranged.join(F.broadcast(ends), "part").withColumn("last", F.coalesce(F.lag(here).over(W.partitionBy("part").orderBy(group, key)), "end"))
    return rows.withColumn("prior", F.when(F.col("last.g") == F.col(group), F.col("last.k"))).drop("part", "end", "last")


def branches(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation, as arrays of turns."""
    made = pick(conversations, "conv_id", "turn", "role", "text")
    told = materialize(turns(made.where("conv_id is not null"), "conv_id", "chosen"), "conversations")
    first = told.select("conv_id", F.xxhash64(F.get("chosen", F.lit(0))["role"], F.get("chosen", F.lit(0))["text"]).alias("h"))
    pairs = before(first, "h", "conv_id").where("prior is not null").select("conv_id", "prior")
    other = materialize(pairs, "pairs").join(told.select(F.col("conv_id").alias("prior"), F.col("chosen").alias("_other")), "prior").drop("prior")
    # a hash may be shared by other first turns; the turns decide
    same = F.get("_other", F.lit(0)) == F.get("chosen", F.lit(0))
    met = told.join(other, "conv_id", "left").withColumn("rejected", F.when(same, F.col("_other")).otherwise(echoed(F.col("chosen")))).drop("_other")
    one = F.array(F.struct(F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    loose = made.where("conv_id is null").select("conv_id", one.alias("chosen"))
    return met.unionByName(loose.withColumn("rejected", echoed(F.col("chosen"))))


def preference_rows(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen against another that begins like it, or against a branch of its own."""
    return preferences(branches(conversations), "conv_id")
