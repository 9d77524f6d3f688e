"""Chat formatting by event-sourced reconstruction.

A log has events ``conv_id, turn, seq, kind, role, text``. Kinds: ``message`` (the default)
begins a message at its turn; ``delta`` appends to the turn's latest message; ``edit`` replaces that
message's text; ``regenerate`` discards it and begins again with its own text. Events of a
turn fold in order of seq (ties: role, then text) into final messages, and these are rendered.

The template marks a turn as ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a
newline. A control string inside a role or text (of this template, or of other common
ones) gets a tilde after its first character, one more if it had some; reading back
takes it off again, so every text survives.

A conversation is cut into chunks of ``CHUNK`` turns, which fold, sort and render apart, so
even one that holds a third of all rows is rendered by many tasks; a chunk's rows are the
output, and ``assembled`` joins them where a whole string is wanted.

Null texts and roles are empty; a null turn comes before all others; a null conv_id is a
conversation of its own; repeated rows are messages each; extra columns are ignored; an
empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, running_totals

CHUNK = 64
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"~*(?:/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>|/?SYS>>)"


def escaped(t: Column) -> Column:
    return F.regexp_replace(t, rf"([<\[])({CONTROL})", "$1~$2")


def unescaped(t: Column) -> Column:
    return F.regexp_replace(t, rf"([<\[])~({CONTROL})", "$1$2")


def escaped_role(r: Column) -> Column:
    return escaped(F.replace(F.replace(r, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescaped_role(r: Column) -> Column:
    return F.replace(F.replace(unescaped(r), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def messages(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, chunk, turn, msg, role, text`` of a log of events."""
    e = events.select("conv_id", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).cast("long").alias("chunk"), "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.repartition("conv_id", "chunk")  # serves all that follows
    turn = Window.partitionBy("conv_id", "chunk", "turn").orderBy("seq", "role", "text", "kind")
    upto = turn.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("msg", F.sum((F.col("kind") == "message").cast("int")).over(upto)).withColumn("ver", F.sum((F.col("kind") != "delta").cast("int")).over(upto)).withColumn("n", F.row_number().over(turn))
    of = ("conv_id", "chunk", "turn", "msg")
    e = e.withColumn("last", F.max("ver").over(Window.partitionBy(*of))).withColumn("who", F.first("role", ignorenulls=True).over(Window.partitionBy(*of).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    e = e.where("ver = last").groupBy(*of).agg(F.first("who").alias("role"), F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts"))
    return e.select(*of, F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def formatted(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Chunks ``conv_id, chunk, formatted, loss_spans``: the rendered turns of a chunk, and the
    spans in it (code points, ends exclusive) of the texts that the loss is taken on."""
    m = messages(events).select("conv_id", "chunk", F.struct("turn", "msg", (F.col("role") == learn).alias("loss"), F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body")).alias("m"))
    m = m.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("m")).alias("m"))
    tail = F.lit(END + "\n")
    whole = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], tail)), "")
    ends = running_totals(F.transform("m", lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(tail)))
    spans = F.zip_with("m", ends, lambda x, e: F.struct((e - F.length(tail) - F.length(x["body"])).alias("start"), (e - F.length(tail)).alias("end"), x["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return m.select("conv_id", "chunk", whole.alias("formatted"), spans.alias("loss_spans"))


def assembled(chunks: DataFrame) -> DataFrame:
    """``conv_id, formatted``: a conversation's chunks as one string."""
    x = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "formatted"))).alias("c"))
    return x.select("conv_id", F.array_join(F.transform("c", lambda c: c["formatted"]), "").alias("formatted"))


def read_back(chunks: DataFrame) -> DataFrame:
    """What the output holds: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``, from rendered strings and loss spans alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(head) + 2, F.length(p))
        return F.concat(unescaped_role(F.substring(head, F.lit(len(START) + 1), F.length(head))), F.lit("\n"), unescaped(text), F.lit("\n"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    x = chunks.select("conv_id", "chunk", F.transform(pieces, turn).alias("t"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    x = x.select("conv_id", F.struct("chunk", F.array_join("t", "").alias("turns"), "loss").alias("c"), F.size("t").cast("long").alias("n"), "chars")
    x = x.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("c")).alias("c"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("c", lambda c: c["loss"]), "")
    x = x.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("c", lambda c: c["turns"]), ""), 256).alias("turns_sha256"), loss.alias("loss"), "formatted_chars")
    return x.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def as_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns as a log of messages."""
    return rows.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are control strings."""
    bad = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", bad), (-7, 1, "assistant", bad)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(~*(?:/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>|/?SYS>>))', '\1~\2', 'g') as et,
             regexp_replace(replace(replace(role, '~', '~0'), chr(10), '~1'), '([<\[])(~*(?:/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>|/?SYS>>))', '\1~\2', 'g') as er from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(12 + length(er) + 1 + length(et) + 10 + 1)::bigint as formatted_chars
from e group by conv_id
"""
