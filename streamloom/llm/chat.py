"""Chat formatting from an event log, in DataFrame operations only.

A log holds, per conversation, messages and what happened to them: streamed deltas, edits and
regenerations. The fold takes, for each message, the text of its last message, edit or regenerate event
and the deltas after it. Messages are then rendered and joined into one string per conversation, with the
spans of that string that carry loss.

Template: ``[INST] text [/INST]`` for user, ``<<SYS>>text<</SYS>>`` for system, ``text</s>`` for assistant,
``<<ROLE hex>>text<</ROLE>>`` for any other role. Inside a text, a control string gets one backslash after
its opening bracket, before those that are there already; reading takes one away. So no unescaped text
can contain a mark, and every text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The control strings after their opening bracket; shared with SQL, so in the syntax of both engines.
BODIES = r"/?s>|/?INST\]|</?SYS>>|<ROLE |</ROLE>>"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|<<ROLE [0-9A-F]*>>.*?<</ROLE>>|.*?</s>"


def escaped(text) -> "F.Column":
    return F.regexp_replace(text, rf"([<\[])(\\*)({BODIES})", r"$1\\$2$3")


def unescaped(text) -> "F.Column":
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({BODIES})", "$1$2$3")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, position, message_id, role, text) from events (conv_id, seq, kind, message_id, role, text).

    kind is message, delta, edit or regenerate; any other counts as a delta. Events are taken by seq,
    ties by kind and text. A message stands where its first event stood; its role is the first one
    given. A null text is empty. Deltas before any other event of their message start it.
    """
    e = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    m = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(e)).alias("log"))
    last = F.array_max(F.transform("log", lambda x, i: F.when(x.kind.isin("message", "edit", "regenerate"), i).otherwise(0)))
    m = m.withColumn("last", last)
    text = F.array_join(F.transform(F.filter("log", lambda x, i: i >= F.col("last")), lambda x: x.text), "")
    role = F.filter("log", lambda x: x.role.isNotNull())
    return m.select("conv_id", F.col("log")[0]["seq"].alias("position"), "message_id", F.get(role, F.lit(0))["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from messages; spans are (start, length) in code points, from 0.

    Messages stand by position, ties by message_id. The loss is on assistant texts as they stand in
    the string, without their end mark.
    """
    text, role = escaped(F.col("text")), F.coalesce("role", F.lit(""))
    shown = F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
    shown = shown.when(role == "assistant", F.concat(text, F.lit("</s>"))).otherwise(F.concat(F.lit("<<ROLE "), F.hex(role), F.lit(">>"), text, F.lit("<</ROLE>>")))
    order = Window.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("shown", shown).withColumn("stop", F.sum(F.length("shown")).over(order)).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("position", "message_id")))
    m = m.withColumn("start", F.col("stop") - F.length("shown"))
    turns = F.array_sort(F.collect_list(F.struct("n", "shown", "start", (role == "assistant").alias("loss"))))
    m = m.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), (F.length(t.shown) - 4).cast("long").alias("length")))
    return m.select("conv_id", F.array_join(F.transform("turns", lambda t: t.shown), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted) -> "F.Column":
    """Array of (role, text) from a formatted string; an absent role comes back empty."""

    def turn(s):
        inner = lambda a, b: F.substring(s, F.lit(a + 1), F.length(s) - (a + b))
        role = F.when(s.startswith("[INST] "), "user").when(s.startswith("<<SYS>>"), "system")
        role = role.when(s.startswith("<<ROLE "), F.decode(F.unhex(F.regexp_extract(s, "^<<ROLE ([0-9A-F]*)>>", 1)), "utf-8")).otherwise("assistant")
        text = F.when(s.startswith("[INST] "), inner(7, 8)).when(s.startswith("<<SYS>>"), inner(7, 8))
        text = text.when(s.startswith("<<ROLE "), F.regexp_extract(s, "(?s)^<<ROLE [0-9A-F]*>>(.*)<</ROLE>>$", 1)).otherwise(inner(0, 4))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def turn_events(rows: DataFrame) -> DataFrame:
    """One message event per row of (conv_id, turn, role, text); rows of one turn are taken by role and text, nulls
    first, and repeated rows are turns of their own. A null text is empty, a null role stays null; rows without a conv_id
    are one conversation."""
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select("conv_id", seq.alias("seq"), F.lit("message").alias("kind"), seq.alias("message_id"), "role", "text")


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from formatted strings and their spans. A null role comes back empty; a conversation without
    assistant texts has an empty loss."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    r = rendered.withColumn("loss", loss)
    return r.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(render(reconstruct(turn_events(rows.unionByName(own)))))


SQL = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown as (
  select *, length(regexp_replace(text, '([<\[])(\\*)({BODIES})', '\1\\\2\3', 'g'))
    + case role when 'user' then 15 when 'system' then 15 when 'assistant' then 4 else 18 + 2 * strlen(role) end as n
  from rows
), agg as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
    sum(n) as formatted_chars
  from shown group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from agg
"""
