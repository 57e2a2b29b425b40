"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log row is (conv_id, msg, seq, kind, role, text); msg names a message within a conversation, seq is
any orderable type. Kinds: `delta` appends text, `edit` replaces all text so far by its own, `regen`
discards all text so far and appends its own (usually empty). Folding sorts a message's events by seq,
drops what comes before its last edit or regen, and joins the rest. Messages of a conversation stand in
the order of (first seq, role, text).

Template, per turn: <s>[ROLE]role[/ROLE]text</s>, where the text of a role that isn't trained on stands
between "[INST] " and " [/INST]". A control string inside a role or text gets a backslash after its
first character; one more where backslashes stand there already. Removing one backslash reverses it.

Defined results: null role or text is the empty string; a null turn sorts first; rows that tie in turn
stand in order of (role, text), equal rows stay separate turns; an empty table gives no row; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

TRAINED_ROLES = ("assistant",)
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\]))"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def event_log(turns: DataFrame) -> DataFrame:
    """The log from which a streaming client would have built these turns: assistants stream a draft that
    is regenerated, then two halves; others are typed, every third is edited to its final text."""
    t = F.col("text")
    event = lambda part, kind, text: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), text.alias("text"))
    head, tail = F.expr("left(text, length(text) div 2)"), F.expr("substr(text, length(text) div 2 + 1)")
    streamed = F.array(event(0, "delta", head), event(1, "regen", F.lit("")), event(2, "delta", head), event(3, "delta", tail))
    typed = F.array(event(0, "delta", t))
    edited = F.array(event(0, "delta", tail), event(1, "edit", t))
    # a message is named by its place, so that a task that runs again names it alike; rows that tie are equal
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("msg", F.row_number().over(place))
    picked = F.when(F.col("role").isin(*TRAINED_ROLES), streamed).when(F.pmod("turn", F.lit(3)) == 2, edited).otherwise(typed)
    exploded = rows.select("conv_id", "msg", "turn", "role", F.explode(picked).alias("e"))
    return exploded.select("conv_id", "msg", F.struct("turn", "e.part").alias("seq"), "e.kind", "role", "e.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<at, role, text>>), messages in order."""
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    message = log.groupBy("conv_id", "msg").agg(events.alias("events"), F.min("seq").alias("at"), F.coalesce(F.min("role"), F.lit("")).alias("role"))
    resets = F.filter(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i)), lambda i: i.isNotNull())
    kept = F.expr("slice(events, start, size(events))")
    message = message.withColumn("start", F.coalesce(F.array_max(resets), F.lit(0)) + 1)
    message = message.select("conv_id", "at", "role", F.array_join(F.transform(kept, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"))
    return message.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("messages"))


def render(conversations: DataFrame, trained_roles: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """(conv_id, formatted string, loss_mask array<struct<start, length>>), start counted in code points from 1."""
    trained = lambda role: role.isin(*trained_roles)

    def piece(m: Column) -> Column:
        head, body = F.concat(F.lit("<s>[ROLE]"), escape(m["role"]), F.lit("[/ROLE]")), escape(m["text"])
        learn = trained(m["role"])
        whole = F.when(learn, F.concat(head, body, F.lit("</s>"))).otherwise(F.concat(head, F.lit("[INST] "), body, F.lit(" [/INST]</s>")))
        return F.struct(whole.alias("text"), F.when(learn, F.length(head)).alias("skip"), F.length(body).alias("long"), F.length(whole).alias("all"))

    pieces = conversations.select("conv_id", F.transform("messages", piece).alias("pieces"))
    start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("mask"))

    def add(done: Column, p: Column) -> Column:
        span = F.array(F.struct((done["next"] + p["skip"]).alias("start"), p["long"].alias("length")))
        return F.struct((done["next"] + p["all"]).alias("next"), F.when(p["skip"].isNull(), done["mask"]).otherwise(F.concat(done["mask"], span)).alias("mask"))

    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), F.aggregate("pieces", start, add)["mask"].alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Turns and the texts under the loss mask, read back from the formatted string."""

    def turn(segment: Column) -> Column:
        inner = F.substring(segment, 10, 2**31 - 1)
        role = F.substring_index(inner, "[/ROLE]", 1)
        body = F.substr(inner, F.length(role) + 8)
        plain = F.when(body.startswith("[INST] "), F.substr(body, F.lit(8), F.length(body) - 15)).otherwise(body)
        return F.struct(unescape(role).alias("role"), F.when(unescape(role).isin(*TRAINED_ROLES), unescape(body)).otherwise(unescape(plain)).alias("text"))

    segments = F.filter(F.split("formatted", "</s>", -1), lambda s: s != "")
    learned = F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"], m["length"])))
    return formatted.select("conv_id", "formatted", F.transform(segments, turn).alias("turns"), learned.alias("learned"))


def with_probe(turns: DataFrame) -> DataFrame:
    """The table and conversation -1, whose two texts are control strings."""
    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.unionByName(turns.sparkSession.sql(f"select * from values (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') as t(conv_id, turn, role, text)"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = parse(render(reconstruct(event_log(with_probe(table(spark, sf_dir, "conversations"))))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\\\2\3', 'g')"

OP9_SQL = f"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(20 + length({_SQL_ESCAPED.format('role')}) + length({_SQL_ESCAPED.format('text')}) + case when role = 'assistant' then 0 else 15 end) as bigint) as formatted_chars
from rows group by conv_id
"""
