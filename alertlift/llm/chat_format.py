"""Chat formatting: an event log is folded into messages, and messages are rendered as training text with a loss mask.

Log.  A row is an event: ``conv_id``, ``position`` (place of its message in the conversation), ``entry`` (tells
messages of one place apart), ``seq`` (order of events within the message), ``kind``, ``role``, ``text``.
``start`` opens a message, ``delta`` appends, ``edit`` replaces the text so far, ``regenerate`` discards it; the text
of an event that discards begins the new version.  Folding is associative: a run of events comes down to (discards
what came before?, text), so a message of very many events is folded run by run of ``seq`` and then once more.

Template.  ``### role: text</turn>\\n``.  Backslashes and number signs of a text get a backslash, as does the slash of
``</``; so neither control string occurs inside a text, and taking each backslash away again gives the text back.

Output.  Rows ``conv_id``, ``piece``, ``text``, ``loss``: a conversation is cut into pieces of ``PIECE`` places, in
ascending order, whose texts joined are its formatted text.  ``loss`` holds the code points [start, end) within
the piece under the loss mask: texts of ``LEARNED`` roles.  No row holds a whole long conversation.

Awkward input.  Null text or role counts as empty, a null ``kind`` or any other one changes nothing, null ``conv_id`` is a
conversation of its own, null ``position`` or ``seq`` comes first.  An event that is there twice (same ``seq`` and
content) counts once; rows of a conversation table that are there twice are two turns.  Messages at one place are
ordered by role, then text.  An empty table gives none.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlift.sources.staging import scratch_path

#: Places of a conversation in one output row, and events folded at once.
PIECE, RUN = 32, 4096
#: Code points of one delta when a finished text is turned into a log.
DELTA = 2048
LEARNED = ("assistant",)

TURN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
_CONTROL, _CONTROL_IN_ROLE = r"([\\#]|(?<=<)/)", r"([\\#]|(?<=<)/|(?<=:) )"
_DISCARDS = ("start", "edit", "regenerate")
_FIRST = -(1 << 62)


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, _CONTROL_IN_ROLE if role else _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation_log(rows: DataFrame, conv: str = "conv_id", place: str = "turn") -> DataFrame:
    """Events of finished turns: an opening with the role, then the text in deltas of at most ``DELTA`` code points."""
    empty = F.coalesce(F.col("text").cast("string"), F.lit(""))
    deltas = F.regexp_extract_all(empty, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    opening = F.struct(F.lit("start").alias("kind"), F.col("role").cast("string").alias("role"), F.lit("").alias("text"))
    streamed = F.transform(
        deltas, lambda t: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), t.alias("text"))
    )
    keyed = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(place).cast("long").alias("position"),
        F.monotonically_increasing_id().alias("entry"),
        F.concat(F.array(opening), streamed).alias("events"),
    )
    return keyed.select(
        "conv_id", "position", "entry", F.posexplode("events").alias("seq", "event")
    ).select("conv_id", "position", "entry", F.col("seq").cast("long").alias("seq"), "event.*")


def _once(events: Column) -> Column:
    """Sorted events without those equal to the one before."""
    return F.filter(events, lambda e, i: (i == 0) | ~e.eqNullSafe(F.get(events, i - 1)))


def _folded(parts: Column) -> list[Column]:
    """``discards``, ``text`` and ``role`` of ordered parts with these fields."""
    last = F.coalesce(F.array_max(F.transform(parts, lambda p, i: F.when(p["discards"], i))), F.lit(-1))
    held = F.filter(parts, lambda p, i: i >= last)
    roles = F.filter(parts, lambda p: p["role"].isNotNull())
    return [
        F.exists(parts, lambda p: p["discards"]).alias("discards"),
        F.array_join(F.transform(held, lambda p: p["text"]), "").alias("text"),
        F.try_element_at(roles, F.lit(-1))["role"].alias("role"),
    ]


def fold_messages(events: DataFrame) -> DataFrame:
    """``conv_id``, ``piece``, ``position``, ``entry``, ``role``, ``text``: the final state of every message."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    event = F.struct(
        F.coalesce(F.col("seq"), F.lit(_FIRST)).alias("seq"),
        kind.isin(*_DISCARDS).alias("discards"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("role").cast("string").alias("role"),
    )
    place = F.coalesce(F.col("position").cast("long"), F.lit(_FIRST))
    runs = (
        events.where(kind.isin("delta", *_DISCARDS))
        .select(
            "conv_id", place.alias("position"), "entry", event.alias("event"),
            F.floor(F.coalesce(F.col("seq"), F.lit(_FIRST)) / RUN).alias("run"),
        )
        .groupBy("conv_id", "position", "entry", "run")
        .agg(F.array_sort(F.collect_list("event")).alias("events"))
        .select("conv_id", "position", "entry", "run", _once(F.col("events")).alias("events"))
        .select("conv_id", "position", "entry", "run", *_folded(F.col("events")))
    )
    # One shuffle for the second fold and the rendering: a piece holds all of a message.
    return (
        runs.withColumn("piece", F.floor(F.col("position") / PIECE))
        .repartition("conv_id", "piece")
        .groupBy("conv_id", "piece", "position", "entry")
        .agg(F.array_sort(F.collect_list(F.struct("run", "discards", "text", "role"))).alias("parts"))
        .select("conv_id", "piece", "position", "entry", *_folded(F.col("parts")))
        .withColumn("role", F.coalesce("role", F.lit("")))
        .drop("discards")
    )


def render(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Formatted pieces with their loss mask, from the result of ``fold_messages``."""
    head = F.concat(F.lit(TURN), escape(F.col("role"), role=True), F.lit(AFTER_ROLE))
    order = ["position", "role", "text", "entry"]
    so_far = Window.partitionBy("conv_id", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        messages.withColumns({"head": head, "body": escape(F.col("text"))})
        .withColumn("size", F.length("head") + F.length("body") + len(END))
        .withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        .withColumn("start", F.col("before") + F.length("head"))
        .select(
            "conv_id", "piece", "before", F.col("role").isin(*learned).alias("learned"), "start",
            (F.col("start") + F.length("body")).alias("end"), F.concat("head", "body", F.lit(END)).alias("turn"),
        )
    )
    pieces = turns.groupBy("conv_id", "piece").agg(
        F.array_sort(F.collect_list(F.struct("before", "turn", "learned", "start", "end"))).alias("turns")
    )
    spans = F.transform(
        F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))
    )
    return pieces.select(
        "conv_id", "piece", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"), spans.alias("loss")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Back from pieces: ``turns`` (role and text of each) and ``learned``, the unescaped text under the mask."""
    turns = F.transform(
        F.filter(F.split("text", END.replace("/", r"\/")), lambda t: t != ""),
        lambda t: F.struct(
            unescape(F.substr(F.substring_index(t, AFTER_ROLE, 1), F.lit(len(TURN) + 1))).alias("role"),
            unescape(
                F.substr(t, F.length(F.substring_index(t, AFTER_ROLE, 1)) + F.lit(len(AFTER_ROLE) + 1))
            ).alias("text"),
        ),
    )
    masked = F.transform(
        "loss",
        lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.select("conv_id", "piece", "text", turns.alias("turns"), F.array_join(masked, "").alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, learned text and size; only here a whole conversation is in one row."""
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    pieces = parse(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.length("text").cast("long").alias("n_chars"),
        F.struct("piece", said.alias("said"), "learned").alias("part"),
    )
    whole = pieces.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    texts = whole.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("learned").alias("learned"))
    return texts.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """Write the formatted pieces of a conversation table to ``path`` and read them back."""
    out = render(fold_messages(conversation_log(rows)))
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


#: Fixed values of the contract: a conversation whose texts hold control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(probe), scratch_path(spark, "formatted")))


_ROWS = f"""
select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations
union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
"""
_GROWN = "(length({0}) + length({0}) - length(replace(replace({0}, '\\', ''), '#', '')) + (length({0}) - length(replace({0}, '</', ''))) // 2)"
ORACLE = f"""
with said as ({_ROWS})
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
  cast(coalesce(sum(length(body)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(TURN + AFTER_ROLE + END)} + {_GROWN.format("role")} + (length(role) - length(replace(role, ': ', ''))) // 2
    + {_GROWN.format("body")}) as bigint) as formatted_chars
from said group by conv_id
"""
