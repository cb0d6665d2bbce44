"""Chat formatting from an event log.

A conversation is a log of events (conv_id, seq, message, kind, role, text):

* ``delta`` adds ``text`` to the message,
* ``edit`` replaces what the message says by ``text``,
* ``regenerate`` discards what it says, so that later deltas start anew,
* ``delete`` takes the message out; a later event brings it back.

Events are folded per message in the order of ``seq``, then messages are put
in order and rendered.  Every stage is DataFrame operations and Column
expressions; events of one conversation are spread by message until its final
text, which is one row of the result, is put together.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings are
kept out of texts and roles by one more backslash between ``<`` and ``|``,
which ``unescape`` takes out again, so every text survives the round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
EVENTS = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: a backslash is written as backslash and s, a line
    end as backslash and n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    The last edit or regenerate of a message hides what came before it; what
    is left is joined in order.  The role is the last one that is not null.
    Events that share a seq are taken in the order of their kind, then text.
    Null texts add nothing.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    start = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("parts"), F.lit(True).alias("there"))

    def step(s: Column, e: Column) -> Column:
        kind, one = e["kind"], F.array(e["text"])
        none = F.array().cast("array<string>")
        parts = (F.when(kind == "delta", F.concat(s["parts"], one)).when(kind == "edit", one)
                 .when(kind.isin("regenerate", "delete"), none).otherwise(s["parts"]))
        return F.struct(F.coalesce(e["role"], s["role"]).alias("role"), parts.alias("parts"), (kind != "delete").alias("there"))

    out = log.select("conv_id", "message", F.aggregate("log", start, step).alias("m")).where("m.there")
    return out.select("conv_id", "message", F.coalesce("m.role", F.lit("")).alias("role"), F.array_join("m.parts", "").alias("text"))


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_mask``, the spans
    (start, end in code points, end exclusive) of learned texts in order."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct(
        "message", F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == learned_role).alias("learned"),
        F.concat(head, body, F.lit(END), F.lit("\n")).alias("piece"))
    conv = messages.select("conv_id", piece.alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + p["head"]
        span = F.array(F.struct(begin.alias("start"), (begin + p["body"]).alias("end")))
        return F.struct((s["at"] + F.length(p["piece"])).alias("at"), F.when(p["learned"], F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), spans.alias("out"))
    return conv.select("conv_id", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"),
                       F.aggregate("p", zero, step)["out"].alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From (conv_id, formatted, loss_mask) the turns, array<struct<role, text,
    learned>>, from nothing but the output: it is cut at the marks, and a turn
    is learned if its text's place is in the mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    cut = F.transform(pieces, lambda p: F.struct(
        F.substring_index(p, "\n", 1).alias("role"), F.length(p).cast("long").alias("n"), p.alias("p")))
    begin = F.lit(len(START)).cast("long")

    def place(s: Column, c: Column) -> Column:
        at = s["at"] + begin + F.length(c["role"]) + 1
        return F.struct((s["at"] + begin + c["n"]).alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    starts = F.aggregate("cut", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), place)["out"]
    masked = F.transform("loss_mask", lambda m: m["start"])
    tail = len(END) + 1

    def turn(c: Column, at: Column) -> Column:
        body = F.substr(c["p"], F.length(c["role"]) + 2, (c["n"] - F.length(c["role"]) - 1 - tail).cast("int"))
        return F.struct(unescape_role(c["role"]).alias("role"), unescape(body).alias("text"), F.array_contains(F.col("masked"), at).alias("learned"))

    rows = formatted.withColumn("cut", cut).withColumn("starts", starts).withColumn("masked", masked)
    return rows.select("conv_id", "formatted", F.zip_with("cut", "starts", turn).alias("turns"))


def turn_events(turns: DataFrame, delta_chars: int = 512) -> DataFrame:
    """The event log behind a table of finished turns (conv_id, turn, role,
    text): a message per row, streamed as deltas of ``delta_chars`` code
    points (at least one, so that an empty text is a message too).

    Rows are ordered by turn (null first); rows of one turn by role, then
    text.  Repeated rows are messages of their own.
    """
    # messages are numbered by turn and place in the turn, as one bigint
    # pair: the place within one turn needs no look at the conversation
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.row_number().over(same))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.call_function("div", F.length("text") - 1, F.lit(delta_chars)).cast("int"))),
                        lambda k: F.substr(F.col("text"), k * delta_chars + 1, F.lit(delta_chars)))
    return rows.select("conv_id", F.struct("turn", "place").alias("message"), "role", F.posexplode(parts).alias("seq", "text")).select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "message", F.lit("delta").alias("kind"), "role", "text")


def chat_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars, read back from the rendered conversations."""
    back = read_back(render(fold(turn_events(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    rows = back.withColumn("loss", loss)
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
