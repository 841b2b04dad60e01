r"""Chat formatting from event logs, in DataFrame functions only.

Events are folded into final messages per conversation and rendered. A turn is rendered as ``### role``, the text and
``</turn>``, each on lines of its own. In texts, a backslash goes before every backslash, ``### `` and ``</turn>``, so the end
line never occurs inside a text and the rendering can be read back. Roles are percent-encoded (plain names stay as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HEAD, END = "### ", "\n</turn>\n"
_CONTROL = r"(\\|### |</turn>)"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _CONTROL, "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): final messages.

    ``events`` has conv_id, seq, op, message, role, text. In order of seq: ``message``, ``edit`` and ``regenerate`` set a
    message's text, ``delta`` appends to it, and ``regenerate`` also drops every later message logged before it. Null text: empty.
    Equal seq: by op, then text. A null op is a delta. Null conv_id: a conversation of its own. The role is the last that is not null.
    A message whose events are all deltas starts empty. Repeated events apply again. Texts of any length are folded whole; an empty log gives no rows.
    """
    order = [F.col(c).asc_nulls_first() for c in ("seq", "op", "text")]
    log = events.select("conv_id", "seq", F.coalesce("op", F.lit("delta")).alias("op"), "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy(*(F.col(c).desc_nulls_last() for c in ("seq", "op", "text"))).rowsBetween(Window.unboundedPreceding, -1)
    live = log.withColumn("cut", F.min(F.when(F.col("op") == "regenerate", F.col("message"))).over(later)).where("cut is null or not (message > cut)")
    # the pieces of a message: the last that sets the text, and the deltas after it
    own = Window.partitionBy("conv_id", "message").orderBy(*order)
    cut = live.withColumn("part", F.sum((F.col("op") != "delta").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(own))
    by = cut.groupBy("conv_id", "message", "part").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("pieces"))
    last = by.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("part"))).alias("role"), F.max_by("pieces", "part").alias("pieces")
    )
    return last.select("conv_id", "message", "role", F.array_join("pieces.text", "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation; spans are (start, length) in code points, from 0, of the
    escaped texts of ``trained_role``. Messages are ordered by message, role, text; null role or text: empty. Texts of any length are rendered whole; no messages give no rows."""
    turns = messages.select("conv_id", "message", F.coalesce(F.url_encode("role"), F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.withColumns({"head": F.concat(F.lit(HEAD), F.col("role"), F.lit("\n"))})
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "role", "text", "head"))).alias("turns"))
    size = lambda x: F.length(x["head"]) + F.length(x["text"]) + F.lit(len(END))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).cast("long").alias("at"),
            F.when(
                x["role"] == trained_role,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["text"]).cast("long").alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a rendering."""
    blocks = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(
        blocks,
        lambda x: F.struct(
            F.url_decode(F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(x, F.position(F.lit("\n"), x) + 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, with nothing between the spans."""
    return F.array_join(F.transform(spans, lambda x: unescaped(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")


def chat_format(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation of an event log; see fold_events and render.

    A conversation's output is one row, so its turns meet in one task; nothing else does. Conversations without a live message
    have no row; an empty log gives no rows. Columns besides those named are not read.
    """
    return render(fold_events(events), trained_role)


def messages_from_rows(rows: DataFrame) -> DataFrame:
    """Events for a table of whole turns (conv_id, turn, role, text): every row is a message of its own, ordered by turn, role,
    text, repeated rows included; a null turn comes first."""
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    return rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("seq")).select("conv_id", "seq", F.lit("message").alias("op"), F.col("seq").alias("message"), "role", "text")
