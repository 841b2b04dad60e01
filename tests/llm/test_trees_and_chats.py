"""The k-d tree against a plain recursion, and odd rows of chats."""

from pyspark.sql import functions as F

from taperline.llm import chat_format, sharding


def reference(points, first, n, out):
    """Leaves of points (key, bytes, coordinates): split the widest dimension where the weights meet the sides' shares of n."""
    if n == 1 or not points:
        out |= {key: first for key, *_ in points}
        return
    spans = [max(p[2][d] for p in points) - min(p[2][d] for p in points) for d in range(3)]
    dim = spans.index(max(spans))
    points = sorted(points, key=lambda p: p[2][dim])
    aim, before, at = sum(p[1] for p in points) * (n // 2) / n, 0.0, 0
    while before + points[at][1] < aim:
        before += points[at][1]
        at += 1
    at += before + points[at][1] - aim <= aim - before  # the border goes where it comes nearer
    reference(points[:at], first, n // 2, out)
    reference(points[at:], first + n // 2, n - n // 2, out)


def test_leaves_are_those_of_recursion(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select((F.octet_length("text") + 8).cast("long").alias("size"), F.xxhash64("text").alias("group"), "lang", "source")
    points = sharding.group_points(rows, 1e12).cache()
    held = [(r["group"], float(r["bytes"]), (r["d0"], r["d1"], r["d2"])) for r in points.collect()]
    assert len({x for *_, x in held}) == len(held) > 100
    for shards in (2, 7, 24):
        want: dict = {}
        reference(held, 0, shards, want)
        assert {r["group"]: r["leaf"] for r in sharding.kd_leaves(points, shards, tolerance=0.0).collect()} == want


def test_chats_of_odd_rows(spark):
    long = "word \\ </turn> ### " * 60_000
    rows = [(1, 0, "assistant", long), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, "user", None), (None, 3, None, "x"), (2, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "op", "message", "formatted", "loss_spans", "head")})
    done = chat_format.chat_format(chat_format.messages_from_rows(table))
    assert done.columns == ["conv_id", "formatted", "loss_spans"]
    got = {r["conv_id"]: r for r in done.select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    # a null turn comes first, and turns of one number by their text
    assert [(x["role"], x["text"]) for x in got[1]["t"]] == [("user", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", long)]
    assert got[1]["m"] == "ab" + long and [(x["role"], x["text"]) for x in got[None]["t"]] == [("", "x")] and got[2]["m"] == ""
    log = [(5, 1, "message", 1, "user", "one"), (5, 1, "delta", 1, None, "-a"), (5, 1, "delta", 1, None, "-b"), (5, 2, "message", 2, "assistant", "two"), (5, 2, "message", 2, "assistant", "two")]
    tied = chat_format.fold_events(spark.createDataFrame(log, "conv_id long, seq long, op string, message long, role string, text string"))
    # equal seq: deltas before the message that sets the text, by the order of op
    assert {r["message"]: r["text"] for r in tied.collect()} == {1: "one", 2: "two"}
