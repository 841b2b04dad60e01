"""K-d tree sharding by distributed weighted medians.

Documents with equal texts form a group; a group has a point of metadata and a weight in bytes. A node of the tree splits its groups
along its widest dimension at the weight that its two sides' shares of the shards ask for. The place is found by histograms,
which are narrowed until the border bin weighs next to nothing, for all nodes of a level together: no node's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import BROADCAST_ROWS, stored

#: A coordinate is DIM_BITS of metadata over TIE_BITS of the group's hash, so that a dimension of few values can be split too.
DIM_BITS, TIE_BITS = 20, 32
BINS = 1024


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _unit(x: Column) -> Column:
    """A fraction as DIM_BITS bits."""
    return F.least(F.lit((1 << DIM_BITS) - 1), F.floor(x * (1 << DIM_BITS))).cast("long")


def group_points(docs: DataFrame, split_over: float) -> DataFrame:
    """(group, part, bytes, d0, d1, d2): size of a document, language and source (those of the least row) as coordinates.

    A group of more than ``split_over`` bytes falls into parts, by doc_id, as no shard could hold it.
    """
    per = docs.groupBy("group").agg(F.sum("size").alias("bytes"), F.max("size").alias("one"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(max(split_over, 1.0)))).cast("int")
    spread = per.withColumn("parts", F.when(F.col("bytes") > split_over, 8 * parts).otherwise(1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tie = lambda seed: F.pmod(F.xxhash64("group", "part", F.lit(seed)), F.lit(1 << TIE_BITS))
    named = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << DIM_BITS))
    dims = [_unit(F.least(F.lit(1.0), F.log2(F.col("one").cast("double")) / 40)), named("lang", "lang"), named("source", "source")]
    return spread.select("group", "part", "parts", (F.col("bytes") / F.col("parts")).alias("bytes"), *((d * (1 << TIE_BITS) + tie(f"d{k}")).alias(f"d{k}") for k, d in enumerate(dims)))


def kd_leaves(points: DataFrame, shards: int, tolerance: float = 2e-4) -> DataFrame:
    """(group, part, parts, leaf): leaves 0 to shards - 1 of near equal weight."""
    spark = points.sparkSession
    dims = [c for c in points.columns if c.startswith("d") and c[1:].isdigit()]
    now = stored(points.select("group", "part", "parts", "bytes", *dims, F.lit(0).alias("leaf")), "kd")
    want = {0: shards}  # first leaf of a node: its number of leaves; never more entries than shards
    while max(want.values()) > 1:
        open_ = {k: n for k, n in want.items() if n > 1}
        spans = now.groupBy("leaf").agg(F.sum("bytes").alias("w"), *(F.min(d).alias(f"lo_{d}") for d in dims), *(F.max(d).alias(f"hi_{d}") for d in dims)).collect()
        state = {}
        for r in spans:
            if r["leaf"] in open_:
                k = max(range(len(dims)), key=lambda i: (r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"], -i))
                n = open_[r["leaf"]]
                state[r["leaf"]] = {"dim": k, "lo": r[f"lo_{dims[k]}"], "hi": r[f"hi_{dims[k]}"] + 1, "before": 0.0, "aim": r["w"] * (n // 2) / n, "w": r["w"]}
        x = F.element_at(F.array(*dims), F.col("dim") + 1)
        schema = "leaf int, dim int, lo long, hi long"
        going = dict(state)
        while going:
            rows = [(k, s["dim"], s["lo"], s["hi"]) for k, s in going.items()]
            sent = _small(spark.createDataFrame(rows, schema), len(rows))
            bin_ = F.floor((x - F.col("lo")) / F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.lit(BINS)))).cast("int")
            counts = now.join(sent, "leaf").where((x >= F.col("lo")) & (x < F.col("hi"))).groupBy("leaf", bin_.alias("bin")).agg(F.sum("bytes").alias("w"), F.count("*").alias("n")).collect()  # BINS rows a node at most
            for k in list(going):
                s = going[k]
                step = max(1, -(-(s["hi"] - s["lo"]) // BINS))
                for b, w, n in sorted((r["bin"], r["w"], r["n"]) for r in counts if r["leaf"] == k):
                    if s["before"] + w >= s["aim"]:
                        break
                    s["before"] += w
                lo = s["lo"] + b * step
                if w <= tolerance * s["w"] or step == 1 or n == 1:
                    # the border bin goes to the side that comes nearer
                    s["cut"] = lo + step if s["before"] + w - s["aim"] <= s["aim"] - s["before"] else lo
                    del going[k]
                else:
                    s["lo"], s["hi"] = lo, min(s["hi"], lo + step)
        rows = [(k, s["dim"], s["cut"], k + want[k] // 2) for k, s in state.items()]
        if rows:
            cuts = _small(spark.createDataFrame(rows, "leaf int, dim int, cut long, right int"), len(rows))
            now = stored(now.join(cuts, "leaf", "left").withColumn("leaf", F.when(x >= F.col("cut"), F.col("right")).otherwise(F.col("leaf"))).select(*now.columns), "kd")
        want = {k: n for a, m in want.items() for k, n in (((a, m // 2), (a + m // 2, m - m // 2)) if m > 1 else ((a, m),))}
    return now.select("group", "part", "parts", "leaf")


def slots(rows: DataFrame, order: list[str], per_bucket: int = 200_000) -> DataFrame:
    """``rows`` (with shard) and slot long: 0, 1, ... in each shard, by buckets, so that a shard may outgrow a task."""
    n = rows.count()
    buckets = max(1, -(-n // per_bucket))
    cut = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order)) - 1
    return cut.withColumn("own", own).join(before, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("own")).cast("long")).drop("bucket", "before", "own")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per row of ``docs``, in shards of near equal bytes.

    The number of shards is given, or follows from the target size of a leaf. Size is the text's UTF-8 bytes plus ``overhead``.
    Null text: empty, and of one group with empty texts. Null doc_id, lang or source are values like others, and columns lang and source
    may be absent. Equal texts stay in one shard unless they weigh more than two shards. Repeated rows get slots of their own. An empty
    table gives no rows; fewer groups than shards leave shards empty.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    text = F.coalesce("text", F.lit(""))
    meta = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit("group")).alias("group"), *meta
    )
    rows = stored(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    leaves = kd_leaves(group_points(rows, 2 * total / shards), shards)
    split = leaves.where("parts > 1").groupBy("group").agg(F.first("parts").alias("in_parts"))
    found = rows.join(split, "group", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("in_parts")), F.lit(0)).cast("int"))
    placed = found.join(leaves.select("group", "part", F.col("leaf").alias("shard")), ["group", "part"]).select("doc_id", "size", "text_crc32", "shard")
    return slots(stored(placed, "placed"), ["doc_id", "text_crc32", "size"])
