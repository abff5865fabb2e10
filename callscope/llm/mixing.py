"""Mixing sources to target weights by capped water-filling, and the documents that make up the mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.sources.storage import stored

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 42


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Rows with their place (0, 1, ...) in the order: sorted ranges, whose sizes alone come to the driver, one number per range."""
    ranges = stored(
        df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    sizes = {r["_range"]: r["n"] for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for k in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    if not starts:
        return ranges.withColumn("place", F.lit(0).cast("long")).drop("_range", "_at")
    first = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("_range") + 1)
    return ranges.withColumn("place", first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_at")


def water_fill(sources: DataFrame, total: int, epochs: float = EPOCHS) -> DataFrame:
    """
    Sources (size, weight, ...) with `target`: `total` shared by weight, none above `epochs` times its size.

    Sources that would get more are clamped, and the excess is shared among the others by weight, until none is above. Each round is
    one sum over the sources. If all are clamped, they get what they can give.
    """
    cap = F.col("size") * F.lit(float(epochs))
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) > cap
        sums = sources.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, cap).otherwise(F.lit(0.0))).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("free")
        ).first()
        if sums["n"] == clamped or not sums["free"]:
            return sources.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(level[0]) / F.lit(level[1])) if level else cap)
        clamped, level = sums["n"], (float(total - sums["capped"]), float(sums["free"]))


CLASS = ["id", "source", "size"]
#: Rows of a class are numbered in so many groups side by side.
GROUPS = 256


def _numbered_copies(light: DataFrame) -> DataFrame:
    """
    Rows (id, source, size) with `number`: 1, 2, ... among the rows that are equal in all three.

    Equal rows are counted where they are stored, each part of them gets its share of the numbers, and the parts are dealt out again before they
    become rows, so a class that holds a third of all rows is no task's alone.
    """
    parts = stored(light.withColumn("part", F.spark_partition_id()).groupBy(*CLASS, "part").agg(F.count("*").alias("n")), "copies")
    along = Window.partitionBy(*CLASS).orderBy("part")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = parts.withColumn("before", before).repartition(*CLASS, "part")
    return dealt.select(*CLASS, F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("number"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """
    (id, source, size, source_size, target, repeats, taken) per row of `docs`; taken = size * repeats words.

    Sources, sorted by code point with null last, weigh `weights` in turn and share the size of all rows. A source with target t and size s is taken floor(t / s)
    times whole; the rest of its target is a fractional repetition: its documents are dealt into about the square root of their number of buckets by a
    seeded hash of the id, buckets are taken whole while they fit, and of the bucket that does not, the largest documents that fit
    and then the smallest that fit into what they leave. So the sum misses the target by a short document at most. Rows with the same id, source and size are
    numbered, and each is dealt by id and number.

    A null text has size 0; a null id hashes like the text "null"; empty documents count as rows, not as words; an empty table gives an empty result.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    light = stored(_numbered_copies(stored(light, "sizes")), "numbered")
    sums = light.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("documents"))
    ranked = numbered(sums, F.col("source").asc_nulls_last(), "sources")
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("double"))
    total = weighed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    targets = (
        water_fill(weighed, total, epochs)
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("size")).cast("long"))
        .select("place", F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "whole", "rest", F.ceil(F.sqrt("documents")).alias("buckets"))
    )
    again = F.when(F.col("number") > 1, F.concat(F.lit(":"), F.col("number").cast("string"))).otherwise("")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), again))
    part = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    dealt = (
        light.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("key", key)
        .withColumn("bucket", F.floor(part * F.col("buckets")).cast("long"))
        .drop("_source", "buckets")
    )
    sizes = dealt.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sizes.withColumn("left_before", before)
    own = Window.partitionBy("place", "bucket")
    room = F.col("rest") - F.col("left_before")
    filled = (
        dealt.join(buckets, ["place", "bucket"])
        .withColumn("room", room)
        .withColumn("from_large", F.sum("size").over(own.orderBy(F.desc("size"), "key")))
        .withColumn("from_small", F.sum("size").over(own.orderBy(F.asc("size"), "key")))
        .withColumn("large", F.coalesce(F.max(F.when(F.col("from_large") <= F.col("room"), F.col("from_large"))).over(own), F.lit(0)))
    )
    extra = (F.col("rest") > 0) & (
        (F.col("room") >= F.col("bucket_size"))
        | ((F.col("room") > 0) & ((F.col("from_large") <= F.col("room")) | (F.col("from_small") <= F.col("room") - F.col("large"))))
    )
    return filled.withColumn("repeats", F.col("whole") + extra.cast("long")).select(
        "id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """
    The documents of the mix: each row as often as it is taken, columns as they are, whatever their names.

    Of rows with the same id, source and size, as many are taken once more as the mix says, those whose contents hash lowest; rows that are equal in all columns stand for each other.
    """
    repeats = stored(mix(docs, id_col, text_col, source_col, **options), "repeats")
    taken = repeats.groupBy(*CLASS).agg(F.count("*").alias("rows"), F.min("repeats").alias("least"), F.sum("repeats").alias("all"))
    taken = stored(taken.where("all > 0").withColumn("extra", F.col("all") - F.col("least") * F.col("rows")), "taken")

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    named = taken.select(*[F.col(c).alias(f"of_{c}") for c in CLASS], "rows", "least", "extra")
    same = F.lit(True)
    for c in CLASS:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    of_class = rows.join(named, same)
    single = of_class.where("rows = 1").select("row", (F.col("least") + F.col("extra")).alias("copies"))
    if taken.where("rows > 1").isEmpty():
        return _repeated(single)

    # Classes of several rows, in order of what they hold: counts by group of hashes, and within a group.
    several = of_class.where("rows > 1").withColumn("content", F.xxhash64("row"))
    contents = stored(several.groupBy(*CLASS, "content", "least", "extra").agg(F.count("*").alias("n")).withColumn("part", F.pmod("content", F.lit(GROUPS))), "contents")
    groups = contents.groupBy(*CLASS, "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*CLASS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*[F.col(c).alias(f"of_{c}") for c in CLASS], F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*CLASS, "part").orderBy("content").rowsBetween(Window.unboundedPreceding, -1)
    placed = contents.join(groups, same & (F.col("part") == F.col("of_part"))).select(
        F.col("content").alias("of_content"), *[F.col(f"of_{c}") for c in CLASS], "n", F.col("least").alias("times"),
        (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"), F.col("extra").alias("more"),
    )
    copies = F.col("n") * F.col("times") + F.least(F.greatest(F.col("more") - F.col("first"), F.lit(0)), F.col("n"))
    one_of = several.groupBy(*CLASS, "content").agg(F.first("row").alias("row"))
    repeated = one_of.join(placed, same & (F.col("content") == F.col("of_content"))).select("row", copies.alias("copies"))
    return _repeated(single.unionByName(repeated))


def _repeated(rows: DataFrame) -> DataFrame:
    """The fields of `row`, each as often as `copies` says."""
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
