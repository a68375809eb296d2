"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt by hash into shards. A shard's documents in seeded order, laid end to end and then
once more, form a tape of words that is cut into blocks of ``block`` words. The highest quotients target / (2 k + 1)
over all shards get one block each, which gives an integer quota per shard; a shard's quota is taken from the front of
its seeded tape, so documents stay whole but for the one at the cut, and none is used more than twice.

The divisor that hands out the right number of blocks is found by a multi-section search whose sums Spark computes:
neither sources nor shards are gathered on the driver. A hot source is spread over its shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafwise.llm.common import shuffle_partitions, stored

WEIGHTS = (3, 1, 2)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORDS))).cast("bigint")


def _running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``df`` (small rows) in global order, with the sums of columns over the rows before each one.

    Rows are dealt to ranges of the order; sums within a range are a window's, those of the ranges before come from a
    table of one row a range. No task sees more than its range."""
    ranged = stored(df.repartitionByRange(max(1, shuffle_partitions(df.sparkSession)), *order).withColumn("__range", F.spark_partition_id()))
    totals = sorted(map(tuple, ranged.groupBy("__range").agg(*[F.sum(c) for c in sums.values()]).collect()))  # one row a range
    before, held = [], [0.0] * len(sums)
    for k, *own in totals:
        before.append((k, *held))
        held = [a + b for a, b in zip(held, own, strict=True)]
    names = [f"__before_{k}" for k in range(len(sums))]
    carried = F.broadcast(df.sparkSession.createDataFrame(before, "__range int, " + ", ".join(f"{x} double" for x in names)))
    up = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(carried, "__range")
    for x, (name, column) in zip(names, sums.items(), strict=True):
        out = out.withColumn(name, F.col(x) + F.coalesce(F.sum(column).over(up), F.lit(0)))
    return out.drop("__range", *names)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (..., weight, target): water-filling in closed form over the sources' own table.

    Sources in code point order, nulls last, take the weights in turn. Sorted by capacity / weight, the sources at
    their limit come first; the level of the rest follows from running sums, taken range by range."""
    if sizes.isEmpty():
        return sizes.select("source", "source_size", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    ranked = _running(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one"}).drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank").cast("bigint") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("room", F.col("source_size") * float(most)).withColumn("ratio", F.col("room") / F.col("weight"))
    ranked = stored(_running(ranked, [F.col("ratio"), F.col("rank")], {"room_before": "room", "weight_before": "weight"}))
    all_size, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(all_size * share)) - F.col("room_before")) / (F.lit(float(all_weight)) - F.col("weight_before"))
    ranked = ranked.withColumn("level", level)
    water = ranked.where(F.col("level") * F.col("weight") < F.col("room")).agg(F.min(F.struct("ratio", "rank", "level"))).first()[0]
    full = F.lit(True) if water is None else (F.col("ratio") < water["ratio"]) | (F.col("ratio") == water["ratio"]) & (F.col("rank") < water["rank"])
    return ranked.withColumn("target", F.when(full, F.col("room")).otherwise(F.lit(0.0 if water is None else water["level"]) * F.col("weight"))).select("source", "source_size", "weight", "target")


def apportion(shards: DataFrame, seats: int, sections: int = 64) -> DataFrame:
    """(key, claim, capacity) to (..., quota): ``seats`` seats by highest quotients claim / (2 k + 1), k < capacity.

    A seat's quotient is at least t for k < (claim / t + 1) / 2, so the quotas at a divisor t are in closed form.
    Each round sums them for ``sections`` divisors at once. What is left over at the final divisor, the shards whose
    next quotient ties there, goes by key order."""
    quota = lambda t: F.least(F.col("capacity"), F.greatest(F.lit(0), F.floor((F.col("claim") / t + 1) / 2)).cast("bigint"))
    top, room = shards.agg(F.max("claim"), F.sum("capacity")).first()
    if not top or seats <= 0:
        return shards.withColumn("quota", F.lit(0).cast("bigint"))
    if seats >= room:
        return shards.withColumn("quota", F.col("capacity"))
    low, high = 0.0, top * 2  # quotas at low hold too many seats, at high none
    for _ in range(16):
        cuts = [low + (high - low) * k / sections for k in range(1, sections)]
        if not low < cuts[0] < cuts[-1] < high:
            break
        sums = shards.agg(*[F.sum(quota(F.lit(t))) for t in cuts]).first()
        under = next((k for k, s in enumerate(sums) if s <= seats), len(cuts))
        low, high = ([low] + cuts)[under], (cuts + [high])[under]
        if under < len(cuts) and sums[under] == seats:
            return shards.withColumn("quota", quota(F.lit(high)))
        if high - low <= high * 1e-13:
            break
    given = shards.withColumn("quota", quota(F.lit(high))).withColumn("next", (quota(F.lit(low)) > F.col("quota")) if low else (F.col("quota") < F.col("capacity")))
    left = seats - given.agg(F.sum("quota")).first()[0]
    extra = given.where("next").orderBy("key").limit(int(left)).select("key", F.lit(1).alias("extra"))
    return given.join(extra, "key", "left").withColumn("quota", F.col("quota") + F.coalesce("extra", F.lit(0))).drop("next", "extra")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, block: int = 16, shard_words: int = 500_000, seed: int = 42) -> DataFrame:
    """Adds size, source_size, target, taken, and the takes of either round (``taken_1``, ``taken_2``), to (id, source).

    A null text has size 0 and takes nothing; null sources form one source, last; null ids and repeated rows are rows
    like any other, and rows that tie in every field are interchangeable. Reruns agree: order and shards are hashes of
    the id. An empty table gives an empty result. ``most`` rounds of the tape must be 2 or less."""
    rows = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), word_count(df[text_col]).alias("size"), F.xxhash64(F.lit(seed), df[id_col].cast("string")).alias("h"))
    rows = stored(rows)  # a few numbers a row, so that the texts are read once
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    targets = stored(targets.withColumn("n_shards", (F.ceil(F.col("source_size") / shard_words) + 1).cast("bigint")).withColumnRenamed("source", "s"))
    dealt = rows.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("shard", F.pmod(F.shiftrightunsigned("h", 20), "n_shards")).drop("s")
    key = F.struct(F.col("source").isNull().alias("none"), F.col("source"), F.col("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.where("shard_size > 0").select(key.alias("key"), (F.col("target") * F.col("shard_size") / F.col("source_size") / block).alias("claim"), F.ceil(F.col("shard_size") * most / block).cast("bigint").alias("capacity"), "shard_size")
    shards = stored(shards)
    seats = round((targets.agg(F.sum("target")).first()[0] or 0) / block)
    quotas = apportion(shards, seats).select(F.col("key.source").alias("qs"), F.col("key.shard").alias("qk"), "shard_size", "quota")
    tape = W.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(tape), F.lit(0)))
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qk")), "left")
    words = F.coalesce(F.col("quota"), F.lit(0)) * block
    part = lambda used: F.least(F.col("size"), F.greatest(F.lit(0), used - F.col("start"))).cast("bigint")
    return joined.withColumn("taken_1", part(words)).withColumn("taken_2", part(words - F.coalesce("shard_size", F.lit(0)))).select("doc_id", "size", "source_size", "target", (F.col("taken_1") + F.col("taken_2")).alias("taken"), "taken_1", "taken_2", "source")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, each once for every round of the tape that takes words of it; ``df``'s columns."""
    takes = mix(df, id_col, **options).select(F.col("doc_id").alias("__id"), ((F.col("taken_1") > 0).cast("int") + (F.col("taken_2") > 0).cast("int")).alias("__n"))
    takes = takes.where("__n > 0").groupBy("__id").agg(F.max("__n").alias("__n"))
    copy = next(n for n in ("__copy" + "_" * k for k in range(len(df.columns) + 1)) if n not in {c.lower() for c in df.columns})
    out = df.join(takes, df[id_col].eqNullSafe(takes["__id"])).select(*[df[c] for c in df.columns], F.explode(F.array_repeat(F.lit(1), takes["__n"])).alias(copy))
    return out.select(*df.columns)
