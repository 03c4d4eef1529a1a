"""Temperature mixing of sources; DataFrame functions only.

Source weights are token shares raised to an exponent in [0, 1] and normalised.
The exponent is bisected to the smallest one at which no source is repeated more
than ``repeat_limit`` times (or, with ``entropy``, at which the weights' entropy is
still that share of its maximum), given a budget at which the largest source is
read exactly once - so no document is lost.  A source with weight w is then read
w * budget / tokens times: whole epochs, and a last part made of blocks of about
``block_tokens`` tokens in the order of a permutation, the last block cut where
the budget ends.

Null sources are one source; a document without words counts one token; equal
rows share their place in the permutation and are taken together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

ROUNDS = 40
#: Blocks whose sums one task adds up; a source of 10^8 blocks has some thousands of groups.
GROUP = 1 << 14


def exponent_for(sources: DataFrame, repeat_limit: float, entropy: float | None) -> float:
    """Bisects the exponent; ``sources`` has one row (source, tokens) each.  Only sums reach the driver."""
    top = sources.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("largest"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if not top["n"]:
        return 1.0
    if entropy is None:
        spread = math.log(top["largest"] / top["least"])

        def fits(x: float) -> bool:
            return math.exp(spread * (1 - x)) <= repeat_limit * (1 + 1e-12)
    else:
        goal = entropy * math.log(top["n"])

        def fits(x: float) -> bool:
            w = F.pow(F.col("tokens") / F.lit(float(top["largest"])), F.lit(x))
            z, wl = sources.agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wl")).first()
            return math.log(z) - wl / z < goal

    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(ROUNDS if entropy is None else 20):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def mixed(docs: DataFrame, carry: list[str], repeat_limit: float = 2.0, entropy: float | None = None, block_tokens: int = 100_000, seed: int = 20, added: bool = True) -> DataFrame:
    """``carry`` columns once per reading, with tokens, mix_weight, mix_epoch and mix_block if ``added``."""
    words = F.greatest(F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(1))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    source = F.struct(F.col("source").alias("name"))
    narrow = cut(docs.select(source.alias("s"), place.alias("u"), words.alias("tokens")), "tokens")
    sources = cut(narrow.groupBy("s").agg(F.sum("tokens").alias("tokens")), "sources")
    x = exponent_for(sources, repeat_limit, entropy)
    top = sources.agg(F.max("tokens").alias("largest")).first()["largest"] or 1
    share = F.pow(F.col("tokens") / F.lit(float(top)), F.lit(x))
    total = sources.agg(F.sum(share).alias("z")).first()["z"] or 1.0
    # the largest source has share 1 and is read once, so the budget is z * its tokens
    plan = sources.withColumns({
        "mix_weight": share / F.lit(total),
        "readings": share * F.lit(float(top)) / F.col("tokens"),
        "blocks": F.ceil(F.col("tokens") / block_tokens),
    }).withColumn("epochs", F.greatest(F.floor(F.col("readings") + 1e-9), F.lit(1))).withColumn("rest", F.greatest(F.round((F.col("readings") - F.col("epochs")) * F.col("tokens")), F.lit(0)).cast("bigint")).drop("tokens")

    block = F.pmod(F.col("u"), F.col("blocks"))
    inner = F.xxhash64("u", F.lit(1))
    rows = narrow.join(plan.where("rest > 0").select("s", "blocks"), "s").withColumns({"block": block, "v": inner})
    # where the budget ends: the group of blocks, in it the block, in that the document; each
    # running sum is over at most GROUP blocks, as many groups as that leaves, or one block
    def ends(sums: DataFrame, by: list[str], unit: str) -> DataFrame:
        """The unit in which the running sum passes ``rest``, with what is ``left`` for it."""
        run = sums.withColumn("end", F.sum("n").over(Window.partitionBy(*by).orderBy(unit)))
        return run.where("end > rest and end - n <= rest").select(*by, unit, (F.col("rest") - F.col("end") + F.col("n")).alias("rest"))

    rests = plan.where("rest > 0").select("s", "rest")
    sums = cut(rows.groupBy("s", F.floor(F.col("block") / GROUP).alias("group"), "block").agg(F.sum("tokens").alias("n")), "blocks")
    in_group = ends(sums.groupBy("s", "group").agg(F.sum("n").alias("n")).join(rests, "s"), ["s"], "group")
    edge = ends(sums.join(in_group, ["s", "group"]), ["s", "group"], "block").select("s", "block", F.col("rest").alias("left"))
    inside = rows.select("s", "block", "v", "tokens").join(edge, ["s", "block"]).withColumn("end", F.sum("tokens").over(Window.partitionBy("s", "block").orderBy("v")))
    limit = inside.groupBy("s", "block").agg(F.max(F.when(F.col("end") <= F.col("left"), F.col("v"))).alias("limit")).withColumnRenamed("block", "edge")
    plan = cut(plan.join(limit, "s", "left"), "plan")

    last = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("_block") < F.col("edge")) | ((F.col("_block") == F.col("edge")) & (F.xxhash64("_u", F.lit(1)) <= F.col("limit"))))
    times = F.col("epochs") + F.when(F.coalesce(last, F.lit(False)), 1).otherwise(0)
    out = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], source.alias("s"), place.alias("_u"), words.alias("tokens")).join(plan, "s")
    out = out.withColumn("_block", F.pmod(F.col("_u"), F.col("blocks"))).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    more = ["tokens", "mix_weight", "mix_epoch", F.col("_block").alias("mix_block")] if added else []
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *more)
