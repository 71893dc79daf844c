"""Uniform shuffle of rows into shards of exact sizes through a communication matrix.

The rows lie in blocks.  How many rows each block sends to each shard is drawn first: the matrix of
a uniformly random permutation has multivariate hypergeometric rows under fixed row and column sums.
It is drawn down a tree, each node splitting its shard sizes among at most ``FANOUT`` children, so
no task holds the whole matrix.  Each block then permutes its rows and deals them out by its counts,
the rows move, and each shard permutes what it received.

All randomness comes from hashes of the seed and of numbers written before, so a lost task is
repeated with the same result.

Law ``rows``: shard sizes differ by one row at most.  Equal texts are spread like any other rows.
Null text: size 16, CRC of the empty text.  Null or repeated ``doc_id``: each row gets a slot of its
own.  No rows: no result rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..workspace import stage

#: Rows of one block, children of one node, rows of one run of slots: each fits one task.
BLOCK_ROWS = 1 << 15
FANOUT = 64
RUN_ROWS = 50_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def log_factorial(n: Column) -> Column:
    """Stirling's series, shifted by 8 so that it holds to about 1e-9 for every n >= 0."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    series = series - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    product = n + F.lit(1.0)
    for i in range(2, 9):
        product = product * (n + F.lit(float(i)))
    return series - F.log(product)


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``good`` ones, for uniform ``u``.

    Inverts the distribution from its mode outwards.  Beyond 12 standard deviations and 40 counts
    the tail holds less than 1e-30 and is left out.
    """
    low = F.greatest(F.lit(0.0), draws + good - total)
    high = F.least(draws, good)
    mode = F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0)).cast("double")
    mode = F.least(F.greatest(mode, low), high)

    def choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    at_mode = F.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    spread = F.sqrt(draws * good * (total - good) * (total - draws) / F.greatest(total, F.lit(1.0)) / F.greatest(total, F.lit(1.0)) / F.greatest(total - 1.0, F.lit(1.0)))
    reach = F.least(F.greatest(mode - low, high - mode), F.ceil(12 * spread) + 40)

    def step(at: Column, i: Column) -> Column:
        up, down = mode + i, mode - i
        p_up = at["up"] * (good - up + 1) * (draws - up + 1) / (up * (total - good - draws + up))
        p_up = F.when(up <= high, p_up).otherwise(0.0)
        p_down = at["down"] * (down + 1) * (total - good - draws + down + 1)
        p_down = F.when(down >= low, p_down / ((good - down) * (draws - down))).otherwise(0.0)
        left_up = at["left"] - p_up
        taken = at["x"].isNotNull()
        x = F.when(taken, at["x"]).when(left_up < 0, up).when(left_up - p_down < 0, down)
        return F.struct(
            (left_up - p_down).alias("left"), p_up.alias("up"), p_down.alias("down"), x.alias("x")
        )

    first = F.struct(
        (u - at_mode).alias("left"),
        at_mode.alias("up"),
        at_mode.alias("down"),
        F.when(u < at_mode, mode).alias("x"),
    )
    steps = F.when(reach >= 1, F.sequence(F.lit(1), reach.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(steps, first, step, lambda at: F.coalesce(at["x"], mode))


def split_sizes(seed: int, node: Column, children: Column, sizes: Column) -> Column:
    """Counts of every child in every shard.

    ``children`` are the row counts below a node, ``sizes`` the places it has in each shard; both
    have the same sum.  Returns one array of counts for each child, in order.
    """

    def one_child(state: Column, child: Column) -> Column:
        def one_shard(at: Column, s: Column) -> Column:
            good = F.get(state["left"], s)
            u = uniform(F.lit(seed), node, F.size(state["done"]), s)
            drawn = hypergeometric(u, at["total"], good, at["draws"])
            return F.struct(
                (at["total"] - good).alias("total"),
                (at["draws"] - drawn).alias("draws"),
                F.concat(at["row"], F.array(drawn)).alias("row"),
            )

        total = F.aggregate(state["left"], F.lit(0.0), lambda a, b: a + b)
        empty = F.array().cast("array<double>")
        row = F.aggregate(
            F.sequence(F.lit(0), F.size(state["left"]) - 1),
            F.struct(total.alias("total"), child.alias("draws"), empty.alias("row")),
            one_shard,
            lambda at: at["row"],
        )
        return F.struct(
            F.zip_with(state["left"], row, lambda a, b: a - b).alias("left"),
            F.concat(state["done"], F.array(row)).alias("done"),
        )

    start = F.struct(
        sizes.alias("left"), F.array().cast("array<array<double>>").alias("done")
    )
    return F.aggregate(children, start, one_child, lambda state: state["done"])


def communication_matrix(blocks: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """``(block, counts)``: rows of each block for each shard.

    ``blocks`` has ``block`` and ``n``; the sum of ``n`` is the sum of ``sizes``.
    """
    n_leaves = max(1, math.ceil(blocks.count() / (FANOUT / 2)))
    # hashing deals about FANOUT / 2 blocks to a leaf; upper levels join FANOUT neighbours each
    levels = [blocks.select("block", "n", F.pmod(F.xxhash64(F.lit(seed), "block"), F.lit(n_leaves)).alias("parent"))]
    while True:
        below = levels[-1]
        above = below.groupBy(F.col("parent").alias("block")).agg(F.sum("n").alias("n"))
        above = above.withColumn("parent", F.floor(F.col("block") / FANOUT))
        if n_leaves == 1:
            break
        levels.append(stage(above, "shard-tree"))
        n_leaves = math.ceil(n_leaves / FANOUT)
    held = None
    for depth, level in enumerate(reversed(levels)):
        members = level.groupBy("parent").agg(
            F.sort_array(F.collect_list(F.struct("block", F.col("n").cast("double").alias("n")))).alias("c")
        )
        if held is None:  # the one node at the top has all places
            placed = members.withColumn("sizes", F.array(*[F.lit(float(x)) for x in sizes]))
        else:
            placed = held.join(members, "parent")
        drawn = placed.select(
            "c",
            split_sizes(seed + 1 + depth, F.col("parent"), F.col("c.n"), F.col("sizes")).alias("rows"),
        )
        pairs = drawn.select(F.inline(F.arrays_zip(F.col("c.block").alias("block"), F.col("rows").alias("sizes"))))
        held = stage(pairs.withColumnRenamed("block", "parent"), "shard-matrix")
    return held.select(
        F.col("parent").alias("block"),
        F.transform("sizes", lambda x: x.cast("long")).alias("counts"),
    )


def shuffle_to_shards(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            # rows are numbered once, and read back from the written table ever after
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    rows = rows.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS))
    blocks = stage(rows.groupBy("block").agg(F.count("*").alias("n")), "shard-blocks")
    n_rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(blocks, sizes, seed)

    # local permutation: the place of a row in its block decides the shard by the block's counts
    local = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row")
    ends = matrix.select("block", _running(F.col("counts")).alias("ends"))
    placed = rows.withColumn("place", F.row_number().over(local)).join(ends, "block")
    dealt = placed.withColumn(
        "shard", F.size(F.filter("ends", lambda end: end < F.col("place"))).cast("int")
    )

    # after the exchange: runs of each shard by a new random key, then places within the run
    n_runs = max(1, math.ceil(n_rows / n_shards / RUN_ROWS))
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "row")
    dealt = stage(
        dealt.select(
            "doc_id", "size", "text_crc32", "row", "shard", key.alias("key"),
            F.pmod(key, F.lit(n_runs)).alias("run"),
        ),
        "shard-dealt",
    )
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = dealt.groupBy("shard", "run").agg(F.count("*").alias("n")).select(
        "shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = W.partitionBy("shard", "run").orderBy("key", "row")
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(runs, ["shard", "run"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("first") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _running(counts: Column) -> Column:
    """Running sums of an array."""
    empty = F.array().cast("array<long>")

    def add(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x))

    return F.aggregate(counts, empty, add)
