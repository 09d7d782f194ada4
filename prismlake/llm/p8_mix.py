"""Problem 8: a mix of sources with target shares of the tokens, by weighted fair queueing.

Each use of a record has a virtual finish time: the tokens its source has handed out up to and with it, divided by the
source's target weight. Records of a source come in the order of a salted hash; a source that may be repeated starts
over when it is through, at most max_repeats times. All uses, over all sources, are taken in the order of their finish
times until the token budget is full. Then every source has its share as long as it lasts.

Nothing is sorted in one task: the running sums are taken in hash cells (a source's cells are sized by its rows), the
cell totals are summed up over the few cells, and the place where the budget ends is found from two histograms of
finish times of BINS bins each, so that only one bin of one bin is sorted.

Defined results: texts that are null or empty have no tokens and are not used; sources that are null or have no
target, a share that isn't above 0 or no repeats are not used; ties are broken by key; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from .tokens import VOCABULARY, with_tokens

SALT = "prismlake-mix-1"
#: Tokens of the mix, as a share of what all targeted sources hold without repeats.
BUDGET_SHARE = 0.5
CELL_ROWS = 20_000
BINS = 4096


def finish_times(sized: DataFrame, targets: DataFrame, key: str, salt: str = SALT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(source, key, n_tokens, use_no, finish): every permitted use of every record of a targeted source."""
    goal = (
        targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
        .groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    )
    rows = sized.where("n_tokens > 0").select("source", F.col(key).alias("key"), "n_tokens").join(F.broadcast(goal), "source")
    size = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("total"))
    # a record's place is a hash in [0, 2^62); cells are ranges of places, so cells in order are records in order
    place = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "key"), 2)
    cells = F.ceil(F.col("n") / cell_rows)
    rows = rows.join(F.broadcast(size), "source").withColumn("place", place).withColumn("cell", F.floor(F.col("place") / F.lit(float(1 << 62)) * cells))
    sums = rows.groupBy("source", "cell").agg(F.sum("n_tokens").alias("cell_tokens"))
    before = sums.withColumn("before", F.sum("cell_tokens").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_tokens")).drop("cell_tokens")
    inner = Window.partitionBy("source", "cell").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(before, ["source", "cell"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner))
    uses = ranked.withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    finish = (F.col("upto") + (F.col("use_no") - 1) * F.col("total")) / F.col("share")
    return uses.select("source", "key", "n_tokens", "use_no", finish.alias("finish"))


def truncate(uses: DataFrame, budget: float, bins: int = BINS) -> DataFrame:
    """The uses, in the order (finish, source, key, use_no), whose tokens sum up to the budget at most; `finish` is the
    place of a use in the mix."""
    number = lambda low, width: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("finish") - F.lit(low)) / F.lit(width)))).cast("int")
    high = uses.agg(F.max("finish")).first()[0]
    if high is None:
        return uses
    whole, inside, used, low, width = [], uses, 0, 0.0, high / bins
    for _ in range(2):  # at most `bins` rows come to the driver
        if not width > 0:
            break  # all that is left ends at the same time
        bin_of = number(low, width)
        edge = None
        for b, n in sorted((r[0], r[1]) for r in inside.groupBy(bin_of.alias("bin")).agg(F.sum("n_tokens")).collect()):
            if used + n > budget:
                edge = b
                break
            used += n
        if edge is None:  # everything fits
            whole.append(inside)
            inside = None
            break
        whole.append(inside.where(bin_of < edge))
        inside = inside.where(bin_of == edge)
        low, width = low + edge * width, width / bins
    if inside is not None:
        w = Window.orderBy("finish", "source", "key", "use_no").rowsBetween(Window.unboundedPreceding, 0)
        whole.append(inside.withColumn("sum", F.sum("n_tokens").over(w)).where(F.col("sum") <= F.lit(budget - used)).drop("sum"))
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out


def mix(spark: SparkSession, sf_dir: str, budget_share: float = BUDGET_SHARE) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats")
    names = targets.where("source IS NOT NULL").select("source").distinct()
    sized = cut(with_tokens(docs.join(F.broadcast(names), "source", "left_semi"), vocabulary=VOCABULARY))
    uses = cut(finish_times(sized, targets, "doc_id"))
    total = uses.where("use_no = 1").agg(F.sum("n_tokens")).first()[0] or 0
    return truncate(uses, float(int(total * budget_share)))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a record in the mix; ordered by finish (ties: source, doc_id, use_no) it is the mix's sequence."""
    return mix(spark, sf_dir).select("source", F.col("key").alias("doc_id"), "use_no", "n_tokens", "finish")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source, and how often its records are used at most."""
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats")
    got = mix(spark, sf_dir).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("use_no").alias("most_uses"))
    every = Window.partitionBy()
    return targets.join(got, "source", "left").select(
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
        F.round(F.coalesce(F.col("tokens") / F.sum("tokens").over(every), F.lit(0.0)), 6).alias("reached_share"),
    )


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL = {}
