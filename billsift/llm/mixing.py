"""Mixing sources to target weights by temperature, realised as block permutations."""

from __future__ import annotations

from math import ceil, exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import col, without

#: Tokens of a block at most, about; exponents tried in a pass; passes (2^-40 of the exponent).
BLOCK_TOKENS, TRIED, PASSES = 20_000, 32, 8
#: Sources that may be broadcast (under 2 MB), parts of a source's rows beyond that.
FEW, SALTS = 10_000, 64
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix"


def source_key(source: Column) -> Column:
    """Null is a source of its own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("none"))


def find_exponent(shares: DataFrame, meets) -> float:
    """Smallest exponent in [0, 1] that ``meets`` (true from some exponent on), by bisection.

    Each pass sums p^a and p^a ln p over all sources for evenly spaced
    exponents at once, so the table of sources is never collected.
    ``meets(a, sum, log_sum)`` judges an exponent; 1 if none does.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / TRIED
        tried = shares.select("p", F.explode(F.sequence(F.lit(0), F.lit(TRIED))).alias("k"))
        power = F.pow("p", F.lit(low) + F.col("k") * F.lit(step))
        sums = {r["k"]: (r["s"], r["t"]) for r in tried.groupBy("k").agg(
            F.sum(power).alias("s"), F.sum(power * F.log("p")).alias("t")).collect()}
        good = [k for k in sorted(sums) if meets(low + k * step, *sums[k])]
        if not good:
            return 1.0
        if good[0] == 0:
            return low
        low, high = low + (good[0] - 1) * step, low + good[0] * step
    return high


def plan(docs: DataFrame, tokens: str, key: str, budget: int | None = None,
         repeats: float | None = None, entropy: float | None = None) -> DataFrame:
    """(key, n tokens, weight, rounds) of each source; rounds = budget / tokens.

    Weights are shares to the power of the smallest exponent that keeps every
    source at most ``repeats`` times in the mix, or brings the entropy of
    the weights down to ``entropy`` (a share of its largest value). Without a
    budget it is the smallest one that takes every source whole at least once.
    Sources without tokens pass once.
    """
    if (repeats is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    totals = cut(docs.groupBy(key).agg(F.sum(tokens).cast("long").alias("n")))
    n, count, least, most = totals.where("n > 0").agg(
        F.sum("n"), F.count("*"), F.min("n"), F.max("n")).first()
    if not n:
        return totals.select(key, "n", F.lit(0.0).alias("weight"), F.lit(1.0).alias("rounds"))
    shares = totals.where("n > 0").select(key, "n", (F.col("n") / F.lit(n)).alias("p"))

    def meets(a: float, total: float, log_sum: float) -> bool:
        if entropy is not None:
            return log(total) - a * log_sum / total <= entropy * log(max(count, 2)) + 1e-12
        if budget is None:
            return exp((1 - a) * log(most / least)) <= repeats
        return budget / n * exp((a - 1) * log(least / n)) / total <= repeats

    a = round(find_exponent(shares, meets), 9)
    total = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    weight = F.coalesce(F.pow(F.col("n") / F.lit(n), F.lit(a)) / F.lit(total), F.lit(0.0))
    whole = float(budget) if budget is not None else n * exp((1 - a) * log(most / n)) * total
    rounds = F.round(weight * F.lit(whole) / F.col("n"), 6)
    return totals.select(key, "n", F.when(F.col("n") > 0, weight).otherwise(0.0).alias("weight"),
                         F.when(F.col("n") > 0, rounds).otherwise(1.0).alias("rounds"))


def with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with their source's plan.

    Up to ``FEW`` sources are broadcast, their number is counted first. Beyond that
    each source's plan is dealt to ``SALTS`` keys, so that a source with a third of all rows
    is as many tasks.
    """
    if weights.count() <= FEW:
        return rows.join(F.broadcast(weights), "_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(SALTS)))
    dealt = weights.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return salted.join(dealt, ["_key", "_salt"]).drop("_salt")


def order_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary"))


def mix(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        budget: int | None = None, repeats: float | None = None, entropy: float | None = None) -> DataFrame:
    """Repeat or cut the rows of each source to its weight; the rows of the mix.

    A source's rows fall into blocks of about ``BLOCK_TOKENS`` words by a hash
    of their id. Every full round takes all its blocks in a new order; the last
    takes blocks in that order while the budget's rest lasts, whole blocks
    only. Adds ``mix_epoch`` and ``mix_key``: rows sorted by the key within an epoch are a
    shuffled mix. Columns of these names are replaced, all others kept.

    The rest is measured by running sums in two steps, within ranges of the
    order and over the ranges, so a source with a third of all rows is many tasks.

    Null and empty texts have no tokens and go with their block. A null source
    is a source of its own; rows without an id share a block of their source.
    Repeated rows are rows like others. A source without tokens passes once. Long texts are counted
    where they lie. Columns may bear any names.
    An empty table gives an empty one.
    """
    base = without(df, ["mix_epoch", "mix_key"])
    # the caller's columns travel as one, so that none can clash with ours
    own = F.struct(F.lit(0).alias("_"), *[col(c).alias(f"c{i}") for i, c in enumerate(base.columns)])
    rows = base.select(
        own.alias("own"), source_key(col(source)).alias("_key"),
        F.md5(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("_hash"),
        F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_n"))
    weights = plan(rows.select("_key", "_n"), "_n", "_key", budget, repeats, entropy)
    digits = F.lit(0)
    for power in range(12):
        digits = digits + (F.col("n") > BLOCK_TOKENS * 16 ** power).cast("int")
    weights = cut(weights.select(
        "_key", digits.alias("_digits"), F.floor("rounds").cast("int").alias("_full"),
        F.round((F.col("rounds") - F.floor("rounds")) * F.col("n")).cast("long").alias("_rest")))
    rows = with_weights(rows, weights).withColumn("_block", F.substring(F.col("_hash"), F.lit(1), F.col("_digits")))

    blocks = rows.where("_rest > 0").groupBy("_key", "_block", "_full", "_rest").agg(F.sum("_n").alias("b"))
    blocks = cut(blocks.withColumn("o", order_key(F.col("_key"), F.col("_full").cast("string"), F.col("_block")))
                 .withColumn("range", F.substring("o", 1, 3)))
    over = Window.partitionBy("_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("_key", "range").agg(F.sum("b").alias("s")).withColumn(
        "before", F.coalesce(F.sum("s").over(over), F.lit(0))).select("_key", "range", "before")
    inner = Window.partitionBy("_key", "range").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    taken = blocks.join(ranges, ["_key", "range"]).withColumn(
        "before", F.col("before") + F.coalesce(F.sum("b").over(inner), F.lit(0)))
    taken = taken.where(F.col("before") < F.col("_rest")).select("_key", "_block", F.lit(1).alias("_more"))

    rows = rows.join(taken, ["_key", "_block"], "left")
    epochs = F.col("_full") + F.coalesce("_more", F.lit(0))
    rows = rows.where(epochs > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    key = order_key(F.col("_key"), F.col("mix_epoch").cast("string"), F.col("_block"))
    return rows.select(*[F.col("own").getField(f"c{i}").alias(c) for i, c in enumerate(base.columns)], "mix_epoch",
                       F.concat(key, F.lit("-"), "_hash").alias("mix_key"))


def mix_sql(repeats: float) -> str:
    """DuckDB SQL of ``mix`` over ``documents`` with a budget of all its tokens; doc_id, source, mix_epoch, mix_key."""
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('s:' || source, 'none') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n
  FROM documents),
t AS (SELECT k, sum(n)::BIGINT AS n FROM r GROUP BY k),
p AS (SELECT k, n, n / sum(n) OVER () AS p, sum(n) OVER () AS total FROM t WHERE n > 0),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.0::DOUBLE AS a
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE a END, CASE WHEN ok THEN a ELSE high END,
         CASE WHEN ok THEN (low + a) / 2 ELSE (a + high) / 2 END
  FROM (SELECT b.*, (SELECT max(pow(p, b.a - 1)) / sum(pow(p, b.a)) FROM p) <= {repeats} AS ok
        FROM bisect b WHERE step < 60)),
e AS (SELECT round(CASE WHEN (SELECT max(1 / p) / count(*) FROM p) <= {repeats} THEN 0 ELSE high END, 9) AS a
      FROM bisect WHERE step = 60),
w AS (SELECT k, n, round(pow(p, a) / sum(pow(p, a)) OVER () * total / n, 6) AS rounds FROM p, e
      UNION ALL SELECT k, n, 1.0 FROM t WHERE n = 0),
q AS (SELECT k, floor(rounds)::INT AS full_, round((rounds - floor(rounds)) * n)::BIGINT AS rest,
             (SELECT count(*) FROM range(12) x(i) WHERE n > {BLOCK_TOKENS} * pow(16, i)) AS digits FROM w),
d AS (SELECT r.*, full_, rest, substr(h, 1, digits::INT) AS block FROM r JOIN q USING (k)),
b AS (SELECT k, block, rest, sum(n) OVER (PARTITION BY k ORDER BY o) - n AS before
      FROM (SELECT k, block, rest, sum(n) AS n, md5('{SEED}|' || k || '|' || any_value(full_) || '|' || block) AS o
            FROM d WHERE rest > 0 GROUP BY k, block, rest)),
c AS (SELECT d.*, full_ + CASE WHEN b.block IS NULL THEN 0 ELSE 1 END AS epochs
      FROM d LEFT JOIN (SELECT * FROM b WHERE before < rest) b ON d.k = b.k AND d.block = b.block)
SELECT doc_id, source, i::INT AS mix_epoch, md5('{SEED}|' || k || '|' || i || '|' || block) || '-' || h AS mix_key
FROM c, range(1000) x(i) WHERE i < epochs
"""
