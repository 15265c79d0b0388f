"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

#: Bins (a power of two), low-order bits kept of each, words of a shingle.
BINS, KEPT, WORDS = 256, 4, 5
#: Bins tried one by one for an empty bin before all are ranked.
TRIES = 12
BIN_BITS = BINS.bit_length() - 1
SHIFT = 64 - BIN_BITS
REST = (1 << SHIFT) - 1
PER_LONG = 64 // KEPT
LOW = (1 << KEPT) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _bin(value: Column) -> Column:
    return F.shiftright(value, SHIFT)


def _empty(value: Column) -> Column:
    return value.bitwiseAND(_long(REST)) == _long(REST)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append ``out``: the packed fingerprint of each text, ``array<bigint>``.

    Words are runs of other signs than the six ASCII blanks. Every shingle of
    five words is hashed once; its top bits name a bin and each bin keeps its
    smallest hash. One sort does that: a largest value per bin is mixed in,
    so the first value of each bin in sorted order is its minimum or, if that
    largest value, marks it empty. An empty bin takes the value of a bin drawn
    by a hash of (bin, try) until one holds a value (optimal densification);
    after ``TRIES`` draws the filled bins are ranked by such a hash, so every
    fingerprint gets filled. The low ``KEPT`` bits of all bins are packed into longs.

    Fewer than five words make one shingle, no words (empty or null text) the
    shingle of the empty text. Each step is a projection of its own, so no
    step is computed twice.
    """
    keep = [col(c) for c in df.columns if c.lower() != out.lower()]
    blanks = "[\\x20\\x09-\\x0D]+"
    step = df.select(*keep, F.filter(F.split(F.coalesce(col(text), F.lit("")), blanks),
                                     lambda w: w != "").alias("_w"))
    step = step.select(*keep, F.concat_ws(" ", F.slice("_w", 1, WORDS)).alias("_s"),
                       F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    shingles = F.transform(
        F.sequence(F.lit(0), F.size("_h") - WORDS),
        lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WORDS)]))
    tops = F.lit([((b << SHIFT) | REST) for b in range(-BINS // 2, BINS // 2)])
    step = step.select(*keep, F.sort_array(F.concat(
        F.when(F.size("_h") < WORDS, F.array(F.xxhash64("_s"))).otherwise(shingles),
        tops.cast("array<bigint>"))).alias("_h"))
    step = step.select(*keep, F.filter("_h", lambda v, i: (i == 0) | (
        _bin(v) != _bin(F.get(F.col("_h"), i - 1)))).alias("_b"))
    step = step.select(*keep, "_b", F.filter("_b", lambda v: ~_empty(v)).alias("_f"))

    def draw(i: Column, t: int) -> Column:
        value = F.get(F.col("_b"), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
        return F.when(~_empty(value), value)

    def ranked(i: Column) -> Column:
        return F.array_min(F.transform("_f", lambda v: F.struct(
            F.xxhash64(i, _bin(v), F.lit(TRIES)).alias("r"), v.alias("v"))))["v"]

    step = step.select(*keep, F.transform("_b", lambda v, i: F.when(~_empty(v), v).otherwise(
        F.coalesce(*[draw(i, t) for t in range(TRIES)], ranked(i))).bitwiseAND(_long(LOW))).alias("_b"))
    # one expression per long: in a lambda the optimizer would fill the bins anew for each
    words = F.array(*[F.aggregate(
        F.slice("_b", n + 1, PER_LONG), _long(0), lambda packed, v: F.shiftleft(packed, KEPT).bitwiseOR(v))
        for n in range(0, BINS, PER_LONG)])
    return step.select(*keep, words.alias(out))


def to_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1.

    Two different values agree in their kept bits with chance 2^-KEPT; the
    share of agreeing bins is corrected for that and cut at 0.
    """
    ones = sum(1 << (KEPT * i) for i in range(PER_LONG))
    ones = _long(ones - (1 << 64) if ones >> 63 else ones)

    def differing(x: Column, y: Column) -> Column:
        spread = x.bitwiseXOR(y)
        folded = spread
        for i in range(1, KEPT):
            folded = folded.bitwiseOR(F.shiftrightunsigned(spread, i))
        return F.bit_count(folded.bitwiseAND(ones))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, v: n + v)
    chance = 2.0 ** -KEPT
    return F.greatest(F.lit(0.0), ((BINS - off) / F.lit(float(BINS)) - chance) / (1 - chance))


def with_next(df: DataFrame, doc_id: str, carried: list[str], make, buckets: int) -> DataFrame:
    """Append ``next_<c>`` of the row that follows in id order; the last row's is the first's.

    Ids are cut into ranges at values of their own (the first from each approximate quantile on), and
    each range is a window partition. The row that begins the next range is
    added to each as a guest, so no row is ever looked up across ranges and
    the table is shuffled once. ``make`` derives columns before the shuffle.
    Rows of equal id follow each other by their carried columns; null ids come last.
    """
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    low, bounds = df.select(F.min(doc_id), F.percentile_approx(doc_id, shares)).first()
    bounds = sorted({b for b in bounds or [] if b > low})
    if bounds:
        # quantiles go through doubles: each range begins at the smallest id that really stands in it
        place = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= col(doc_id)))
        begun = df.where(col(doc_id).isNotNull()).groupBy(place.alias("_home")).agg(F.min(doc_id).alias("b"))
        bounds = sorted(r["b"] for r in begun.collect() if r["b"] > low)
    last = len(bounds)
    edges = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    home = F.when(col(doc_id).isNull(), last).otherwise(F.size(F.filter(edges, lambda b: b <= col(doc_id))))
    own = make(df).withColumns({"_home": home, "_guest": F.lit(False)})
    begins = df.where(col(doc_id).isin(bounds) | col(doc_id).eqNullSafe(F.lit(low)))
    first = Window.partitionBy(col(doc_id)).orderBy(*[col(c) for c in carried])
    guests = make(begins).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    guests = guests.withColumns({
        "_home": F.when(col(doc_id).eqNullSafe(F.lit(low)), last).otherwise(
            F.size(F.filter(edges, lambda b: b < col(doc_id)))),
        "_guest": F.lit(True)})
    order = Window.partitionBy("_home").orderBy(
        "_guest", col(doc_id).asc_nulls_last(), *[col(c) for c in carried])
    led = own.union(guests).withColumns({f"next_{c}": F.lead(col(c)).over(order) for c in carried})
    return led.where(~F.col("_guest")).drop("_home", "_guest")


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, one row per row of ``df``.

    The edited text has the last quarter of its signs (rounded down) replaced
    by the first as many of the next text in id order (all, if it is shorter).
    Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint`` (hex), ``near_edited`` and ``near_next``.

    Null texts count as empty; the empty text has a fingerprint of its own and
    a likeness of 1 to itself. Rows of a repeated id follow one another by
    text, rows without an id come last. A single row is its own next. Other
    columns are left out. An empty table gives an empty one.
    """
    spark = df.sparkSession
    buckets = max(2, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = df.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    led = with_next(own, "doc_id", ["text", "fp"], lambda d: fingerprint(d, "text", "fp"), buckets)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    led = led.select(
        "doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp",
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut),
                 F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"))
    led = led.select("doc_id", "n_chars", "fp", "next_fp", "edited",
                     F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    led = fingerprint(led, "edited", "edited_fp")
    return led.select(
        F.col("doc_id").alias(doc_id), "n_chars", "edited_sha256",
        to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
