"""Order statistics and ranks by counting: no group's values and no table's rows are ever sorted or held in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a round of the selection decides, and rounds.
BITS, ROUNDS = 16, 4
#: Rows of the sample that the bounds of ranges are read from, at most about twice as many, and ranges.
SAMPLE, RANGES = 4000, 100


def ordered_bits(v: Column) -> Column:
    """A whole number for every double, in the same order and back by from_bits; both zeros are 0, NaN and NULL are NULL.

    The number is what the double's bits say, computed from its exponent and fraction by exact scalings.
    """
    x = v.cast("double")
    a = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    guess = F.floor(F.log2(a)).cast("int")
    guess = F.greatest(F.least(guess, F.lit(1023)), F.lit(-1022))
    # the logarithm may be one off beside powers of two
    e = F.when(a * two(-guess) >= 2, guess + 1).when((a * two(-guess) < 1) & (guess > -1022), guess - 1).otherwise(guess)
    normal = (e.cast("long") + 1023) * F.lit(1 << 52) + ((a * two(-e) - 1) * F.lit(float(1 << 52))).cast("long")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(a == float("inf"), F.lit(2047 << 52)).when(a < 2.0**-1022, small).otherwise(normal)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def from_bits(b: Column) -> Column:
    """The double of a number that ordered_bits gave."""
    n = F.abs(b)
    e, part = F.shiftright(n, 52), n.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (part / float(1 << 52) + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double"))
    a = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, part * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise(normal)
    return F.when(b < 0, -a).otherwise(a)


def kth_smallest(df: DataFrame, keys: list[str], value: Column, wanted: DataFrame) -> DataFrame:
    """keys and `keys`, the values (long) with the wanted ranks: wanted has keys and ranks, an array of 0-based ranks of values that are there.

    Each round counts by the next BITS bits the values that agree with what is known of an answer, and so finds the bits of it. A task
    and a group hold counts of 2^BITS digits for each rank at most, however many values there are and however many are equal.
    """
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], value.alias("__v")).where(F.col("__v").isNotNull())
    names = [f"__k{i}" for i in range(len(keys))]
    state = wanted.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.posexplode("ranks").alias("which", "rank")).withColumn("prefix", F.lit(0).cast("long"))
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    for k in range(ROUNDS):
        shift = 64 - BITS * (k + 1)
        rows_k = rows.withColumns({"now": F.shiftright("__v", shift), "before": F.shiftright("__v", shift + BITS) if k else F.lit(0).cast("long")})
        met = rows_k.alias("r").join(state.alias("s"), [*same, F.col("r.before") == F.col("s.prefix")]) if names else rows_k.alias("r").join(state.alias("s"), F.col("r.before") == F.col("s.prefix"))
        counts = met.groupBy(*[F.col(f"s.{n}").alias(n) for n in names], "which", "rank", "now").agg(F.count(F.lit(1)).alias("n"))
        line = Window.partitionBy(*names, "which").orderBy("now")
        through = counts.withColumn("through", F.sum("n").over(line))
        hit = through.where((F.col("through") > F.col("rank")) & (F.col("through") - F.col("n") <= F.col("rank")))
        state = hit.select(*names, "which", (F.col("rank") - (F.col("through") - F.col("n"))).alias("rank"), F.col("now").alias("prefix"))
    found = state.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "prefix"))), lambda s: s["prefix"]).alias("keys"))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "keys")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles per group with linear interpolation between neighbours: keys and a column for each name in shares (0 to 1).

    NULL and NaN count as absent; groups without values have no row.
    """
    bits = ordered_bits(F.col(value))
    n = df.where(bits.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in shares.values()]
    ranks = F.array(*[r.cast("long") for at in places for r in (F.floor(at), F.ceil(at))])
    wanted = n.select(*keys, ranks.alias("ranks"))
    found = kth_smallest(df, keys, bits, wanted)
    if keys:
        both = found.alias("f").join(n.alias("n"), [F.col(f"f.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
        names = [F.col(f"n.{k}").alias(k) for k in keys]
    else:
        both, names = found.crossJoin(n), []  # one row each
    low = lambda i: from_bits(F.col("keys")[2 * i])
    high = lambda i: from_bits(F.col("keys")[2 * i + 1])
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return both.select(*names, *[F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())])


def global_rank(df: DataFrame, key: str, ties: list[str] = [], name: str = "rank") -> DataFrame:  # noqa: B006
    """Adds 0-based ranks by key (NULL first), then by the columns in ties, with rows dealt to ranges of the order.

    The bounds of ranges come from a bounded sample that a hash picks, so a repeated run has the same ranges; rows are numbered within
    theirs, and the numbers of rows in earlier ranges are added. A key that fills several ranges is cut by the hash of the tie columns,
    which then decides before them; rows that are equal in all of these keep no order among themselves.
    """
    mark = F.xxhash64(*[F.col(c) for c in dict.fromkeys([key, *ties])])
    total = df.count()
    every = max(1, total // SAMPLE)
    picked = df.where(F.pmod(F.xxhash64(F.lit(7), mark), F.lit(every)) == 0).where(F.col(key).isNotNull()).select(key).limit(4 * SAMPLE)
    sample = sorted(r[0] for r in picked.collect())
    bounds = [sample[len(sample) * i // RANGES] for i in range(1, RANGES)] if len(sample) >= 2 * RANGES else []
    distinct = sorted(set(bounds))
    often = {b: bounds.count(b) for b in distinct if bounds.count(b) > 1}
    kind = df.schema[key].dataType
    literals = F.array(*[F.lit(b).cast(kind) for b in distinct]) if distinct else None
    bucket = F.size(F.filter(literals, lambda b: b < F.col(key))) if distinct else F.lit(0)
    bucket = F.when(F.col(key).isNull(), -1).otherwise(bucket)
    part = F.lit(0)
    if often:
        cuts = F.create_map(*[x for b, n in often.items() for x in (F.lit(b).cast(kind), F.lit(n))])
        # a key that is a bound is the last of its bucket
        part = F.coalesce(F.floor(F.pmod(F.shiftright(mark, 1), F.lit(1 << 30)) * F.try_element_at(cuts, F.col(key)) / (1 << 30)).cast("int") + 1, F.lit(0))
    rows = df.withColumns({"__bucket": bucket, "__part": part})
    sizes = rows.groupBy("__bucket", "__part").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__bucket", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", "__part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__start"))  # a row per range
    within = Window.partitionBy("__bucket", "__part").orderBy(F.col(key), *ties)
    numbered = rows.withColumn("__i", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["__bucket", "__part"]).withColumn(name, F.col("__start") + F.col("__i")).drop("__bucket", "__part", "__start", "__i")
