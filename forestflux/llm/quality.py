"""Quality rules: base statistics of each text, then robust multivariate outliers per language and source.

A document that passes the base rules is described by five transformed statistics (mean word length, symbols, repeated lines, repeated
words and length, on log scales, in thousandths as whole numbers). For each language and source the minimum-covariance-determinant
estimate of location and scatter is found by concentration steps: the three quarters of the documents nearest to the current estimate
give the next one. Steps start from the median with the median deviation and from the plain moments, and the start that ends with the
smaller determinant wins. A document is rejected if its squared Mahalanobis distance is over the chi-square quantile.

Only DataFrame functions run here. A step needs no sort of a group and no row list: rows are summed per group and distance bin, with
map-side combining, so that a source with a third of all rows costs no single task more than its share, and the subset is made of
whole bins. All sums are of whole numbers, so results don't depend on the order of rows.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources are groups of their own; a group
under `least` documents is judged by the estimate of all documents of its language, and where those are fewer by that of all documents;
if even these are fewer, nothing is judged and all are kept; repeated rows count as often as they occur; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
STATS = ("word_length", "symbols", "dup_lines", "repeats", "length")
#: The least step of the three shares, in counts or words (one symbol, one repeated line, one window), and its variance as a part of the
#: step's square: a count that is none or one by chance, and a length that is rounded evenly to windows.
COUNTED = {1: (1, 1 / 4), 2: (1, 1 / 4), 3: (WINDOW, 1 / 12)}
#: Share of a group in the concentrated subset, and what its scatter is multiplied by to fit all of a normal group (5 dimensions).
SHARE, CONSISTENCY = 0.75, 1.41
#: The 0.99999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 30.86
#: LEAST: an estimate is made from ten times the dimension on.
STEPS, LEAST = 5, 50
_BINS = 32.0
_N = len(STATS)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: (a >= 0) & (b < n) & (F.get(s, a)["h"] == F.get(s, b)["h"])
            twins = F.filter(s, lambda x, k: same(k - 1, k) | same(k, k + 1))
            places = F.array_sort(F.transform(twins, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("sum"))
            step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(window), p - a["last"])).alias("sum"))
            return F.aggregate(places, start, step)["sum"]

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(order, spans)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) > window, _let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    found = docs.select(
        "doc_id", "lang", "source", F.xxhash64("doc_id", "text", "lang", "source").alias("row_key"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("again"))).alias("w"),
    )
    n, again = F.col("w.n"), F.col("w.again")
    failed = (n < 20) | (100 * again > 30 * n)
    return found.select("doc_id", "lang", "source", "row_key", n.alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", again.alias("n_repeat_words"), failed.alias("base_failed"))


def _error(i: int, log_words: Column) -> Column:
    """Variance of statistic i from counting alone, in a text with so many words (as q4 has them): the least scatter of any group.

    A share has the error of its least step from nought; mean word length that of a mean over words whose lengths vary by half; length
    that of a count.
    """
    n = F.exp(log_words / 1000)
    if i in COUNTED:
        step, part = COUNTED[i]
        return F.pow(1000 * F.log(1 + 100 * step / n), 2) * part
    return 1e6 * (0.25 if i == 0 else 1.0) / n


def _quantised() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    per_cent = lambda c: F.log(1 + 100 * F.col(c) / n)
    values = [F.log((F.col("word_chars") + 1) / n), per_cent("n_symbols"), per_cent("n_dup_lines"), per_cent("n_repeat_words"), F.log(n)]
    return [F.round(1000 * v).cast("long").alias(f"q{i}") for i, v in enumerate(values)]


def _finish(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the inverse of the scatter c{i}{j} (by Cholesky factors) as p{i}{j}, and its log determinant."""
    df = moments
    for j in range(_N):  # column j of the factor
        below = lambda i, j=j: F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(below(j)))
        df = df.withColumns({f"l{i}{j}": below(i) / F.col(f"l{j}{j}") for i in range(j + 1, _N)} or {f"l{j}{j}": F.col(f"l{j}{j}")})
    for j in range(_N):  # column j of the factor's inverse
        df = df.withColumn(f"v{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, _N):
            df = df.withColumn(f"v{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    inverse = [sum((F.col(f"v{k}{i}") * F.col(f"v{k}{j}") for k in range(max(i, j), _N)), F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS]
    logdet = sum((F.log(f"l{i}{i}") for i in range(_N)), F.lit(0.0))
    return df.select(*keys, *[f"m{i}" for i in range(_N)], *inverse, *[f"c{i}{i}" for i in range(_N)], (2 * logdet).alias("logdet"))


def _distance() -> Column:
    """Squared distance from the group. A shorter text than the group's typical one has a larger counting error: its deviations count as much less."""
    more = [F.greatest(_error(i, F.col("q4")) - _error(i, F.col("m4")), F.lit(0.0)) for i in range(_N)]
    z = [(F.col(f"q{i}") - F.col(f"m{i}")) / F.sqrt(1 + more[i] / F.col(f"c{i}{i}")) for i in range(_N)]
    return sum((z[i] * z[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _sums() -> list[Column]:
    once = [F.sum(f"q{i}").alias(f"s{i}") for i in range(_N)]
    return [F.count(F.lit(1)).alias("n"), *once, *[F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]]


def _moments(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    n = F.col("n").cast("double")
    mean = [(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_N)]
    cov = []
    for i, j in _PAIRS:
        c = (F.col(f"s{i}{j}") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n)) * scale
        cov.append((c + _error(i, F.col("s4") / n) if i == j else c).alias(f"c{i}{j}"))
    return sums.select(*keys, *mean, *cov)


def _medians(rows: DataFrame) -> DataFrame:
    """Median and median deviation of every statistic of every group, from counts of the distinct values."""
    tall = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"q{i}").alias("q")) for i in range(_N)])).alias("x")).select("g", "x.k", "x.q")
    counts = tall.groupBy("g", "k", "q").agg(F.count(F.lit(1)).alias("n"))

    def middle(df: DataFrame, value: str, name: str) -> DataFrame:
        order = Window.partitionBy("g", "k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("g", "k")
        ranked = df.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(whole))
        return ranked.withColumn(name, F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col(value))).over(whole))

    off = middle(counts, "q", "median").withColumn("off", F.abs(F.col("q") - F.col("median")))
    found = middle(off, "off", "mad").groupBy("g", "k").agg(F.first("median").alias("median"), F.first("mad").alias("mad"))
    pick = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c))).cast("double")
    wide = found.groupBy("g").agg(*[pick(i, "median").alias(f"m{i}") for i in range(_N)], *[pick(i, "mad").alias(f"d{i}") for i in range(_N)])
    scatter = [(F.pow(1.4826 * F.col(f"d{i}"), 2) + _error(i, F.col("m4")) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return wide.select("g", F.lit("median").alias("start"), *[f"m{i}" for i in range(_N)], *scatter)


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, small: bool = True) -> DataFrame:
    """MCD location m{i} and inverse scatter p{i}{j} of each group g; rows: g, q0..q4, n_group. small: estimates may be broadcast."""
    hint = F.broadcast if small else (lambda x: x)
    keys = ["g", "start"]
    plain = _moments(rows.groupBy("g").agg(*_sums()).withColumn("start", F.lit("moments")), keys, 1.0)
    found = table(_finish(_medians(rows).unionByName(plain), keys), "quality-start")
    for step in range(steps):
        bins = rows.join(hint(found), "g").withColumn("bin", F.floor(_BINS * F.log2(_distance() + 1e-3)).cast("int"))
        bins = bins.groupBy(*keys, "bin").agg(*_sums(), F.first("n_group").alias("n_group"))
        order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        inside = bins.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") - F.col("n") < share * F.col("n_group"))
        total = inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in bins.columns if c[0] in "ns" and c not in ("n_group", "start")])
        found = table(_finish(_moments(total, keys, CONSISTENCY), keys), f"quality-step{step}")
    best = Window.partitionBy("g").orderBy("logdet", "start")
    return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "start")


def judge(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST, **options) -> DataFrame:
    """(doc_id, the base statistics, base_failed, distance, kept, row_key) for every row; distance is null where none was computed."""
    keyed = base_statistics(docs).withColumn("l", F.to_json(F.struct("lang"))).withColumn("g", F.to_json(F.struct("lang", "source")))
    stats = table(keyed.drop("lang", "source"), "quality-stats")
    groups = table(stats.where("not base_failed").groupBy("l", "g").agg(F.count(F.lit(1)).alias("n_g")), "quality-groups")
    n, n_all = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_g"), F.lit(0))).first()
    small = n <= 20_000
    hint = F.broadcast if small else (lambda x: x)
    # the keys of the three steps, all told apart by their first letter
    steps = [(F.concat(F.lit("g"), "g"), F.col("n_g")), (F.concat(F.lit("l"), "l"), F.col("n_l")), (F.lit("all"), F.lit(n_all))]
    own = F.coalesce(*[F.when(count >= least, key) for key, count in steps])
    names = groups.join(groups.groupBy("l").agg(F.sum("n_g").alias("n_l"), F.min("n_g").alias("n_min")), "l").withColumn("own", own)
    names = table(names, "quality-names")
    rest = not names.where("own = 'all'").isEmpty()
    needed = [F.col("n_g") >= least, (F.col("n_min") < least) & (F.col("n_l") >= least), F.lit(rest)]
    feeds = F.array_compact(F.array(*[F.when(need, F.struct(key.alias("g"), count.cast("long").alias("n_group"))) for (key, count), need in zip(steps, needed)]))
    rows = stats.join(hint(names.select("g", "own", feeds.alias("feeds"))), "g", "left").withColumn("g", F.col("own")).drop("own", "l").withColumns({f"q{i}": c for i, c in enumerate(_quantised())})
    judged = rows.where(~F.col("base_failed")).select(F.explode("feeds").alias("feed"), *[f"q{i}" for i in range(_N)]).select("feed.*", *[f"q{i}" for i in range(_N)])
    found = estimates(judged, small=small, **options)
    out = rows.join(hint(found), "g", "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = (~F.col("base_failed")) & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"), "row_key")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, all columns as they are; rows that share a doc_id are judged one by one."""
    bad = judge(docs, **options).where("not kept").select(F.col("row_key").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64("doc_id", "text", "lang", "source") == F.col("__bad"), "left_anti")
