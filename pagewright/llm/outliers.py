"""Quality rules: robust multivariate outliers among text statistics. Native columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as S

from pagewright.functions.sql import Expr, fn as F
from pagewright.llm.common import SPACE, UPPER, let, words
from pagewright.session import write_through

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Transformed statistics are kept as integers in units of 1/UNIT, so sums are exact in any order.
UNIT = 4096
#: Smallest spread of each feature that counts as unusual; added to the covariance, it keeps estimates regular
#: where most documents share one value (no symbols, no repeated line).
FEATURES = {"f_length": 0.5, "f_word": 0.25, "f_symbols": 0.05, "f_upper": 0.1, "f_lines": 0.1, "f_repeats": 0.1}
SUPPORT = 0.75  # share of a group that an estimate rests on
MIN_GROUP = 50  # groups with fewer rows are judged by the estimate of their language, or of the table
STEPS = 8  # concentration steps at most; a fit ends as soon as a step changes nothing
#: Sets the distance limit: the chi-square quantile that a row of exactly normal statistics passes with this probability.
TAIL = 1e-6


# ---- statistics of a text --------------------------------------------------------------------


def repeat_words(ws: Expr, window: int = WINDOW) -> Expr:
    """Words in windows of ``window`` words that the text has twice or more. Linear in the text but for one sort.

    Windows are compared by 64 bits of hash within one text; only texts with an equal pair are sorted.
    """

    def covered(hashes: Expr) -> Expr:
        def count(s: Expr) -> Expr:
            at = F.transform(F.filter(s, lambda x, k: ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])
            return let(F.array_sort(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, window), window)), 0, lambda a, b: a + b))

        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.array_sort(keyed), count))

    def windows(w: Expr) -> Expr:
        return F.transform(F.sequence(1, F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return let(hashed, lambda w: F.when(F.size(w) <= window, 0).otherwise(let(windows(w), covered))).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_upper (A-Z), n_dup_lines and n_repeat_words (long), each over the whole text.

    NULL text counts as empty: all are 0.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, SPACE) != "")
    stats = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    return docs.withColumn("_s", stats.col).withColumns({
        "n_words": S.col("_s.n_words"),
        "word_chars": F.char_length(F.translate(text, SPACE, "")).cast("long").col,
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").col,
        "n_upper": (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))).cast("long").col,
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").col,
        "n_repeat_words": S.col("_s.n_repeat_words"),
    }).drop("_s")


def features() -> dict[str, Column]:
    """Transformed statistics: logarithms of sizes, arc sines of shares, in units of 1/UNIT."""
    n = S.greatest(S.col("n_words"), S.lit(1))

    def share(c: Column) -> Column:
        return S.asin(S.sqrt(S.least(c, S.lit(1.0))))

    raw = {
        "f_length": S.log(n.cast("double")),
        "f_word": S.log(S.greatest(S.col("word_chars"), S.lit(1)) / n),
        "f_symbols": share(S.col("n_symbols") / S.greatest(S.col("word_chars"), S.lit(1))),
        "f_upper": share(S.col("n_upper") / S.greatest(S.col("word_chars"), S.lit(1))),
        "f_lines": share(S.col("n_dup_lines") / n),
        "f_repeats": share(S.col("n_repeat_words") / n),
    }
    return {k: S.round(v * UNIT).cast("long") for k, v in raw.items()}


# ---- chi-square with k degrees of freedom ----------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    while term > total * 1e-16:
        a += 1
        term *= x / a
        total += term
    return total * math.exp(-x + k / 2 * math.log(x) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-12, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def consistency(support: float, k: int) -> float:
    """Factor by which the covariance of the innermost ``support`` of normal rows falls short."""
    return support / chi2_cdf(chi2_quantile(support, k), k + 2)


# ---- estimates -------------------------------------------------------------------------------


def label(by: tuple[str, ...], cut: int) -> Column:
    """Name of the group of a row at the level of its first ``cut`` group columns."""
    return S.concat(S.lit(f"{cut}:"), S.to_json(S.struct(*[S.col(c) for c in by[:cut]]))) if cut else S.lit("0:")


def pooled_groups(rows: DataFrame, by: tuple[str, ...], min_group: int) -> DataFrame:
    """(by, cut, group): for each combination, the level and the name of the estimate that judges it.

    A combination of ``min_group`` rows has its own; else the estimate of all rows that share its first columns holds, as soon as
    these are ``min_group``; else that of the whole table, however small. Works on counts per combination.
    """
    counts = rows.groupBy(*by).agg(S.count(S.lit(1)).alias("_n"))
    cut = S.when(S.col("_n") >= min_group, len(by))
    for k in range(len(by) - 1, 0, -1):
        cut = cut.when(S.sum("_n").over(Window.partitionBy(*by[:k])) >= min_group, k)
    named = counts.withColumn("_cut", cut.otherwise(0))
    group = S.lit(None).cast("string")
    for k in range(len(by) + 1):
        group = S.coalesce(group, S.when(S.col("_cut") == k, label(by, k)))
    return named.select(*by, "_cut", group.alias("_group"))


def group_members(rows: DataFrame, groups: DataFrame, by: tuple[str, ...], names: list[str]) -> DataFrame:
    """(_group, names): the rows that each estimate rests on. A pooled one rests on all rows of its level, so a row may be in several."""
    levels = {r._cut for r in groups.select("_cut").distinct().collect()}
    out = rows.limit(0).select(S.lit("").alias("_group"), *names)
    for k in sorted(levels):
        level = rows.withColumn("_group", label(by, k))
        if k:
            needed = groups.filter(S.col("_cut") == k).select("_group").distinct()
            level = level.join(needed, "_group", "left_semi")
        out = out.unionByName(level.select("_group", *names))
    return out


#: Products are added up in two parts, the bits from this one on and those below, so that sums of longs hold 2^43 rows.
LOW_BITS = 20


def moments(names: list[str]) -> list[Column]:
    """Count, sums and sums of products; exact whole numbers, so partial sums may meet in any order."""
    out = [S.count(S.lit(1)).alias("_n")] + [S.sum(c).alias(f"_s{i}") for i, c in enumerate(names)]
    for i in range(len(names)):
        for j in range(i + 1):
            product = S.col(names[i]) * S.col(names[j])
            out += [S.sum(S.shiftright(product, LOW_BITS)).alias(f"_h{i}_{j}"), S.sum(product.bitwiseAND(S.lit((1 << LOW_BITS) - 1).cast("long"))).alias(f"_r{i}_{j}")]
    return out


def moment_names(p: int) -> list[str]:
    return ["_n", *[f"_s{i}" for i in range(p)], *[f"_{k}{i}_{j}" for i in range(p) for j in range(i + 1) for k in "hr"]]


def with_products(sums: DataFrame, p: int) -> DataFrame:
    """The two parts of each sum of products put together as ``_s{i}_{j}``."""
    whole = lambda at: (S.col(f"_h{at}").cast("decimal(27,0)") * (1 << LOW_BITS) + S.col(f"_r{at}")).cast("double")
    return sums.withColumns({f"_s{i}_{j}": whole(f"{i}_{j}") for i in range(p) for j in range(i + 1)})


def estimate(sums: DataFrame, names: list[str], floors: list[float], factor: float, keys: list[str]) -> DataFrame:
    """From the sums of ``with_products``: (keys, _m array, _w array, _det): centre, inverse Cholesky factor row by row, log determinant.

    Plain columns on one row per group: the factor column by column, then its inverse by forward substitution.
    """
    p, n = len(names), S.col("_n").cast("double")
    df = sums.withColumns({f"_m{i}": S.col(f"_s{i}") / n for i in range(p)})
    df = df.withColumns({
        f"_c{i}_{j}": (S.col(f"_s{i}_{j}") / n - S.col(f"_m{i}") * S.col(f"_m{j}")) * factor + ((floors[i] * UNIT) ** 2 if i == j else 0.0)
        for i in range(p) for j in range(i + 1)
    })
    for j in range(p):
        square = S.col(f"_c{j}_{j}") - sum((S.col(f"_l{j}_{k}") * S.col(f"_l{j}_{k}") for k in range(j)), S.lit(0.0))
        # Rounding may take a pivot below its floor, never the true value.
        df = df.withColumn(f"_l{j}_{j}", S.sqrt(S.greatest(square, S.lit((floors[j] * UNIT) ** 2 / 2))))
        df = df.withColumns({
            f"_l{i}_{j}": (S.col(f"_c{i}_{j}") - sum((S.col(f"_l{i}_{k}") * S.col(f"_l{j}_{k}") for k in range(j)), S.lit(0.0))) / S.col(f"_l{j}_{j}")
            for i in range(j + 1, p)
        })
    for i in range(p):
        df = df.withColumns({f"_w{i}_{i}": 1.0 / S.col(f"_l{i}_{i}")})
        df = df.withColumns({f"_w{i}_{j}": -sum((S.col(f"_l{i}_{k}") * S.col(f"_w{k}_{j}") for k in range(j, i)), S.lit(0.0)) / S.col(f"_l{i}_{i}") for j in range(i)})
    det = sum((S.log(f"_l{i}_{i}") * 2 for i in range(p)), S.lit(0.0))
    return df.select(*keys, S.array(*[f"_m{i}" for i in range(p)]).alias("_m"), S.array(*[f"_w{i}_{j}" for i in range(p) for j in range(i + 1)]).alias("_w"), det.alias("_det"))


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of a row to the centre ``_m`` under the factor ``_w``."""
    out, at = S.lit(0.0), 0
    for i in range(len(names)):
        z = S.lit(0.0)
        for j in range(i + 1):
            z = z + S.get("_w", S.lit(at)) * (S.col(names[j]).cast("double") - S.get("_m", S.lit(j)))
            at += 1
        out = out + z * z
    return out


BINS_PER_DOUBLING, MAX_BIN = 64, 4095


def nearest(rows: DataFrame, est: DataFrame, names: list[str], support: float) -> DataFrame:
    """``moments`` of the rows nearest to each centre, at least ``support`` of a group.

    Distances are counted in bins of a sixty-fourth of a doubling, at most ``MAX_BIN`` + 1 per group; rows of the
    last bin taken all go in, so ties need no order. One pass adds up the moments of each bin; bins are then taken from the
    centre on.
    """
    step = S.least(S.floor(S.log2(1e-6 + S.col("_d")) * BINS_PER_DOUBLING) + 20 * BINS_PER_DOUBLING, S.lit(MAX_BIN)).cast("int")
    near = rows.join(est, ["_group"]).withColumn("_d", distance(names)).withColumn("_bin", step)
    bins = near.groupBy("_group", "_start", "_bin").agg(*moments(names))
    w = Window.partitionBy("_group", "_start")
    inside = S.sum("_n").over(w.orderBy("_bin")) - S.col("_n") < S.ceil(S.sum("_n").over(w) * support)
    return bins.withColumn("_in", inside).filter("_in").groupBy("_group", "_start").agg(*[S.sum(c).alias(c) for c in moment_names(len(names))])


def fit(rows: DataFrame, floors: dict[str, float], support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """(_group, _m, _w): the minimum-covariance-determinant estimate of each group of ``rows`` (_group, features).

    Two starts, all rows with the full covariance and all rows with variances only, each refined by
    concentration steps (estimate from the nearest rows, then anew) until a step takes the same rows, by their moments,
    in every group, or ``steps`` are done; the lower determinant wins, ties by start.
    """
    names, p = list(floors), len(floors)
    levels = list(floors.values())
    keys = ["_group", "_start"]
    sums = with_products(write_through(rows.groupBy("_group").agg(*moments(names))), p)
    est = estimate(sums, names, levels, 1.0, ["_group"])
    flat = sums
    for i in range(p):
        for j in range(i):  # products of the means: a covariance of zero
            flat = flat.withColumn(f"_s{i}_{j}", S.col(f"_s{i}").cast("double") * S.col(f"_s{j}").cast("double") / S.col("_n"))
    est = est.withColumn("_start", S.lit(0)).unionByName(estimate(flat, names, levels, 1.0, ["_group"]).withColumn("_start", S.lit(1)))
    factor = consistency(support, p)
    before = None
    for _ in range(steps):
        now = write_through(nearest(rows, est, names, support))
        est = estimate(with_products(now, p), names, levels, factor, keys)
        taken = now.agg(S.bit_xor(S.xxhash64(*keys, *moment_names(p)))).first()[0]
        if taken == before:
            break
        before = taken
    best = S.row_number().over(Window.partitionBy("_group").orderBy("_det", "_start"))
    return est.withColumn("_b", best).filter("_b = 1").select("_group", "_m", "_w")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text_col: str, by: tuple[str, ...], min_words: int, max_repeat_percent: int) -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and the group columns as names ``_by0``, ``_by1``, ..."""
    failed = (S.col("n_words") < min_words) | (S.col("n_repeat_words") * 100 > S.col("n_words") * max_repeat_percent)
    keyed = docs.withColumns({f"_by{i}": S.col(f"`{c}`").cast("string") for i, c in enumerate(by)})
    return text_statistics(keyed, text_col).withColumn("base_failed", failed)


def group_estimates(stats: DataFrame, n_by: int, min_group: int, support: float) -> DataFrame:
    """(_by0g, ..., _m, _w): the estimate that holds for each combination of group columns in a table of statistics."""
    own = tuple(f"_by{i}" for i in range(n_by))
    sound = stats.filter("NOT base_failed").withColumns(features())
    groups = write_through(pooled_groups(sound, own, min_group))
    rows = group_members(sound, groups, own, list(FEATURES))
    est = write_through(fit(write_through(rows), FEATURES, support))
    return write_through(groups.join(est, "_group").select(*[S.col(c).alias(f"{c}g") for c in own], "_m", "_w"))


def with_verdicts(rows: DataFrame, estimates: DataFrame, n_by: int, tail: float) -> DataFrame:
    """``rows`` (with statistics) and their ``distance`` (NULL where the base failed) and ``kept``."""
    same = [S.col(f"_by{i}").eqNullSafe(S.col(f"_by{i}g")) for i in range(n_by)]
    judged = rows.withColumns(features()).join(estimates, same, "left")
    judged = judged.withColumn("distance", S.when(~S.col("base_failed"), distance(list(FEATURES))))
    # One expression over both sides of the join: a filter on it stays above the join, and statistics are computed once.
    near = S.coalesce("distance", S.lit(0.0)) <= chi2_quantile(1 - tail, len(FEATURES))
    kept = S.when(S.col("base_failed"), S.lit(False)).otherwise(near)
    return judged.withColumn("kept", kept).drop(*FEATURES, "_m", "_w", *[f"_by{i}{g}" for i in range(n_by) for g in ("", "g")])


def quality_verdicts(
    docs: DataFrame, keep: list[str], text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT, min_group: int = MIN_GROUP, support: float = SUPPORT, tail: float = TAIL,
) -> DataFrame:
    """(keep, the six statistics, base_failed, distance, kept) for every row of ``docs``.

    base_failed: under ``min_words`` words, or over ``max_repeat_percent`` of them in repeated windows. Of the other
    rows, one is rejected if the squared Mahalanobis distance of its transformed statistics to the robust
    estimate of its language and source is beyond a limit, the chi-square quantile at 1 - ``tail``. Rows of groups under
    ``min_group`` rows are judged by the estimate over all rows of their language, or, if these are fewer, too, of the
    table; every row is judged, in a table of any size. NULL languages and sources are names like any other, NULL text is empty and fails the base,
    equal rows get equal verdicts, an empty table gives no rows. Columns not in ``keep`` are not carried.
    """
    own = docs.select(*[S.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *[S.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(by)], S.col(f"`{text_col}`").alias("_text"))
    stats = write_through(with_statistics(own, "_text", tuple(f"_c{i}" for i in range(len(by))), min_words, max_repeat_percent).drop("_text"))
    judged = with_verdicts(stats, group_estimates(stats, len(by), min_group, support), len(by), tail)
    return judged.select(*[S.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *STATISTICS, "base_failed", "distance", "kept")


def drop_outliers(
    docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT, min_group: int = MIN_GROUP, support: float = SUPPORT, tail: float = TAIL,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with their columns.

    The statistics are computed once and written beside the documents; estimates read them alone, and no text is shuffled.
    """
    columns = docs.columns
    own = tuple(f"_c{i}" for i in range(len(by)))
    whole = docs.select(S.struct("*").alias("_row"), *[S.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(by)], S.col(f"`{text_col}`").alias("_text"))
    rows = write_through(with_statistics(whole, "_text", own, min_words, max_repeat_percent).drop("_text", *own))
    estimates = group_estimates(rows.drop("_row"), len(by), min_group, support)
    return with_verdicts(rows, estimates, len(by), tail).filter("kept").select(*[S.col(f"_row.`{c}`").alias(c) for c in columns])
