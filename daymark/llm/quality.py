"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Each document becomes a vector of transformed statistics. For each language and source the location and scatter of the vectors
are estimated by the minimum covariance determinant: from two starts (medians with MADs, and mean with covariance),
concentration steps keep the 75 % of the rows with the smallest Mahalanobis distances and estimate anew, until the
determinants stand still; the start with the smaller determinant wins and is reweighted once. A document whose
distance passes ``CUT`` is rejected.

Scale: a text is read once, in its own row; the statistics are a narrow table. A concentration step is one pass over it:
moments are summed by group and by bin of the distance, which partial aggregation does before the shuffle whatever the
size of a group, and the bins up to the 75 % quantile are added. So a source with a third of all rows costs no more than
its share, and a group has some hundred bins. Group estimates are written tables of a row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import table

GAP = "[ \t-\r]+"
POSITION_BITS = 27  # a row cannot hold more words
DIMENSIONS = 5
#: Least variance of each coordinate: ln words, ln word length, ln symbols, duplicate lines and repeated words a hundred words.
FLOORS = (0.25, 0.01, 0.25, 0.25, 0.25)
#: Fixed values for five dimensions: consistency at 75 %, the 97.5 % point of chi-squared and the consistency there.
CONSISTENT_75, POINT_975, CONSISTENT_975 = 1.412, 12.833, 1.055
#: Squared distance beyond which a document is an outlier.
CUT = 46.0
LEAST_ROWS = 50
STEPS = 12




def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row; a null text has no word.

    Words repeated in three-word windows: a window's hash is packed with its position into one long, the longs are sorted, and
    windows that share a hash with a neighbour are compared word by word. So the count is exact.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                     F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("t"))
    df = df.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("t", GAP), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike("[^ \t-\r]")).alias("lines"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    hashed = F.expr(
        f"CASE WHEN size(words) < 4 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size(words) - 3), "
        f"i -> shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), {POSITION_BITS}) | i)) END")
    df = df.select(
        "doc_id", "lang", "source", "n_symbols", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashed.alias("packed"),
    )
    twin = f"shiftright(x, {POSITION_BITS}) = shiftright(get(packed, k + %s), {POSITION_BITS})"
    at = f"cast(x & {(1 << POSITION_BITS) - 1} AS int)"
    df = df.withColumn("places", F.expr(f"transform(filter(packed, (x, k) -> coalesce({twin % 1}, false) OR coalesce({twin % -1}, false)), x -> {at})")).drop("packed")
    df = df.withColumn("windows", F.expr("array_sort(transform(places, p -> struct(get(words, p) AS a, get(words, p + 1) AS b, get(words, p + 2) AS c, p AS p)))")).drop("words", "places")
    same = "(get(windows, k + {0}).a = x.a AND get(windows, k + {0}).b = x.b AND get(windows, k + {0}).c = x.c)"
    df = df.withColumn("starts", F.expr(f"array_sort(transform(filter(windows, (x, k) -> coalesce({same.format(1)}, false) OR coalesce({same.format(-1)}, false)), x -> x.p))")).drop("windows")
    covered = F.expr("aggregate(transform(starts, (p, k) -> least(3, coalesce(get(starts, k + 1) - p, 3))), 0L, (s, x) -> s + x)")
    return df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    share = lambda c: F.log1p(100.0 * F.col(c) / n)
    return [F.log1p("n_words"), F.log(F.greatest("word_chars", F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def moments() -> list[Column]:
    return [F.sum(F.lit(1.0)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMENSIONS)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


MOMENTS = ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"q{i}{j}" for i, j in PAIRS]]


def estimates(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means, Cholesky factor and log determinant from summed moments. Variances get ``FLOORS`` added."""
    mean = {i: F.col(f"s{i}") / F.col("n") for i in range(DIMENSIONS)}
    df = sums.select(*keys, *[mean[i].alias(f"m{i}") for i in range(DIMENSIONS)], *[
        ((F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * scale + (F.lit(FLOORS[i]) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in PAIRS])
    return factored(df, keys)


def factored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the covariances c_ij by the Cholesky factor l_ij, and add ``logdet``."""
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, DIMENSIONS)), 2 * F.log("l00"))
    return df.select(*keys, *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def with_distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMENSIONS)), F.col("z0") * F.col("z0")))


def grouped(rows: DataFrame) -> DataFrame:
    """Add the group ``g``: language and source, or the pool of a language's small sources, or the pool of what is left."""
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("n_source"))
    pooled = Window.partitionBy("lang")  # one row per source
    small = F.when(F.col("n_source") < LEAST_ROWS, F.col("n_source")).otherwise(0)
    names = by_source.withColumn("n_pool", F.sum(small).over(pooled)).select(
        F.col("lang").alias("l"), F.col("source").alias("s"),
        F.when(F.col("n_source") >= LEAST_ROWS, F.concat_ws("\0", F.lit("source"), "lang", "source"))
        .when(F.col("n_pool") >= LEAST_ROWS, F.concat_ws("\0", F.lit("language"), "lang")).otherwise("rest").alias("g"))
    names = table(names, "quality-groups")
    return rows.join(names, (rows["lang"] == names["l"]) & (rows["source"] == names["s"])).drop("l", "s")


def medians(rows: DataFrame, values: list[str], step: float = 0.01) -> DataFrame:
    """Median of each column by group, to ``step``: counts by bin, then the bin that reaches half."""
    long = rows.select("g", F.posexplode(F.array(*values)).alias("i", "x")).groupBy("g", "i", F.round(F.col("x") / step).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("g", "i")
    reached = long.withColumn("upto", F.sum("n").over(run.orderBy("bin"))).withColumn("all", F.sum("n").over(run)).where("2 * upto >= all")
    found = reached.groupBy("g", "i").agg((F.min("bin") * step).alias("x"))
    return found.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(c) for i, c in enumerate(values)])


def median_start(rows: DataFrame) -> DataFrame:
    """Medians, and a diagonal scatter of squared MADs."""
    names = [f"x{i}" for i in range(DIMENSIONS)]
    centre = table(medians(rows, names), "quality-medians").select("g", *[F.col(c).alias(f"m{c[1:]}") for c in names])
    off = rows.join(centre, "g").select("g", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(DIMENSIONS)])
    spread = medians(off, names)
    df = centre.join(spread, "g")
    df = df.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(DIMENSIONS)], *[
        (F.pow(1.4826 * F.col(f"x{i}"), 2) + FLOORS[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    return factored(df, ["g", "start"])


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: estimates from the bins of distance that hold the nearest 75 % of each group."""
    near = with_distance(rows.join(model, "g")).withColumn("bin", F.floor(20 * F.log1p("d2")))
    bins = near.groupBy("g", "start", "bin").agg(*moments())
    run = Window.partitionBy("g", "start")  # some hundred bins
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(run.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inner = bins.withColumn("all", F.sum("n").over(run)).where("before < ceil(0.75 * all)")
    return estimates(inner.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in MOMENTS]), ["g", "start"], CONSISTENT_75)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Per group ``g``: reweighted MCD location and Cholesky factor. ``rows`` has g and x0 to x4."""
    whole = estimates(rows.groupBy("g").agg(*moments()).where(F.col("n") >= LEAST_ROWS), ["g"], 1.0).withColumn("start", F.lit(1))
    first = median_start(rows).join(whole.select("g"), "g", "left_semi")
    model = table(first.unionByName(whole), "quality-start")
    for _ in range(STEPS):
        after = table(concentrated(rows, model), "quality-step")
        moved = after.alias("a").join(model.alias("b"), ["g", "start"]).agg(F.max(F.abs(F.col("a.logdet") - F.col("b.logdet")))).first()[0]
        model = after
        if moved is None or moved < 1e-6:
            break
    best = model.groupBy("g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    chosen = table(model.join(best, ["g", "start"]), "quality-chosen")
    inner = with_distance(rows.join(chosen, "g")).where(F.col("d2") <= POINT_975)
    return table(estimates(inner.groupBy("g").agg(*moments()), ["g"], CONSISTENT_975), "quality-model")


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Statistics of every row with ``base_failed``, ``distance`` (squared; null if there is no estimate) and ``kept``.

    Documents that fail the base rules take no part in the estimates. Null language or source is the empty name. Fewer than
    ``LEAST_ROWS`` rows make no estimate of their own: small sources of a language are pooled, then small languages, and a pool that
    is still small rejects nothing.
    """
    stats = table(statistics(docs), "quality-statistics").withColumn("base_failed", base_failed())
    vectors = stats.where("not base_failed").select("lang", "source", *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    rows = grouped(vectors)
    rows = table(rows.select("g", *[f"x{i}" for i in range(DIMENSIONS)]), "quality-vectors")
    model = robust_estimates(rows)
    names = table(grouped(vectors).select("lang", "source", "g").distinct(), "quality-names")
    model = table(names.join(model, "g"), "quality-by-source")
    out = with_distance(stats.withColumns({f"x{i}": v for i, v in enumerate(vector())}).join(model, ["lang", "source"], "left"))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cut))
    return out.select(*stats.columns, F.when(~F.col("base_failed"), F.col("d2")).alias("distance"), kept.alias("kept"))
