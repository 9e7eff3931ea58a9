"""Quality rules: base rules, then robust multivariate outliers per language and source.

Location and scatter of transformed text statistics are minimum-covariance-determinant
estimates. They start twice, at medians with median deviations and at mean and covariance of all. Every
concentration step takes mean and covariance of the three quarters of a group that lie nearest, until no
determinant falls by more than `SETTLED`, `MOST_STEPS` at most; the start with the least determinant is
taken. The squares of `FLOORS` are added to the variances, before determinants are compared as well, so
small differences never count as unusual. A document is rejected if its squared Mahalanobis distance exceeds `CUT`.

A language and source with fewer than `LEAST_GROUP` documents is judged by the estimate of its source in all languages,
if that has fewer by that of its language in all sources, and else by that of all documents, few as they may be.

All work is aggregation by group of a narrow table: histograms with fixed bins (merged map side)
give medians and the distance of the nearest three quarters, sums of products give covariances.
Estimates are broadcast if their counted rows prove them small, so a source of a third of all rows is no special
case; only with some hundred thousand groups are rows shuffled by group.

Defined results: a null text is empty, has no words and fails the base rules. Null languages and
sources are groups of their own. Equal rows get equal verdicts. Other
columns of the input, of whatever name, are ignored by `judge` and kept by `kept_documents`.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import let, small, words, written

SYMBOLS = "#*$%&|<>"
# Bits for the place of a word in its text.
PLACE_BITS = 24
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
NEAREST = 0.75
MOST_STEPS = 12
# A determinant that falls by less than this share has settled.
SETTLED = 1e-3
LEAST_GROUP = 64
# The covariance of the nearest three quarters of a 4-dimensional normal, times this, is its own.
CONSISTENCY = 1.48
# A normal vector of four exceeds this squared distance once in ten million times.
CUT = 38.0
# Least standard deviation of each statistic: smaller differences do not count as unusual.
FLOORS = {"word_length": 0.08, "symbols": 0.06, "dup_lines": 0.20, "repeats": 0.15}
FEATURES = list(FLOORS)
# Bins of a histogram: this many to a floor, and to a doubling of a distance.
BINS, DISTANCE_BINS = 16, 32
PLACES = 9
N = len(FEATURES)


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more in the text."""
    low = (1 << PLACE_BITS) - 1
    place = lambda x: x.bitwiseAND(low).cast("int")

    def alike(x: Column, y: Column) -> Column:
        same = [F.get(w, place(x) + k) == F.get(w, place(y) + k) for k in range(3)]
        return (F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0) & same[0] & same[1] & same[2]

    # Forty bits of a window's hash, then its place: equal windows are neighbours once sorted.
    starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    placed = F.sort_array(F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
                                      .bitwiseAND(~low).bitwiseOR(i)))
    found = let(placed, lambda s: let(
        F.filter(F.transform(s, lambda x, k: F.when(alike(x, F.get(s, k - 1)), k)), lambda k: k.isNotNull()),
        lambda ks: F.concat(F.transform(ks, lambda k: place(F.get(s, k))),
                            F.transform(ks, lambda k: place(F.get(s, k - 1))))))
    ordered = F.sort_array(F.array_distinct(found))
    return let(ordered, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0), lambda a, b: a + b))


def statistics(text: Column) -> Column:
    """One struct of counts of a whole text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, whole)
    return F.struct(
        let(words(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        (F.length(whole) - F.length(plain)).cast("long").alias("n_symbols"))


def _measured(docs: DataFrame, id_column: str, text: str, group: list[str]) -> DataFrame:
    """Narrow table of ids, groups, counts and, for documents that pass the base rules, features."""
    s = docs.select(F.col(id_column).alias("id"), F.col(group[0]).cast("string").alias("g1"),
                    F.col(group[1]).cast("string").alias("g2"), statistics(F.col(text)).alias("s"))
    s = s.select("id", "g1", "g2", "s.w.*", "s.l.*", "s.n_symbols")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    share = lambda part, of: F.sqrt(F.col(part) / F.col(of))
    features = {
        "word_length": F.log(F.col("word_chars") / F.col("n_words")), "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}
    return s.withColumn("base_failed", failed).withColumns(
        {f: F.when(~F.col("base_failed"), F.round(x, PLACES)) for f, x in features.items()})


def _at_rank(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """The bin that holds the row at a share of each group; counts has (by, bin, n)."""
    w = Window.partitionBy(*by)
    running = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*by, "bin", running.alias("upto"), F.sum("n").over(w).alias("all"))
    return ranked.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(F.min("bin").alias("bin"))


def _medians(rows: DataFrame, value: dict[str, Column]) -> DataFrame:
    """Per group an array of the medians of the features, to a sixteenth of their floor."""
    step = {f: FLOORS[f] / BINS for f in FEATURES}
    bins = F.explode(F.array(*(
        F.struct(F.lit(i).alias("f"), F.floor(value[f] / step[f]).alias("bin")) for i, f in enumerate(FEATURES))))
    counts = rows.select("group", bins.alias("b")).groupBy("group", "b.f", "b.bin").agg(F.count("*").alias("n"))
    at = _at_rank(counts, ["group", "f"], 0.5)
    steps = F.array(*(F.lit(step[f]) for f in FEATURES))
    middle = (F.col("bin") + 0.5) * F.get(steps, F.col("f"))
    return at.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("f", middle.alias("v"))))["v"].alias("median"))


def inverse(matrix: Column, n: int = N) -> Column:
    """Inverse of a positive definite matrix, an array of n * n by rows: every row is swept."""

    def sweep(a: Column, k: Column) -> Column:
        d = F.get(a, k * (n + 1))

        def cell(v: Column, at: Column) -> Column:
            i, j = F.floor(at / n).cast("int"), at % n
            return (F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), v / d)
                    .otherwise(v - F.get(a, i * n + k) * F.get(a, k * n + j) / d))

        return F.transform(a, cell)

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, sweep)
    return F.transform(swept, lambda v: -v)


def _determinant(matrix: Column, n: int = N) -> Column:
    """Determinant of an array of n * n by rows."""
    def signed(p: tuple[int, ...]) -> Column:
        sign = prod(-1 if p[i] > p[j] else 1 for j in range(n) for i in range(j))
        return prod((F.get(matrix, F.lit(i * n + j)) for i, j in enumerate(p)), start=F.lit(float(sign)))

    return reduce(lambda x, y: x + y, map(signed, permutations(range(n))))


def _distance() -> Column:
    """Squared Mahalanobis distance of the features from the joined `mean` and `inverse`."""
    off = [F.col(f) - F.get("mean", F.lit(i)) for i, f in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * off[i] * off[j] * F.get("inverse", F.lit(i * N + j))
             for i in range(N) for j in range(i, N)]
    return sum(terms[1:], terms[0])


def _moments(rows: DataFrame) -> DataFrame:
    """Mean, inverse covariance and its determinant per group and start, spread to a normal's and not below the floors."""
    pairs = [(i, j) for i in range(N) for j in range(i, N)]
    sums = rows.groupBy("group", "start").agg(
        F.count("*").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs))

    def covariance(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        c = (F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") * CONSISTENCY
        return F.round(c + FLOORS[FEATURES[i]] ** 2 if i == j else c, PLACES)

    mean = F.array(*(F.round(F.col(f"s{i}") / F.col("n"), PLACES) for i in range(N)))
    of = sums.select("group", "start", mean.alias("mean"), F.array(*(covariance(i, j) for i in range(N) for j in range(N))).alias("c"))
    return of.select("group", "start", "mean", inverse(F.col("c")).alias("inverse"), _determinant(F.col("c")).alias("determinant"))


def _nearest(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The three quarters of each group that lie nearest, for each start, to a thirty-second of a doubling."""
    far = rows.join(estimate.select("group", "start", "mean", "inverse"), "group").withColumn(
        "bin", F.ceil(F.log2(F.greatest(_distance(), F.lit(1e-6))) * DISTANCE_BINS)).drop("mean", "inverse")
    counts = far.groupBy("group", "start", "bin").agg(F.count("*").alias("n"))
    most = written(_at_rank(counts, ["group", "start"], NEAREST).withColumnRenamed("bin", "most"), "most")
    return far.join(small(most, 100), ["group", "start"]).where("bin <= most")


def _starts(rows: DataFrame) -> DataFrame:
    """(group, start, mean, inverse): medians with median deviations, and mean and covariance of all."""
    medians = small(written(_medians(rows, {f: F.col(f) for f in FEATURES}), "medians"), 200)
    off = rows.join(medians, "group")
    deviations = _medians(off, {f: F.abs(F.col(f) - F.get("median", F.lit(i))) for i, f in enumerate(FEATURES)})
    # 1.4826 median deviations are a standard deviation of a normal.
    scale = [F.greatest(1.4826 * F.get("deviation", F.lit(i)), F.lit(FLOORS[f])) for i, f in enumerate(FEATURES)]
    inverse_of = F.array(*(1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i in range(N) for j in range(N)))
    robust = medians.join(deviations.withColumnRenamed("median", "deviation"), "group").select(
        "group", F.lit(0).alias("start"), F.col("median").alias("mean"), inverse_of.alias("inverse"))
    return robust.union(_moments(rows.withColumn("start", F.lit(1))).drop("determinant"))


def estimates(rows: DataFrame) -> DataFrame:
    """(group, mean, inverse) by concentration steps; rows hold a group and the features."""
    estimate, before = written(_starts(rows), "starts"), None
    for step in range(MOST_STEPS):
        estimate = written(_moments(_nearest(rows, small(estimate, 400))), f"step{step}")
        if before is not None:
            earlier = before.select("group", "start", F.col("determinant").alias("earlier"))
            falls = F.col("determinant") * (1 + SETTLED) < F.col("earlier")
            if estimate.join(earlier, ["group", "start"]).where(falls).isEmpty():
                break
        before = estimate
    least = estimate.groupBy("group").agg(F.min(F.struct("determinant", "start", "mean", "inverse")).alias("e"))
    return least.select("group", "e.mean", "e.inverse")


def _groups(passing: DataFrame) -> DataFrame:
    """(g1, g2, levels, group): the groups whose estimates the documents of g1, g2 may enter, and the one that judges them."""
    sizes = passing.groupBy("g1", "g2").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n1", F.sum("n").over(Window.partitionBy("g1"))).withColumn("n2", F.sum("n").over(Window.partitionBy("g2")))
    own, source, language = (F.concat(F.lit(level), F.to_json(F.struct(*names))) for level, names in (
        ("both", ("g1", "g2")), ("second", ("g2",)), ("first", ("g1",))))
    chosen = F.when(F.col("n") >= LEAST_GROUP, own).when(F.col("n2") >= LEAST_GROUP, source).when(
        F.col("n1") >= LEAST_GROUP, language).otherwise("all")
    return sizes.select("g1", "g2", F.array(own, source, language, F.lit("all")).alias("levels"), chosen.alias("group"))


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
          group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept)."""
    measured = written(_measured(docs, id_column, text, list(group)), "measured")
    passing = measured.where("NOT base_failed")
    groups = written(_groups(passing), "groups")
    place = groups.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), "levels", "group")
    same = F.col("g1").eqNullSafe(F.col("p1")) & F.col("g2").eqNullSafe(F.col("p2"))
    # Only groups that judge documents are estimated, from all documents of theirs.
    enters = place.select("p1", "p2", F.explode("levels").alias("group")).join(place.select("group").distinct(), "group", "left_semi")
    rows = written(passing.join(small(written(enters, "enters"), 200), same).select("group", *FEATURES), "rows")
    estimate = estimates(rows)
    known = small(written(place.join(estimate, "group").drop("group", "levels"), "estimates"), 400)
    judged = measured.join(known, same & ~F.col("base_failed"), "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return judged.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def kept_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                   group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The documents that are kept, with all their columns.

    A verdict depends on the text and the group only, so documents that share an id, or have
    none, are told apart by them: the verdicts are joined back by id, text hash and group.
    """
    keyed = docs.select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"),
                                 *(F.col(g).alias(f"g{i}") for i, g in enumerate(group))).alias("row"),
                        F.col(text).alias("text"), F.col(group[0]).alias("lang"), F.col(group[1]).alias("source"))
    rejected = judge(keyed, "row", "text", ("lang", "source")).where("NOT kept").select("row.*").distinct()
    same = [F.col(id_column).eqNullSafe(F.col("_id")), F.xxhash64(F.col(text)) == F.col("_h"),
            *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group))]
    condition = same[0] & same[1] & same[2] & same[3]
    renamed = small(written(rejected.toDF("_id", "_h", "_g0", "_g1"), "rejected"), 100)
    return docs.join(renamed, condition, "left_anti")
