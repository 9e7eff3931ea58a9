"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A score is sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part costs time
linear in the features, as the sum of squares identity gives it as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2); that is how the machine of MLlib, used here, computes it.

Features of a whole text: its words (lower case, without digits) hashed to `BUCKETS` frequencies of
length 1; as structure shares of symbols, capitals, digits, marks, distinct words and distinct lines,
and lengths of text, words and lines, all within 0 and 1; as metadata given numeric columns, as logarithms.

Fitting takes a bounded sample: the `MOST_LABELLED` labelled documents with the least hash of their
id. Scoring is one projection without a shuffle.

Defined results: null and empty texts have no words and statistics of 0, and get the score of that.
Null metadata is 0. Labels: null ones are not learnt from; of several for one id the greatest counts. Without labels
of both classes every score is the share of label 1, or `NO_LABELS` without any label. Repeated rows get equal scores. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import GAP_PATTERN, let, small, written

BUCKETS = 1 << 12
FACTORS = 4
MOST_LABELLED = 10_000
ITERATIONS = 60
STEP = 0.1
REGULARISATION = 1e-5
SEED = 11
NO_LABELS = 0.5
# Numbers of a text's structure.
STATISTICS = 10
LONGEST = 20.0


def _structure(text: Column) -> Column:
    """Statistics of a text, each within 0 and 1."""
    whole = F.coalesce(text, F.lit(""))
    length = F.greatest(F.length(whole), F.lit(1))
    share = lambda pattern: (F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))) / length

    def of_words(w: Column) -> list[Column]:
        n = F.greatest(F.size(w), F.lit(1))
        return [F.size(F.array_distinct(w)) / n, F.least(length / n / 50, F.lit(1.0)), F.log1p(F.size(w)) / LONGEST]

    def of_lines(lines: Column) -> list[Column]:
        n = F.size(lines)
        return [F.size(F.array_distinct(lines)) / n, F.log1p(n) / LONGEST, F.least(length / n / 2000, F.lit(1.0))]

    words = let(F.split(whole, GAP_PATTERN), lambda w: F.array(*of_words(w)))
    lines = let(F.split(whole, "\n"), lambda x: F.array(*of_lines(x)))
    shares = F.array(share(r"[#*$%&|<>]+"), share(r"[A-Z]+"), share(r"[0-9]+"), share(r"[!?]+"))
    return F.concat(F.transform(shares, lambda x: F.sqrt(x)), words, lines)


def features(docs: DataFrame, text: str, metadata: list[str]) -> DataFrame:
    """docs (id, text, metadata, ...) with a column `features`; keeps no text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.lower(whole), r"[^\p{L}]+"), "")
    numbers = [F.coalesce(F.log1p(F.abs(F.col(m).cast("double"))), F.lit(0.0)) / LONGEST for m in metadata]
    statistics = F.concat(_structure(whole), F.array(*numbers)) if numbers else _structure(whole)
    rest = [c for c in docs.columns if c != text]
    read = docs.select(*rest, words.alias("_words"), array_to_vector(statistics).alias("_statistics"))
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="_words", outputCol="_counts").transform(read).drop("_words")
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(hashed).drop("_counts")
    # Without the size the assembler would look for a first row.
    size = VectorSizeHint(inputCol="_statistics", size=STATISTICS + len(metadata), handleInvalid="optimistic")
    unit = size.transform(unit)
    whole = VectorAssembler(inputCols=["_statistics", "_unit"], outputCol="features").transform(unit)
    return whole.drop("_statistics", "_unit")


@dataclass
class Model:
    """A fitted machine, or the constant score that replaces it."""

    machine: FMClassificationModel | None
    constant: float


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
        metadata: list[str] | None = None, learn: Column | None = None) -> Model:
    """learn: which labels may be learnt from, a condition on the labels' columns."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    known = known.where(learn) if learn is not None else known
    one = known.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = small(written(one.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED), "labelled"), 16)
    names = [f"m{i}" for i in range(len(metadata or []))]
    read = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), *(
        F.col(m).alias(n) for m, n in zip(metadata or [], names))).join(sample, "id")
    rows = written(features(read, "text", names).select("features", F.col("label").cast("double").alias("label")), "sample")
    counts = rows.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    if not counts["n"] or counts["good"] in (0, counts["n"]):
        return Model(None, counts["good"] / counts["n"] if counts["n"] else NO_LABELS)
    machine = FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=REGULARISATION, seed=SEED,
                           initStd=0.05, tol=1e-7)
    # Rows are few and bounded; a few partitions make each step one short job.
    return Model(machine.fit(rows.coalesce(4)), 0.0)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text",
          metadata: list[str] | None = None) -> DataFrame:
    """(id, score, predicted)."""
    names = [f"m{i}" for i in range(len(metadata or []))]
    read = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), *(
        F.col(m).alias(n) for m, n in zip(metadata or [], names)))
    if model.machine is None:
        scored = read.select("id", F.lit(float(model.constant)).alias("score"))
    else:
        scored = model.machine.transform(features(read, "text", names)).select(
            "id", vector_to_array("probability")[1].alias("score"))
    return scored.select(F.col("id").alias(id_column), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
