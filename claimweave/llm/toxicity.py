"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting takes a bounded sample of labelled documents (`MOST_LABELLED`, those with the least hash of
their id). Terms are lower-case words between white space, without the marks at their ends. Every term of an
example is indexed; terms that no example has are outside the vector space. A vector has
(1 + ln tf) * ln((1 + documents) / (1 + df)) * told for each of its terms and length 1. Document frequencies are
counted over all documents. told weighs terms by what labels tell of them: the odds of the term in toxic examples over those in
others (each counted once per document, so that long documents do not make all terms frequent), less `LEAST_Z` standard errors
of its logarithm, and at least 1; it only raises weights, no term is dropped.

The inverted index lists a term's postings by example number, split into blocks of `BLOCK`
numbers, each with its greatest weight. A document's bound for a block is the sum of
its weights times those maxima; blocks are visited by falling bound until no bound reaches the
`NEIGHBOURS`-th best cosine, so the neighbours are exact. Cosines are rounded to `PLACES` and ties
go to the lesser example id. A neighbour votes with weight 1 / (distance^2 + SOFT), distance being
1 - cosine; the prior votes with `PRIOR` weight. Calibration maps the vote to the share of toxic
labels: a least-squares increasing step function over the examples, each scored without itself,
and one share for documents without a neighbour.

Defined results: null, empty and blank texts, and texts without a term of an example, have no
neighbour and get that one share. Labels: null ones are not learnt from; of several for one id, the greatest
counts. Ids may be of any type that can be ordered and cast to text and back. Repeated rows get equal scores. Without labelled documents
every score is `NO_LABELS`. Empty tables give no rows. Other columns are ignored by `score` and kept by `kept_documents`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import small, text_key, written

MOST_LABELLED = 3_000
LEAST_Z = 2.0
NEIGHBOURS = 15
BLOCK = 1_024
# Blocks of which a term fills one part in so many are kept as rows.
FULL = 8
PLACES = 6
SOFT, PRIOR = 0.01, 1.0
NO_LABELS = 0.0
# Scores that a task remembers for further copies of a text.
MOST_CACHED = 1 << 15
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\~`+=@^…„“”«»‚‘’¡¿–—·"


def _counts(text: str | None) -> dict[str, int]:
    """How often each term occurs; different words are stripped once."""
    counts: dict[str, int] = {}
    for word, n in Counter(text.lower().split()).items() if text else ():
        term = word.strip(MARKS)
        counts[term] = counts.get(term, 0) + n
    counts.pop("", None)
    return counts


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to before its end, run after run."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Index:
    """Block-max inverted index over example vectors of length 1."""

    ids: np.ndarray
    toxic: np.ndarray
    term: dict[str, int]
    # What a term weighs before its count: idf * told.
    weight: np.ndarray
    # Postings by term and example number: the numbers and weights.
    numbers: np.ndarray
    weights: np.ndarray
    # Blocks by term: number, greatest weight, and where it starts in the postings (with an end); of each term the first block.
    blocks: np.ndarray
    most: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    # Blocks with many postings, also as rows of BLOCK weights: the row of a block, or -1.
    row: np.ndarray
    prior: float
    # Increasing steps of votes, and the share of toxic labels of each; then without neighbours.
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    alone: float = NO_LABELS
    # Of each id its text, if ids are numbers given in the order of others.
    names: list[str] = field(default_factory=list)

    @cached_property
    def rows(self) -> np.ndarray:
        """The rows, made where neighbours are looked for: they take many times the room of their postings."""
        full = self.row >= 0
        rows = np.zeros((np.count_nonzero(full), BLOCK))
        low, high = self.starts[:-1][full], self.starts[1:][full]
        posting = _runs(low, high)
        rows[np.repeat(np.arange(len(rows)), high - low), self.numbers[posting] % BLOCK] = self.weights[posting]
        return rows

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms, rising, and their weights as a vector of length 1; none if all terms are unknown or weigh nothing."""
        at = np.fromiter(map(self.term.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(at)[np.count_nonzero(at < 0) :]
        at = at[order]
        w = (1 + np.log(n[order])) * self.weight[at]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def nearest(self, at: np.ndarray, w: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the nearest examples, best first, of all examples but those of the id `without`."""
        if not len(at) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        low, high = self.first[at], self.first[at + 1]
        entry, weight = _runs(low, high), np.repeat(w, high - low)
        bound = np.bincount(self.blocks[entry], weight * self.most[entry], -(-len(self.ids) // BLOCK))
        order = np.argsort(self.blocks[entry], kind="stable")
        entry, weight = entry[order], weight[order]
        cuts = np.searchsorted(self.blocks[entry], np.arange(len(bound) + 1))
        found, scores, least = [], [], 0.0
        n = 0
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or (n >= NEIGHBOURS and round(bound[block] + 10**-PLACES, PLACES) < least):
                break
            here = slice(cuts[block], cuts[block + 1])
            start = block * BLOCK
            of, x, row = entry[here], weight[here], self.row[entry[here]]
            thin, full = row < 0, row >= 0
            s, e = self.starts[of[thin]], self.starts[of[thin] + 1]
            posting = _runs(s, e)
            dots = np.bincount(self.numbers[posting] - start, np.repeat(x[thin], e - s) * self.weights[posting], BLOCK)
            dots = dots + x[full] @ self.rows[row[full]]
            hit = np.flatnonzero(dots > 0)
            if without is not None:
                hit = hit[self.ids[hit + start] != without]
            found.append(hit + start)
            scores.append(np.round(dots[hit], PLACES))
            n += len(hit)
            if n >= NEIGHBOURS:
                every = np.concatenate(scores)
                least = np.partition(every, len(every) - NEIGHBOURS)[len(every) - NEIGHBOURS]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        number, cosine = np.concatenate(found), np.concatenate(scores)
        best = np.lexsort((self.ids[number], -cosine))[:NEIGHBOURS]
        return number[best], cosine[best]

    def vote(self, number: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (np.square(1 - cosine) + SOFT)
        return float(((weight * self.toxic[number]).sum() + PRIOR * self.prior) / (weight.sum() + PRIOR))

    def share(self, vote: float) -> float:
        if not len(self.votes):
            return vote
        return float(np.interp(vote, self.votes, self.shares))


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares increasing fit: mean x and mean y of each pooled step."""
    steps: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for a, b in zip(x[order], y[order]):
        if steps and steps[-1][1] / steps[-1][2] == a:
            steps[-1][0] += b
            steps[-1][1] += a
            steps[-1][2] += 1
        else:
            steps.append([b, a, 1.0])
        while len(steps) > 1 and steps[-2][0] / steps[-2][2] >= steps[-1][0] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    return np.array([s[1] / s[2] for s in steps]), np.array([s[0] / s[2] for s in steps])


def build(examples: Iterable[tuple[int, int, dict[str, int]]], vocabulary: list[str], frequencies: dict[str, int],
          documents: int, told: dict[str, float] | None = None) -> Index:
    """Index from (id, toxic, term counts) of labelled documents, with and without terms; not calibrated."""
    idf = np.array([np.log((1 + documents) / (1 + frequencies.get(t, 0))) for t in vocabulary])
    weight = np.maximum(idf, 0) * np.array([(told or {}).get(t, 1.0) for t in vocabulary])
    nothing = np.zeros(0, np.int64)
    index = Index(nothing, np.zeros(0), {t: i for i, t in enumerate(vocabulary)}, weight, nothing, np.zeros(0), nothing,
                  np.zeros(0), np.zeros(1, np.int64), np.zeros(len(vocabulary) + 1, np.int64), nothing, 0.0)
    every = [(i, y, *index.vector(counts)) for i, y, counts in examples]
    index.prior = sum(v[1] for v in every) / len(every) if every else NO_LABELS
    empty = [v for v in every if not len(v[2])]
    index.alone = (sum(v[1] for v in empty) + PRIOR * index.prior) / (len(empty) + PRIOR) if every else NO_LABELS
    # Examples with the same heaviest term share blocks, which makes other blocks' maxima of it small.
    vectors = sorted((v for v in every if len(v[2])), key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))
    if not vectors:
        return index
    index.ids, index.toxic = np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], float)
    terms = np.concatenate([v[2] for v in vectors])
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    index.numbers = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])[order]
    index.weights = np.concatenate([v[3] for v in vectors])[order]
    block = index.numbers // BLOCK
    new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])
    index.blocks, index.most = block[new], np.maximum.reduceat(index.weights, new)
    index.starts = np.r_[new, len(terms)]
    index.first = np.searchsorted(terms[new], np.arange(len(vocabulary) + 1))
    full = np.diff(index.starts) >= BLOCK // FULL
    index.row = np.where(full, np.cumsum(full) - 1, -1)
    return index


def _calibrated(index: Index, rows: DataFrame) -> Index:
    """The index with the steps of its votes; rows: (id, y, terms, n) of the labelled documents."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = cloudpickle.loads(shared.value)
        for pdf in batches:
            out = []
            for i, y, terms, n in zip(pdf["id"], pdf["y"], pdf["terms"], pdf["n"]):
                at, w = index.vector(dict(zip(terms, n)))
                if len(at):
                    near = index.nearest(at, w, without=i)
                    out.append((index.vote(*near) if len(near[0]) else index.prior, y))
            yield pd.DataFrame(out, columns=["vote", "y"])

    found = rows.mapInPandas(votes, "vote double, y int").collect()
    shared.destroy()
    if found:
        order = sorted((r["vote"], r["y"]) for r in found)
        index.votes, index.shares = _isotonic(*(np.array(x, float) for x in zip(*order)))
    return index


def sampled_labels(labels: DataFrame, id_column: str, label: str, learn: Column | None) -> DataFrame:
    """(id, y) of at most MOST_LABELLED labelled ids."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    known = known.where(learn) if learn is not None else known
    one = known.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
        learn: Column | None = None) -> Index:
    """learn: which labels may be learnt from, a condition on the labels' columns."""
    # Ids are numbered in their order; at most MOST_LABELLED rows.
    numbered = sampled_labels(labels, id_column, label, learn).withColumn("number", F.row_number().over(Window.orderBy("id")).cast("long"))
    sample = small(written(numbered, "labelled"), 256)
    names = [r["name"] for r in sample.select("number", F.col("id").cast("string").alias("name")).orderBy("number").collect()]
    body = F.col(text).cast("string")
    found = docs.select(F.col(id_column).alias("id"), body.alias("text")).join(sample, "id").select(
        F.col("number").alias("id"), "y", "text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [_counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "terms": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    rows = written(found.mapInPandas(extract, "id long, y int, terms array<string>, n array<int>"), "examples")
    size = F.size("terms")
    totals = rows.agg(F.sum(F.when(F.col("y") == 1, size)).alias("toxic"), F.sum(F.when(F.col("y") == 0, size)).alias("clean")).first()
    a, b = F.sum("y") + 0.5, F.sum(1 - F.col("y")) + 0.5
    odds = F.log(a / ((totals["toxic"] or 0) + 1 - a)) - F.log(b / ((totals["clean"] or 0) + 1 - b))
    sure = F.greatest(odds - LEAST_Z * F.sqrt(1 / a + 1 / b), F.lit(0.0))
    told = rows.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.exp(sure).alias("told")).orderBy("term").toArrow()
    vocabulary = told["term"].to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set(shared.value)
        seen: Counter[str] = Counter()
        n = 0
        for pdf in batches:
            n += len(pdf)
            for t in pdf["text"]:
                seen.update(known.intersection({w.strip(MARKS) for w in set(t.lower().split())}) if t else ())
        # The count of documents comes with the empty term.
        yield pd.DataFrame({"term": ["", *seen], "df": [n, *seen.values()]})

    df = docs.select(body.alias("text")).mapInPandas(frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    shared.destroy()
    df = dict(zip(df["term"].to_pylist(), df["df"].to_pylist()))
    examples = ((r["id"], r["y"], dict(zip(r["terms"], r["n"]))) for r in rows.toLocalIterator())
    index = build(examples, vocabulary, df, int(df.get("", 0)), dict(zip(vocabulary, told["told"].to_pylist())))
    index.names = names
    del told, df
    return _calibrated(index, rows)


def score(docs: DataFrame, index: Index, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, score, predicted, neighbours): key is the text's hash; neighbours the evidence, best first."""
    # Pickled here, as executors have no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))
    body = F.col(text).cast("string")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = cloudpickle.loads(shared.value)
        cache: dict[tuple[int, int], tuple[float, list[dict]]] = {}

        def result(key: tuple[int, int], text: str | None) -> tuple[float, list[dict]]:
            if key not in cache:
                if len(cache) >= MOST_CACHED:
                    cache.clear()
                number, cosine = index.nearest(*index.vector(_counts(text)))
                cache[key] = (index.share(index.vote(number, cosine)), [
                    {"id": index.names[index.ids[n] - 1], "cosine": float(c), "toxic": int(index.toxic[n])} for n, c in zip(number, cosine)]
                ) if len(number) else (index.alone, [])
            return cache[key]

        for pdf in batches:
            results = [result((a, b), t) for a, b, t in zip(pdf["key"], pdf["key2"], pdf["text"])]
            yield pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "score": [r[0] for r in results],
                                "neighbours": [r[1] for r in results]})

    # Ids go through Python as texts, as pandas would round whole numbers next to a null.
    key, key2 = text_key(body)
    read = docs.select(F.col(id_column).cast("string").alias("id"), key.alias("key"), key2, body.alias("text"))
    out = read.mapInPandas(judge, "id string, key long, score double, neighbours array<struct<id: string, cosine: double, toxic: int>>")
    id_type = docs.schema[id_column].dataType
    near = f"array<struct<id: {id_type.simpleString()}, cosine: double, toxic: int>>"
    return out.select(F.col("id").cast(id_type).alias(id_column), "key", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      F.col("neighbours").cast(near).alias("neighbours"))


def kept_documents(docs: DataFrame, index: Index, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    toxic = score(docs, index, id_column, text).where("predicted = 1").select(F.col("key").alias("_key")).distinct()
    toxic = small(written(toxic, "toxic"), 16)
    return docs.join(toxic, F.xxhash64(F.col(text).cast("string")) == F.col("_key"), "left_anti")
