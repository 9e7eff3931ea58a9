"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct five-word shingles (words split at ASCII white space, A-Z
lower-cased); a shorter text is one shingle, its whole sequence. Two permutations of the numbers
below 2**32 give all coordinates of a signature: the first scatters the shingles once, the second
is shifted circularly by one more place for every coordinate. Bands of four coordinates are
buckets; pairs in a bucket are confirmed by exact Jaccard similarity of the full sets.

Equal sets are one class from the start, so exact copies cost one row. In a bucket every class
is first compared with the least one (a star, never all pairs). Buckets whose classes are still
in several components afterwards are cut into blocks by hash, and pairs of blocks are compared by
whole signatures; only pairs in different components whose signatures agree in 55 % of their
coordinates are confirmed, until those of the two blocks are joined as far as they can be. So no
more links are made than there are members. A pair at the threshold shares no band with probability
5e-6, and agrees in fewer coordinates with 1e-7. Links are joined to components by least labels.

Defined results: a null or blank text has no shingles, links with nothing and is its own
component. Rows without an id belong to a component but give it no name: the component's id is its
least non-null id, null if there is none. Rows of one id and equal sets are equal rows. An empty
table gives no rows. Other columns are ignored by `components` and kept by `deduplicated`.
Classes go by a 64-bit hash of their set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import KEY, small, small_batches, text_key, written

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
# Least share of equal coordinates of a pair that is confirmed on full sets.
LEAST_AGREEMENT = 0.55
BLOCK = 256
CHUNK = 2048
MOST_CACHED_WORDS = 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, each computed once per task."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(first)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(second)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def shingle_sets(texts: list[bytes | None], known: _Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for text in texts:
        found = text.lower().split() if text else []
        if not found:
            yield np.empty(0, np.uint64)
            continue
        if len(known) > MOST_CACHED_WORDS:
            known.clear()
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        size = min(SHINGLE, len(h))
        n = len(h) - size + 1
        s = h[:n].copy()
        for k in range(1, size):
            s = _mixed(s * _FACTOR + h[k : k + n])
        yield np.unique(s + np.uint64(size))


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima: of the shingles, scattered once, under a permutation shifted by 0, 1, 2, ..."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    x = _permuted(x, 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        shifted = x[None, at : at + CHUNK] + shifts
        np.minimum(least, _permuted(shifted, 0x21F0AAAD, 0xD35A2D97).min(axis=1), out=least)
    return least


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words()
    for pdf in batches:
        rows = [(len(s), _node(s), signature(s).tobytes()) if len(s) else (0, None, None)
                for s in shingle_sets(pdf["text"].tolist(), known)]
        n, node, sig = zip(*rows) if rows else ((), (), ())
        yield pdf.drop(columns="text").assign(
            n_shingles=np.array(n, np.int64), node=pd.array(node, "Int64"), signature=pd.Series(sig, dtype=object, index=pdf.index))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words()
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "shingles": [s.tobytes() for s in shingle_sets(pdf["text"].tolist(), known)]})


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose full sets are similar enough."""
    for pdf in batches:
        keep = [_similar(a, b) for a, b in zip(pdf["set_a"], pdf["set_b"])]
        yield pdf.loc[np.array(keep, bool), ["a", "b"]]


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of star edges whose signatures agree in enough coordinates."""
    for pdf in batches:
        x = np.frombuffer(b"".join(pdf["sig_a"]), np.uint32).reshape(-1, COORDINATES)
        y = np.frombuffer(b"".join(pdf["sig_b"]), np.uint32).reshape(-1, COORDINATES)
        yield pdf.loc[(x == y).sum(axis=1) >= LEAST_AGREEMENT * COORDINATES, ["a", "b"]]


def _cell_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links that join components, of one cell: two blocks of a bucket, or one with itself.

    Pairs are tried by falling agreement of their signatures. A pair that earlier links of the cell
    have put in one component needs no link, so there are fewer links than components.
    """
    side, i, j = rows["side"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0]
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if not len(left) or not len(right):
        return none
    sig = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(-1, COORDINATES)
    node, label, n, sets = (rows[c].to_numpy() for c in ("node", "label", "n_shingles", "shingles"))
    # The star has compared the bucket's leader with all others.
    led = node == rows["leader"].iloc[0]
    equal = np.zeros((len(left), len(right)), np.uint8)
    shared_before = np.zeros((len(left), len(right)), bool)
    for band in range(BANDS):
        whole = np.ones((len(left), len(right)), bool)
        for k in range(band * ROWS, (band + 1) * ROWS):
            same = sig[left, k][:, None] == sig[right, k][None, :]
            equal += same
            whole &= same
        if band < rows["band"].iloc[0]:
            # A bucket of an earlier band has both.
            shared_before |= whole
    low, high = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    tried = (equal >= LEAST_AGREEMENT * COORDINATES) & (label[left][:, None] != label[right][None, :]) & ~shared_before
    tried &= (100 * low >= PERCENT * high) & ~led[left][:, None] & ~led[right][None, :]
    x, y = np.nonzero(tried)
    order = np.argsort(-equal[x, y].astype(int), kind="stable")
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    links = []
    for p, q in zip(left[x[order]], right[y[order]]):
        a, b = find(label[p]), find(label[q])
        if a != b and _similar(sets[p], sets[q]):
            root[max(a, b)] = min(a, b)
            links.append((min(node[p], node[q]), max(node[p], node[q])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64") if links else none


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells arrive one after the other; the last of a batch may go on in the next."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        cell = (pdf[["key", "i", "j"]] != pdf[["key", "i", "j"]].shift()).any(axis=1).cumsum()
        last = cell == cell.iloc[-1]
        rest = pdf[last]
        out = [_cell_links(g) for _, g in pdf[~last].groupby(cell[~last], sort=False)]
        if out:
            yield pd.concat(out)
    if rest is not None and len(rest):
        yield _cell_links(rest)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of linked nodes: the least node reachable. edges: (a, b), written."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        seen = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        least = labels.join(seen, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        # The label of the label is nearer to the end of a chain.
        further = labels.toDF("label", "further")
        after = written(least.join(further, "label", "left").select(
            "node", "before", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if after.where("label <> before").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.toDF("a", "set_a")
    right = sets.toDF("b", "set_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInPandas(_linked, "a long, b long")


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The full sets of the wanted classes, each from one of its texts."""
    wanted = small(written(nodes.join(wanted.distinct(), "node").select("node", *KEY), "wanted"), 48)
    found = texts.join(wanted, KEY).select("node", "text")
    # Copies of a text are many rows with the same key; one is enough.
    one = found.groupBy("node").agg(F.first("text").alias("text"))
    return written(one.mapInPandas(_sets, "node long, shingles binary"), "sets")


def _band_keys() -> Column:
    width = 4 * ROWS
    return F.posexplode(F.array(*(
        F.xxhash64(F.lit(b), F.substring("signature", 1 + b * width, width)) for b in range(BANDS))))


def links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes. rows: signed documents; texts: (key1, key2, text)."""
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"),
        F.min(F.struct(*KEY)).alias("k")).select("node", "signature", "n_shingles", "k.*"), "nodes")
    buckets = nodes.select("node", _band_keys().alias("band", "key"))
    several = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    members = written(buckets.join(several.drop("last"), "key"), "members")
    signatures = nodes.select("node", "signature")
    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    agreeing = written(star.join(signatures.toDF("a", "sig_a"), "a").join(signatures.toDF("b", "sig_b"), "b")
                       .select("a", "b", "sig_a", "sig_b").mapInPandas(_agreeing, "a long, b long"), "agreeing")
    ends = agreeing.select("a").union(agreeing.select("b")).toDF("node")
    first = written(_confirmed(agreeing, _sets_of(ends, nodes, texts)), "links")
    # What the stars left apart.
    labels = connected(first)
    label = F.coalesce("label", "node").alias("label")
    labelled = members.join(labels, "node", "left").select("band", "key", "leader", "node", label)
    apart = labelled.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high AND n > 2")
    cells = written(labelled.join(apart.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key"), "apart")
    sets = _sets_of(cells.select("node"), nodes, texts)
    of_node = sets.join(nodes.select("node", "signature", "n_shingles"), "node")
    cells = cells.withColumn("side", F.pmod(F.hash("node"), F.col("blocks")))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = ["key", "i", "j"]
    cells = cells.withColumns({"i": F.least("side", "o"), "j": F.greatest("side", "o")}).drop("o", "blocks").join(of_node, "node")
    found = cells.repartition(*at).sortWithinPartitions(*at).mapInPandas(_cells, "a long, b long")
    return first.union(written(found.distinct(), "more"))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(*text_key(body), body.cast("binary").alias("text"))


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, key1, key2): kept documents name their component."""
    body = F.col(text).cast("string")
    # Ids go through Python as texts, as pandas would round whole numbers next to a null.
    read = docs.select(F.col(id_column).cast("string").alias("id"), *text_key(body), body.cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        rows = written(read.mapInPandas(
            _signed, "id string, key1 long, key2 long, n_shingles long, node long, signature binary"
        ).withColumn("id", F.col("id").cast(docs.schema[id_column].dataType)), "signed")
        linked = connected(written(links(rows, _texts(docs, text)), "all"))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = classes.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = named.join(names, "label").select("node", "component_id")
    out = rows.drop("signature").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", component.alias("component_id"), *KEY).select(
        F.col("id").alias(id_column), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *KEY)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns; of repeated rows, one.

    Documents without words are kept. Where no member of a component has an id, one text of
    the component stays.
    """
    judged = written(components(docs, id_column, text), "judged")
    gone = small(written(judged.where("NOT kept").select(F.col(id_column).alias("_id"), *KEY).distinct(), "gone"), 40)
    gone = gone.toDF("_id", "_k1", "_k2")
    keyed = docs.withColumns(dict(zip(("_key1", "_key2"), text_key(F.col(text).cast("string")))))
    same = (F.col(id_column).eqNullSafe(F.col("_id"))) & (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2"))
    kept = keyed.join(gone, same, "left_anti")
    # Rows of one id (or none) and one text are few; only they are grouped.
    often = judged.where("kept AND n_shingles > 0").groupBy(F.col(id_column).alias("_id"), *KEY).agg(
        F.count("*").alias("n")).where("n > 1").drop("n")
    often = small(written(often, "often"), 40).toDF("_id", "_k1", "_k2")
    single = kept.join(often, same, "left_anti")
    first = kept.join(often, same, "left_semi").dropDuplicates([id_column, "_key1", "_key2"])
    return single.union(first).drop("_key1", "_key2")
