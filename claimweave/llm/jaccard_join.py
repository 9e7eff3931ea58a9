"""Exact self-join of documents on n-gram Jaccard similarity, by set-relation skipping.

A document is the set of its distinct word n-grams (words split at ASCII white space, A-Z lower-cased), a shorter
one the set of its whole sequence. Documents of equal sets are one class. The n-grams have one global order, rare ones
first, and every class is listed under the n-grams of its prefix: a pair at the threshold has its first common
n-gram in both prefixes. Lists name the position of the n-gram in each set's order.

* **Skipping by position.** Members of a list are blocks of like size. A pair whose first common n-gram this is has
  at most n - o others before it, o being the overlap it needs; blocks whose least positions exceed that, or whose
  sizes differ too much, are never brought together, and in a block no pair whose own positions exceed it is compared.
* **Answers from answers.** Lists of the same members have the same answers and are compared once. Two blocks are compared by an inverted index of the one. The overlaps of a set with
  all members are counted afresh only if the set before it is not like it; otherwise they follow from the
  earlier set's overlaps and the few n-grams that one has and the other lacks. All are exact.

Each class is first compared with the least leader of its lists, a list's leader being its least member; only lists whose members are still in several
components are compared block by block, and a comparison gives no more links than it joins
components. Before texts are brought to a comparison, counts of n-grams in buckets rule out members that differ too much from
all others; their difference is never less than that of the counts. So groups of thousands of near copies make no quadratic output, while no link between components is lost.

Only n-grams with a hash in the lowest SHARE of the hash range are counted and listed. That is exact too: of
a set with more than D = n - ceil(t n) such n-grams, a partner has at least one, and at most D of them come before
the first common one. Sets with fewer are listed a second time, under all their n-grams.

Defined results: a null or blank text has no n-grams and is its own component. Rows without an id belong to a component but give it
no name: the component's id is its least non-null id, null if there is none. Rows that repeat are equal rows. An empty
table gives no rows. Other columns are ignored, whatever their names. Sets and n-grams go by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweave.llm.common import KEY, small, small_batches, text_key, written
from claimweave.llm.minhash import connected

WORDS = 4
PERCENT = 85
# Share of the hash range whose n-grams are listed; above 1 - PERCENT / 100, so that prefixes fit into it.
SHARE = 0.4
# Most members, and about most n-grams, of a block that is compared by sketches, and of one that is compared by full sets.
SCREEN, SCREEN_GRAMS = 1024, 1 << 22
BLOCK, BLOCK_GRAMS = 512, 1 << 18
# Sketches are compared in so many rows and buckets at a time, up to this count in a bucket.
ROWS, BUCKETS, LEVELS = 256, 256, 8
NEVER = np.iinfo(np.int32).max
# Most classes that one row of a leader is compared with.
GROUP = 512
MOST_CACHED_WORDS = 1 << 18
MOST_SEEN = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, each computed once per task."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_sets(texts: list[bytes | None], words: int, known: _Words) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of every text."""
    for text in texts:
        found = text.lower().split() if text else []
        if not found:
            yield np.empty(0, np.uint64)
            continue
        if len(known) > MOST_CACHED_WORDS:
            known.clear()
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        size = min(words, len(h))
        n = len(h) - size + 1
        s = h[:n].copy()
        for k in range(1, size):
            s = s * _FACTOR + h[k : k + n]
            s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(29)
        yield np.unique(s + np.uint64(size))


def _node(ngrams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ngrams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _listed(ngrams: np.ndarray) -> np.ndarray:
    return ngrams[: np.searchsorted(ngrams, np.uint64(int(SHARE * 2**64)))]


def sketch(ngrams: np.ndarray) -> bytes:
    """How many n-grams fall into each of about n / 2 buckets, at most 255."""
    bits = max(4, int(len(ngrams) - 1).bit_length() - 1)
    counts = np.bincount((ngrams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def least_differences(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each pair of sets a number that their symmetric difference reaches at least, from their sketches."""
    width = max(min(map(len, left + right)), max(map(len, left + right)) // 64)
    if min(map(len, left + right)) < width:  # sizes too different for a link
        return np.full((len(left), len(right)), np.iinfo(np.int32).max, np.int32)

    def folded(sketches: list[bytes]) -> np.ndarray:
        # Buckets are leading bits, so neighbours add up to the bucket of one bit less.
        return np.stack([np.frombuffer(s, np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int16) for s in sketches])

    # A difference is both sums less twice the sum of the lesser counts. Of these a product of matrices counts
    # the first LEVELS of each bucket; of what is above them, no more than the lesser sum can be common.
    x, y = folded(left), folded(right)
    common = np.minimum(*(np.maximum(c - LEVELS, 0).sum(axis=1, dtype=np.float32)[at] for c, at in ((x, np.s_[:, None]), (y, np.s_[None, :]))))
    levels = np.arange(1, min(LEVELS, max(x.max(), y.max())) + 1)[:, None]
    for at in range(0, width, BUCKETS):
        a, b = ((c[:, None, at : at + BUCKETS] >= levels).reshape(len(c), -1).astype(np.float32) for c in (x, y))
        common = common + a @ b.T
    sums = x.sum(axis=1, dtype=np.int32)[:, None] + y.sum(axis=1, dtype=np.int32)[None, :]
    return np.maximum(sums - 2 * common.astype(np.int32), 0)


def _spare(n: int, percent: int) -> int:
    """Most n-grams of a set that a partner may lack."""
    return n - -(-percent * n // 100)


def _signing(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            rows = [(len(s), len(_listed(s)), _node(s), sketch(s)) if len(s) else (0, 0, None, None)
                    for s in ngram_sets(pdf["text"].tolist(), words, known)]
            n, listed, node, counts = zip(*rows) if rows else ((), (), (), ())
            yield pdf.drop(columns="text").assign(
                n=np.array(n, np.int64), n_listed=np.array(listed, np.int64), node=pd.array(node, "Int64"),
                sketch=pd.Series(counts, pdf.index, dtype=object))

    return signed


def _listing(words: int, percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(node, grams): n-grams to be listed. The last bit tells the listing among all n-grams from the usual one."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = _Words(), set()
        for pdf in batches:
            rows = []
            for s in ngram_sets(pdf["text"].tolist(), words, known):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.add(node)
                some = _listed(s)
                rows.append((node, (some & ~_ODD).view(np.int64)))
                if len(some) <= _spare(len(s), percent):
                    rows.append((node, (s | _ODD).view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "grams"]).astype({"node": "int64"})

    return listed


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies of a text are many rows; a task sends one of them to each group."""
    seen: set[tuple[int, int, int]] = set()
    for pdf in batches:
        keep = []
        for row in pdf[["cell", "side", "node"]].itertuples(index=False, name=None):
            keep.append(row not in seen)
            if len(seen) > MOST_SEEN:
                seen.clear()
            seen.add(row)
        yield pdf[np.array(keep, bool)]


def _with_sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Texts become sets; of a class that several tasks sent, one row stays."""
    known, last = _Words(), None
    for pdf in batches:
        keep = []
        for row in pdf[["cell", "side", "node"]].itertuples(index=False, name=None):
            keep.append(row != last)
            last = row
        pdf = pdf[np.array(keep, bool)]
        yield pdf.drop(columns="text").assign(grams=pd.Series(list(ngram_sets(pdf["text"].tolist(), words, known)), pdf.index, dtype=object))


def _overlap_needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes at the threshold."""
    return F.ceil((n + m) * percent / (100.0 + percent) - 1e-9)


def _verifying(words: int, percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of leaders (side 0) with members (side 1); each cell comes as its leader, then its members."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, leader, x = None, 0, np.empty(0, np.uint64)
        for pdf in _with_sets(batches, words):
            found = []
            for c, side, node, y in pdf[["cell", "side", "node", "grams"]].itertuples(index=False, name=None):
                if side == 0:
                    cell, leader, x = c, node, y
                elif c == cell:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((leader, node))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return linked


class Overlaps:
    """Overlaps of sets with all sets of a block, each derived from the one before where those are alike."""

    def __init__(self, sets: list[np.ndarray]):
        grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.size = grams[order], owner[order], len(sets)
        self.last: tuple[np.ndarray, np.ndarray] | None = None
        self.derived = 0

    def _counted(self, grams: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        found = np.concatenate([self.owner[a:b] for a, b in zip(low, high) if a < b] or [np.empty(0, np.int64)])
        return np.bincount(found, minlength=self.size)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if self.last is not None:
            before, overlaps = self.last
            new = np.setdiff1d(grams, before, assume_unique=True)
            gone = np.setdiff1d(before, grams, assume_unique=True)
            if 2 * (len(new) + len(gone)) < len(grams):
                self.derived += 1
                self.last = grams, overlaps + self._counted(new) - self._counted(gone)
                return self.last[1]
        self.last = grams, self._counted(grams)
        return self.last[1]


def cell_links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join components, between the two blocks of a cell (sides 0 and 1) or inside one (side 2)."""
    rows = rows.assign(n=rows["grams"].map(len))
    left, right = rows[rows["side"] != 1].sort_values(["label", "n"]), rows[rows["side"] != 0]
    index = Overlaps(list(right["grams"]))
    sizes, labels = np.array([len(s) for s in right["grams"]]), right["label"].tolist()
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    links = []
    for node, label, n, grams in left[["node", "label", "n", "grams"]].itertuples(index=False):
        both = index.of(grams)
        for j in np.flatnonzero(100 * both >= percent * (n + sizes - both)):
            a, b = find(label), find(labels[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                other = int(right["node"].iat[j])
                links.append((min(node, other), max(node, other)))
    return links


def possible_links(cell: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some of the left members at a time: (members, least differences from the right ones, which pairs may be links).

    A pair of two components may be a link if their first common n-gram can be the list's, by its places, and the
    sketches do not rule it out.
    """
    n, pos, label, counts = cell["n"], cell["pos"], cell["label"], cell["sketch"]
    width = np.array([len(c) for c in counts])
    for at in range(0, len(left), ROWS):
        x = left[at : at + ROWS]
        a, b = n[x][:, None], n[right][None, :]
        # Exact in whole numbers: the overlap that a pair of these sizes needs.
        needed = -(-percent * (a + b) // (100 + percent))
        may = (pos[x][:, None] <= a - needed) & (pos[right][None, :] <= b - needed) & (label[x][:, None] != label[right][None, :])
        least = np.full(may.shape, NEVER, np.int32)
        some, others = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        for v in np.unique(width[x[some]]):
            for w in np.unique(width[right[others]]):
                # Sets whose sketches differ more in width differ too much in size.
                if max(v, w) <= 2 * min(v, w):
                    i, j = some[width[x[some]] == v], others[width[right[others]] == w]
                    least[np.ix_(i, j)] = least_differences(counts[x[i]].tolist(), counts[right[j]].tolist())
        yield x, least, may & (least <= a + b - 2 * needed)


def sides(cell: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the left and the right members: sides 0 and 1; members of side 2 are compared with one another."""
    return np.flatnonzero(cell["side"] != 1), np.flatnonzero(cell["side"] != 0)


def nearest(cell: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, partner, bound) of members that may have a link: the member that they seem to differ from least."""
    left, right = sides(cell)
    bound = np.full(len(cell["node"]), NEVER, np.int32)
    partner = np.zeros(len(bound), np.int64)
    for x, least, may in possible_links(cell, left, right, percent):
        least = np.where(may, least, NEVER)
        for mine, other, of in ((x, right, least), (right, x, least.T)):
            best = of.argmin(axis=1)
            found = of[np.arange(len(mine)), best]
            nearer = found < bound[mine]
            bound[mine[nearer]], partner[mine[nearer]] = found[nearer], cell["node"][other[best[nearer]]]
    at = np.flatnonzero(bound < NEVER)
    return at, partner[at], bound[at]


def smaller_cells(cell: dict[str, np.ndarray], percent: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, places, sides): members with a possible link, in cells whose full sets may be held at once."""
    left, right = sides(cell)
    # Blocks of members: at most so many, and so many n-grams unless one set has more.
    in_block = []
    for of in (left, right):
        n = np.cumsum(cell["n"][of]) // BLOCK_GRAMS
        _, first, group = np.unique(n, return_index=True, return_inverse=True)
        within = (np.arange(len(of)) - first[group]) // block
        in_block.append(np.unique(np.stack([group, within]), axis=1, return_inverse=True)[1].ravel())
    found: dict[tuple[int, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}
    itself = bool((cell["side"] == 2).all())
    at = 0
    for x, _, may in possible_links(cell, left, right, percent):
        mine = in_block[0][at : at + len(x)]
        at += len(x)
        for i in np.unique(mine):
            of_i = may[mine == i]
            for j in np.unique(in_block[1][of_i.any(axis=0)]):
                if not itself or i <= j:
                    part = of_i & (in_block[1] == j)
                    one, other = found.setdefault((int(i), int(j)), ([], []))
                    one.append(x[mine == i][part.any(axis=1)])
                    other.append(right[part.any(axis=0)])
    for (i, j), (one, other) in found.items():
        a, b = np.unique(np.concatenate(one)), np.unique(np.concatenate(other))
        # A hash of whole numbers is the same in every process.
        name = hash((int(cell["cell"][0]), i, j))
        if itself and i == j:
            both = np.union1d(a, b)
            yield name, both, np.full(len(both), 2)
        else:
            yield name, np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])


def _by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The cells of each batch; cells come one after the other, and the last of a batch may go on in the next."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = pdf["cell"] == pdf["cell"].iat[-1]
        rest = pdf[last]
        yield [g for _, g in pdf[~last].groupby("cell", sort=False)]
    if rest is not None and len(rest):
        yield [rest]


def _columns_by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict[str, np.ndarray]]]:
    """The cells of each batch as arrays; the last cell of a batch may go on in the next."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        cell = pdf["cell"].to_numpy()
        ends = [*np.flatnonzero(cell[1:] != cell[:-1]) + 1]
        rest = pdf.iloc[ends[-1] if ends else 0 :]
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        yield [{c: v[a:b] for c, v in columns.items()} for a, b in zip([0, *ends], ends)]
    if rest is not None and len(rest):
        yield [{c: rest[c].to_numpy() for c in rest.columns}]


def _frame(parts: list[dict[str, np.ndarray]], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts] or [np.empty(0, np.int64)]) for c in columns})


def _nearest(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _columns_by_cell(batches):
            parts = []
            for c in cells:
                at, partner, bound = nearest(c, percent)
                parts.append({k: c[k][at] for k in ("cell", "side", "node", "pos")} | {"partner": partner, "bound": bound})
            yield _frame(parts, ["cell", "side", "node", "pos", "partner", "bound"])

    return screen


def _screening(percent: int, block: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _columns_by_cell(batches):
            yield _frame([
                {"cell": np.full(len(at), name), "side": side, "node": c["node"][at], "label": c["label"][at]}
                for c in cells for name, at, side in smaller_cells(c, percent, block)], ["cell", "side", "node", "label"])

    return screen


def _celling(words: int, percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _by_cell(_with_sets(batches, words)):
            yield pd.DataFrame([x for c in cells for x in cell_links(c, percent)], columns=["a", "b"], dtype="int64")

    return linked


def _texts(docs: DataFrame, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(*text_key(body), body.cast("binary").alias("text"))


def _gathered(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that each cell needs, cell by cell. wanted: (cell, side, node, label)."""
    keyed = small(written(wanted.join(classes.select("node", *KEY), "node"), "wanted"), 64)
    found = texts.join(keyed, KEY).select("cell", "side", "node", "label", "text")
    once = found.mapInPandas(_once, found.schema)
    return once.repartition("cell").sortWithinPartitions("cell", "side", "node")


def prefixes(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(gram, often, node, n, pos) of the n-grams in prefixes that another class has too. pos: place in the set's order."""
    grams = texts.select("text").mapInPandas(_listing(words, percent), "node long, grams array<long>")
    # The one shuffle of n-grams. An n-gram has at most one row a class and task, a small part of all rows.
    of_gram = Window.partitionBy("gram")
    placed = grams.select("node", F.explode("grams").alias("gram")).withColumns({
        "often": F.count("*").over(of_gram), "low": F.min("node").over(of_gram), "high": F.max("node").over(of_gram)})
    shared = placed.where("low < high").groupBy("gram", "node").agg(F.max("often").alias("often"))
    shared = shared.withColumn("all", F.col("gram").bitwiseAND(1))
    of_set = Window.partitionBy("node", "all")
    ranked = shared.withColumns({
        "at": F.row_number().over(of_set.orderBy("often", "gram")), "n_shared": F.count("*").over(of_set)})
    sizes = classes.select("node", "n", "n_listed")
    size = F.when(F.col("all") == 1, F.col("n")).otherwise(F.col("n_listed"))
    # What no other class has comes first in the order.
    placed = ranked.join(sizes, "node").withColumn("pos", size - F.col("n_shared") + F.col("at") - 1)
    return written(placed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9)).select("gram", "often", "node", "n", "pos"), "prefixes")


def _compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among the pairs (node, a): each class with one other, in groups of a bounded size around it."""
    pairs = written(pairs, "pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    cell, none = F.xxhash64("a", "part").alias("cell"), F.lit(0).cast("long").alias("label")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    to_each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = pairs.join(sizes, "a").withColumn("part", part).select(cell, F.lit(1).alias("side"), "node", none)
    leaders = sizes.withColumn("part", to_each).select(cell, F.lit(0).alias("side"), F.col("a").alias("node"), none)
    return written(_gathered(members.union(leaders), classes, texts).mapInPandas(_verifying(words, percent), "a long, b long"), "links")


def links(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that join them to the components of all links."""
    lists = prefixes(texts, classes, words, percent)
    leaders = lists.groupBy("gram").agg(F.count("*").alias("size"), F.min(F.struct("node", "n", "pos")).alias("leader"))
    members = written(lists.join(leaders.where("size > 1").drop("size"), "gram"), "members")
    need = _overlap_needed(F.col("n"), F.col("leader.n"), percent)
    star = members.where(F.col("node") != F.col("leader.node")).where(
        (F.col("pos") <= F.col("n") - need) & (F.col("leader.pos") <= F.col("leader.n") - need))
    first = _compared(star.groupBy("node").agg(F.min("leader.node").alias("a")), classes, texts, words, percent)
    # What the least members leave apart.
    label = F.coalesce("label", "node").alias("label")
    labelled = members.drop("leader").join(connected(first), "node", "left").select("gram", "often", "node", "n", "pos", label)
    hashed = F.xxhash64("node").cast("decimal(38,0)")
    several = labelled.groupBy("gram").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("often").alias("often"), F.count("*").alias("size"),
        F.sum(hashed).alias("one"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("other")).where("low < high")
    # Lists of the same members have the same answers; positions are least in the one that is first in the order.
    several = several.groupBy("size", "one", "other").agg(F.min(F.struct("often", "gram")).alias("first")).select(
        "first.gram", F.col("size").alias("total"))
    # A list of one block is one cell; larger ones are cut by size first.
    of_size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    apart = written(labelled.join(several, "gram").drop("often").withColumn(
        "size", F.when(F.col("total") > SCREEN, of_size).otherwise(0)).drop("total"), "apart")
    if apart.isEmpty():
        return first
    at = ["gram", "size"]
    parts = F.greatest(F.count("*") / SCREEN, F.sum("n") / SCREEN_GRAMS)
    blocks = written(apart.groupBy(*at).agg(
        F.ceil(parts).cast("int").alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("pos").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")), "blocks")
    names = blocks.columns
    x, y = (blocks.toDF(*(c if c == "gram" else f"{s}_{c}" for c in names)) for s in "xy")
    close = lambda p, q: F.col(f"{p}_first") * (100 + percent) <= F.col(f"{p}_most") * 100 - F.col(f"{q}_least") * percent
    together = x.join(y, "gram").where(
        (F.col("x_size") <= F.col("y_size")) & close("x", "y") & close("y", "x")
        & (F.least("x_low", "y_low") < F.greatest("x_high", "y_high")))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cells = together.withColumn("x_part", numbers("x_parts")).withColumn("y_part", numbers("y_parts")).where(
        (F.col("x_size") < F.col("y_size")) | (F.col("x_part") <= F.col("y_part")))
    ends = [[f"{s}_{c}" for c in ("size", "part")] for s in "xy"]
    itself = (F.col("x_size") == F.col("y_size")) & (F.col("x_part") == F.col("y_part"))
    cells = written(cells.select("gram", *ends[0], *ends[1], itself.alias("itself"), F.xxhash64("gram", *ends[0], *ends[1]).alias("cell")), "cells")
    parted = apart.join(blocks.select(*at, "parts"), at).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def members_of(end: list[str], cells: DataFrame, side: Column) -> DataFrame:
        named = cells.select("gram", *(F.col(c).alias(c[2:]) for c in end), "cell", side.alias("side"))
        return parted.join(named, [*at, "part"]).select("cell", "side", "node", "pos")

    rows = members_of(ends[0], cells, F.when(F.col("itself"), 2).otherwise(0)).union(
        members_of(ends[1], cells.where("NOT itself"), F.lit(1)))

    def screened_by(found: DataFrame, rows: DataFrame, screening: Callable, schema: str) -> DataFrame:
        known = classes.select("node", "n", "sketch").join(connected(found), "node", "left")
        known = known.select("node", "n", "sketch", label)
        of_cell = rows.join(known, "node").repartition("cell").sortWithinPartitions("cell")
        return written(of_cell.select("cell", "side", "node", "label", "n", "pos", "sketch").mapInPandas(screening, schema), "near")

    # Each class apart is first compared with the one that it seems to differ from least, which joins most components.
    could = screened_by(first, rows, _nearest(percent), "cell long, side int, node long, pos long, partner long, bound long")
    closest = could.groupBy("node").agg(F.min(F.struct("bound", "partner")).alias("to"))
    first = written(first.union(_compared(closest.select("node", F.col("to.partner").alias("a")), classes, texts, words, percent)), "first")
    near = screened_by(first, could.select("cell", "side", "node", "pos"), _screening(percent, BLOCK), "cell long, side int, node long, label long")
    found = _gathered(near, classes, texts).mapInPandas(_celling(words, percent), "a long, b long")
    return first.union(written(found.distinct(), "more"))


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): documents whose sets have 100 * intersection >= percent * union are linked."""
    if not 0 < 100 - percent < 100 * SHARE:
        raise ValueError(f"percent must lie above {100 - 100 * SHARE:g} and below 100")
    texts = _texts(docs, text)
    body = F.col(text).cast("string")
    # Ids go through Python as texts, as pandas would round whole numbers next to a null.
    read = docs.select(F.col(id_column).cast("string").alias("id"), *text_key(body), body.cast("binary").alias("text"))
    signed = read.mapInPandas(_signing(words), "id string, key1 long, key2 long, n long, n_listed long, node long, sketch binary")
    with small_batches(docs.sparkSession):
        rows = written(signed.withColumn("id", F.col("id").cast(docs.schema[id_column].dataType)), "signed")
    classes = written(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("n_listed").alias("n_listed"), F.first("sketch").alias("sketch"),
        F.min(F.struct(*KEY)).alias("k"), F.min("id").alias("least")).select("node", "n", "n_listed", "sketch", "k.*", "least"), "classes")
    with small_batches(docs.sparkSession):
        linked = connected(written(links(texts, classes, words, percent), "all"))
    labelled = written(linked.join(classes.select("node", "least"), "node"), "labelled")
    names = small(written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "names"), 32)
    of_node = small(written(labelled.join(names, "label").select("node", "component_id"), "components"), 32)
    # Classes without a link are named by their own least id.
    own = small(written(classes.join(linked, "node", "left_anti").select("node", F.col("least").alias("own")), "own"), 32)
    out = rows.join(of_node, "node", "left").join(own, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "own"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))
