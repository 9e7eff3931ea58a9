"""Conversations that do not alternate, repaired by the cheapest edits: bidirectional Dijkstra over the edit lattice.

Rows of a conversation lie in the order of (turn with nulls first, role, text). Each row has at most one fault, the
first of: blank (no character but ASCII white space), duplicate (role and text occur before it in the
conversation), truncated (its last character that is no white space is not `.`, `!` or `?`). Edits are Keep (0), Rerole to
user or assistant (3), Delete (4; the only one for blank and duplicate rows) and Insert of an empty
user or assistant row anywhere (3); a truncated row that stays adds 3. The roles' initials must come to `(s?(ua)+)?`.

A lattice node is (rows consumed, state of that pattern). One heap grows from the start and one from the
goals; they have met once the sum of their tops strictly exceeds the best cost, by when all crossings
of that cost are finished. Each settled node keeps the least audit (edits' initials) among its cheapest
ways, and the least concatenation over all crossings is the answer. No audit of equal cost is the beginning of another,
as only Insert consumes no row and it is not free, so least parts make the least whole.

Equal rows (same turn, role and text) are counted before anything is shuffled further. Rows are range partitioned
by conversation and order, so a conversation of any length is spread over tasks. A conversation that
lies whole within a task, in at most SEGMENT rows, is repaired there. Of others, every segment gives the least
(cost, audit) from each state to each state, found by the same search, and these 4 x 4 tables
are chained. What one conversation brings to one task is its audit and these tables, about 16 letters a row. The
repaired text of a split conversation is hashed row after row in one task, as SHA-256 is sequential; its rows stream
through and are never held together.

Defined results: null roles and texts are one space, so such a text is blank. A null turn comes first and does
not count for gaps; a null id is a conversation of its own. An empty table gives no rows, conversations without rows
zeros and empty texts. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import small, text_key, written

SEGMENT = 1024
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WORD_PATTERN = r"[^\x20\x09-\x0D]"
ENDED_PATTERN = r"[.!?][\x20\x09-\x0D]*\z"
# States of the pattern (s?(ua)+)?: start, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GOALS = (START, AFTER_A)
# A user or an assistant row comes next, by state.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = ("su", "ua", "au")

Row = tuple[str, bool, bool]  # initial of the role, must go, is truncated
Way = tuple[int, str]  # cost, audit


def _onward(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(cost, rows consumed, state, edit) of the edges from a node."""
    yield INSERT, i, NEXT[state], "I"
    if i < len(rows):
        initial, gone, truncated = rows[i]
        yield DELETE, i + 1, state, "D"
        if not gone:
            extra = TRUNCATED if truncated else 0
            yield REROLE + extra, i + 1, NEXT[state], "R"
            kept = KEPT.get((state, initial))
            if kept is not None:
                yield extra, i + 1, kept, "K"


def _back(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(cost, rows consumed, state, edit) of the edges into a node, by the nodes they come from."""
    before = [s for s in range(4) if NEXT[s] == state]
    for s in before:
        yield INSERT, i, s, "I"
    if i:
        initial, gone, truncated = rows[i - 1]
        yield DELETE, i - 1, state, "D"
        if not gone:
            extra = TRUNCATED if truncated else 0
            for s in before:
                yield REROLE + extra, i - 1, s, "R"
            for s in range(4):
                if KEPT.get((s, initial)) == state:
                    yield extra, i - 1, s, "K"


class _Front:
    """One of the two searches. Free edges consume a row, so nodes of one cost are settled in the order of rows."""

    def __init__(self, rows: list[Row], nodes: Iterable[tuple[int, int]], forward: bool):
        self.rows, self.forward, self.sign = rows, forward, 1 if forward else -1
        self.ways: dict[tuple[int, int], Way] = {n: (0, "") for n in nodes}
        self.settled: set[tuple[int, int]] = set()
        self.heap = [(0, self.sign * i, s) for i, s in self.ways]
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        """Settle the next node; top() has cleared the heap of settled ones."""
        _, i, s = heapq.heappop(self.heap)
        node = (self.sign * i, s)
        self.settled.add(node)
        cost, audit = self.ways[node]
        for extra, j, t, edit in (_onward if self.forward else _back)(self.rows, *node):
            way = (cost + extra, audit + edit if self.forward else edit + audit)
            known = self.ways.get((j, t))
            if known is None or way < known:
                self.ways[j, t] = way
                if known is None or way[0] < known[0]:
                    heapq.heappush(self.heap, (way[0], self.sign * j, t))
        return node


def cheapest(rows: list[Row], start: int = START, goals: Iterable[int] = GOALS) -> Way | None:
    """Least (cost, audit) from a state before the rows to one of the states after them."""
    forth = _Front(rows, [(0, start)], True)
    back = _Front(rows, [(len(rows), g) for g in goals], False)
    best = float("inf")
    while (a := forth.top()) + (b := back.top()) <= best and min(a, b) < float("inf"):
        front, other = (forth, back) if a <= b else (back, forth)
        node = front.settle()
        if node in other.ways:
            best = min(best, front.ways[node][0] + other.ways[node][0])
    least: Way | None = None
    for node in forth.settled:
        cost, audit = forth.ways[node]
        for extra, j, t, edit in [(0, *node, ""), *_onward(rows, *node)]:
            if (j, t) in back.ways:
                rest, suffix = back.ways[j, t]
                if cost + extra + rest == best:
                    way = (cost + extra + rest, audit + edit + suffix)
                    least = way if least is None or way < least else least
    return least


def chained(ways: list[Way | None], table: list[list[Way | None]]) -> list[Way | None]:
    """Ways to each state, continued by a segment's table of ways."""
    out: list[Way | None] = [None] * 4
    for s, way in enumerate(ways):
        for t in range(4):
            step = table[s][t]
            if way is not None and step is not None:
                new = (way[0] + step[0], way[1] + step[1])
                out[t] = new if out[t] is None or new < out[t] else out[t]
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


class Repaired:
    """The repaired rows of a conversation, from its audit and its rows in order, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.any = hashlib.sha256(), False

    def _give(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._give(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self._give(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._give(ROLES[self.state], text)

    def sha256(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


_SOLVED = "key string, closed boolean, part int, seq int, illegal long, first string, last string, cost long, audit string, sha256 string, costs array<long>, audits array<string>"


def _whole(key: str, rows: list[Row], texts: list[tuple[str, str]]) -> dict:
    cost, audit = cheapest(rows)
    text = Repaired(audit)
    for role, body in texts:
        text.row(role, body)
    return {"key": key, "closed": True, "illegal": _illegal([r[0] for r in rows]), "cost": cost, "audit": audit, "sha256": text.sha256()}


def _piece(key: str, rows: list[Row], part: int, seq: int) -> dict:
    ways = [cheapest(rows, s, [t]) for s in range(4) for t in range(4)]
    return {
        "key": key, "closed": False, "part": part, "seq": seq, "illegal": _illegal([r[0] for r in rows]),
        "first": rows[0][0], "last": rows[-1][0], "costs": [w[0] if w else None for w in ways], "audits": [w[1] if w else None for w in ways]}


def _frame(found: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in _SOLVED.split(", ")]
    frame = pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype=object) for n in names})
    return frame.astype({"closed": bool, "part": "Int32", "seq": "Int32", "illegal": "Int64", "cost": "Int64"})


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole conversations repaired, and tables of ways of the segments of others; rows come in order.

    The first and the last conversation of a task may go on in its neighbours, so they count as split.
    """
    part, seq, is_open = TaskContext.get().partitionId(), 0, True
    key: str | None = None
    rows: list[Row] = []
    texts: list[tuple[str, str]] = []
    found: list[dict] = []

    def close(last: bool) -> None:
        nonlocal is_open, seq
        if key is not None and rows:
            if is_open or last:
                found.append(_piece(key, rows, part, seq))
                seq += 1
            else:
                found.append(_whole(key, rows, texts))
        rows.clear()
        texts.clear()

    for pdf in batches:
        for k, role, text, copies, blank, seen, truncated in pdf.itertuples(index=False):
            if k != key:
                close(False)
                is_open, key = key is None, k
            for copy in range(copies):
                if len(rows) == SEGMENT:
                    is_open = True
                    close(False)
                rows.append((role[:1], bool(blank or seen or copy), bool(truncated)))
                if not is_open:
                    texts.append((role, text))
        if found:
            yield _frame(found)
            found.clear()
    close(True)
    if found:
        yield _frame(found)


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """One row for a split conversation, from its segments in order."""
    pieces = pieces.sort_values(["part", "seq"])
    ways: list[Way | None] = [(0, ""), None, None, None]
    illegal, last = 0, None
    for p in pieces.itertuples(index=False):
        steps = [(int(c), a) if a is not None else None for c, a in zip(p.costs, p.audits)]
        ways = chained(ways, [steps[4 * s : 4 * s + 4] for s in range(4)])
        illegal += int(p.illegal) + (last is not None and last + p.first not in LEGAL)
        last = p.last
    cost, audit = min(w for w in (ways[g] for g in GOALS) if w is not None)
    return pd.DataFrame({"key": [pieces["key"].iloc[0]], "illegal": [illegal], "cost": [cost], "audit": [audit]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of split conversations: each comes as its audit, then its rows in order."""
    key, text, found = None, None, []
    for pdf in batches:
        for k, audit, role, body, copies in pdf[["key", "audit", "role", "text", "copies"]].itertuples(index=False):
            if k != key:
                if key is not None:
                    found.append((key, text.sha256()))
                key, text = k, Repaired(audit)
                continue
            for _ in range(int(copies)):
                text.row(role, body)
        if found:
            yield pd.DataFrame(found, columns=["key", "sha256"])
            found = []
    if key is not None:
        yield pd.DataFrame([(key, text.sha256())], columns=["key", "sha256"])


def _key(conv: str) -> Column:
    """Conversations go through Python by a text, which tells a null id from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, copies) with faults planted by a checksum of id and turn, modulo 20.

    0 drops a row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it a user's.
    """
    none = F.lit(" ")
    of = lambda c: F.coalesce(F.col(c).cast("string"), none)
    plan = F.crc32(F.concat(of(conv), F.lit(":"), of(turn)).cast("binary")) % 20
    rows = rows.select(_key(conv).alias("key"), F.col(turn).alias("turn"), of(role).alias("role"), of(text).alias("text"), plan.alias("plan"))
    return rows.where("plan <> 0").select(
        "key", "turn",
        F.when(F.col("plan") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("plan") == 1, F.lit("")).when(F.col("plan") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("plan") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


def as_found(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, copies) of rows as they are, for `repaired`."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(_key(conv).alias("key"), F.col(turn).alias("turn"), of(role).alias("role"), of(text).alias("text"),
                       F.lit(1).cast("long").alias("copies"))


def repaired(rows: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation with rows."""
    place = ["key", "turn", "role", "text"]
    rows = rows.groupBy(*place).agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("blank", ~F.col("text").rlike(WORD_PATTERN)).withColumn("cut", ~F.col("text").rlike(ENDED_PATTERN))
    # Rows that occur at several turns; elsewhere the first of equal rows is the one that counts.
    said = rows.where("NOT blank").groupBy("key", "role", *text_key(F.col("text"))).agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    said = small(written(said.select("key", "role", "key1", "key2", F.col("first.turn").alias("first_turn")), "said"), 96)
    said = said.withColumnRenamed("role", "said_role").withColumn("known", F.lit(True))
    rows = rows.withColumns(dict(zip(("k1", "k2"), text_key(F.col("text"))))).withColumnRenamed("key", "conv")
    rows = rows.join(said, (F.col("conv") == F.col("key")) & (F.col("role") == F.col("said_role"))
                     & (F.col("k1") == F.col("key1")) & (F.col("k2") == F.col("key2")), "left")
    seen = F.col("known").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    rows = written(rows.select(
        F.col("conv").alias("key"), "turn", "role", "text", "copies", "blank", (~F.col("blank") & seen).alias("seen"),
        (~F.col("blank") & F.col("cut")).alias("cut")), "turns")
    counts = rows.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).cast("long").alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("seen").cast("long"))).cast("long").alias("duplicate"),
        F.count_if(F.col("cut") & ~F.col("seen")).cast("long").alias("truncated"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    solved = written(ordered.select("key", "role", "text", "copies", "blank", "seen", "cut").mapInPandas(_solved, _SOLVED), "solved")
    # Of split conversations: at most two a task and those of more than SEGMENT rows.
    split = written(solved.where("NOT closed").groupBy("key").applyInPandas(
        _joined, "key string, illegal long, cost long, audit string"), "split")
    named = small(split.select("key"), 64)
    lines = rows.join(named, "key", "left_semi").select("key", F.lit(1).alias("kind"), "turn", "role", "text", "copies")
    both = lines.unionByName(split.select("key", F.lit(0).alias("kind"), "audit"), allowMissingColumns=True)
    order = [F.col("key"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digests = both.repartition("key").sortWithinPartitions(*order).mapInPandas(_hashed, "key string, sha256 string")
    columns = ["key", "illegal", "cost", "audit", "sha256"]
    repairs = solved.where("closed").select(*columns).unionByName(split.join(digests, "key").select(*columns))
    return counts.join(repairs, "key").withColumnRenamed("sha256", "repaired_sha256")


def repair(rows: DataFrame, originals: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for every id of `originals`, with zeros and empty texts where `rows` (see `damaged`, `as_found`) has none."""
    found = repaired(rows)
    ids = originals.select(conv).distinct().withColumn("_key", _key(conv))
    joined = ids.join(found, F.col("_key") == F.col("key"), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.select(
        conv, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
