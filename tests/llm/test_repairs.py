"""Conversation repair and centroid clustering against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from claimweave.llm import centroids, conversations

PATTERN = re.compile("(s?(ua)+)?")


def all_repairs(rows):
    """Least (cost, audit) by trying every edit of every row, with up to two inserts before each and at the end."""
    n = len(rows)
    best = None
    for inserts in product(range(3), repeat=n + 1):
        for edits in product("KRD", repeat=n):
            shapes = [""]
            cost, audit = 3 * sum(inserts), ""
            for (initial, gone, cut), edit, before in zip([*rows, ("", True, False)], [*edits, ""], inserts):
                audit += "I" * before + edit
                shapes = [s + "*" * before for s in shapes]
                if edit == "D":
                    cost += 4
                elif edit:
                    if gone:
                        break
                    cost += 3 * (edit == "R") + 3 * cut
                    shapes = [s + ("*" if edit == "R" else initial or "?") for s in shapes]
            else:
                shape = shapes[0]
                # A star is a user or an assistant, whichever the place needs.
                fits = any(
                    PATTERN.fullmatch(text) for size in [len(shape)]
                    for text in (("ua" * size)[:size], ("s" + "ua" * size)[:size] if shape[:1] == "s" else "")
                    if len(text) == size and all(a in ("*", b) for a, b in zip(shape, text)))
                if fits and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_least_audit_equals_all_edits():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randrange(4))]
        assert conversations.cheapest(rows) == all_repairs(rows), rows


def test_segments_chain_to_the_whole():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(30)]
        ways = [(0, ""), None, None, None]
        for at in range(0, 30, 7):
            part = rows[at : at + 7]
            ways = conversations.chained(ways, [[conversations.cheapest(part, s, [t]) for t in range(4)] for s in range(4)])
        assert min(w for w in (ways[0], ways[3]) if w) == conversations.cheapest(rows)


def brute(rows):
    """rows: (conv, turn, role, text) -> {conv: result} by a table over all rows and states."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            plan = zlib.crc32(key.encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(plan, text)
            mine += [(turn is not None, turn or 0, "user" if plan == 4 else role, text)] * {0: 0, 3: 2}.get(plan, 1)
        mine.sort()
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in mine:
            full = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
            seen.add((role, text))
        ways = {0: (0, "", [])}

        def inserted(ways):
            for s, t, role in ((0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")):
                if s in ways:
                    c, a, lines = ways[s]
                    ways[t] = min(ways.get(t, (9e9,)), (c + 3, a + "I", [*lines, f"{role}:"]))
            return ways

        ways = inserted(ways)
        for (_, _, role, text), fault in zip(mine, faults):
            after = {}
            for s, (c, a, lines) in ways.items():
                options = [(s, c + 4, "D", [])]
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    t, name = (3, "assistant") if s == 2 else (2, "user")
                    options.append((t, c + 3 + extra, "R", [f"{name}:{text}"]))
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                    if kept:
                        options.append((kept, c + extra, "K", [f"{role}:{text}"]))
                for t, cost, edit, more in options:
                    after[t] = min(after.get(t, (9e9,)), (cost, a + edit, lines + more))
            ways = inserted(after)
        cost, audit, lines = min(ways[g] for g in (0, 3) if g in ways)
        initials = [role[:1] for _, _, role, _ in mine]
        out[conv] = (
            gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def compared(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"key": F.lit("clash"), "copies": F.lit(7), "audit": F.lit("x")}).repartition(5)
    got = conversations.repair(conversations.damaged(frame), frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("segment", [1024, 5])
def test_repairs_equal_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rng = random.Random(9)
    says = ["Yes.", "No!", "why", "What?\n", "", " \t", None, "ä.. ", "Yes."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(says)))
    rows += rows[:10]  # rows that repeat
    rows += [(900, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(3000)]  # a conversation of many tasks
    rows += [(901, 5, "user", "same.")] * 300
    rows += [(902, 1, "user", "long. " * 100_000), (902, 2, "assistant", "ok.")]
    got = compared(spark, rows)
    assert len(got[900][6]) > 2500 and len(got) == 64


def test_a_conversation_without_rows_after_damage(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = compared(spark, [(7, gone, "user", "Yes."), (8, None, "user", "Yes.")])
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repairs_of_rows_as_they_are_and_of_none(spark):
    frame = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], "c string, t int, r string, x string")
    names = {"conv": "c", "turn": "t", "role": "r", "text": "x"}
    got = conversations.repair(conversations.as_found(frame, **names), frame, "c").collect()
    assert [(r["cost"], r["audit"]) for r in got] == [(0, "KK")]
    assert got[0]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    none = frame.limit(0)
    assert conversations.repair(conversations.as_found(none, **names), none, "c").collect() == []


# ---------------------------------------------------------------- centroids


@pytest.mark.parametrize("k, dimensions, span", [(1, 1, 5), (2, 3, 3), (7, 2, 100), (40, 64, 60), (30, 4, 2)])
def test_threshold_search_finds_the_nearest(k, dimensions, span):
    rng = np.random.default_rng(k)
    c, x = rng.integers(-span, span, (k, dimensions)), rng.integers(-span, span, (700, dimensions))
    cluster, distance, met = centroids.SortedLists(c).nearest(x)
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    # argmin takes the first of equals.
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert (met <= k).all() and (dimensions > 2 or k < 7 or met.mean() < k)


def brute_clusters(rows, k, rounds):
    """rows: (id, whole vector)."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in order]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in rows]
        for i in set(of):
            mine = [v for (_, v), j in zip(rows, of) if i == j]
            c[i] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [nearest(v) for _, v in rows]
    each = {i: sum(d for d, j in found if j == i) for _, i in found}
    return sorted(
        (r[0], i, d, each[i], sum(each.values()), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest())
        for r, (d, i) in zip(rows, found))


def test_clusters_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    rows = [(r["vec_id"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in docs.collect()]
    want = brute_clusters(rows, 12, 3)
    frame = docs.withColumns({"id": F.lit("clash"), "vector": F.lit(1), "cluster": F.lit("c")}).repartition(4)
    got = centroids.cluster(frame, k=12, rounds=3).drop("n_met")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_unusable_and_extreme_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.501, 0.25]), (3, [1e300, -1e300]), (4, [1.0]), (5, None), (6, [nan, 0.0]),
            (7, [None, 0.0]), (8, [inf, 0.0]), (9, []), (10, [0.1, 0.2, 0.3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [(1, [128, -128]), (1, [128, -128]), (2, [128, 64]), (3, [1 << 27, -(1 << 27)])]
    for k in (1, 2, 9):
        got = centroids.cluster(frame, k=k, rounds=2, dimensions=2).drop("n_met")
        assert sorted(tuple(r) for r in got.collect()) == brute_clusters(kept, k, 2)
    assert centroids.cluster(frame.where("vec_id > 3"), dimensions=2).collect() == []
    with pytest.raises(ValueError):
        centroids.cluster(frame, k=0)
