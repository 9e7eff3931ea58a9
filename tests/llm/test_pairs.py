"""MinHash links, decontamination and licence scans against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from claimweave.llm import common, decontaminate, jaccard_join, licenses, minhash

WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(text, size=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def expected_components(rows, size=5, percent=75):
    """rows: (id, text) with ids; every pair is compared."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def near_copies(rng):
    base = [text_of(rng, 120) for _ in range(6)]
    rows = []
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w))
    # Texts that share a passage but are not similar, short ones, ties of case.
    passage = text_of(rng, 60)
    rows += [f"{text_of(rng, 70)} {passage} {text_of(rng, 70)}" for _ in range(60)]
    rows += ["", " \n\t ", "One two", "one TWO", "one  two\n", "x", "five words are just enough"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = near_copies(random.Random(5))
    rows += [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(docs).collect()}
    assert got == expected_components(rows)


def test_blocks_of_a_bucket_find_links_that_stars_miss(spark, monkeypatch):
    """Chains: neighbours are similar, the ends are not; a bucket's star alone cannot join them."""
    rng = random.Random(8)
    w = text_of(rng, 200).split()
    rows = [(i, " ".join(w[4 * i : 4 * i + 140])) for i in range(14)]
    monkeypatch.setattr(minhash, "BLOCK", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(docs).collect()}
    assert got == {i: c for i, (_, c) in expected_components(rows).items()}
    assert set(got.values()) == {0}


def test_cells_join_each_component_once(monkeypatch):
    import pandas as pd

    rng = random.Random(2)
    base = text_of(rng, 150).split()
    known = minhash._Words()
    texts = [" ".join(base[:k] + ["new"] + base[k + 1 :]).encode() for k in range(10, 40)]
    sets = list(minhash.shingle_sets(texts, known))
    rows = pd.DataFrame({
        "key": 1, "i": 0, "j": 0, "side": 0, "band": 0, "leader": -1, "node": range(len(sets)), "label": range(len(sets)),
        "n_shingles": [len(s) for s in sets], "signature": [minhash.signature(s).tobytes() for s in sets],
        "shingles": [s.tobytes() for s in sets]})
    assert len(minhash._cell_links(rows)) == len(sets) - 1


def test_signature_estimates_similarity():
    rng = random.Random(1)
    w = [text_of(rng, 1)[:] + str(i) for i in range(2000)]
    a, b = (" ".join(w[s : s + 1500]).encode() for s in (0, 150))
    x, y = minhash.shingle_sets([a, b], minhash._Words())
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - exact) < 0.15


def test_deduplication_keeps_one_row_of_each_group(spark):
    long = text_of(random.Random(3), 30_000)
    rows = [(1, "a b c d e f", "x", 5), (1, "a b c d e f", "x", 5), (2, "A b c d e f", "y", 6), (3, None, "z", 7), (4, "", "z", 8),
            (5, long, "l", 9), (6, long, "l", 9), (None, "n o p q r s", "q", 1), (None, "n o p q r s", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, key1 int")
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[3], rows[4], rows[5], rows[7]], key=str)


def test_minhash_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.components(docs).collect() == [] and minhash.deduplicated(docs).collect() == []


def test_long_texts_come_in_small_batches(spark, monkeypatch):
    """An executor holds a few texts at a time, however many its task reads."""
    signed, most = minhash._signed, 2 * common.BATCH_BYTES

    def checked(batches):
        def small():
            for pdf in batches:
                assert pdf["text"].map(len).sum() <= most
                yield pdf

        return signed(small())

    monkeypatch.setattr(minhash, "_signed", checked)
    docs = spark.range(0, 250, 1, 1).select(F.col("id").alias("doc_id"), F.expr("concat(id % 50, repeat(' long text', 8000))").alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    # Sets of three shingles, two of them in all texts: similarity 1/2.
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(docs).collect()}
    assert got == {i: (3, i % 50) for i in range(250)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


# ---------------------------------------------------------------- n-gram join


@pytest.mark.parametrize("block", [128, 5])
def test_joined_components_equal_brute_force(spark, monkeypatch, block):
    """Near copies, chains whose ends are apart, boilerplate without links, and short texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "GROUP", block)
    rng = random.Random(12)
    texts = [t for _, t in near_copies(rng)]
    w = text_of(rng, 300).split()
    texts += [" ".join(w[3 * i : 3 * i + 150]) for i in range(25)]
    for _ in range(120):
        w = text_of(rng, rng.randrange(3, 30)).split()
        texts += [" ".join(w), " ".join([*w[:-1], "new"])]
    rows = list(enumerate(texts))
    rows += [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"node": F.lit("clash"), "n": F.lit(1), "gram": F.lit(2), "label": F.lit(3), "key1": F.lit(4)}).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert got == expected_components(rows, 4, 85)


def edited_copies(rng, n, share):
    """Texts of like sizes that share much of one base, each with places of its own where words differ."""
    base = [f"b{i}" for i in range(160)]
    return [" ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in base[: 160 - rng.randrange(6)]) for _ in range(n)]


def test_screening_names_a_member_once_in_a_list(spark, monkeypatch):
    """Copies too different to be linked all at once share many lists; nothing is made for each pair of blocks."""
    rows = list(enumerate(edited_copies(random.Random(6), 700, 0.012)))
    tables = []

    def kept(df, name, *more):
        tables.append((name, common.written(df, name, *more)))
        return tables[-1][1]

    monkeypatch.setattr(jaccard_join, "written", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert got == expected_components(rows, 4, 85)
    made = [t.count() for name, t in tables if name == "near"]
    members = next(t for name, t in tables if name == "apart").count()
    assert members > 700 and made and max(made) <= members


def test_larger_lists_are_cut_into_blocks(spark, monkeypatch):
    """Lists of more members than a block, or of more n-grams, give the same components."""
    monkeypatch.setattr(jaccard_join, "SCREEN", 30)
    monkeypatch.setattr(jaccard_join, "SCREEN_GRAMS", 3000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = random.Random(16)
    rows = list(enumerate(edited_copies(rng, 120, 0.012) + [t for _, t in near_copies(rng)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert got == expected_components(rows, 4, 85)


@pytest.mark.parametrize("side", [2, None])
@pytest.mark.parametrize("most", [1 << 18, 400])
def test_smaller_cells_hold_every_possible_link(monkeypatch, side, most):
    monkeypatch.setattr(jaccard_join, "ROWS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", most)
    rng = random.Random(9)
    sets = list(jaccard_join.ngram_sets([t.encode() for t in edited_copies(rng, 60, 0.015)], 4, jaccard_join._Words()))
    cell = {"cell": np.full(60, 5), "side": np.array([side if side else k % 2 for k in range(60)]), "node": np.arange(60), "label": np.arange(60) // 3,
            "n": np.array([len(s) for s in sets]), "pos": np.zeros(60, np.int64), "sketch": np.array([jaccard_join.sketch(s) for s in sets], object)}
    together, bounds = set(), {}
    for _, at, sides in jaccard_join.smaller_cells(cell, 85, 5):
        assert len(at) <= 10
        together |= {(int(a), int(b)) for a, i in zip(at, sides) for b, j in zip(at, sides) if i != 1 and j != 0}
    at, partner, bound = jaccard_join.nearest(cell, 85)
    bounds = {int(a): (int(p), int(b)) for a, p, b in zip(at, partner, bound)}
    linked = 0
    for a in range(60):
        for b in range(60):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if a // 3 != b // 3 and 100 * len(x & y) >= 85 * len(x | y) and (side == 2 or (a % 2, b % 2) == (0, 1)):
                linked += 1
                assert (a, b) in together or (side == 2 and (b, a) in together)
                assert bounds[a][1] <= len(x ^ y) and bounds[b][1] <= len(x ^ y)
    assert linked > 20 and all(p // 3 != a // 3 for a, (p, _) in bounds.items())


def test_overlaps_follow_from_a_similar_sets_overlaps():
    rng = np.random.default_rng(3)
    base = rng.choice(5000, 400, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.95], rng.choice(5000, 10)])).astype(np.uint64) for _ in range(20)]
    index = jaccard_join.Overlaps(sets[:8])
    for s in sets[8:]:
        assert index.of(s).tolist() == [len(np.intersect1d(s, t)) for t in sets[:8]]
    assert index.derived == 11


def test_a_comparison_gives_no_more_links_than_it_joins():
    import pandas as pd

    rng = random.Random(2)
    base = text_of(rng, 150).split()
    texts = [" ".join(base[:k] + ["new"] + base[k + 1 :]).encode() for k in range(10, 40)]
    sets = list(jaccard_join.ngram_sets(texts, 4, jaccard_join._Words()))
    rows = pd.DataFrame({"cell": 1, "node": range(30), "label": range(30), "grams": sets})
    both = pd.concat([rows.assign(side=0), rows.assign(side=1)], ignore_index=True)
    assert len(jaccard_join.cell_links(both, 85)) == 29


def test_sketches_never_rule_out_a_pair():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2) for n in (1, 2, 15, 16, 17, 31, 60, 64, 500, 513, 9000)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.9], rng.integers(0, 1 << 63, 1 + len(s) // 20, dtype=np.uint64)])) for s in sets]
    counts = [jaccard_join.sketch(s) for s in sets]
    for x, a in zip(sets, counts):
        for y, b in zip(sets, counts):
            found = jaccard_join.least_differences([a], [b])[0, 0]
            if max(len(x), len(y)) > 32 * min(len(x), len(y)):
                continue  # no cell has such sizes
            assert found <= len(np.setxor1d(x, y)) and (len(x) != len(y) or (x != y).any() or found == 0)
    assert jaccard_join.least_differences([counts[8]], [counts[9]])[0, 0] > 300


def test_boilerplate_lists_are_never_paired(spark):
    """Documents that share three fifths of their text, none linked: nobody's prefix holds the shared part."""
    rng = random.Random(4)
    shared = text_of(rng, 120)
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(40)]) + f" {shared} " + " ".join([f"b{i}_{k}" for k in range(40)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = jaccard_join._texts(docs, "text")
    signed = texts.mapInPandas(jaccard_join._signing(4), "key1 long, key2 long, n long, n_listed long, node long, sketch binary")
    listed = jaccard_join.prefixes(texts, signed, 4, 85)
    assert listed.count() < 400 * 6
    assert {r["component_id"] == r["doc_id"] for r in jaccard_join.components(docs).collect()} == {True}


def test_join_of_empty_tables_nulls_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d  e f"), (3, None), (4, ""), (None, "a b c d e f"), (None, "x"), (5, "x y"),
            (6, "word " * 40_000), (7, "word " * 39_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0] or -1, r[1], r[2] or -1) for r in jaccard_join.components(docs).collect()))
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (-1, 3, 1), (-1, 1, -1), (5, 1, 5), (6, 1, 6), (7, 1, 6)])
    assert jaccard_join.components(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        jaccard_join.components(docs, percent=50)


# ---------------------------------------------------------------- decontamination


def runs(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def windowed(w, size):
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def brute_matches(docs, items):
    df = Counter(s for t in {(i, tuple(runs(t))) for i, t in items if runs(t)} for s in set(windowed(list(t[1]), min(5, len(t[1])))))
    n = len({(i, tuple(runs(t))) for i, t in items if runs(t)})
    weight = lambda s: math.log1p(n / max(1, df[s]))
    found = set()
    for d, text in docs:
        w = runs(text)
        for item, of in items:
            v = runs(of)
            if not v:
                continue
            size = min(5, len(v))
            y = Counter(windowed(v, size))
            for start in range(max(1, len(w) - size + 1)):
                x = Counter(windowed(w[start : start + len(v)], size))
                keys = set(x) | set(y)
                if x and sum(weight(s) * min(x[s], y[s]) for s in keys) >= 0.75 * sum(weight(s) * max(x[s], y[s]) for s in keys) - 1e-9:
                    found.add((d, item))
    return found


def test_matches_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, text_of(rng, rng.choice([14, 20, 33, 50]))) for i in range(20)] + [(20, "only three words"), (21, ""), (22, None), (23, None)]
    docs = []
    for d in range(120):
        w = text_of(rng, 150).split()
        if d % 2:
            item = items[rng.randrange(21)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in item] if d % 4 == 1 else item
        docs.append((d, " ".join(w)))
    docs += [(200, docs[1][1]), (201, docs[1][1]), (202, None), (203, ""), (204, items[0][1]), (205, "only three words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key1", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, benchmark).collect()}
    want = brute_matches(docs, items)
    assert got == want and len(want) > 30
    clean = decontaminate.clean_documents(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def changed(rng, item):
    """An item with words inserted, deleted or replaced in one place or several."""
    w = item.split()
    kind = rng.randrange(5)
    at = rng.randrange(len(w) // 4, 3 * len(w) // 4)
    if kind == 0:
        w[at:at] = [f"new{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))]
    elif kind == 1:
        del w[at : at + rng.randrange(1, 6)]
    elif kind == 2:
        del w[: rng.randrange(1, 8)]
    elif kind == 3:
        del w[-rng.randrange(1, 8) :]
    else:
        w[at] = "changed"
        w[at // 2 : at // 2] = ["two", "more"]
    return " ".join(w)


def test_matches_with_inserted_and_deleted_words_equal_brute_force(spark):
    """Items share their edges, so that only shingles in their middle are rare; some passages end a text."""
    rng = random.Random(23)
    head, tail = text_of(rng, 12), text_of(rng, 12)
    items = [(i, f"{head} {text_of(rng, rng.choice([30, 36, 60]))} {tail}") for i in range(12)]
    items += [(20 + i, text_of(rng, rng.choice([20, 40, 60]))) for i in range(8)]
    docs = []
    for d in range(160):
        passage = changed(rng, rng.choice(items)[1])
        before, after = text_of(rng, rng.choice([0, 3, 40])), text_of(rng, rng.choice([0, 3, 40]))
        docs.append((d, f"{before} {passage} {after}"))
    docs += [(300, f"{items[0][1]} {text_of(rng, 9)} {changed(rng, items[0][1])}"), (301, head), (302, f"{head} {tail}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, benchmark).collect()}
    want = brute_matches(docs, items)
    assert got == want and 60 < len(want) < 320


def test_inserted_words_between_shared_edges_are_found(spark):
    """Five words in the middle of an item whose edges other items have: a start between the two alignments is best."""
    middle = [f"m{i}" for i in range(36)]
    edge = [f"e{i}" for i in range(24)]
    item = " ".join(edge[:12] + middle + edge[12:])
    others = [" ".join(edge[:12] + [f"o{k}x{i}" for i in range(36)] + edge[12:]) for k in range(6)]
    text = " ".join(["z"] * 30 + edge[:12] + middle[:18] + [f"n{i}" for i in range(3)] + middle[18:] + edge[12:] + ["y"] * 30)
    items = list(enumerate([item, *others]))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_matches([(1, text)], items)


def test_index_holds_all_fingerprints_within_the_radius():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        blocks = [((a >> s) & 255, (b >> s) & 255) for s in range(0, 64, decontaminate.BLOCK_BITS)]
        assert any((x ^ y) in decontaminate.MASKS for x, y in blocks)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([(1, None)], [(1, None)])])
def test_empty_decontamination(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.matches(frame, benchmark).collect() == []
    assert decontaminate.clean_documents(frame, benchmark).count() == len(docs)


# ---------------------------------------------------------------- licences


def brute_license(text, templates):
    vectors = {}
    for i, name, term, weight in templates.entries:
        vectors.setdefault((name, i), {})[term] = weight
    best = None
    for line in (text or "").split("\n"):
        c = Counter(runs(line))
        v = {t: (1 + math.log(n)) * templates.idf.get(t, templates.unknown) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        for (name, _), of in vectors.items():
            shared = set(of) & set(v)
            cosine = round(sum(of[t] * v[t] for t in shared) / norm, 9) if norm else 0
            if cosine >= licenses.SIMILARITY and len(shared) >= licenses.LEAST_SHARED:
                best = min(best or (0, "~"), (-cosine, name))
    return best and (best[1], -best[0])


def test_own_licenses_equal_brute_force(spark):
    templates = licenses.Templates()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9000 + i, f"first line\n{t} more words here\nlast") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(9100, "mit"), (9101, "the license of the work"), (9102, None), (9103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.concat(F.lit("d"), "doc_id", F.lit("/x")))
    got = {r["doc_id"]: r for r in licenses.scan(docs, id_column="doc_id").collect()}
    for i, text in rows:
        want = brute_license(text, templates)
        r = got[i]
        assert (r["license"] if r["origin"] == "own" else None) == (want and want[0]), (i, want, r)
        assert not want or r["similarity"] == pytest.approx(want[1], abs=1e-6)


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", f"text\n{mit}" + "\nother" * 50), ("a/b/c/x.py", "code"), ("a/b/COPYING", apache), ("a/x.py", None),
            ("a/own.py", apache + " code" * 2 + "\n" + "code " * 90), ("ab/x.py", ""), (None, "x"), ("a/b/c/x.py", "code")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("directory", F.lit("clash"))
    got = {(r["path"], r["license"], r["origin"], r["from_directory"]) for r in licenses.scan(files).collect()}
    assert got == {
        ("a/LICENSE", "MIT", "own", None), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b"),
        ("a/b/COPYING", "Apache-2.0", "own", None), ("a/x.py", "MIT", "inherited", "a"),
        ("a/own.py", "Apache-2.0", "own", None), ("ab/x.py", None, None, None), (None, None, None, None)}
    assert licenses.scan(files.limit(0)).collect() == []
    nothing = licenses.scan(files, templates=licenses.Templates(()))
    assert {r["license"] for r in nothing.collect()} == {None}


def test_versions_of_a_header_are_told_apart(spark):
    header = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    files = spark.createDataFrame([("a/x.c", "/* " + header.format(2)), ("b/y.c", "/* " + header.format(3))], "path string, text string")
    assert {r["path"]: r["license"] for r in licenses.scan(files).collect()} == {"a/x.c": "GPL-2.0", "b/y.c": "GPL-3.0"}
