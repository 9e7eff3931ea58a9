"""Quality rules, toxicity and the quality model against brute force and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimweave.llm import quality_model, quality_rules, toxicity

SF_LARGER = SF.replace("0.001", "0.01")


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def brute_distances(rows):
    """MCD of one group from many random starts, without bins; rows: features."""
    x, rng = np.array(rows), np.random.default_rng(2)
    floors = np.diag(np.array(list(quality_rules.FLOORS.values())) ** 2)
    h = int(np.ceil(quality_rules.NEAREST * len(x)))
    best = None
    for _ in range(40):
        near = x[rng.choice(len(x), 12, replace=False)]
        last = np.inf
        while True:
            mean, c = near.mean(axis=0), np.cov(near.T, bias=True) * quality_rules.CONSISTENCY + floors
            distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(c), x - mean)
            if len(near) == h and np.linalg.det(c) >= last * (1 - 1e-9):
                break
            last = np.linalg.det(c) if len(near) == h else np.inf
            near = x[np.argsort(distance, kind="stable")[:h]]
        if best is None or last < best[0]:
            best = last, distance
    return best[1]


def test_base_counts_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    extra = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "a b c " * 40_000), (-5, "one two"), (-6, "ä ö ü " * 20 + "\n\nx\nx\n \n \n")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "g1": F.lit("clash"), "n_words": F.lit(-1)})
    got = {r["doc_id"]: r for r in quality_rules.judge(frame).collect()}
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert len(got) == len(rows)
    features, ids = [], []
    for i, text in rows:
        n, chars, symbols, dup, repeated = b = base(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b, i
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        if not r["base_failed"]:
            lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
            features.append([np.log(chars / n), *np.sqrt([symbols / chars, dup / lines, repeated / n])])
            ids.append(i)
    want = brute_distances(features)
    mine = np.array([got[i]["distance"] for i in ids])
    # Bins move the nearest three quarters by a few rows.
    assert np.corrcoef(np.log1p(want), np.log1p(mine))[0, 1] > 0.999
    unequal = [(w, m) for w, m in zip(want, mine) if (w <= quality_rules.CUT) != (m <= quality_rules.CUT)]
    assert all(0.8 < w / quality_rules.CUT < 1.25 for w, _ in unequal)
    assert all(got[i]["kept"] == (m <= quality_rules.CUT) for i, m in zip(ids, mine))


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    counts = {(r["quality"], r["b"]): r["count"] for r in quality_rules.judge(docs).where("NOT base_failed").join(
        labels, "doc_id").groupBy("quality", F.col("kept").alias("b")).count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts[0, False] >= 0.5 * counts.get((0, True), 0)


def prose(rng, n=80):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_small_groups_are_judged_by_wider_ones(spark):
    """A language and source of few documents goes by its source, its language, or all documents; none stays unjudged."""
    rng = random.Random(8)
    junk = lambda: " ".join(w + "#|*$<>" if rng.random() < 0.5 else "&%$#*|<>" * 3 for w in prose(rng).split())
    rows = [("en", "web", prose(rng)) for _ in range(150)] + [("de", "web", prose(rng)) for _ in range(20)] + [("de", "web", junk())]
    rows += [("en", "books", prose(rng)) for _ in range(20)] + [("en", "books", junk()), ("fr", None, prose(rng)), ("fr", None, junk())]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    groups = {(r["g1"], r["g2"]): r["group"] for r in quality_rules._groups(docs.selectExpr("lang AS g1", "source AS g2")).collect()}
    assert groups == {("en", "web"): 'both{"g1":"en","g2":"web"}', ("de", "web"): 'second{"g2":"web"}',
                      ("en", "books"): 'first{"g1":"en"}', ("fr", None): "all"}
    got = quality_rules.judge(docs).collect()
    assert all(r["distance"] is not None for r in got if not r["base_failed"])
    assert sorted(r["doc_id"] for r in got if not r["kept"]) == [i for i, (_, _, t) in enumerate(rows) if "#" in t]
    # Alone in their table, few documents are held against each other.
    few = quality_rules.judge(docs.where("lang = 'de'")).collect()
    assert [r["doc_id"] for r in few if not r["kept"]] == [170]


def test_determinant(spark):
    m = np.random.default_rng(3).normal(size=(4, 4))
    row = spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>").select(quality_rules._determinant(F.col("m")).alias("d")).first()
    assert np.isclose(row["d"], np.linalg.det(m))


def test_quality_rules_of_few_and_no_documents(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert quality_rules.judge(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, None, None), (None, text, "en", None), (None, text, "en", None), (3, None, None, "s")]
    frame = spark.createDataFrame(rows, schema)
    assert [(r["doc_id"], r["kept"]) for r in quality_rules.judge(frame).orderBy("doc_id").collect()] == [
        (None, True), (None, True), (1, True), (3, False)]
    assert quality_rules.kept_documents(frame).count() == 3


def test_inverse_of_a_matrix(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 4))
    m = a.T @ a
    row = spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>").select(quality_rules.inverse(F.col("m")).alias("i")).first()
    assert np.allclose(np.array(row["i"]).reshape(4, 4), np.linalg.inv(m))


# ---------------------------------------------------------------- toxicity


def random_examples(n, rng):
    terms = [f"t{i}" for i in range(40)]
    return [(i, rng.randrange(2), dict(Counter(rng.choices(terms, k=rng.randrange(7))))) for i in range(n)], terms


def vectors_of(index):
    dense = np.zeros((len(index.ids), len(index.term)))
    for t in range(len(index.term)):
        entries = slice(index.first[t], index.first[t + 1])
        for block, most, s, e in zip(index.blocks[entries], index.most[entries], index.starts[:-1][entries], index.starts[1:][entries]):
            assert (index.numbers[s:e] // toxicity.BLOCK == block).all() and most == index.weights[s:e].max()
            dense[index.numbers[s:e], t] = index.weights[s:e]
    return dense


def test_nearest_examples_are_exact():
    rng = random.Random(3)
    examples, terms = random_examples(700, rng)
    index = toxicity.build(examples, terms, {t: 5 + i for i, t in enumerate(terms)}, 1000)
    dense = vectors_of(index)
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    for _ in range(300):
        at, w = index.vector(dict(Counter(rng.choices(terms, k=rng.randrange(1, 6)))))
        cosine = np.round(dense[:, at] @ w, toxicity.PLACES)
        order = [i for i in np.lexsort((index.ids, -cosine)) if cosine[i] > 0][: toxicity.NEIGHBOURS]
        number, got = index.nearest(at, w)
        assert np.allclose(got, cosine[order], atol=2e-6)
        assert set(index.ids[number]) == set(index.ids[order]) or np.isclose(got[-1], cosine[order[-1]], atol=2e-6)


def test_nearest_examples_without_itself_are_exact(monkeypatch):
    """Calibration votes with as many neighbours as scoring does, from all blocks that reach them."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    examples, terms = random_examples(700, random.Random(5))
    index = toxicity.build(examples, terms, {t: 5 + i for i, t in enumerate(terms)}, 1000)
    dense = vectors_of(index)
    for n, i in enumerate(index.ids):
        at = np.flatnonzero(dense[n])
        cosine = np.round(dense[:, at] @ dense[n, at], toxicity.PLACES)
        order = [k for k in np.lexsort((index.ids, -cosine)) if cosine[k] > 0 and index.ids[k] != i][: toxicity.NEIGHBOURS]
        number, got = index.nearest(at, dense[n, at], without=i)
        assert i not in index.ids[number] and len(got) == len(order)
        assert np.allclose(got, cosine[order], atol=2e-6)


def test_index_travels_without_its_rows(monkeypatch):
    """Full blocks become rows where neighbours are looked for; the driver holds and sends postings only."""
    monkeypatch.setattr(toxicity, "FULL", 64)
    examples, terms = random_examples(700, random.Random(7))
    index = toxicity.build(examples, terms, {t: 5 + i for i, t in enumerate(terms)}, 1000)
    full = np.count_nonzero(index.row >= 0) * toxicity.BLOCK * 8
    sent = cloudpickle.dumps(index)
    assert "rows" not in vars(index) and 0 < len(sent) < full / 2
    there = cloudpickle.loads(sent)
    assert there.rows.nbytes == full
    for _, _, counts in examples:
        for got, want in zip(there.nearest(*there.vector(counts)), index.nearest(*index.vector(counts))):
            assert (got == want).all()


def test_fit_frees_what_it_broadcast(spark, monkeypatch):
    sent, freed = [], []
    send, free = type(spark.sparkContext).broadcast, Broadcast.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(x := send(self, value)) or x)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **b: freed.append(self) or free(self, *a, **b))
    docs = spark.createDataFrame([(i, f"you {'idiot' if i % 2 else 'friend'} w{i}") for i in range(20)], "doc_id long, text string")
    index = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic"))
    assert len(sent) == 2 and freed == sent and len(index.term) == 23
    assert {r["doc_id"] for r in toxicity.kept_documents(docs, index).collect()} == set(range(0, 20, 2))


def test_calibration_increases():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    at, share = toxicity._isotonic(x, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and np.isclose(share[1], 1 / 3)


def test_toxic_documents_are_found(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    learn = F.expr("crc32(cast(doc_id as string)) % 5 <> 0")
    index = toxicity.fit(docs, labels, learn=learn)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "you idiot, you moron, you scum"), (-3, "x " * 200_000)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").union(extra).withColumns({"key": F.lit("clash"), "score": F.lit(-1)})
    scores = {r["doc_id"]: r for r in toxicity.score(frame, index).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scores.values())
    assert scores[-1]["score"] == scores[-2]["score"] == scores[-3]["score"] == index.alone < 0.5
    assert scores[None]["predicted"] == 1 and scores[None]["neighbours"][0]["toxic"] == 1
    held = labels.where(~learn).collect()
    right = [scores[r["doc_id"]]["predicted"] == r["toxic"] for r in held]
    assert np.mean(right) > 0.85
    clean = [scores[r["doc_id"]]["predicted"] == 0 for r in held if not r["toxic"]]
    assert np.mean(clean) > 0.95
    kept = toxicity.kept_documents(frame, index)
    assert kept.columns == frame.columns and kept.where("doc_id IS NULL").isEmpty()


def test_neighbours_of_whole_documents(spark):
    """All terms count: neighbours of documents under brute-force TF-IDF cosine, text ids, copies of labelled examples."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat('d', doc_id) AS doc_id", "text")
    rare = "quorvex blenthish " + " ".join(f"zyx{i}w" for i in range(30))
    extra = [("rare", rare), ("copy", rare), ("void", None), ("other", "qqqq wwww vvvv")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("concat('d', doc_id) AS doc_id", "toxic")
    labels = labels.union(spark.createDataFrame([("rare", 1)], labels.schema))
    index = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    counts = {i: Counter(w for w in (w.strip(toxicity.MARKS) for w in (t or "").lower().split()) if w) for i, t in text.items()}
    examples = sorted(i for i in label if i in text)
    df = Counter(t for c in counts.values() for t in c)
    of_class = [Counter(t for i in examples if label[i] == y for t in counts[i]) for y in (0, 1)]
    total = [sum(c.values()) for c in of_class]

    def weight(t):
        b, a = (c[t] + 0.5 for c in of_class)
        odds = np.log(a / (total[1] + 1 - a)) - np.log(b / (total[0] + 1 - b))
        return np.log((1 + len(text)) / (1 + df[t])) * np.exp(max(0, odds - toxicity.LEAST_Z * np.sqrt(1 / a + 1 / b)))

    weights = {t: weight(t) for t in of_class[0] | of_class[1]}

    def vector(i):
        v = {t: (1 + np.log(n)) * weights[t] for t, n in counts[i].items() if weights.get(t)}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in examples}
    for i in text:
        v = vector(i)
        cosine = sorted((-round(sum(x * u.get(t, 0) for t, x in v.items()), toxicity.PLACES), k) for k, u in vectors.items())
        want = [(-c, k) for c, k in cosine if c < 0][: toxicity.NEIGHBOURS]
        near = got[i]["neighbours"]
        assert np.allclose([n["cosine"] for n in near], [c for c, _ in want], atol=2e-6), i
        clear = {k for c, k in want if c > want[-1][0] + 3e-6} if want else set()
        assert clear <= {n["id"] for n in near} and all(n["toxic"] == label[n["id"]] for n in near)
    assert got["copy"]["neighbours"][0]["id"] == "rare" and np.isclose(got["copy"]["neighbours"][0]["cosine"], 1)
    assert got["copy"]["score"] > 0.5 and got["rare"]["score"] == got["copy"]["score"]
    assert got["void"]["score"] == got["other"]["score"] == index.alone and got["other"]["neighbours"] == []


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1)]])
def test_toxicity_without_labels(spark, labels):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, index).collect()] == [toxicity.NO_LABELS] * 2
    assert toxicity.score(docs.limit(0), index).collect() == []


# ---------------------------------------------------------------- quality model


def test_quality_is_learnt(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    learn = F.expr("crc32(cast(doc_id as string)) % 3 <> 1")
    model = quality_model.fit(docs, labels, metadata=["n_chars"], learn=learn)
    extra = spark.createDataFrame([(-1, None, None), (-2, "", 0), (None, "text " * 100_000, 5)], "doc_id long, text string, n_chars long")
    frame = docs.select("doc_id", "text", F.col("n_chars").cast("long")).union(extra).withColumn("features", F.lit("clash"))
    scores = {r["doc_id"]: r for r in quality_model.score(frame, model, metadata=["n_chars"]).collect()}
    assert len(scores) == frame.count() and all(0 <= r["score"] <= 1 for r in scores.values())
    assert scores[-1]["score"] == scores[-2]["score"]
    held = labels.where(~learn).collect()
    assert np.mean([scores[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.85


def test_scores_are_those_of_all_pairs(spark):
    """The machine's linear-time score is the sum over pairs of features."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).machine
    rows = quality_model.features(docs.select("doc_id", "text"), "text", []).limit(5)
    factors, linear = model.factors.toArray(), model.linear.toArray()
    for r in model.transform(rows).collect():
        x = Vectors.dense(r["features"].toArray()).toArray()
        at = np.flatnonzero(x)
        pairs = sum(factors[i] @ factors[j] * x[i] * x[j] for n, i in enumerate(at) for j in at[:n])
        raw = model.intercept + linear @ x + pairs
        assert np.isclose(1 / (1 + np.exp(-raw)), r["probability"][1])


def test_quality_model_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for labels, want in (([], quality_model.NO_LABELS), ([(1, 1), (1, None)], 1.0)):
        model = quality_model.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r["score"] for r in quality_model.score(docs, model).collect()] == [want] * 2
    assert quality_model.score(docs.limit(0), model).collect() == []
