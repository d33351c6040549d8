"""Near-duplicate documents and vectors, components, mixing: brute force and odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import minhash, mixing, vectors
from quarry.llm.components import components
from tests.llm.conftest import prose


def roots(n, links):
    """Smallest index reachable from each of n."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    n = 300
    links = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)], "none": [(5, 5)], "random": [tuple(x) for x in np.random.default_rng(2).integers(0, n, (150, 2)).tolist()]}[shape]
    df = spark.createDataFrame([*links, *links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = roots(n, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


def sets(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_copies():
    base = prose(120, 1).split()
    out = [" ".join(base)]
    for k in range(12):
        w = list(base)
        for j in range(k % 4 * 2):
            w[(k * 17 + j * 29) % len(w)] = f"new{k}{j}"
        out.append(" ".join(w))
    chain = prose(200, 3).split()
    for k in range(6):
        out.append(" ".join(chain[4 * k : 4 * k + 100]))
    return out


@pytest.mark.parametrize(("n", "over", "of"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_are_brute_force(spark, n, over, of):
    texts = [*near_copies(), "One  TWO", "one\ttwo", "one", None, "", " \n", prose(60, 9), prose(60, 9).upper()]
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    own = [sets(t, n) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if own[a] and own[b] and of * len(own[a] & own[b]) >= over * len(own[a] | own[b])]
    want = roots(len(texts), links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, n, over, of).collect()}
    assert [got[i * 3 + 1]["component_id"] for i in range(len(texts))] == [w * 3 + 1 for w in want]
    assert [got[i * 3 + 1]["n_shingles"] for i in range(len(texts))] == [len(s) for s in own]
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got.values())
    kept = minhash.keep_first(docs.withColumn("lang", F.lit("x")), n, over, of)
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r["doc_id"] for r in kept.collect()} == {w * 3 + 1 for w in want}


def test_open_buckets_are_compared_in_tiles(spark, monkeypatch):
    """A bucket's smallest member links with none, others link with each other; pairs of one component are no work."""
    monkeypatch.setattr(minhash, "TILE", 2)
    sign = lambda seed: np.random.default_rng(seed).integers(0, 2**16, minhash.HASHES).astype("<u2").tobytes()
    rows = [(1, 0, 5, i, i, bytearray(sign(i // 2))) for i in range(5)] + [(2, 0, 2, i, 0, bytearray(sign(0))) for i in range(2)]
    df = spark.createDataFrame(rows, "bucket long, band int, m long, id long, comp long, signature binary")
    found = minhash.tiled(df, 0.85)
    assert {r["id"] for r in found.collect()} == {0, 1, 2, 3}
    sets = spark.createDataFrame([(i, bytearray((np.arange(20, dtype=np.uint64) + i // 2 * 100).tobytes())) for i in range(5)], "id long, hashes binary")
    assert {tuple(r) for r in minhash.tiled_links(found, sets, 85, 100).collect()} == {(0, 1), (2, 3)}
    late = spark.createDataFrame([(*r[:1], 1, *r[2:]) for r in rows], df.schema)
    assert minhash.tiled(late, 0.85).count() == 0  # equal signatures agree in band 0 already


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 5)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = minhash.shared_counts(sets)
    assert all(got[i][j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_posterior_bounds():
    table = dict(minhash.least_matches(0.85))
    tail = lambda n, m: sum(math.comb(n + 1, k) * 0.85**k * 0.15 ** (n + 1 - k) for k in range(m + 1))
    for n, m in table.items():
        assert tail(n, m) >= minhash.MISS and (m == 0 or tail(n, m - 1) < minhash.MISS)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, 3, 85, 100).collect()
    assert len(got) == odd_docs.count()
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert (comp[1], comp[2], comp[7], comp[6], comp[None], comp[3]) == (1, 1, 6, 6, None, 3)
    assert minhash.near_duplicates(no_docs, 3, 85, 100).count() == 0
    kept = minhash.keep_first(odd_docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10]
    assert kept.columns == odd_docs.columns


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        center = rng.normal(size=16)
        rows += [((center + rng.normal(size=16) * 0.08).tolist(), k % 3) for _ in range(1 + k % 5)]
    rows += [(rows[0][0], rows[0][1])] * 5 + [(rows[0][0], 99), (rows[0][0], None), (None, 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([], 1), ([1e30] * 16, 1), ([1e-30] * 16, 1), ([1.0] * 8, 1)]
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(rows)], "vec_id long, embedding array<double>, label int")

    def good(v, t):
        return t is not None and bool(v) and None not in v and np.isfinite(v).all() and any(v)

    def linked(a, b):
        (v, s), (w, t) = rows[a], rows[b]
        if not good(v, s) or not good(w, t) or s != t or len(v) != len(w):
            return False
        v, w = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
        return v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93

    links = [p for p in itertools.combinations(range(len(rows)), 2) if linked(*p)]
    want = roots(len(rows), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    got = sorted(vectors.near_duplicates(df).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in got] == n.tolist()
    assert [r["component_id"] for r in got] == want
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.15
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").withColumn("size", F.lit(1))
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.93).sum(axis=1) - 1
    got = sorted(vectors.near_duplicates(df).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in got] == want.tolist()


def test_table_counts_grow_with_labels():
    few, many = vectors.tables_for(100, 0.93), vectors.tables_for(10**8, 0.93)
    assert few[0] < many[0] and few[1] < many[1]


def plain_rake(cells, rounds):
    w = {k: float(v) for k, v in cells.items()}
    total = sum(w.values())
    for _ in range(rounds):
        for m in range(3):
            own = {}
            for k, v in cells.items():
                own[k[m]] = own.get(k[m], 0) + v
            share = {c: t**mixing.TEMPER for c, t in own.items()}
            aim = {c: s / sum(share.values()) * total for c, s in share.items()}
            sums = {}
            for k, v in w.items():
                sums[k[m]] = sums.get(k[m], 0) + v
            w = {k: v * aim[k[m]] / sums[k[m]] for k, v in w.items()}
    return w


def test_raking(spark):
    cells = {("a", "en", "x"): 100, ("a", "de", "x"): 10, ("b", "en", "y"): 50, ("b", "de", "x"): 5, ("c", "en", "x"): 1}
    df = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    got = {(r["source"], r["lang"], r["topic"]): r["w"] for r in mixing.rake(df).collect()}
    assert got == pytest.approx(plain_rake(cells, mixing.ROUNDS))
    fixed = mixing.rake(df, {"source": {"a": 0.5, "b": 0.25, "c": 0.25}}, rounds=3).groupBy("topic").agg(F.sum("w").alias("w")).collect()
    assert sum(r["w"] for r in fixed) == pytest.approx(166)


def test_samples_meet_their_targets(spark):
    cells = {("a", "en", "x"): 9000, ("a", "de", "x"): 700, ("a", "de", "y"): 40, ("b", "en", "y"): 300, ("b", "de", "x"): 100, ("c", "en", "x"): 60, ("c", "de", "y"): 5}
    df = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    targets = {"topic": {"x": 0.9, "y": 0.1}}
    rows = mixing.calibrated(df, 0.9, targets).collect()
    kept = sum(r["p"] * r["tokens"] for r in rows)
    assert all(0 < r["p"] <= 1 for r in rows) and 0.2 * sum(cells.values()) < kept <= 0.9 * sum(cells.values())
    for m in mixing.MARGINS:
        own, got = {}, {}
        for r in rows:
            own[r[m]] = own.get(r[m], 0) + r["tokens"]
            got[r[m]] = got.get(r[m], 0) + r["p"] * r["tokens"] / kept
        share = targets.get(m) or {c: t**mixing.TEMPER / sum(x**mixing.TEMPER for x in own.values()) for c, t in own.items()}
        assert got == pytest.approx(share, rel=0.015)


def test_sampled_rows_meet_their_targets(spark):
    """A rare topic's share of the sampled rows is its target, not its share of the corpus."""
    docs = spark.createDataFrame([(i, "one License" if i % 20 == 0 else "two words", "en", "a") for i in range(20_000)], "doc_id long, text string, lang string, source string")
    n = {r["license"]: r["count"] for r in mixing.sample(docs).groupBy(F.contains("text", F.lit("icense")).alias("license")).count().collect()}
    want = 1 / (1 + 19**mixing.TEMPER)
    assert n[True] / (n[True] + n[False]) == pytest.approx(want, rel=0.1)


def test_mixing_of_odd_rows(odd_docs, no_docs):
    rows = mixing.weighted(odd_docs)
    assert rows.count() == odd_docs.count()
    assert rows.where("_p is null or _p < 0 or _p > 1").count() == 0
    assert mixing.sample(odd_docs).columns == odd_docs.columns
    assert mixing.sample(no_docs).count() == 0


def test_cells_beyond_the_bound_give_the_same_weights(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cells = [(f"s{a}", f"l{b}", f"t{c}", float(rng.integers(1, 900))) for a in range(6) for b in range(3) for c in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    held = {r[:3]: r["w"] for r in mixing.rake(df, keep=0.9).select("source", "lang", "topic", "w").collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    for keep, want in ((0.9, held), (None, None)):
        got = {r[:3]: r["w"] for r in mixing.rake(df, keep=keep).select("source", "lang", "topic", "w").collect()}
        assert got == pytest.approx(want or plain_rake({c[:3]: c[3] for c in cells}, mixing.ROUNDS))


def test_categories_without_a_target_keep_their_share(spark):
    docs = spark.createDataFrame([(i, "two words", "en", "ab"[i % 10 == 0]) for i in range(1000)] + [(1000 + i, "two words", "en", None) for i in range(100)], "doc_id long, text string, lang string, source string")
    rows = {(r["margin"], r["category"]): r for r in mixing.report(docs, 0.9, {"source": {"a": 0.5, "b": 0.5}}).collect()}
    assert rows["source", "(null)"]["reached"] == pytest.approx(100 / 1100) and rows["source", "a"]["target"] == pytest.approx(500 / 1100)
    assert all(r["shortfall"] < 0.001 and r["reached"] == pytest.approx(r["target"], rel=0.01) for r in rows.values() if r["margin"] == "source")


def test_contradicting_targets_are_reported(spark):
    """No documents of source b in language x: the targets can't be met together, and the report says so."""
    docs = spark.createDataFrame([(i, "two words", "y" if i % 2 else "x", "a" if i % 2 == 0 else "ab"[i % 4 == 1]) for i in range(400)], "doc_id long, text string, lang string, source string")
    rows = mixing.report(docs, 0.9, {"source": {"a": 0.1, "b": 0.9}, "lang": {"x": 0.9, "y": 0.1}}).collect()
    assert max(r["shortfall"] for r in rows) > 0.1


def test_mixing_keeps_clashing_columns(odd_docs):
    own = ("_p", "_gone", "_tokens", "_source", "_lang", "_topic", "_taken", "row", "p")
    docs = odd_docs.select("*", *(F.lit("own").alias(c) for c in own if c not in odd_docs.columns))
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and all(r["_p"] == r["row"] == r["_taken"] == "own" for r in kept.collect())


def test_one_id_with_several_texts(spark):
    """Each text of a doc_id is judged on its own; of a group one row stays, none of another text goes with it."""
    a, b = prose(80, 1), prose(80, 2)
    docs = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, a + " x", 0), (3, b + " y", 0), (1, a, 1), (4, "one", 0), (4, "two", 0), (None, a, 0), (None, None, 0), (5, None, 0), (5, None, 0), (5, "", 0)], "doc_id long, text string, _gone int")
    got = minhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] or 0, r[1] or "") for r in got.collect()) == sorted([(1, a), (1, b), (4, "one"), (4, "two"), (0, a), (0, ""), (5, ""), (5, "")])
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == 12 and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}


def test_buckets_with_members_outside(spark, monkeypatch):
    """Members of the first member's component meet those outside only; blocks are bounded by shingles too."""
    monkeypatch.setattr(minhash, "TILE", 3)
    monkeypatch.setattr(minhash, "SALT", 4)
    monkeypatch.setattr(minhash, "HELD", 50)
    sign = lambda seed: bytearray(np.random.default_rng(seed).integers(0, 2**16, minhash.HASHES).astype("<u2").tobytes())
    rows = [(1, 0, 25, i, 0 if i < 20 else i, 10, sign(0 if i < 22 else 1)) for i in range(25)]
    df = spark.createDataFrame(rows, "bucket long, band int, m long, id long, comp long, size long, signature binary")
    found = minhash.tiled(df, 0.85).collect()
    assert {r["id"] for r in found} == set(range(25))  # 0 to 21 are alike, and so are 22 to 24
    outer = {r["own"] for r in found if r["id"] >= 20}
    assert all(r["i"] in outer for r in found) and not {r["own"] for r in found if r["id"] < 20} & outer
    assert max(sum(r["j"] == t["j"] and r["i"] == t["i"] for r in found) for t in found) < 25


def test_one_vec_id_with_several_vectors(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, x, 1), (1, y, 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (3, [0.0, 0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 1, 1)]
