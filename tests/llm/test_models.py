"""Toxicity and language: held-out accuracy, gradients, odd rows; chats; the pipeline."""

import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, langid, queries, toxicity
from tests.llm.conftest import SF, prose


@pytest.fixture(scope="module")
def small_net():
    texts = [prose(40, i) + (" vilebad stuff" if i % 3 == 0 else "") for i in range(150)]
    toxic = np.array([int(i % 3 == 0) for i in range(150)])
    return toxicity.train(texts, toxic, ["en"] * 150, np.ones(150))


def test_toxic_words_are_learned(small_net):
    reader = toxicity.Reader(small_net)
    bad = [reader.score(prose(40, 1000 + i) + " vilebad") for i in range(20)]
    good = [reader.score(prose(40, 2000 + i)) for i in range(20)]
    assert min(bad) > 0.5 > max(good)
    assert 0 <= reader.score(None) <= 1 and reader.score("") == reader.score(None)


def test_pooling_in_blocks_is_the_same(small_net, monkeypatch):
    x = np.random.default_rng(0).normal(size=(100, toxicity.WIDTH)).astype(np.float32)
    whole = toxicity.pooled(small_net, x)
    monkeypatch.setattr(toxicity, "SPAN", 7)
    assert np.allclose(whole[0], toxicity.pooled(small_net, x)[0], atol=1e-5)


def test_one_label_alone_gives_the_prior():
    net = toxicity.train(["a", "b"], np.array([0, 0]), ["en", "en"], np.ones(2))
    assert toxicity.Reader(net).score("anything") < 0.01


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, small_net):
    got = toxicity.scores(odd_docs, small_net)
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.keep_clean(odd_docs, small_net)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    assert sorted(r[1] for r in toxicity.sample(odd_docs, labels)) == [0, 1]  # documents 6 and 1; of two labels the larger
    net = toxicity.fit(no_docs, labels.where("false"))
    assert toxicity.scores(no_docs, net).count() == 0


def test_gru_gradients():
    rng = np.random.default_rng(0)
    unit = langid.Unit(rng.normal(0, 0.4, (3 * langid.HIDDEN, 256)), rng.normal(0, 0.4, (3 * langid.HIDDEN, langid.HIDDEN)))
    steps = rng.integers(0, 5, (4, 3))
    d = rng.normal(size=(4, langid.HIDDEN, 3))

    def loss(u):
        kept = []
        return float((langid.run(u, steps, kept).astype(float) * d).sum()), kept

    kept = []
    states = langid.run(unit, steps, kept)
    grads = langid.backprop(unit, steps, states, kept, d)
    for which, at in (("x", (2, steps[1, 1])), ("x", (10, steps[0, 2])), ("x", (20, steps[3, 0])), ("h", (3, 4)), ("h", (12, 1)), ("h", (22, 6))):
        eps, values = 1e-2, []
        for sign in (1, -1):
            w = getattr(unit, which).copy()
            w[at] += sign * eps
            values.append(loss(unit._replace(**{which: w}))[0])
        assert getattr(grads, which)[at] == pytest.approx((values[0] - values[1]) / (2 * eps), abs=2e-2)


@pytest.fixture(scope="module")
def lang_net():
    texts = ["the river and the stone of this house with that " + prose(10, i) for i in range(30)] + ["der fluß und die straße über das schöne haus für einen alten mann, schlüssel größer als türen " + str(i) * 3 for i in range(30)]
    return langid.train(texts, ["en"] * 30 + ["de"] * 30)


def test_languages_are_learned(lang_net):
    p = langid.pool(lang_net, ["the stone and the river".encode(), "die straße und das haus über".encode() * 20, b"x"])
    assert [lang_net.langs[k] for k in p.argmax(axis=1)][:2] == ["en", "de"]
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_windows_are_the_text():
    texts = [b"a" * 64, b"b", b"c" * 130]
    flat, held, first = langid.cut_windows(texts)
    assert flat.shape == (5, 64) and held.tolist() == [64, 1, 64, 64, 2] and first.tolist() == [0, 1, 2]


def test_language_of_odd_rows(odd_docs, no_docs, lang_net):
    got = {r["doc_id"]: r for r in langid.predict(odd_docs, lang_net).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 10)] == ["und"] * 4
    assert got[9]["lang_pred"] in ("en", "de") and 0 <= got[9]["score"] <= 1
    assert langid.predict(odd_docs, lang_net).count() == odd_docs.count()
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.predict(odd_docs, None).collect()} == {"und"}


CHAT = [
    (1, 0, "user", "What is a lamp?\nI ask again."), (1, 1, "assistant", "> What is a lamp?\nA light."), (1, 2, "user", ">> what is  A lamp\n> A light.\nThanks."), (1, 3, "assistant", "Nothing quoted"), (1, 2, "user", ">> what is  A lamp\n> A light.\nThanks."),
    (1, 4, "user", "> said by none\nHm."), (2, 0, "user", "A light."), (2, 1, "user", "> What is a lamp?"), (2, 1, "user", "> What is a lamp?"), (3, 0, None, None), (None, 1, "user", "> A light."), (1, None, "user", "x"),
    (4, 0, "user", "> a b\n> c d\nown"), (4, 1, "user", "a b\nc d"), (4, 2, "user", "> a b\n> c d\n\n>> own\nlast"),
]


def plain_links(rows):
    """What each message replies to, by a loop over all earlier messages."""
    import re

    norm = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip()
    mark = re.compile(r"^([ \t]*>)+")
    level = lambda x: m[0].count(">") if (m := mark.match(x)) else 0
    own = lambda t: re.sub(r"^\s+|\s+$", "", "\n".join(x for x in t.split("\n") if not level(x)))
    out = []
    for conv, turn, _, text in rows:
        found = []
        if conv is not None and turn is not None:
            for lev, run in itertools.groupby((text or "").split("\n"), key=level):
                passage = norm(" ".join(mark.sub("", x) for x in run))
                if not lev or not passage:
                    continue
                said = [t for c, t, _, x in rows if c == conv and t is not None and passage in {norm(u) for u in [own(x or ""), *own(x or "").split("\n"), *re.split(r"\n\s*\n", own(x or ""))]}]
                first = min(said, default=None)
                found.append((lev, -len(passage), first if first is not None and first < turn else None))
        hits = [(a, b, -t) for a, b, t in found if t is not None]
        out.append((-min(hits)[2] if hits else None, len(found)))
    return out


def test_chat_links(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit("clash"), "depth": F.lit("clash"), "original": F.lit("clash")})
    key = lambda c, t, *rest: (str(c), str(t), *map(str, rest))
    got = sorted(key(r["conv_id"], r["turn"], r["reply_to"], r["n_quotes"]) for r in chat.link(df).collect())
    assert got == sorted(key(c, t, *p) for (c, t, *_), p in zip(CHAT, plain_links(CHAT), strict=True))
    two = next(r for r in chat.link(df).collect() if (r["conv_id"], r["turn"]) == (1, 2))
    assert (two["reply_to"], two["root_turn"], two["depth"], two["text"]) == (1, 0, 2, "Thanks.")
    assert chat.link(df.where("false")).count() == 0
    assert chat.formatted(chat.link(df)).where("turn = 3").first()["chat"] == "<|assistant|>\nNothing quoted\n<|end|>\n"


def all_run_links(rows):
    """What each message replies to, by every run of whole lines of all earlier messages."""
    import re

    norm = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip()
    mark = re.compile(r"^([ \t]*>)+")
    level = lambda x: m[0].count(">") if (m := mark.match(x)) else 0
    out = {}
    for conv, turn, _, text in rows:
        hits = []
        for lev, run in itertools.groupby(text.split("\n"), key=level):
            passage = norm(" ".join(mark.sub("", x) for x in run))
            for c, t, _, x in rows:
                own = [y for y in x.split("\n") if not level(y)]
                if lev and passage and c == conv and t < turn and any(norm(" ".join(own[i:j])) == passage for i, j in itertools.combinations(range(len(own) + 1), 2)):
                    hits.append((lev, -len(passage), t))
        best = min((h[:2] for h in hits), default=None)
        firsts = {}
        for lev, size, t in hits:
            firsts.setdefault((lev, size), t)
        out[conv, turn] = firsts.get(best)
    return out


def test_runs_of_quoted_lines_link(spark):
    three = "First line here.\nSecond, line!\nthird line"
    rows = [(1, 0, "user", three), (1, 1, "user", "> First line here.\n> Second, line!\nyes"), (1, 2, "user", "> second line\n> third\n> line\nno"), (1, 3, "user", "> first line here second\nhalf a line"), (1, 4, "user", "> line here\nhalf"), (2, 0, "user", "para one\nstill one\n\npara two\n\npara é three"), (2, 1, "user", "> para one\n> still one\n>\n> para two\nfine"), (2, 2, "user", "> para two\n>\n> para é three\n\n>> First line here.\nok"), (3, 0, "user", "x"), (3, 1, "user", "> Second, line!\n> third line")]
    rng = np.random.default_rng(0)
    for conv in range(10, 30):
        said = []
        for turn in range(6):
            own = ["ab"[x % 2] + " c" * (x // 2) for x in rng.integers(0, 6, rng.integers(1, 6))]
            quote = []
            if said:
                of = said[rng.integers(len(said))]
                i = int(rng.integers(len(of)))
                quote = ["> " + x for x in of[i : i + int(rng.integers(1, 4))]]
            said.append(own)
            rows.append((conv, turn, "user", "\n".join(quote + own)))
    want = all_run_links(rows)
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want
    assert [want[k] for k in ((1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1))] == [0, 0, None, None, 0, 0, None]


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    out = {r["turn"]: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((out[i]["depth"], out[i]["root_turn"], out[i]["text"]) == (i, 0, f"line {i}") for i in range(40))


def both_ways(spark, rows):
    """Rows of op7, from the operator and from its SQL."""
    import duckdb
    import pandas as pd

    schema = "conv_id long, turn long, role string, text string"
    df = chat.formatted(chat.ordered(chat.link(spark.createDataFrame(rows, schema)))).drop("text")
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    result = con.sql(chat.oracle()).select(*df.columns)
    order = lambda r: tuple(map(str, r))
    return sorted((tuple(r) for r in df.collect()), key=order), sorted(result.fetchall(), key=order)


def test_chat_is_its_sql(spark):
    rng = np.random.default_rng(5)
    rows = [*CHAT, (5, 0, "user", " \t> > a b \n>\n\n \n> a"), (5, 1, None, "\x0b x\n>> \n>a b\n\n"), (5, None, "user", "a b")]
    for conv in range(10, 25):
        said = []
        for turn in range(7):
            own = ["ab"[x % 2] + " c" * (x // 2) + "\n" * int(x == 3) for x in rng.integers(0, 6, rng.integers(1, 5))]
            of = said[rng.integers(len(said))] if said else []
            said.append(own)
            rows.append((conv, turn, "user", "\n".join([">" * int(rng.integers(1, 3)) + " " + x for x in of[int(rng.integers(0, 2)) :]] + own)))
    got, want = both_ways(spark, rows)
    assert got == want
    assert sum(r[3] is not None for r in got) > 30


def test_reply_order_and_conversations(spark, monkeypatch):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "two"), (1, 2, "user", "> one\nre one"), (1, 3, "user", "> re one\nagain"), (1, 4, "user", "> two\nre two"), (2, 0, "user", "x"), (None, 0, "user", "lost"), (1, 1, "user", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["position"], r["turn"]) for r in chat.ordered(chat.link(df)).where("conv_id = 1").collect())
    assert got == [(1, 0), (2, 2), (3, 3), (4, 1), (5, 1), (6, 4)]
    assert chat.ordered(chat.link(df)).where("conv_id is null").first()["position"] is None
    parts = {(r["conv_id"], r["part"]): (r["n_messages"], r["chat"]) for r in chat.conversations(df, 4).collect()}
    line = lambda t: f"<|user|>\n{t}\n<|end|>\n"
    assert parts == {(1, 0): (4, "".join(map(line, ("one", "re one", "again", "two")))), (1, 1): (2, line("two") + line("re two")), (2, 0): (1, line("x"))}
    assert chat.conversations(df.where("false")).count() == 0


def test_positions_over_many_ranges(spark):
    """One conversation of all rows lies over several tasks and is still counted through."""
    df = spark.range(3000).selectExpr("7L AS conv_id", "3000 - id AS turn", "'user' AS role", "concat('m', id) AS text")
    got = {r["turn"]: r["position"] for r in chat.ordered(chat.link(df)).collect()}
    assert got == {t: t for t in range(1, 3001)}


def test_marks_and_blanks_without_end(spark):
    import time

    n = 1_000_000
    texts = [">" * n, "> " * n, " " * n + ">x", "a" + " " * n + "b", "\n" * n, "a\n" + " \t" * n + "\nb", ">a\n" * 10_000]
    df = spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(texts)] + [(0, 2, "user", ">" * n)], "conv_id long, turn long, role string, text string")
    chat.link(df.limit(1)).collect()
    start = time.perf_counter()
    got = {(r["conv_id"], r["turn"]): r["text"] for r in chat.link(df).collect()}
    assert time.perf_counter() - start < 20
    assert [got[i, 1] for i in (0, 1, 2, 4)] == [""] * 4 and len(got[3, 1]) == n + 2 and got[5, 1][0] + got[5, 1][-1] == "ab"


def test_native_plans_hold_no_python(spark, odd_docs):
    from quarry.llm import license_scan

    convs = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    for df in (license_scan.scan(odd_docs), chat.link(convs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    from tests.test_queries import TABLES, plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    result = con.sql(queries.ORACLES[name])
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    assert sorted(result.columns) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline_stages(spark):
    """Each stage's rows follow from the stage before; the last covers all that were kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.cut(after)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        assert name != "personal_data" or set(ids) == before
        before = set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == before
    assert docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0


def plain_score(net, text):
    """The classifier's score by loops over every window of words."""
    words = toxicity.WORDS.findall((text or "").lower())
    x = [sum(net.table[k].astype(float) for k in toxicity.keys(w)) for w in words] or [np.zeros(toxicity.WIDTH)]
    tops = []
    for width, w in zip(toxicity.WIDTHS, net.filters, strict=True):
        padded = x + [np.zeros(toxicity.WIDTH)] * (width - len(x))
        tops.append(np.max([np.concatenate(padded[i : i + width]) @ w for i in range(len(padded) - width + 1)], axis=0))
    z = np.maximum(np.concatenate(tops) + net.bias, 0) @ net.out[:-1] + net.out[-1]
    return 1 / (1 + np.exp(-(net.scale[0] * z + net.scale[1])))


def test_scores_are_the_plain_convolution(small_net):
    reader = toxicity.Reader(small_net)
    for t in (None, "", "one", "two Words", "vilebad", prose(60, 1) + " vilebad stuff", prose(7, 2), "1 2 3", "é" * 50):
        assert reader.score(t) == pytest.approx(plain_score(small_net, t), abs=1e-4)


def plain_gru(unit, data):
    """States of one unit over bytes, one at a time, by the usual equations."""
    n, h, out = langid.HIDDEN, np.zeros(langid.HIDDEN), []
    logistic = lambda v: 1 / (1 + np.exp(-v))
    for c in data:
        x, u = unit.x[:, c].astype(float), unit.h.astype(float) @ h
        z, r = logistic(x[:n] + u[:n]), logistic(x[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = z * h + (1 - z) * new
        out.append(h)
    return out


def plain_pool(net, raw):
    """Each span's labels from the span and its context alone, byte after byte."""
    total = np.zeros(len(net.langs))
    for a in range(0, len(raw), langid.SPAN):
        low, high = max(0, a - langid.CONTEXT), min(len(raw), a + langid.SPAN + langid.CONTEXT)
        f, b = plain_gru(net.forward, raw[low:high]), plain_gru(net.backward, raw[low:high][::-1])[::-1]
        for k in range(a - low, min(a + langid.SPAN, len(raw)) - low):
            e = np.exp(net.out @ np.concatenate([f[k], b[k]]) + net.bias[:, 0])
            total += e / e.sum()
    return total / len(raw)


def test_languages_are_the_plain_network(lang_net):
    texts = ["x".encode(), "straße über das haus".encode(), ("the stone and the river é " * 40).encode(), b"a" * langid.SPAN, b"b" * (langid.SPAN + 1), "ü".encode() * 300]
    got = langid.pool(lang_net, texts)
    assert np.allclose(got, [plain_pool(lang_net, t) for t in texts], atol=1e-4)
    assert np.allclose(got, np.concatenate([langid.pool(lang_net, [t]) for t in texts]), atol=1e-5)


def test_masked_gradients(monkeypatch):
    """Gradients through a unit that starts late in some windows."""
    rng = np.random.default_rng(3)
    unit = langid.Unit(rng.normal(0, 0.4, (3 * langid.HIDDEN, 256)), rng.normal(0, 0.4, (3 * langid.HIDDEN, langid.HIDDEN)))
    steps, d = rng.integers(0, 5, (5, 3)), rng.normal(size=(5, langid.HIDDEN, 3))
    inside = np.array([[1, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 1], [1, 1, 1]], dtype=np.float32)
    kept = []
    states = langid.run(unit, steps, kept, inside)
    assert (states[1, :, 1:] == 0).all()
    grads = langid.backprop(unit, steps, states, kept, d, inside)
    loss = lambda u: float((langid.run(u, steps, [], inside).astype(float) * d).sum())
    for which, at in (("x", (2, steps[4, 1])), ("x", (20, steps[3, 2])), ("h", (3, 4)), ("h", (30, 1)), ("h", (22, 6))):
        values = []
        for sign in (1, -1):
            w = getattr(unit, which).copy()
            w[at] += sign * 1e-2
            values.append(loss(unit._replace(**{which: w})))
        assert getattr(grads, which)[at] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-2)


def test_letters_are_of_category_l(spark, lang_net):
    docs = spark.createDataFrame(list(enumerate(["½ ① ²", "12 !", "_", "中", "ª", "٣", "1a"])), "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(docs, lang_net).orderBy("doc_id").collect()] == [True, True, True, False, False, True, False]


def test_samples_hold_one_row_of_an_id(spark, monkeypatch):
    """A doc_id repeated over and over is learned from once; rare languages beyond the bound aren't learned."""
    rows = [(7, "the river", "en")] * 500 + [(i, "the stone", "en") for i in range(100, 140)] + [(i, "die straße", "de") for i in range(200, 240)] + [(300 + i, "x", f"l{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGS", 2)
    got = langid.sample(docs).collect()
    assert len({r["doc_id"] for r in got}) == len(got) <= 81 and {r["lang"] for r in got} == {"en", "de"}
    labels = spark.createDataFrame([(7, 1), (100, 0), (200, 0), (7, 0)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, labels)) == 3


def test_calibration_of_large_logits():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.1).astype(float)
    for size in (1e-3, 1.0, 1e4):
        z = size * (rng.normal(size=400) + 3 * y)
        a, b = toxicity.platt(z, y, np.full(400, 1 / 400), 0.1)
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        assert abs(p.mean() - y.mean()) < 0.05 and p[y == 1].mean() > 3 * p[y == 0].mean()
