"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its
prefixes.  Filters of several widths run over the word vectors, each filter's
largest value in the document is kept, and a logistic layer scores them.  The
network is fitted on a bounded sample of labelled rows (POSITIVES and
NEGATIVES, in an order by hash, texts of at most LONGEST bytes); a part of it
that training doesn't see scales the scores to probabilities and sets one
threshold for each language.  Training runs in one task, not in the driver.

Nulls: a null or empty text has no words and gets the score of the bias alone.
Null labels aren't learned from; several labels of a document count as their
largest, of several texts of a labelled doc_id the first in order is learned
from.  Null doc_id stay, repeated rows each give a row, other columns are
ignored, whatever their names.  keep_clean() keeps rows with null or empty text
as long as the bias alone is under the threshold, repeated ones alike.  Without both labels in the sample, every score is the prior's.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fitted, fold, map_texts

#: Rows of each label that are learned from, at most, and bytes of such a text.
POSITIVES, NEGATIVES, LONGEST = 2048, 4096, 1 << 18
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 16, 16, 24, (1, 2, 3)
#: Chosen, with STEPS and DROPPED, on folds of the rows that may be learned from (remainders 0 and 1, each left out in turn).
PREFIXES = (3, 4, 5)
STEPS, BATCH, RATE = 1200, 24, 0.05
#: Share of a row's words that a training step leaves out, so that one word of several is learned too.
DROPPED = 0.4
#: Word vectors kept in a worker; beyond that, the store starts anew.
KEPT = 150_000
#: Words whose filters are computed at once.
SPAN = 1 << 15
WORDS = re.compile(r"[^\W\d_]+")


def keys(word: str) -> list[int]:
    """Buckets of a word and of those prefixes that are shorter than it."""
    parts = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


KEYS = 1 + len(PREFIXES)


def word_keys(text: str, held: dict[str, list[int]]) -> np.ndarray:
    """Keys of each word of a text, words x KEYS, filled up with BUCKETS; one empty word at least."""
    words = WORDS.findall(text.lower())
    for w in set(words):
        if w not in held:
            k = keys(w)
            held[w] = k + [BUCKETS] * (KEYS - len(k))
    return np.array([held[w] for w in words] or [[BUCKETS] * KEYS], dtype=np.int32)


class Net(NamedTuple):
    table: np.ndarray  # BUCKETS x WIDTH
    filters: list[np.ndarray]  # for each width: (width * WIDTH) x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray  # weight of each filter
    scale: tuple[float, float]  # score = sigmoid(scale[0] * logit + scale[1])
    thresholds: dict[str, float]  # by language; "" for all others


def pooled(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter over the words, and where it lies; x: words x WIDTH."""
    best, where = [], []
    for width, w in zip(WIDTHS, net.filters, strict=True):
        top, at = np.full(FILTERS, -np.inf, dtype=np.float32), np.zeros(FILTERS, dtype=np.int64)
        padded = x if len(x) >= width else np.concatenate([x, np.zeros((width - len(x), WIDTH), dtype=np.float32)])
        n = len(padded) - width + 1
        for b in range(0, n, SPAN):
            e = min(n, b + SPAN)
            value = sum(padded[b + j : e + j] @ w[j * WIDTH : (j + 1) * WIDTH] for j in range(width))
            k = value.argmax(axis=0)
            v = value[k, np.arange(FILTERS)]
            at, top = np.where(v > top, k + b, at), np.maximum(top, v)
        best.append(top)
        where.append(at)
    return np.concatenate(best) + net.bias, np.concatenate(where)


def logit(net: Net, x: np.ndarray) -> float:
    return float(np.maximum(pooled(net, x)[0], 0) @ net.out[:-1] + net.out[-1])


class Reader:
    """Word vectors of texts, each word's sum computed once."""

    def __init__(self, net: Net):
        self.net, self.known, self.rows = net, {}, np.zeros((1024, WIDTH), dtype=np.float32)

    def vectors(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        if new := list({w for w in words if w not in known}):
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            while len(known) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            lists = [keys(w) for w in new]
            starts = np.cumsum([0, *map(len, lists)])[:-1]
            self.rows[first : len(known)] = np.add.reduceat(self.net.table[[k for own in lists for k in own]], starts, axis=0)
        return self.rows[[known[w] for w in words]] if words else np.zeros((1, WIDTH), dtype=np.float32)

    def score(self, text: str | None) -> float:
        a, b = self.net.scale
        return float(1 / (1 + np.exp(-np.clip(a * logit(self.net, self.vectors(text or "")) + b, -30, 30))))


def train(texts: list[str], toxic: np.ndarray, langs: list[str], weight: np.ndarray, seed: int = 7) -> Net:
    """Fit on rows in a fixed order; every fifth row calibrates instead.

    weight: how many rows of the corpus each stands for.  Adagrad, STEPS
    batches with as many rows of either label.  Only the windows that win a
    filter's maximum get a gradient.
    """
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32),
        [rng.normal(0, 0.3 / np.sqrt(w), (w * WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        np.concatenate([rng.normal(0, 0.1, FILTERS * len(WIDTHS)), [0]]).astype(np.float32),
        (1.0, 0.0),
        {},
    )
    prior = float((weight * toxic).sum() / max(weight.sum(), 1e-9)) if len(toxic) else 0.1
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    part = np.arange(len(texts)) % 5 == 4
    yes, no = np.flatnonzero(~part & (toxic == 1)), np.flatnonzero(~part & (toxic == 0))
    if not len(yes) or not len(no):
        return net._replace(scale=(0.0, float(np.log(prior / (1 - prior)))), thresholds={"": 0.3})
    held: dict[str, list[int]] = {}
    bags = [word_keys(t, held) for t in texts]
    grown = [np.full_like(a, 1e-2) for a in (*net.filters, net.bias, net.out)]
    table = np.concatenate([net.table, np.zeros((1, WIDTH), dtype=np.float32)])  # the last row fills up short lists of keys
    grown_table = np.full(BUCKETS, 1e-2, dtype=np.float32)
    for step in range(STEPS):
        rate = RATE * (1 - step / STEPS) + 1e-3
        rows = np.concatenate([rng.choice(yes, BATCH // 2), rng.choice(no, BATCH // 2)])
        grads = [np.zeros_like(a) for a in (*net.filters, net.bias, net.out)]
        hit, push = [], []
        for i in rows:
            stay = rng.random(len(bags[i])) >= DROPPED
            bag = bags[i][stay] if stay.any() else bags[i]
            x = table[bag].sum(axis=1)
            value, at = pooled(net, x)
            drop = rng.random(len(value)) < 0.8
            active = np.maximum(value, 0) * drop / 0.8
            p = 1 / (1 + np.exp(-np.clip(active @ net.out[:-1] + net.out[-1], -30, 30)))
            d = (p - toxic[i]) / BATCH
            grads[-1] += d * np.append(active, 1)
            back = d * net.out[:-1] * (value > 0) * drop / 0.8
            grads[-2] += back
            for f, (width, w) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                part_back, part_at = back[f * FILTERS : (f + 1) * FILTERS], at[f * FILTERS : (f + 1) * FILTERS]
                for j in range(width):
                    where = part_at + j
                    inside = where < len(x)
                    where = np.minimum(where, len(x) - 1)
                    block = slice(j * WIDTH, (j + 1) * WIDTH)
                    grads[f][block] += (x[where] * inside[:, None]).T * part_back
                    some = np.flatnonzero(part_back * inside)
                    hit.append(bag[where[some]])
                    push.append((w[block][:, some] * part_back[some]).T)
        for a, g, s in zip((*net.filters, net.bias, net.out), grads, grown, strict=True):
            g += 1e-4 * a
            s += g * g
            a -= rate * g / np.sqrt(s)
        if hit:
            flat = np.concatenate(hit).ravel()
            order = np.argsort(flat, kind="stable")
            own, first = np.unique(flat[order], return_index=True)
            g = np.add.reduceat(np.concatenate(push)[order // KEYS], first, axis=0)
            own, g = (own[:-1], g[:-1]) if own[-1] == BUCKETS else (own, g)
            grown_table[own] += (g * g).mean(axis=1)
            table[own] -= rate * g / np.sqrt(grown_table[own])[:, None]
    net = net._replace(table=table[:BUCKETS])
    return calibrate(net, texts, toxic, langs, weight, part, prior)


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over logits z, by Newton steps that never raise the loss.

    Logits are brought to mean 0 and deviation 1 first, so that a network of
    large ones converges too; the slope is positive.
    """
    mean, spread = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - mean) / spread, np.ones_like(z)], axis=1)
    start = np.array([1.0, np.log(prior / (1 - prior))])

    def loss(t: np.ndarray) -> float:
        return float(w @ (np.logaddexp(0, x @ t) - y * (x @ t)) + 1e-3 * ((t - start) ** 2).sum())

    theta = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 2e-3])
        step, now = np.linalg.solve(hess, x.T @ (w * (p - y)) + 2e-3 * (theta - start)), loss(theta)
        while loss(theta - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
        if np.abs(step).max() < 1e-7:
            break
    slope = max(float(theta[0]), 0.05) / spread
    return slope, float(theta[1]) - slope * mean


def calibrate(net: Net, texts: list[str], toxic: np.ndarray, langs: list[str], weight: np.ndarray, part: np.ndarray, prior: float) -> Net:
    """Scale logits to probabilities on unseen rows, and set the threshold of best F1 for each language."""
    reader, rows = Reader(net), np.flatnonzero(part)
    if not len(rows):
        return net._replace(scale=(1.0, float(np.log(prior / (1 - prior)))), thresholds={"": 0.3})
    z = np.array([logit(net, reader.vectors(texts[i])) for i in rows])
    y, w = toxic[rows].astype(float), weight[rows] / weight[rows].sum()
    scale = platt(z, y, w, prior)
    p = 1 / (1 + np.exp(-np.clip(scale[0] * z + scale[1], -30, 30)))
    thresholds = {}
    for lang in ["", *sorted({langs[i] for i in rows})]:
        own = np.array([not lang or langs[i] == lang for i in rows])
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            cuts = np.unique(np.clip(np.round(p[own], 3), 0.05, 0.95))
            f1 = [2 * (w[own] * y[own])[p[own] >= c].sum() / (w[own][p[own] >= c].sum() + (w[own] * y[own]).sum()) for c in cuts]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
            thresholds[lang] = float(cuts[best].mean())
    return net._replace(scale=scale, thresholds={"": 0.3} | thresholds)


def sampled(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """At most POSITIVES + NEGATIVES labelled rows (place, doc_id, text, toxic, lang), and the labelled documents of either label.

    learn: condition on doc_id of the rows that may be learned from.  Which
    rows are taken depends on a hash of doc_id alone; a doc_id gives one row.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known.where(learn) if learn is not None else known).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = known.where("toxic = 1").orderBy(*order).limit(POSITIVES).unionByName(known.where("toxic = 0").orderBy(*order).limit(NEGATIVES))
    texts = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).where(F.octet_length("text") <= LONGEST)
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("own"))
    return found.select(F.xxhash64("doc_id").alias("place"), "doc_id", "own.text", "toxic", "own.lang"), counts


def weighed(rows: list[dict], counts: dict[int, int]) -> list[tuple[str, int, str, float]]:
    """Sampled rows in their order: text, label, language, and rows that each stands for."""
    held = {t: sum(r["toxic"] == t for r in rows) for t in (0, 1)}
    return [(r["text"], r["toxic"], r["lang"], counts[r["toxic"]] / held[r["toxic"]]) for r in sorted(rows, key=lambda r: (r["place"], r["doc_id"]))]


def sample(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> list[tuple[str, int, str, float]]:
    """What fit() learns from, brought here."""
    rows, counts = sampled(docs, labels, learn)
    return weighed([r.asDict() for r in rows.collect()], counts)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Net:
    rows, counts = sampled(docs, labels, learn)

    def learned(held: list[dict]) -> Net:
        known = weighed(held, counts)
        return train([r[0] for r in known], np.array([r[1] for r in known], dtype=np.int64), [r[2] for r in known], np.array([r[3] for r in known]))

    return fitted(rows, learned)


def scores(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row, from the whole text alone."""

    def run(reader: Reader, ids, texts):
        return [ids, [reader.score(t) for t in texts]]

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), run, f"doc_id {kind}, score double", lambda: Reader(net))


def keep_clean(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold of their language."""
    from pyspark.sql.functions import pandas_udf

    held: list[Reader] = []

    @pandas_udf("double")
    def score(values):
        if not held:
            held.append(Reader(net))
        return values.map(lambda t: held[0].score(t if isinstance(t, str) else None))

    limit = F.lit(net.thresholds[""])
    for lang, value in sorted(net.thresholds.items()):
        limit = F.when(docs["lang"] == lang, value).otherwise(limit) if lang else limit
    return docs.where(score(docs["text"]) < limit)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return fold(doc_id, 4) == 2
