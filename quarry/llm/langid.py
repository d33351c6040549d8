"""Language of texts by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into spans of SPAN bytes.  Each is read with
CONTEXT bytes of the text on either side: one recurrent unit runs forward and
one backward over all of them, and both states label every byte of the span, so
that a label has seen CONTEXT bytes before and behind at least (up to the ends
of the text).  A document's probabilities are the mean over all its bytes.  The
network is trained in numpy by backpropagation through time, on a bounded
sample: about ROWS documents of each of at most LANGS languages, WINDOWS pieces
of PIECE bytes of each.  Pieces are cut where the texts lie, and training runs
in one task.

Nulls: a null text, and one without a letter (Unicode category L), is "und"
with score 0.  Rows with null lang aren't learned from; a repeated doc_id is
learned from once.  Null doc_id stay, repeated rows each give a row, other
columns are ignored.  If there is nothing to learn from, all is "und".
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, fitted, fold, map_texts

#: Bytes of a window; of a span that is labelled at once, and read on either side of it; units of a direction.
WINDOW, SPAN, CONTEXT, HIDDEN = 64, 192, 32, 12
#: Languages, documents of each that are learned from, pieces of each, and their bytes.
LANGS, ROWS, WINDOWS, PIECE = 64, 300, 6, 96
STEPS, BATCH, RATE = 400, 192, 0.02
#: Spans that are run at once.
SIDE = 1024


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Unit(NamedTuple):
    """Weights of one direction; gates are stacked as update, reset, new."""

    x: np.ndarray  # 3 HIDDEN x 256: what each byte gives, with the bias
    h: np.ndarray  # 3 HIDDEN x HIDDEN


class Net(NamedTuple):
    langs: list[str]
    forward: Unit
    backward: Unit
    out: np.ndarray  # languages x (2 HIDDEN)
    bias: np.ndarray  # languages x 1


def run(unit: Unit, steps: np.ndarray, keep: list | None = None, inside: np.ndarray | None = None) -> np.ndarray:
    """States after each byte; steps: bytes as time x windows.

    inside is 1 where a byte is of the text and 0 where it fills up a window;
    there the state is 0, so that a unit starts anew at the text's other end.
    Gates are logistic, taken as (1 + tanh(x / 2)) / 2; the new state is a tanh.
    """
    time, n = steps.shape
    x = np.empty((3 * HIDDEN, n), dtype=np.float32)
    states = np.empty((time, HIDDEN, n), dtype=np.float32)
    h = np.zeros((HIDDEN, n), dtype=np.float32)
    a, b = HIDDEN, 2 * HIDDEN
    for t in range(time):
        g = np.take(unit.x, steps[t], axis=1, out=x if keep is None else None, mode="clip")
        u = unit.h @ h
        gates = g[:b]
        gates += u[:b]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        inner = u[b:] if keep is None else u[b:].copy()
        u[b:] *= gates[a:]
        new = g[b:]
        new += u[b:]
        np.tanh(new, out=new)
        old = h
        h = states[t]
        np.subtract(old, new, out=h)
        h *= gates[:a]
        h += new
        if inside is not None:
            h *= inside[t]
        if keep is not None:
            keep.append((gates, new, inner))
    return states


def softmax(z: np.ndarray) -> np.ndarray:
    """Over the axis before the last."""
    z -= z.max(axis=-2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-2, keepdims=True)
    return z


def label(net: Net, steps: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Probabilities of every byte: time x languages x windows."""
    f, r = run(net.forward, steps), run(net.backward, steps[::-1], None, inside[::-1])
    z = np.matmul(net.out[:, :HIDDEN], f)
    z += np.matmul(net.out[:, HIDDEN:], r)[::-1]
    z += net.bias
    return softmax(z)


def cut_windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as windows x size (filled with zeros), bytes in each window, and each text's first window."""
    counts = np.array([-(-len(t) // size) for t in texts])
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % size) for t in texts), dtype=np.uint8).reshape(-1, size)
    held = np.full(len(flat), size)
    ends = np.cumsum(counts)
    for t, n, e in zip(texts, counts, ends, strict=True):
        if n:
            held[e - 1] = len(t) - (n - 1) * size
    return flat, held, ends - counts


def pool(net: Net, texts: list[bytes]) -> np.ndarray:
    """Mean of the byte probabilities of each text: texts x languages; none of them may be empty."""
    size = np.array([len(t) for t in texts])
    counts = -(-size // SPAN)
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(texts)), counts)
    own = (np.arange(counts.sum()) - first[of]) * SPAN  # where a span begins in its text
    start = np.maximum(own - CONTEXT, 0)
    length = np.minimum(own + SPAN + CONTEXT, size[of]) - start
    flat = np.frombuffer(b"".join(texts) + bytes(SPAN + 2 * CONTEXT), dtype=np.uint8)
    at = np.cumsum(size)[of] - size[of] + start
    sums = np.empty((len(of), len(net.langs)))
    order = np.argsort(length, kind="stable")
    for b in range(0, len(order), SIDE):
        rows = order[b : b + SIDE]
        time = np.arange(length[rows].max())[:, None]
        inside = time < length[rows]
        steps = np.where(inside, flat[at[rows] + time], 0).astype(np.intp)
        labelled = (time >= (own - start)[rows]) & (time < np.minimum(own - start + SPAN, length)[rows])
        sums[rows] = np.einsum("tkn,tn->nk", label(net, steps, inside.astype(np.float32)), labelled.astype(np.float32))
    return np.add.reduceat(sums, first, axis=0) / size[:, None]


def backprop(unit: Unit, steps: np.ndarray, states: np.ndarray, kept: list, d_states: np.ndarray, inside: np.ndarray | None = None) -> Unit:
    """Gradients of a unit, back through all steps."""
    gx, gh = np.zeros_like(unit.x), np.zeros_like(unit.h)
    dh = np.zeros_like(states[0])
    a = HIDDEN
    for t in range(len(steps) - 1, -1, -1):
        gates, new, inner = kept[t]
        z, r = gates[:a], gates[a:]
        before = states[t - 1] if t else np.zeros_like(dh)
        dh = dh + d_states[t] if inside is None else (dh + d_states[t]) * inside[t]
        slope = gates * (1 - gates)
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (before - new) * slope[:a]
        d_r = d_new * inner * slope[a:]
        local = np.concatenate([d_z, d_r, d_new])
        through = np.concatenate([d_z, d_r, d_new * r])
        np.add.at(gx.T, steps[t], local.T)
        gh += through @ before.T
        dh = dh * z + unit.h.T @ through
    return Unit(gx, gh)


def pieces(raw: bytes, rng: np.random.Generator) -> list[bytes]:
    """WINDOWS pieces of a text, each PIECE bytes at most; a third is cut short, so that short texts are learned too."""
    return [raw[s : s + (PIECE if rng.random() < 0.67 else int(rng.integers(4, PIECE)))] for s in rng.integers(0, max(1, len(raw) - PIECE + 1), WINDOWS)]


def train(texts: list[str], langs: list[str], seed: int = 11) -> Net | None:
    """A network from whole texts."""
    rng = np.random.default_rng(seed)
    return train_pieces([(p, lang) for t, lang in zip(texts, langs, strict=True) if has_letter(t) for p in pieces(t.encode("utf-8", "surrogatepass"), rng)], seed)


def train_pieces(rows: list[tuple[bytes, str]], seed: int = 11) -> Net | None:
    """Adam over batches of pieces that hold every language alike."""
    rng = np.random.default_rng(seed)
    by: dict[str, list] = {}
    for piece, lang in rows:
        by.setdefault(lang, []).append(np.frombuffer(piece.ljust(PIECE, b"\0") + bytes([len(piece)]), dtype=np.uint8))
    by = {lang: np.stack(held) for lang, held in by.items()}
    if not by:
        return None
    names, k = sorted(by), len(by)
    unit = lambda: Unit(rng.normal(0, 0.4, (3 * HIDDEN, 256)).astype(np.float32), rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32))
    net = Net(names, unit(), unit(), rng.normal(0, 0.3, (k, 2 * HIDDEN)).astype(np.float32), np.zeros((k, 1), dtype=np.float32))
    weights = [*net.forward, *net.backward, net.out, net.bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    each = max(1, BATCH // k)
    target = np.repeat(np.arange(k), each)
    for step in range(1, STEPS + 1):
        rows = np.concatenate([by[n][rng.integers(0, len(by[n]), each)] for n in names])
        steps = np.ascontiguousarray(rows[:, :PIECE].T).astype(np.intp)
        kept_f: list = []
        kept_b: list = []
        inside = (np.arange(PIECE)[:, None] < rows[:, PIECE]).astype(np.float32)
        f, r = run(net.forward, steps, kept_f), run(net.backward, steps[::-1], kept_b, inside[::-1])
        back = r[::-1]
        p = softmax(np.matmul(net.out[:, :HIDDEN], f) + np.matmul(net.out[:, HIDDEN:], back) + net.bias)
        p[:, target, np.arange(len(target))] -= 1
        p *= inside[:, None, :] / np.float32(inside.sum())
        g_out = np.concatenate([np.einsum("tkn,thn->kh", p, f), np.einsum("tkn,thn->kh", p, back)], axis=1)
        gf = backprop(net.forward, steps, f, kept_f, np.matmul(net.out[:, :HIDDEN].T, p))
        gb = backprop(net.backward, steps[::-1], r, kept_b, np.matmul(net.out[:, HIDDEN:].T, p)[::-1], inside[::-1])
        grads = [*gf, *gb, g_out, p.sum(axis=(0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, (m, v) in zip(weights, grads, moments, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= RATE * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def sample(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """Pieces (doc_id, lang, pieces) of about ROWS documents of each of the LANGS most frequent languages, chosen by a hash of doc_id alone; learn: which rows may be learned from."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null")
    known = known.where(learn) if learn is not None else known
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS)
    limits = counts.select(F.col("lang").alias("of"), (F.lit(1.0) / F.col("count")).alias("count_inverse"))
    part = (F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFF)) < F.col("count_inverse") * (ROWS * 2.0**31)
    rows = known.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(part).select("doc_id", "text", "lang")

    def run(batches):
        for batch in batches:
            for held in chunks(batch, 1):
                ids, texts, langs = (held.column(k).to_pylist() for k in range(3))
                some = [i for i, t in enumerate(texts) if has_letter(t)]
                cut = [pieces(texts[i].encode("utf-8", "surrogatepass"), np.random.default_rng(zlib.crc32(str(ids[i]).encode()))) for i in some]
                yield pa.RecordBatch.from_arrays([held.column(0).take(pa.array(some, pa.int64())), pa.array([langs[i] for i in some], pa.string()), pa.array(cut, pa.list_(pa.binary()))], names=["doc_id", "lang", "pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, pieces array<binary>").groupBy("doc_id").agg(F.min(F.struct("lang", "pieces")).alias("own")).select("doc_id", "own.lang", "own.pieces")


def fit(docs: DataFrame, learn: Column | None = None) -> Net | None:
    return fitted(sample(docs, learn), lambda rows: train_pieces([(p, r["lang"]) for r in sorted(rows, key=lambda r: r["doc_id"]) for p in r["pieces"]]))


def predict(docs: DataFrame, net: Net | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from the whole text alone."""

    def rows(ids, texts):
        langs, score = ["und"] * len(ids), [0.0] * len(ids)
        some = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
        if some:
            p = pool(net, [texts[i].encode("utf-8", "surrogatepass") for i in some])
            for i, best, row in zip(some, p.argmax(axis=1), p, strict=True):
                langs[i], score[i] = net.langs[best], min(1.0, float(row[best]))
        return [ids, langs, score]

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), rows, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return fold(doc_id, 3) == 1
