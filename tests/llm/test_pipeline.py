"""The whole pipeline over a small folder against a plain version of its five stages."""

import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm import bpe, mixing, pii, toxicity
from tests.llm.conftest import prose
from tests.llm.test_groups import roots, sets
from tests.llm.test_models import plain_score
from tests.llm.test_text_operators import plain_base


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    texts = []
    for i in range(160):
        t = prose(30 + i % 40, i)
        t += " vilebad stuff" * (i % 5 == 0) + f" call +1 (243) 555-5526 or a{i}@b.example.com" * (i % 7 == 0) + f' token = "{"0a" * 20}"' * (i % 6 == 1) + " License" * (i % 9 == 0) + " | a | b" * (i % 11 == 0)
        texts.append(t)
    for i in (3, 11, 12):
        texts += [texts[i], texts[i].upper(), texts[i] + " tail"]
    texts += [None, "", " \n", "x" * 30_000, prose(20_000, 77)]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": ["en", "de", None][0:1] * len(texts), "source": [f"s{i % 3}" for i in range(len(texts))], "n_chars": [len(t or "") for t in texts]})
    docs.loc[::4, "lang"] = "de"
    docs.loc[5, "lang"] = docs.loc[6, "source"] = None
    docs.to_parquet(at / "documents.parquet")
    pd.DataFrame({"doc_id": range(160), "quality": 1, "toxic": [int(i % 5 == 0) for i in range(160)]}).to_parquet(at / "labels.parquet")
    return at


def plain_near(docs):
    """Smallest doc_id of each group by comparing all pairs."""
    own = [sets(t, 5) for t in docs["text"]]
    links = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    up = roots(len(docs), links)
    return docs[[u == i for i, u in enumerate(up)]]


def plain_redacted(docs):
    """Base spans by the plain patterns, and secrets behind the word token; crossing spans are one."""
    codes = {}
    for t in docs["text"]:
        for _, _, _, c in pii.candidates(t or "", pii.base_spans(t or "")):
            codes[c] = codes.get(c, 0) + 1
    parts = [pii.decode(c) for c in sorted(codes)]
    kinds, vote, feature = (np.array([p[k] for p in parts]) for k in range(3))
    count = np.array([codes[c] for c in sorted(codes)], dtype=float)
    x = pii.inputs(kinds, vote, feature)
    good = {c for c, z in zip(sorted(codes), x @ pii.train(x, pii.reliabilities(kinds, vote, count)[0], count), strict=True) if z > 0}
    out = []
    for t in docs["text"]:
        if t is None:
            out.append(None)
            continue
        spans = sorted([(a, b, k) for k, a, b in plain_base(t)] + [(a, b, k) for k, a, b, c in pii.candidates(t, pii.base_spans(t)) if c in good])
        joined = []
        for a, b, k in spans:
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), joined[-1][2])
            else:
                joined.append((a, b, k))
        for a, b, k in reversed(joined):
            t = t[:a] + f"<{k}>" + t[b:]
        out.append(t)
    return docs.assign(text=out)


def plain_sampled(docs):
    """Raking over a dictionary of cells, and the hash of doc_id against each cell's probability."""

    def topic(t):
        return "empty" if not (t or "").strip(" ") else "license" if "icense" in t else "table" if " | " in t else "records" if "@" in t or " = " in t else "prose"

    none = lambda v: "(null)" if v is None or v != v else v
    cell = [(none(s), none(x), topic(t)) for s, x, t in zip(docs["source"], docs["lang"], docs["text"], strict=True)]
    tokens = {}
    for c, t in zip(cell, docs["text"], strict=True):
        tokens[c] = tokens.get(c, 0) + (t or "").count(" ") + 1
    total, aims, scale = sum(tokens.values()), [], 0.9
    for m in range(3):
        own = {}
        for c, n in tokens.items():
            own[c[m]] = own.get(c[m], 0) + n
        share = {k: v**0.7 for k, v in own.items()}
        share = {k: v / sum(share.values()) for k, v in share.items()}
        scale = min(scale, *(own[k] / (share[k] * total) for k in own))
        aims.append(share)
    w = {c: float(n) for c, n in tokens.items()}
    for _ in range(mixing.LIMIT):
        w = {c: min(v, tokens[c]) for c, v in w.items()}
        for m in range(3):
            sums = {}
            for c, v in w.items():
                sums[c[m]] = sums.get(c[m], 0) + v
            w = {c: v * aims[m][c[m]] * total * scale / sums[c[m]] for c, v in w.items()}
        off = 0
        for m in range(2):
            for k, s in aims[m].items():
                off = max(off, abs(sum(v for c, v in w.items() if c[m] == k) / (s * total * scale) - 1))
        if off <= mixing.MISSED:
            break
    room = min(1, *(tokens[c] / v for c, v in w.items() if v > 0))
    u = [int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52 for i in docs["doc_id"]]
    return docs[[x < room * w[c] / tokens[c] for x, c in zip(u, cell, strict=True)]]


def test_run_is_the_plain_pipeline(spark, folder):
    from tokenizers import Tokenizer

    docs = pd.read_parquet(folder / "documents.parquet")
    docs["text"] = [None if t is None or t != t else t for t in docs["text"]]
    docs[["lang", "source"]] = docs[["lang", "source"]].astype(object).where(docs[["lang", "source"]].notna(), None)
    held = spark.read.parquet(str(folder / "documents.parquet"))
    net = toxicity.fit(held, spark.read.parquet(str(folder / "labels.parquet")), ~toxicity.held_out())
    limit = [net.thresholds.get(x if x else "", net.thresholds[""]) for x in docs["lang"]]
    clean = docs[[plain_score(net, t) < v for t, v in zip(docs["text"], limit, strict=True)]]
    assert 120 < len(clean) < 150 and {160, 169, 170} <= set(clean["doc_id"])
    first = plain_near(clean)
    assert len(first) < len(clean)
    redacted = plain_redacted(first)
    assert sum("<secret>" in (t or "") for t in redacted["text"]) > 10 and sum("<phone>" in (t or "") for t in redacted["text"]) > 10
    kept = plain_sampled(redacted)
    assert 10 < len(kept) < len(redacted)
    library, want = Tokenizer.from_file(bpe.tokenizer_path()), {}
    for i, t in zip(kept["doc_id"], kept["text"], strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i] = (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(folder)).collect()}
    assert got == want
