"""Personal data, audio, tokens and licences: brute force, golden values, odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import audio, bpe, license_scan, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ (052)9b_%é", max_size=60))
def test_base_spans_are_the_patterns(t):
    assert pii.base_spans(t) == plain_base(t)


def test_base_spans_of_long_runs_are_quick():
    t = "x" * 400_000 + "@a.b " + "1" * 400_000
    assert pii.base_spans(t) == [("email", 0, 400_004)]


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert [k for k, *_ in pii.base_spans("1.2.3.4 x 1.2.3.256 x +1 (017) 555-7713 x 4111 1111 1111 1111")] == ["ip", "card", "phone"]


def test_codes_round_trip():
    for kind in range(len(pii.ADDED)):
        c = pii.code(kind, (1, 0, -1), (True, False, True, False, True, True))
        assert c < pii.PATTERNS
        assert pii.decode(c)[:2] == (kind, [1, 0, -1])


def test_em_finds_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    flip = lambda right: np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    vote = np.stack([flip(0.95), flip(0.9), flip(0.5)], axis=1)
    patterns, back, count = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    post, table = pii.reliabilities(np.zeros(len(patterns), int), patterns, count.astype(float))
    assert ((post[back.ravel()] > 0.5) == truth).mean() > 0.9
    assert table[0, 0, 1, 2] > 0.9 and 0.4 < table[0, 2, 1, 2] < 0.6


def test_pii_over_rows(spark, odd_docs, no_docs):
    secret = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    docs = spark.createDataFrame([(i, f'call token = "{secret}" or a{i}@b.example.com é 1.2.3.4') for i in range(20)] + [(99, f"commit {secret}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert got[3]["spans"] == "email:59:75,ip:78:85,secret:14:54"
    assert got[3]["base_sha256"] == hashlib.sha256(b"email:59:75,ip:78:85").hexdigest()
    assert got[99]["spans"] == ""
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[3] == 'call token = "<secret>" or <email> é <ip>'
    assert red[99] == f"commit {secret}"
    assert pii.detect(odd_docs).count() == odd_docs.count()
    assert pii.detect(no_docs).count() == pii.redact(no_docs).count() == 0
    assert pii.redact(odd_docs).columns == odd_docs.columns


def test_wav_round_trip():
    for t in (None, "", "a", "x" * 64, "é" * 1000):
        raw = (t or "").encode()
        n, media = audio.store(t)
        payload = audio.read(media)
        assert n == len(raw) and payload[:n] == raw and len(payload) % 64 == 0 and len(payload) >= 64
        assert payload[n:] == bytes(len(payload) - n) and media[:4] == b"RIFF"


@pytest.mark.parametrize("rates", [(16_000, 8_000), (16_000, 10_000), (8_000, 16_000), (8_000, 8_000)])
def test_resampling_is_filtering(rates):
    x = np.random.default_rng(1).normal(size=501).astype(np.float32)
    up, down, h = audio.phases(*rates)
    full = np.zeros(len(x) * up)
    full[::up] = x
    want = np.convolve(full, h.T.ravel())[: len(full)][::down]
    got = audio.resample(x, *rates)
    assert len(got) == -(-len(x) * up // down)
    assert np.allclose(got, want[: len(got)], atol=1e-5)


def test_resampling_in_blocks_is_the_same(monkeypatch):
    x = np.random.default_rng(1).normal(size=3001).astype(np.float32)
    whole = audio.resample(x)
    monkeypatch.setattr(audio, "SAMPLES", 100)
    assert np.array_equal(whole, audio.resample(x))


def test_segments_have_hysteresis():
    e = np.array([0, 0, 10, 4, 4, 0, 0, 4, 4, 0], dtype=float)
    assert audio.segments(e) == [(2, 5)]
    assert audio.segments(np.zeros(5)) == []


@pytest.mark.parametrize("n", [64, 448, 512, 576, 640, 704, 6400])
def test_last_samples_are_in_a_frame(n):
    a, b = bytes([128]) * n, bytes([128]) * (n - 32) + bytes([255]) * 32
    x, y = audio.features(a), audio.features(b)
    assert x.mel.shape == y.mel.shape and len(x.mel) == max(0, -(-(n // 2 - audio.FRAME) // audio.HOP)) + 1
    assert not np.array_equal(x.mel[-1], y.mel[-1])


def test_tensors():
    mel = np.random.default_rng(0).normal(size=(70, audio.BANDS)).astype(np.float32)
    back = audio.untensor(audio.tensors(mel))
    assert back.shape == (3, audio.BLOCK, audio.BANDS)
    assert np.array_equal(back.reshape(-1, audio.BANDS)[:70], mel)


def test_audio_over_rows(odd_docs, no_docs):
    got = audio.digests(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["feature"], r["media_sha256"]))
    assert all(len(v) == 1 for v in by.values())
    empty = next(r for r in got if r["doc_id"] == 3)
    assert (empty["n_bytes"], empty["payload_bytes"], empty["payload_sha256"], empty["tail_crc32"]) == (0, 64, hashlib.sha256(bytes(64)).hexdigest(), zlib.crc32(bytes(64)))
    assert audio.digests(no_docs).count() == 0
    assert audio.extract(odd_docs).where("doc_id = 9").first()["media"][:4] == b"RIFF"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def same(codec, library, t):
    ids = codec.encode(t)
    want = library.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab '\n\t sl12é<|endoftext|>", max_size=80)))
def test_tokens_are_the_library_s(codec, library, t):
    same(codec, library, t)


@pytest.mark.parametrize("t", ["", " ", "   x", "a<|endoftext|><|endoftext|> b", "x" * 5000, "ab" * 3000, " " * 500 + "a", "don't we'll", "\x1c\x85  x", "1234567" * 50])
def test_tokens_of_odd_texts(codec, library, t):
    same(codec, library, t)


def test_long_and_short_merges_agree(codec):
    for t in ("antidisestablishmentarianism", "aaaaaaaaaaaaaaaa", "thththththe"):
        ids = [codec.start[b] for b in t.encode()]
        assert codec.merge_short(ids.copy()) == codec.merge_long(ids.copy())


def test_tokens_over_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in bpe.encode(odd_docs, bpe.tokenizer_path()).collect()}
    assert rows[3]["ids"] == [] and rows[3]["decoded"] == ""
    assert rows[9]["decoded"] == "one two"
    assert bpe.digests(odd_docs, bpe.tokenizer_path()).count() == odd_docs.count()
    assert bpe.digests(no_docs, bpe.tokenizer_path()).count() == 0


def plain_scan(t):
    """Every unit against every template, without pruning."""
    t = (t or "").lower()
    units = t.split("\n") + [p for p in re.split("\n\\s*\n", t) if "\n" in p.strip(" ")]
    out = []
    for u in units:
        w = re.findall(r"[^\W_]+", u)
        own = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        best = max(((round(2 * len(own & set(b)) / (len(own) + len(b)), 6), name) for name, b in ((n, license_scan.template_bigrams(x)) for n, x in license_scan.TEMPLATES.items()) if own), default=(0, ""), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if best[0] >= license_scan.THRESHOLD:
            out.append(best)
    return out


def test_anchors_lose_nothing():
    for t in license_scan.TEMPLATES.values():
        b = license_scan.template_bigrams(t)
        marks = license_scan.anchors(b, license_scan.THRESHOLD)
        left = [x for x in b if not set(x.split()) & set(marks)]
        assert 2 * len(left) / (len(left) + len(b)) < license_scan.THRESHOLD


def test_licenses_over_rows(spark, odd_docs, no_docs):
    texts = [*license_scan.TEMPLATES.values(), "Some text.\nReleased under the MIT License.\nmore", "RELEASED under the  MIT-License", "released under the mit license today for us", "License", None, "", "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files\n\nother", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        want = plain_scan(texts[r["doc_id"]])
        assert r["n_matches"] == len(want), texts[r["doc_id"]]
        assert r["dice"] == (max(d for d, _ in want) if want else None)
        assert sorted((m["dice"], m["license"]) for m in r["matches"]) == sorted(want)
    assert license_scan.scan(odd_docs).count() == odd_docs.count()
    assert license_scan.scan(no_docs).count() == 0


def test_secrets_of_any_length_and_shape(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    keys = ["sk_" + "live_" + word(24), word(150), word(500), "q" * 70 + word(30), "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"]
    texts = [f'token = "{k}"' for k in keys for _ in range(5)] + ["commit f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "sha256 " + "0f" * 32, "the_name_of_a_variable_in_code_1", "w" * 40, "x" * 300_000]
    got = [r["spans"] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[: len(keys) * 5] == [f"secret:9:{9 + len(k)}" for k in keys for _ in range(5)]
    assert got[len(keys) * 5 :] == [""] * 5


def test_labelers_read_different_things():
    """The form reads the span, the list its value, the context what is around: each can differ while the others stay."""
    t = "call token = " + "ab12" * 10
    assert pii.votes("secret", t, 13, 53) == (0, 0, 1)
    assert pii.votes("secret", t.replace("token", "commit"), 14, 54) == (0, 0, -1)
    assert pii.votes("secret", "token sk_" + "live_" + "aB3d" * 6, 6, 38) == (1, 1, 1)
    assert pii.votes("secret", "noted xxxxxxxx1234" + "aB3d" * 6, 6, 42) == (1, -1, 0)
    assert pii.votes("name", "Dear Mr Carlos B. Smith", 8, 23) == (1, 1, 1)
    assert pii.votes("name", "said it. The Stone", 9, 18) == (-1, -1, -1)
    assert pii.votes("iban", "IBAN DE89 3704 0044 0532 0130 00", 5, 32) == (1, 1, 1)


def test_negatives_reach_the_estimate():
    """Candidates that no labeler supports are counted, so that shares of true ones are of all candidates."""
    found = pii.candidates("Thanea Onou went. commit " + "0a" * 20, [])
    assert [k for k, *_ in found] == ["secret", "name"] and all(max(pii.decode(c)[1]) <= 0 for *_, c in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=8))
def test_candidates_cross_no_base_span(spans):
    text = " ".join(f"{i:03d}-12-4321" for i in range(6))
    base = [("ip", a, a + n) for a, n in spans]
    want = [(a, a + 11) for a in range(0, 72, 12) if not any(a < e and s < a + 11 for _, s, e in base)]
    assert [(a, b) for k, a, b, _ in pii.candidates(text, base) if k == "national_id"] == want


def test_candidates_of_long_texts_are_quick():
    import time

    start = time.perf_counter()
    for t in ("a@b.cd " * 30_000 + "123-45-6789 " * 30_000, "Ab " * 200_000, "-a" * 300_000 + " at dot", "aA" * 300_000, "(123) " * 100_000, "AB12 " * 100_000):
        pii.candidates(t, pii.base_spans(t))
    assert time.perf_counter() - start < 20


def test_counts_by_kind(spark):
    docs = spark.createDataFrame([(1, "a@b.com 1.2.3.4 1.2.3.5"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_spans"]) == (1, 2, 3) and rows[2]["n_spans"] == 0
    assert {f"n_{k}" for k in pii.KINDS} < set(rows[1].asDict())


def test_whole_licences_are_found(spark):
    """Each licence's own text, wrapped at any width, alone and within other text, with what authors fill in."""
    import textwrap

    cases = []
    for name, t in license_scan.TEXTS.items():
        for width in (60, 80, 120, 10_000):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))
            cases += [(name, wrapped), (name, f"Some file.\nIts lines.\n\n{wrapped}\n\nMore of the file after it.\n\nand more"), (name, wrapped.replace("\n\n", "\n \t\n")), (name, "Copyright (c) 2020 A. Uthor\n\n" + wrapped.upper())]
    cases += [(None, "A text with license and software in it.\n\nand permission"), (None, "")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    # The two BSD texts share four of five paragraphs: the better one wins.
    assert [got[i]["text_license"] for i in range(len(cases))] == [name for name, _ in cases]
    assert all(got[i]["n_matches"] > 0 for i, (name, _) in enumerate(cases) if name)


def test_paragraphs_of_licences_are_notices(spark):
    import textwrap

    cases = [(k, textwrap.fill(t, w)) for k, t in license_scan.TEMPLATES.items() for w in (60, 10_000)]
    docs = spark.createDataFrame([(i, f"before it\n\n{t}\n\nbehind it") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert all(got[i]["dice"] == 1.0 and got[i]["license"] == k for i, (k, _) in enumerate(cases))


def test_licences_are_their_sql(spark):
    import duckdb
    import pandas as pd

    mit = license_scan.TEXTS["MIT"]
    texts = [mit, mit.replace("\n\n", "\n"), "x\n\n" + mit + "\n\ny", mit[: len(mit) // 2], None, "", license_scan.TEXTS["BSD-2-Clause"], "\n\n".join(["one two"] * 30), "Released under the MIT License.", "é\n \n" + license_scan.TEXTS["ISC"]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("matches")
    assert sorted(map(tuple, rows.collect())) == sorted(con.sql(license_scan.oracle()).select(*rows.columns).fetchall())
