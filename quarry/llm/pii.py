"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns with checks and
always stay.  Further kinds start as candidates, on which three labelers vote
for, against or not at all.  Each reads something else: the pattern labeler the
form of the span (character mix, check digits, numbering rules), the gazetteer
labeler what lists know of its value (key prefixes, published numbers, country
codes, names, domains), the context labeler the CONTEXT characters around it.
Expectation-maximisation over the counts of all vote patterns, with and without
support, estimates each labeler's reliability for each kind; the posteriors
then train a logistic span classifier on votes and discrete features of the
candidates, which decides every candidate.

Reliability is how often a vote is right for true and for false candidates,
where there is one; abstaining says nothing.  Bounds keep a labeler at least as
good as chance, and a kind's share of true candidates at half at most, so that
candidates on which all abstain or votes are even are no personal data.

Votes and features together have finitely many values (PATTERNS at most), so
their counts over all documents are a small table whatever the input.

Nulls: a null text counts as empty.  Null doc_id stay, repeated rows each give
a row, other columns are ignored.  Offsets are code points, ends exclusive.
Time is linear in a text, but for a search in its sorted base spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "national_id", "iban", "phone_local", "name", "email_words")
KINDS = BASE + ADDED

#: What the gazetteer labeler knows.
FIRST_NAMES = frozenset("""
james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica
thomas sarah charles karen hans peter wolfgang ursula klaus monika stefan sabine andreas petra pierre marie jean
nathalie michel isabelle philippe sylvie carlos maria jose carmen antonio ana manuel isabel francisco dolores
""".split())
KEY_PREFIXES = ("sk_live_", "sk_test_", "rk_live_", "pk_live_", "ghp_", "gho_", "ghs_", "github_pat_", "AKIA", "ASIA", "AIza", "npm_", "eyJ")
PLACEHOLDERS = re.compile(r"(?i)example|placeholder|dummy|sample|x{6}|0123456789|abcdefgh|(.)\1{9}")
PUBLISHED_IDS = frozenset(("078-05-1120", "219-09-9999", "123-45-6789", "111-11-1111"))
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FR GB GE GI GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split())
AREAS = frozenset("800 833 844 855 866 877 888 900".split())
DOMAINS = frozenset("com org net edu gov io de fr es it uk eu info".split())

#: Words around a candidate that speak for a kind, and against it.
CONTEXTS = {
    "secret": (frozenset("token secret password passwd pwd apikey api_key key credential credentials bearer auth authorization".split()), frozenset("commit commits sha sha1 sha256 md5 checksum digest hash hashes revision rev blob tree uuid guid etag".split())),
    "national_id": (frozenset("ssn social security passport identity tax taxpayer".split()), frozenset("part order invoice model sku serial ticket".split())),
    "iban": (frozenset("iban bic account konto bank cuenta compte".split()), frozenset("serial model order part licence license plate".split())),
    "phone_local": (frozenset("tel phone call mobile cell fax telefon telephone telefono".split()), frozenset("order invoice version serial part account ticket".split())),
    "name": (frozenset("mr mrs ms dr prof herr frau monsieur madame senor senora sincerely regards dear name".split()), frozenset("street city lake mount river university company the".split())),
    "email_words": (frozenset("mail email e-mail contact write kontakt contacto reach".split()), frozenset("look looked arrive arrived meet stood".split())),
}
#: Words that begin sentences, in the four languages of the corpus.
OPENERS = frozenset("the a an in on at of and but this that when if it he she they we der die das und ein eine im am le la les un une et el los las y en de von zu que".split())

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

_AT, _DOT = (rf"(?: ?[\[(]{w}[\])] ?| {w} )" for w in ("(?:at|AT)", "(?:dot|DOT)"))
CANDIDATES = {
    "secret": re.compile(r"(?<![0-9A-Za-z_])[0-9A-Za-z_]{24,}+"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
    "phone_local": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "name": re.compile(r"(?<![\w.])[A-ZÀ-ÖØ-Þ](?:\.|[a-zà-öø-ÿ]++)(?: [A-Z]\.)? [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]++(?: [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]++)?(?!\w)"),
    "email_words": re.compile(rf"(?<![\w.-])[A-Za-z0-9._-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+(?!\w)"),
}
#: A text without this has no candidate of the kind.
NEEDS = {"secret": re.compile(r"[0-9A-Za-z_]{24}"), "national_id": re.compile(r"[0-9]-[0-9]"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "phone_local": re.compile(r"[0-9][ .-][0-9]{4}"), "email_words": re.compile(r"dot|DOT")}
CONTEXT = 32
LABELERS, FEATURES = 3, 6
PATTERNS = len(ADDED) * 3**LABELERS * 2**FEATURES
#: Votes of a labeler, right and wrong, before any is seen; bounds of how often it is right, and of the share of true candidates.
PRIOR, RIGHT, SHARE = (6.0, 1.0), (0.5, 0.99), (0.01, 0.5)


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @; linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end:
            low = max(end, start - 64)
            stop = max((m.end() for m in NOT_LOCAL.finditer(text, low, start)), default=low)
            start, whole = stop, stop == low
            if not whole:
                break
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start; matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def words_around(text: str, start: int, end: int) -> list[str]:
    """Words of the CONTEXT characters on either side, the nearest one before the span first."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    return WORD.findall(before.lower())[::-1] + WORD.findall(after.lower())


WORD = re.compile(r"[a-z0-9_-]+")
HEX = re.compile(r"[0-9a-f]+")


def form(kind: str, span: str) -> int:
    """Vote on the span's form alone: 1 for, -1 against, 0 none."""
    if kind == "secret":
        numbers = sum(c.isdigit() for c in span)
        if not numbers or (span.islower() and "_" in span and numbers < 4):
            return -1  # a long word, or an identifier of words
        if HEX.fullmatch(span):
            return 0  # a digest looks the same
        return 1 if numbers >= 4 or (not span.islower() and not span.isupper()) else 0
    if kind == "national_id":
        a, b, c = span.split("-")
        return 1 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -1
    if kind == "iban":
        flat = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    if kind == "phone_local":
        return 1 if re.fullmatch(r"(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}([ .-]))[2-9][0-9]{2}(?(1)\1|[ .-])[0-9]{4}", span) else -1
    if kind == "name":
        parts = span.split()
        if parts[0].lower() in OPENERS or any(len(p.strip(".")) > 14 for p in parts):
            return -1
        return 1 if any(len(p.strip(".")) == 1 for p in parts) else 0
    return 1 if "[" in span or "(" in span else 0


def listed(kind: str, span: str) -> int:
    """Vote by what lists know of the span's value."""
    if kind == "secret":
        return 1 if span.startswith(KEY_PREFIXES) else -1 if PLACEHOLDERS.search(span) else 0
    if kind == "national_id":
        return -1 if span in PUBLISHED_IDS else 0
    if kind == "iban":
        return 1 if span[:2] in COUNTRIES else -1
    if kind == "phone_local":
        area = span.strip("(")[:3]
        return -1 if area[1:] == "11" or area < "200" else 1 if area in AREAS else 0
    if kind == "name":
        return 1 if span.split()[0].lower() in FIRST_NAMES else -1
    return 1 if WORD.findall(span.lower())[-1] in DOMAINS else -1


def context(kind: str, text: str, start: int, end: int) -> int:
    """Vote by the words around: of those that speak for or against, the nearest one decides."""
    yes, no = CONTEXTS[kind]
    for w in words_around(text, start, end):
        if w in yes or w in no:
            return 1 if w in yes else -1
    if kind == "name" and (not (gap := text[max(0, start - 3) : start].rstrip()) or gap[-1] in ".!?|:"):
        return -1  # any sentence begins with a capital
    return 0


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, int, int]:
    """Form, list and context: 1 for, -1 against, 0 no vote."""
    span = text[start:end]
    return form(kind, span), listed(kind, span), context(kind, text, start, end)


def shape(span: str, text: str, a: int, b: int) -> tuple[bool, ...]:
    """Discrete features that the classifier reads beside the kind."""
    return (len(span) >= 20, len(span) >= 40, any(c.isdigit() for c in span), span.lower() == span, text[a - 1 : a] in ("'", '"'), "=" in text[max(0, a - 4) : a] or ":" in text[max(0, a - 4) : a])


def code(kind: int, vote: tuple[int, ...], feature: tuple[bool, ...]) -> int:
    out = kind
    for v in vote:
        out = out * 3 + v + 1
    for f in feature:
        out = out * 2 + f
    return out


def decode(value: int) -> tuple[int, list[int], list[int]]:
    feature, vote = [], []
    for _ in range(FEATURES):
        value, f = divmod(value, 2)
        feature.append(f)
    for _ in range(LABELERS):
        value, v = divmod(value, 3)
        vote.append(v - 1)
    return value, vote[::-1], feature[::-1]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """Candidates that cross no base span: kind, start, end and the code of votes and features."""
    out = []
    starts, ends = [], []  # base spans joined where they cross, in order
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s), ends.append(e)
    for k, kind in enumerate(ADDED):
        if kind in NEEDS and not NEEDS[kind].search(text):
            continue
        for m in CANDIDATES[kind].finditer(text):
            a, b = m.span()
            before = bisect.bisect_left(starts, b) - 1
            if before < 0 or ends[before] <= a:
                out.append((kind, a, b, code(k, votes(kind, text, a, b), shape(m[0], text, a, b))))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts, base_sha256, base, candidates): base spans as kind:start:end, candidates with their codes."""

    def run(ids, texts):
        rows = []
        for t in texts:
            base = base_spans(t or "")
            listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            n = [sum(k == kind for k, *_ in base) for kind in BASE]
            found = [{"kind": k, "start": a, "end": b, "code": c} for k, a, b, c in candidates(t or "", base)]
            rows.append((*n, hashlib.sha256(listed.encode()).hexdigest(), listed, found))
        return [ids, *zip(*rows, strict=True)]

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<kind: string, start: int, end: int, code: int>>"
    return map_texts(docs.select(doc_id, text), run, schema)


def reliabilities(kinds: np.ndarray, vote: np.ndarray, count: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and P(vote | truth) by kind, labeler, truth and vote, by EM.

    Votes are independent given the truth, and abstaining doesn't depend on it.
    PRIOR counts of right and wrong votes stand for a fairly good labeler.
    """
    right = np.full((len(ADDED), LABELERS, 2), PRIOR[0] / sum(PRIOR))  # by truth: P(the vote is right | there is one)
    abstain = np.full((len(ADDED), LABELERS), 0.5)
    share = np.full(len(ADDED), SHARE[1])
    post = np.full(len(kinds), 0.5)
    for _ in range(steps):
        odds = np.log(share / (1 - share))[kinds]
        for j in range(LABELERS):
            yes, no = right[kinds, j, 1], right[kinds, j, 0]
            odds = odds + np.where(vote[:, j] == 1, np.log(yes / (1 - no)), np.where(vote[:, j] == -1, np.log((1 - yes) / no), 0.0))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for k in range(len(ADDED)):
            own = kinds == k
            weight = np.stack([(1 - post[own]) * count[own], post[own] * count[own]])
            share[k] = np.clip((weight[1].sum() + 2) / (weight.sum() + 4), *SHARE)
            for j in range(LABELERS):
                v = vote[own, j]
                abstain[k, j] = (weight.sum(0)[v == 0].sum() + 1) / (weight.sum() + 2)
                for truth, sign in ((0, -1), (1, 1)):
                    hit, miss = weight[truth][v == sign].sum(), weight[truth][v == -sign].sum()
                    right[k, j, truth] = np.clip((hit + PRIOR[0]) / (hit + miss + sum(PRIOR)), *RIGHT)
    table = np.empty((len(ADDED), LABELERS, 2, 3))
    table[..., 1] = abstain[..., None]
    for truth, sign in ((0, -1), (1, 1)):
        table[:, :, truth, 1 + sign] = (1 - abstain) * right[:, :, truth]
        table[:, :, truth, 1 - sign] = (1 - abstain) * (1 - right[:, :, truth])
    return post, table


def inputs(kinds: np.ndarray, vote: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Classifier inputs: kind, each labeler's votes, the features."""
    return np.concatenate([np.eye(len(ADDED))[kinds], (vote == 1), (vote == -1), feature], axis=1).astype(float)


def train(x: np.ndarray, target: np.ndarray, count: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression on soft targets, by damped Newton steps with a small ridge."""
    w, weight = np.zeros(x.shape[1]), count / count.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(scanned: DataFrame) -> list[int]:
    """Codes that the trained classifier accepts, from the counts of codes over all documents."""
    rows = scanned.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()  # PATTERNS rows at most
    if not rows:
        return []
    rows = sorted((r["code"], r["count"]) for r in rows)
    parts = [decode(c) for c, _ in rows]
    kinds, vote, feature = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    count = np.array([n for _, n in rows], dtype=float)
    post, _ = reliabilities(kinds, vote, count)
    x = inputs(kinds, vote, feature)
    p = 1 / (1 + np.exp(-np.clip(x @ train(x, post, count), -30, 30)))
    return [c for (c, _), v in zip(rows, p, strict=True) if v > 0.5]


def accepted(codes: list[int]) -> Column:
    """The candidates, in order, that the classifier accepts."""
    listed = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<int>")
    return F.filter("found", lambda c: F.array_contains(listed, c["code"]))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and accepted ones of each row, as kind:start:end in spans, with counts by kind.

    (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), then
    n_<kind> for each added kind.
    """
    scanned = cut(scan(docs, doc_id, text))
    rows = scanned.withColumn("found", accepted(fit(scanned)))
    more = F.transform("found", lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"]))
    spans = F.array_join(F.filter(F.concat(F.array("base"), more), lambda s: s != ""), ",")
    base = ("n_email", "n_ip", "n_card", "n_phone")
    total = sum((F.col(n) for n in base), F.size("found").cast("long"))
    count = lambda kind: F.size(F.filter("found", lambda c: c["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in ADDED]
    return rows.select("doc_id", *base, "base_sha256", spans.alias("spans"), total.alias("n_spans"), *counts)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of a text replaced by its kind in angle brackets.

    Crossing spans are replaced as one, by the kind of the first.  A null
    text stays null; n_chars, where there is one, follows the text; all other
    columns stay as they are.
    """
    codes = frozenset(fit(scan(docs.select(F.lit(0).alias("row"), F.col(text).alias("text")), "row")))

    def cleaned(t: str | None) -> str | None:
        if t is None:
            return None
        base = base_spans(t)
        spans = sorted([(a, b, k) for k, a, b in base] + [(a, b, k) for k, a, b, c in candidates(t, base) if c in codes])
        out, end, i = [], 0, 0
        while i < len(spans):
            a, b, k = spans[i]
            i += 1
            while i < len(spans) and spans[i][0] < b:
                b = max(b, spans[i][1])
                i += 1
            out += [t[end:a], f"<{k}>"]
            end = b
        return "".join(out) + t[end:]

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(values):
        return values.map(cleaned)

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns and text == "text" else out
