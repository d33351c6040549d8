"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic.  The tokens of the
cells are raked, margin after margin, until the tokens of each source, language
and topic stand in their target shares; a cell's ratio of raked to own tokens
then gives the probability with which its documents are sampled.  Sampling
compares a hash of doc_id with that probability, so it is the same in any run.

Target shares: those given for a margin, else the tempered shares of the
corpus, tokens ** TEMPER.  A category that given targets don't name keeps its
share of the corpus, and the named ones divide the rest; a target of zero is
the only way to drop a category.

Probabilities are calibrated: the sample keeps at most the share of tokens that
the scarcest category allows, each round bounds a cell by the tokens it has,
and rounds go on until no category misses its target by more than MISSED.  Where
targets contradict the cells, LIMIT rounds end it; report() tells what is missed.

Cells are counted first.  Up to CELLS of them are raked as arrays and joined to
the documents as a broadcast table; more are raked as a table, a written one
for each round.  Both give the same weights.

Nulls: a null source, language or topic is a category of its own; a null text
has topic "empty" and one token, as any text without a space.  A null doc_id
is hashed as empty text.  Repeated rows are sampled alike.  Other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, discard

MARGINS = ("source", "lang", "topic")
AIMS = tuple(f"aim_{m}" for m in MARGINS)
TEMPER, KEEP = 0.7, 0.9
#: Rounds without a bound; bounded ones, at most, and the largest relative miss of a category at which they end.
ROUNDS, LIMIT, MISSED = 10, 100, 0.001
#: Cells that the driver may hold: about 10 MB.  More are raked as a table.
CELLS = 1 << 16


def topic(text: str | Column = "text") -> Column:
    """Coarse topic of a text, by what it holds."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (
        F.when(F.trim(t) == "", "empty")
        .when(F.contains(t, F.lit("icense")), "license")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("@")) | F.contains(t, F.lit(" = ")), "records")
        .otherwise("prose")
    )


def tokens(text: str | Column = "text") -> Column:
    """Words between spaces, as long."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(doc_id: str | Column = "doc_id") -> Column:
    """A number in [0, 1) by the first 52 bits of the MD5 of doc_id as text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def aimed(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float | None) -> tuple[DataFrame, int]:
    """cells with the tokens to reach of each one's categories (AIMS), and the number of cells.

    With keep, aims sum to that share of all tokens, or to what the scarcest
    category allows.  A category's share of a total is summed over its cells,
    each with its part of the category's tokens.
    """
    rows = cells
    for m in MARGINS:
        rows = rows.withColumn(f"t_{m}", F.sum("tokens").over(Window.partitionBy(m)))
    raw, sums = {}, []
    for m in MARGINS:
        given = (targets or {}).get(m)
        share = F.pow(f"t_{m}", F.lit(TEMPER)) if given is None else F.lit(None).cast("double")
        for name, value in (given or {}).items():
            share = F.when(F.col(m) == name, float(value)).otherwise(share)
        raw[m] = share
        part = F.col("tokens") / F.col(f"t_{m}")
        sums += [F.sum(share * part).alias(f"named_{m}"), F.sum(F.when(share.isNull(), F.col("tokens"))).alias(f"rest_{m}")]
    whole = rows.agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), *sums).first()
    total, shares = whole["total"] or 1.0, {}
    for m in MARGINS:
        rest = (whole[f"rest_{m}"] or 0.0) / total
        shares[m] = F.when(raw[m].isNull(), F.col(f"t_{m}") / total).otherwise(raw[m] * ((1 - rest) / (whole[f"named_{m}"] or 1.0)))
    scale = 1.0
    if keep is not None:
        scarce = rows.agg(*(F.min(F.when(shares[m] > 0, F.col(f"t_{m}") / (shares[m] * total))) for m in MARGINS)).first()
        scale = min(keep, *(s for s in scarce if s is not None)) if whole["n"] else keep
    return rows.select(*cells.columns, *(shares[m] * (total * scale) for m in MARGINS)).toDF(*cells.columns, *AIMS), whole["n"]


def missed(sums: np.ndarray, aim: np.ndarray) -> float:
    """Largest relative distance of a margin's sums from its aims."""
    some = aim > 0
    return float(np.abs(sums[some] / aim[some] - 1).max(initial=0.0))


def rake_arrays(held: pd.DataFrame, rounds: int, bounded: bool) -> np.ndarray:
    """Raked tokens of the cells; with bounded, each round starts from the cells' own tokens at most."""
    own = held["tokens"].to_numpy()
    codes = [pd.factorize(held[m])[0] for m in MARGINS]
    aims = [np.zeros(c.max(initial=-1) + 1) for c in codes]
    for c, aim, name in zip(codes, aims, AIMS, strict=True):
        aim[c] = held[name]
    w = own.copy()
    for _ in range(rounds):
        w = np.minimum(w, own) if bounded else w
        for c, aim in zip(codes, aims, strict=True):
            s = np.bincount(c, w, len(aim))
            w = w * np.divide(aim, s, out=np.zeros_like(s), where=s > 0)[c]
        if bounded and max(missed(np.bincount(c, w, len(a)), a) for c, a in zip(codes[:-1], aims[:-1], strict=True)) <= MISSED:
            break  # the last margin is exact
    return w


def rake_table(now: DataFrame, rounds: int, bounded: bool) -> DataFrame:
    """rake_arrays() over a table of any size; each round is written to the shared folder."""
    now, last = now.withColumn("w", F.col("tokens")), None
    for _ in range(rounds):
        now = now.withColumn("w", F.least("w", "tokens")) if bounded else now
        for m, aim in zip(MARGINS, AIMS, strict=True):
            s = F.sum("w").over(Window.partitionBy(m))
            now = now.withColumn("w", F.when(s > 0, F.col("w") * F.col(aim) / s).otherwise(0.0))
        now = cut(now)
        if last is not None:
            discard(last)
        last = now
        if bounded:
            misses = [now.groupBy(m).agg(F.sum("w").alias("s"), F.first(aim).alias("a")).where("a > 0").agg(F.max(F.abs(F.col("s") / F.col("a") - 1))).first()[0] or 0.0 for m, aim in zip(MARGINS[:-1], AIMS[:-1], strict=True)]
            if max(misses) <= MISSED:
                break
    return now


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int | None = None, keep: float | None = None) -> DataFrame:
    """cells with a column w: tokens raked to the target shares of each margin.

    cells: MARGINS and tokens (double).  Without keep, w sums to all tokens and
    may exceed a cell's own; with it, cells are bounded (see the top).  A table
    of up to CELLS is marked to be broadcast.
    """
    rows, n = aimed(cells, targets, keep)
    rounds = rounds or (ROUNDS if keep is None else LIMIT)
    if n > CELLS:
        return rake_table(rows, rounds, keep is not None)
    held = rows.toPandas()  # CELLS rows at most
    held["w"] = rake_arrays(held, rounds, keep is not None) if n else held["tokens"]
    return F.broadcast(cells.sparkSession.createDataFrame(pa.Table.from_pandas(held, preserve_index=False), rows.withColumn("w", F.lit(0.0)).schema))


def calibrated(cells: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells with w and p, the probabilities whose expected tokens stand in the target shares.

    p is w / tokens, lowered for all cells alike until it is 1 at most.
    """
    raked = rake(cells, targets, keep=keep)
    room = raked.where("w > 0").agg(F.min(F.col("tokens") / F.col("w"))).first()[0]
    return raked.withColumn("p", F.least(F.lit(1.0), min(1.0, room or 1.0) * F.col("w") / F.col("tokens")))


def celled(docs: DataFrame) -> DataFrame:
    """(row, _source, _lang, _topic, _tokens): each row of docs as a struct, and its cell."""
    null = F.lit("(null)")
    return docs.select(F.struct("*").alias("row"), F.coalesce(docs["source"], null).alias("_source"), F.coalesce(docs["lang"], null).alias("_lang"), topic(docs["text"]).alias("_topic"), tokens(docs["text"]).alias("_tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    """The cells of celled() rows, written to the shared folder."""
    return cut(rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").cast("double").alias("tokens")))


def weighted(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(row, _source, _lang, _topic, _tokens, _p, _taken): row is the row of docs, _p its probability.

    keep: the most to sample, as a share of all tokens.
    """
    rows = celled(docs)
    raked = calibrated(cells_of(rows), keep, targets)
    p = raked.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), F.col("p").alias("_p"))
    return rows.join(p, ["_source", "_lang", "_topic"]).withColumn("_taken", uniform(F.col("row.doc_id")) < F.col("_p"))


def sample(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of docs, with their own columns: keep of all tokens at most, in the target shares."""
    return weighted(docs, keep, targets).where("_taken").select("row.*")


def report(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, category, tokens, target, reached, shortfall): shares of the sample asked for and expected, of every category."""
    rows = calibrated(cells_of(celled(docs)), keep, targets)
    kept = rows.agg(F.sum(F.col("p") * F.col("tokens"))).first()[0] or 1.0
    out = None
    for m, aim in zip(MARGINS, AIMS, strict=True):
        own = rows.groupBy(F.col(m).alias("category")).agg(F.sum("tokens").alias("tokens"), F.first(aim).alias("aim"), (F.sum(F.col("p") * F.col("tokens")) / kept).alias("reached"))
        target = F.col("aim") / F.sum("aim").over(Window.partitionBy("margin"))
        own = own.withColumn("margin", F.lit(m)).withColumn("target", target).select("margin", "category", "tokens", "target", "reached", F.greatest(F.lit(0.0), F.col("target") - F.col("reached")).alias("shortfall"))
        out = own if out is None else out.unionByName(own)
    return out


def oracle() -> str:
    """DuckDB SQL of weighted() over documents, as op3 returns it: the same rounds in a recursive table."""
    topic_sql = """CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty' WHEN contains(text, 'icense') THEN 'license'
      WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') OR contains(text, ' = ') THEN 'records' ELSE 'prose' END"""
    aims = ", ".join(AIMS)
    share = ", ".join(f"pow(t_{m}, {TEMPER}) / sum(pow(t_{m}, {TEMPER}) * tokens / t_{m}) OVER () AS share_{m}" for m in MARGINS)
    scale = f"(SELECT least({KEEP}, {', '.join(f'min(t_{m} / (share_{m} * total))' for m in MARGINS)}) FROM s)"
    step = "SELECT n, source, lang, topic, tokens, least(w, tokens) AS w, " + aims + f" FROM r WHERE n < {LIMIT} AND miss > {MISSED}"
    for m in MARGINS:
        step = f"SELECT * REPLACE (w * aim_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM ({step})"
    off = ", ".join(f"abs(sum(w) OVER (PARTITION BY {m}) / aim_{m} - 1)" for m in MARGINS[:-1])
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, {topic_sql} AS topic,
      CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS BIGINT) AS tokens FROM documents),
    c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY source, lang, topic),
    t AS (SELECT *, sum(tokens) OVER () AS total, {', '.join(f'sum(tokens) OVER (PARTITION BY {m}) AS t_{m}' for m in MARGINS)} FROM c),
    s AS MATERIALIZED (SELECT *, {share} FROM t),
    a AS MATERIALIZED (SELECT source, lang, topic, tokens, {', '.join(f'share_{m} * total * {scale} AS aim_{m}' for m in MARGINS)} FROM s),
    r AS (
      SELECT 0 AS n, source, lang, topic, tokens, tokens AS w, {aims}, CAST(1 AS DOUBLE) AS miss FROM a
      UNION ALL
      SELECT n + 1, source, lang, topic, tokens, w, {aims}, max(off) OVER () AS miss FROM (SELECT *, greatest({off}) AS off FROM ({step}))
    ),
    w AS MATERIALIZED (SELECT * FROM r WHERE n = (SELECT max(n) FROM r)),
    p AS (SELECT source, lang, topic, least(1.0, least(1.0, (SELECT min(tokens / w) FROM w WHERE w > 0)) * w / tokens) AS p FROM w)
    SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS p, u < p AS taken
    FROM (SELECT d.*, p.p, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} AS u
      FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic)"""
