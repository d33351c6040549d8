"""Quotation linking: conversations in reply order, without their quotes.

A line's quote level is the number of ">" it starts with.  Runs of lines of
one level are passages; a passage is normalised (lower case, letters and
digits alone) and hashed.  Quoted passages are joined, within a conversation,
to the first message that says the same in its own words (as any run of whole
lines, however they are wrapped) in an earlier turn.  A message replies to the
message that its outermost quote comes from; of several, the longest quote's,
then the latest.

Reply order: by root_turn, depth and turn, so that every message stands after
the one it replies to.  Messages that quote nothing are roots; a conversation
without quotes keeps the order of its turns.  position counts the messages of a
conversation in that order; conversations() joins them, in parts of PART
messages, so that no task holds a whole conversation of any size.

Nulls: a null text counts as empty.  Rows with null conv_id or turn neither
quote nor are quoted, and are their own roots; a null conv_id has no position.
Repeated rows each give a row, one behind the other.  Other columns are
ignored.  Texts of any length take linear time: quote marks and blanks are
trimmed, not matched by patterns.  Built-in operations alone; a conversation's
size doesn't matter, since nothing is gathered by it but the distinct sizes of
its passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Characters of a quote mark, of blanks; messages of a part of a conversation.
MARKS, BLANKS, PART = " \t>", " \t\n\x0b\f\r", 64


def bare(line: Column) -> Column:
    """The line without its quote marks and leading blanks."""
    return F.ltrim(line, F.lit(MARKS))


def level(line: Column) -> Column:
    """Quote level of a line: marks before its first other character."""
    mark = F.substring(line, F.lit(1), F.length(line) - F.length(bare(line)))
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def plain(text: Column) -> Column:
    """Normal form that is hashed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_text(text: Column) -> Column:
    """The lines of level 0, joined again; blanks at both ends go."""
    own = F.array_join(F.filter(F.split(text, "\n"), lambda x: level(x) == 0), "\n")
    return F.btrim(F.when(F.contains(text, F.lit(">")), own).otherwise(text), F.lit(BLANKS))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, size): each quoted passage of each message."""
    some = messages.where(F.contains("text", F.lit(">"))).where(F.exists(F.split("text", "\n"), lambda x: level(x) > 0)).select("conv_id", "turn", "text").distinct()
    some = some.select("conv_id", "turn", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    some = some.withColumn("level", level(F.col("line"))).withColumn("line", bare(F.col("line")))
    own = Window.partitionBy("conv_id", "turn", "key").orderBy("pos")  # the lines of one message
    some = some.withColumn("run", F.sum(F.when(F.lag("level").over(own) == F.col("level"), 0).otherwise(1)).over(own))
    runs = some.where("level > 0").groupBy("conv_id", "turn", "key", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    runs = runs.withColumn("text", plain(F.col("text"))).where("text <> ''")
    return runs.select("conv_id", "turn", "level", F.xxhash64("text").alias("hash"), F.length("text").alias("size"))


def originals(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, hash, original): the first turn that says a wanted passage in its own words."""
    sizes = wanted.groupBy("conv_id").agg(F.collect_set("size").alias("sizes"))
    said = messages.join(sizes, "conv_id").select("conv_id", "turn", own_text(F.col("text")).alias("own"), "sizes")
    lines = F.filter(F.transform(F.split("own", "\n"), plain), lambda x: x != "")
    said = said.withColumn("lines", lines).withColumn("said", F.array_join("lines", " "))
    # Where each line ends in said, by its length and one space for each line before.
    ends = F.aggregate("lines", F.array().cast("array<int>"), lambda ends, x: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)) + 1, F.lit(0)) + F.length(x))))
    said = said.withColumn("ends", ends).withColumn("starts", F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1)))

    def runs(start: Column) -> Column:
        """Hashes of the runs of whole lines from start whose size is wanted."""
        stops = F.array_intersect(F.transform("sizes", lambda n: start + n), F.col("ends"))
        return F.transform(stops, lambda e: F.xxhash64(F.substring("said", start + 1, e - start)))

    units = F.array_distinct(F.flatten(F.transform("starts", runs)))
    return said.select("conv_id", "turn", F.explode(units).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_quotes): messages with quotes, and what they reply to."""
    quoted = cut(passages(messages.where("conv_id is not null and turn is not null")))
    found = quoted.join(originals(messages, quoted), ["conv_id", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    rank = F.min(F.when(F.col("original").isNotNull(), F.struct("level", (-F.col("size")).alias("size"), (-F.col("original")).alias("original"))))
    return found.groupBy("conv_id", "turn").agg((-rank["original"]).alias("reply_to"), F.count("*").alias("n_quotes"))


def rooted(links: DataFrame) -> DataFrame:
    """links with root_turn and depth, by doubling the steps up in each round."""
    now = cut(links.withColumns({"up": F.col("reply_to"), "depth": F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long")}))
    while True:
        above = now.where("up is not null").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("next"), F.col("depth").alias("more"))
        if now.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left_semi").isEmpty():
            break
        now = now.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        now = cut(now.select("conv_id", "turn", "reply_to", "n_quotes", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return now.withColumn("root_turn", F.coalesce("up", "turn")).drop("up")


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, root_turn, depth, n_quotes, text) of each message; text is without quotes."""
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    out = m.join(rooted(replies(m)), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), own_text(F.col("text")).alias("text"))


def ordered(linked: DataFrame) -> DataFrame:
    """linked with position: 1, 2, ... in reply order within each conversation.

    All rows are sorted by ranges; a row's number in its range, and how many
    rows of its conversation other ranges hold before it, give its position.
    A conversation may thus lie over any number of tasks.
    """
    keys = ("conv_id", "root_turn", "depth", "turn", "role", "text")
    rows = linked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("n", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("range", F.shiftright("n", 33)))
    parts = rows.groupBy("conv_id", "range").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a conversation has ranges
    parts = parts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where("conv_id is not null").select("conv_id", "range", "first", "before")
    out = rows.join(parts, ["conv_id", "range"], "left")
    return out.select(*linked.columns, (F.col("n") - F.col("first") + F.col("before") + 1).alias("position"))


def formatted(linked: DataFrame) -> DataFrame:
    """linked with chat: role and text between the marks of a chat format."""
    return linked.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, chat): conversations in reply order without quotes, in parts of so many messages.

    Rows with null conv_id belong to no conversation and are left out.
    """
    rows = formatted(ordered(link(messages))).where("conv_id is not null")
    rows = rows.groupBy("conv_id", F.floor((F.col("position") - 1) / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("position", "chat"))).alias("held"))
    return rows.select("conv_id", "part", F.size("held").alias("n_messages"), F.array_join(F.transform("held", lambda x: x["chat"]), "").alias("chat"))


def oracle() -> str:
    """DuckDB SQL of op7's rows: every run of whole lines of every message against every quoted passage of its conversation."""
    bare, mark = "ltrim(line, ' >' || chr(9))", "substr(line, 1, length(line) - length(ltrim(line, ' >' || chr(9))))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    return f"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    l AS (SELECT r, conv_id, turn, pos, line, length({mark}) - length(replace({mark}, '>', '')) AS level, {norm(bare)} AS said
      FROM (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m)),
    own AS (SELECT r, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), {blanks}) AS text, list(said ORDER BY pos) FILTER (WHERE level = 0 AND said <> '') AS said FROM l GROUP BY r),
    g AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY pos) = level THEN 0 ELSE 1 END AS new FROM l)),
    first AS (SELECT conv_id, turn, text, min(r) AS r FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn, text),
    q AS (SELECT g.r, g.conv_id, g.turn, g.level, trim(string_agg(g.said, ' ' ORDER BY pos) FILTER (WHERE g.said <> ''), ' ') AS said
      FROM g JOIN first USING (r) WHERE g.level > 0 GROUP BY g.r, g.conv_id, g.turn, g.run, g.level),
    h AS (SELECT q.conv_id, q.turn, q.level, q.said, (SELECT min(m.turn) FROM m JOIN own USING (r) WHERE m.conv_id = q.conv_id AND m.turn < q.turn
        AND len(list_filter(range(1, len(own.said) + 1), lambda i: len(list_filter(range(i, len(own.said) + 1), lambda j: array_to_string(own.said[i:j], ' ') = q.said)) > 0)) > 0) AS original
      FROM q WHERE coalesce(q.said, '') <> ''),
    k AS (SELECT conv_id, turn, first(original ORDER BY original IS NULL, level, length(said) DESC, original DESC) AS reply_to, count(*) AS n_quotes FROM h GROUP BY conv_id, turn),
    up(conv_id, turn, above, depth) AS (SELECT conv_id, turn, turn, 0 FROM k UNION ALL SELECT up.conv_id, up.turn, k.reply_to, up.depth + 1 FROM up JOIN k ON k.conv_id = up.conv_id AND k.turn = up.above WHERE k.reply_to IS NOT NULL),
    top AS (SELECT conv_id, turn, first(above ORDER BY depth DESC) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn),
    o AS (SELECT m.conv_id, m.turn, m.role, k.reply_to, coalesce(top.root_turn, m.turn) AS root_turn, coalesce(top.depth, 0) AS depth, coalesce(k.n_quotes, 0) AS n_quotes, own.text
      FROM m JOIN own USING (r) LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn)
    SELECT conv_id, turn, role, reply_to, root_turn, CAST(depth AS BIGINT) AS depth, CAST(n_quotes AS BIGINT) AS n_quotes,
      CASE WHEN conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, text) END AS position,
      '<|' || coalesce(role, 'user') || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS chat FROM o"""
