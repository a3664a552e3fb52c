"""Chat formatting by quotation linking.

Lines that start with marks (">", possibly several, with blanks between) are quotes; the number of
marks is the level. Each run of lines of one level is a passage. Passages are normalised (lower case,
letters and digits only, single spaces) and hashed; the same is done for every sentence-like line of
what a message says itself, and for all of it; and for each run of such lines that is as long as a
quote which begins with the same line (lines without letters and digits don't count). A quote is
linked to the earliest other message that has the same hash: of the same conversation if there is
one, else of any. A conversation
is read in reply order, without quotes: links within it form threads, a message that quotes follows
the thread of what it quotes, and threads come in the order of their first turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.llm.common import Stage, plain

MARKS = r"^[\x20\t]*(?:>[\x20\t]*)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, f"({MARKS})", 1), r"[\x20\t]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, line, level, body for each line of each message; null texts have none."""
    out = messages.select("conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    return out.select("conv_id", "turn", "line", _level(F.col("raw")).alias("level"), F.trim(F.regexp_replace("raw", MARKS, "")).alias("body"))


def passages(split: DataFrame) -> DataFrame:
    """Runs of lines of one level: conv_id, turn, level, first line, parts (normalised lines that aren't empty), hash (null if there are none)."""
    by = W.partitionBy("conv_id", "turn").orderBy("line")
    cut = split.withColumn("new", (F.coalesce(F.lag("level").over(by), F.lit(-1)) != F.col("level")).cast("int"))
    cut = cut.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"])
    out = cut.groupBy("conv_id", "turn", "run", "level").agg(F.min("line").alias("line"), ordered.alias("bodies"))
    out = out.withColumn("parts", F.filter(F.transform("bodies", normalised), lambda x: x != ""))
    return out.withColumn("hash", F.when(F.size("parts") > 0, _joined(F.col("parts")))).drop("run", "bodies")


def _joined(parts: Column) -> Column:
    """The hash of normalised lines: that of their text when normalised as one."""
    return F.sha2(F.array_join(parts, " "), 256)


def _hash(body: Column) -> Column:
    clean = normalised(body)
    return F.when(clean != "", F.sha2(clean, 256))


def excerpts(found: DataFrame) -> DataFrame:
    """conv_id, turn, hash of the consecutive lines of unquoted passages that are as many as a quote of several lines that begins like them."""
    begins = found.filter("level > 0 and size(parts) > 1").select(F.col("parts")[0].alias("begin"), F.size("parts").alias("n"))
    begins = begins.groupBy("begin").agg(F.collect_set("n").alias("sizes"))
    own = found.filter("level = 0 and size(parts) > 1").select("conv_id", "turn", "line", "parts")
    at = own.select("conv_id", "turn", "line", F.posexplode("parts").alias("pos", "begin")).join(begins, "begin")
    at = at.groupBy("conv_id", "turn", "line").agg(F.collect_list(F.struct("pos", "sizes")).alias("at"))  # at most a message's own lines
    inside = lambda x: F.transform(F.filter(x["sizes"], lambda n: x["pos"] + n <= F.size("parts")), lambda n: _joined(F.slice("parts", x["pos"] + 1, n)))
    hashes = F.array_distinct(F.flatten(F.transform("at", inside)))
    return own.join(at, ["conv_id", "turn", "line"]).select("conv_id", "turn", F.explode(hashes).alias("hash"))


def link(spark: SparkSession, messages: DataFrame, stage: Stage | None = None) -> DataFrame:
    """conv_id, turn, level, line, hash, to_conv, to_turn for each quoted passage; the ends are null where nothing matches."""
    stage = stage or Stage(spark, "quotes")
    split = stage.write(lines(messages), "lines")
    found = stage.write(passages(split), "passages")
    quotes = found.filter("level > 0 and hash is not null")
    wanted = quotes.select("hash").distinct()
    said = found.filter("level = 0").select("conv_id", "turn", "hash").unionByName(split.filter("level = 0").select("conv_id", "turn", _hash(F.col("body")).alias("hash")))
    said = said.unionByName(excerpts(found))
    said = said.filter("hash is not null").join(wanted, "hash", "left_semi").distinct()
    # The earliest in each conversation (one row for each hash and conversation), then the earliest of all, and that of the next conversation.
    near = stage.write(said.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn")), "near")
    first = near.groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("any"))
    later = near.join(first, "hash").filter(F.col("conv_id") > F.col("any.conv_id"))
    second = later.groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("next"))
    out = quotes.join(near, ["hash", "conv_id"], "left").join(first, "hash", "left").join(second, "hash", "left")
    inside = F.col("near_turn").isNotNull() & (F.col("near_turn") < F.col("turn"))
    outside = F.when(F.col("any.conv_id") == F.col("conv_id"), F.col("next")).otherwise(F.col("any"))
    return out.select(
        "conv_id", "turn", "level", "line", "hash",
        F.when(inside, F.col("conv_id")).otherwise(outside["conv_id"]).alias("to_conv"),
        F.when(inside, F.col("near_turn")).otherwise(outside["near_turn"]).alias("to_turn"),
    )


def threads(stage: Stage, links: DataFrame) -> DataFrame:
    """conv_id, turn, thread: the turn at which the chain of links within the conversation ends, by pointer doubling.

    Links lead to earlier turns, so chains end; a chain of n links takes log2(n) rounds.
    """
    now, turn = stage.write(links, "thread-0"), 0
    while True:
        step = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"))
        joined = now.join(step, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        turn += 1
        after = stage.write(joined.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")), f"thread-{turn}")
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return now


def conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, n_linked, quote_depth, reply_conv, reply_turn, thread, place for each message.

    A message replies to the message that its first linked quote of the least level comes from; without
    one, to the message of the turn before in its conversation. ``place`` is its number in reply order.
    Null texts are kept as they are; repeated messages (same conv_id and turn) count once, by the smallest
    role and text; messages without a conv_id or turn are left out, as no reply can name them. An empty
    table gives no rows.
    """
    stage = Stage(spark, "quotes")
    given = plain(messages, "conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    given = stage.write(given.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text"), "given")
    links = stage.write(link(spark, given, stage), "links")
    quotes = links.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.max("level").alias("quote_depth"), F.count("to_conv").alias("n_linked"),
        F.min(F.when(F.col("to_conv").isNotNull(), F.struct("level", "line", "to_conv", "to_turn"))).alias("first"),
    )
    quotes = stage.write(quotes, "quotes")
    roots = threads(stage, quotes.filter("first.to_conv = conv_id").select("conv_id", "turn", F.col("first.to_turn").alias("thread")))
    kept = F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike(MARKS))
    by = W.partitionBy("conv_id").orderBy("turn")
    out = given.join(quotes, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left").withColumn("text", F.array_join(kept, "\n"))
    out = out.withColumn("before", F.lag("turn").over(by)).withColumn("thread", F.coalesce("thread", "turn"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("thread", "turn"))
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("quote_depth", F.lit(0)).cast("long").alias("quote_depth"), F.coalesce("first.to_conv", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("first.to_turn", "before").alias("reply_turn"), "thread", place.cast("long").alias("place"),
    )


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, min(struct_pack(role := role, text := text)) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
g AS (SELECT conv_id, turn, m.role AS role, m.text AS text FROM m),
l AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS line FROM g WHERE text IS NOT NULL),
q AS (
  SELECT conv_id, turn, line, raw, len(regexp_replace(regexp_extract(raw, '^[\x20\t]*(?:>[\x20\t]*)+'), '[\x20\t]', '', 'g')) AS level,
         trim(regexp_replace(raw, '^[\x20\t]*(?:>[\x20\t]*)+', ''), ' ') AS body FROM l),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN coalesce(lag(level) OVER (PARTITION BY conv_id, turn ORDER BY line), -1) <> level THEN 1 ELSE 0 END AS fresh FROM q) x),
b AS (SELECT *, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS clean FROM c),
n AS (SELECT conv_id, turn, run, level, min(line) AS line, coalesce(list(clean ORDER BY line) FILTER (clean <> ''), []) AS parts FROM b GROUP BY conv_id, turn, run, level),
p AS (SELECT conv_id, turn, level, line, parts, array_to_string(parts, ' ') AS norm FROM n WHERE level > 0 AND len(parts) > 0),
begins AS (SELECT DISTINCT parts[1] AS start, len(parts) AS size FROM p WHERE len(parts) > 1),
s AS (
  SELECT DISTINCT conv_id, turn, norm FROM (
    SELECT conv_id, turn, array_to_string(parts, ' ') AS norm FROM n WHERE level = 0
    UNION ALL SELECT conv_id, turn, clean FROM b WHERE level = 0
    UNION ALL SELECT conv_id, turn, array_to_string(list_slice(parts, i, i + size - 1), ' ')
      FROM (SELECT conv_id, turn, parts, unnest(generate_series(1, len(parts))) AS i FROM n WHERE level = 0 AND len(parts) > 1) x JOIN begins ON begins.start = x.parts[x.i] AND x.i + size - 1 <= len(x.parts)) y
  WHERE norm <> '' AND norm IN (SELECT norm FROM p)),
k AS (
  SELECT p.conv_id, p.turn, p.level, p.line,
         (SELECT min(s.turn) FROM s WHERE s.norm = p.norm AND s.conv_id = p.conv_id) AS near_turn,
         (SELECT min(struct_pack(conv_id := s.conv_id, turn := s.turn)) FROM s WHERE s.norm = p.norm AND s.conv_id <> p.conv_id) AS far
  FROM p),
t AS (
  SELECT conv_id, turn, level, line, CASE WHEN near_turn < turn THEN conv_id ELSE far.conv_id END AS to_conv, CASE WHEN near_turn < turn THEN near_turn ELSE far.turn END AS to_turn FROM k),
u AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(to_conv) AS n_linked, max(level) AS quote_depth,
         min(CASE WHEN to_conv IS NOT NULL THEN struct_pack(level := level, line := line, to_conv := to_conv, to_turn := to_turn) END) AS f
  FROM t GROUP BY conv_id, turn),
h AS (
  SELECT conv_id, turn, f.to_turn AS thread FROM u WHERE f.to_conv = conv_id
  UNION SELECT h.conv_id, h.turn, u.f.to_turn FROM h JOIN u ON u.conv_id = h.conv_id AND u.turn = h.thread WHERE u.f.to_conv = u.conv_id),
z AS (SELECT conv_id, turn, min(thread) AS thread FROM h GROUP BY conv_id, turn),
o AS (
  SELECT g.*, u.n_quotes, u.n_linked, u.quote_depth, u.f, lag(g.turn) OVER (PARTITION BY g.conv_id ORDER BY g.turn) AS prior, coalesce(z.thread, g.turn) AS thread
  FROM g LEFT JOIN u ON u.conv_id = g.conv_id AND u.turn = g.turn LEFT JOIN z ON z.conv_id = g.conv_id AND z.turn = g.turn)
SELECT conv_id, turn, role, array_to_string(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: NOT regexp_matches(x, '^[\x20\t]*(?:>[\x20\t]*)+')), chr(10)) AS text,
       coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(quote_depth, 0)::BIGINT AS quote_depth,
       coalesce(f.to_conv, CASE WHEN prior IS NOT NULL THEN conv_id END) AS reply_conv, coalesce(f.to_turn, prior) AS reply_turn, thread,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) AS place
FROM o
"""
