"""Chat formatting by quotation linking, in DataFrame functions only.

A message's quoted passages (runs of lines with ``>`` marks, nested to any depth, of one depth) are normalised without line
breaks; each is joined to its original: of all earlier messages of its conversation the one whose own words cover most
of the passage, the latest on ties. A message replies to the original of its shallowest, longest quotes. Threads follow
replies up to their first message; ordering a conversation by (thread, position) puts every reply below what it answers,
before the next reply to that, and ``text`` no longer holds the quotes whose originals are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialise, release

#: Quote marks at the start of a line, with blanks around each.
MARKS = r"^[ \t]*>[> \t]*"
#: Lines that introduce a quotation in four languages begin, go on and end so; they go with the quotation that follows.
INTRO = (r"^[ \t]*(?:On|Am|Le|El)\b", "wrote|schrieb|écrit|escribió", r":[ \t]*$")
#: Words of a passage or line that find its places in other messages.
ANCHOR = 4
#: Turns in one range of the running maximum.
RANGE = 1000
#: Up to so many conversation ids are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 400_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")


def depth(line: Column) -> Column:
    """Quote marks before a line's words; 0: its author's own."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    """Without marks, in lower case, blanks as single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def _without_quotes(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """conv_id, turn, message, own of the messages in ``gone`` (conv_id, turn, message, pos): their texts without these lines,
    without lines that introduce them, and without quote marks that stand alone.

    Quoted lines without an original stay: their words stand nowhere else.
    """
    key = ["conv_id", "turn", "message"]
    some = texts.join(gone.select(*key).distinct(), key, "left_semi").select(*key, "text").distinct()
    lines = some.select(*key, F.posexplode(_lines(F.col("text"))).alias("pos", "line")).join(gone.withColumn("gone", F.lit(True)), [*key, "pos"], "left")
    alone = F.col("line").rlike(MARKS) & (normalised(F.col("line")) == "")
    lines = lines.withColumn("gone", F.coalesce("gone", alone))
    told = F.col("line").rlike(INTRO[0]) & F.col("line").rlike(INTRO[1]) & F.col("line").rlike(INTRO[2])
    ahead = F.lead("gone", 1, False).over(Window.partitionBy(*key).orderBy("pos"))
    own = lines.withColumn("told", told & ahead).groupBy(*key).agg(F.sort_array(F.collect_list(F.when(~F.col("gone") & ~F.col("told"), F.struct("pos", "line")))).alias("l"))
    return own.select(*key, F.regexp_replace(F.regexp_replace(F.array_join("l.line", "\n"), r"^\s+|\s+$", ""), "\n{3,}", "\n\n").alias("own"))


def _own_words(text: Column) -> Column:
    """The author's own words in order, whatever the line breaks; each quoted line stands as one word that nobody writes."""
    lines = F.transform(_lines(text), lambda x: F.when(x.rlike(MARKS), F.lit("\x00")).otherwise(normalised(x)))
    return F.split(F.array_join(F.filter(lines, lambda x: x != ""), " "), " ")


def _passages(quoting: DataFrame) -> DataFrame:
    """conv_id, turn, message, depth, lines, at, norm: runs of quoted lines of one depth; norm joins their words without line
    breaks. message is a hash of the text, at holds the numbers of the lines, blank ones between them included."""
    lines = quoting.select("conv_id", "turn", "message", "text").distinct().select("conv_id", "turn", "message", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("conv_id", "turn", "message", "pos", depth(F.col("line")).alias("depth"), normalised(F.col("line")).alias("norm")).filter("depth = 0 OR norm <> ''")
    order = Window.partitionBy("conv_id", "turn", "message").orderBy("pos")
    starts = F.coalesce(F.col("depth") != F.lag("depth").over(order), F.lit(True)).cast("int")
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order)).filter("depth > 0")
    out = runs.groupBy("conv_id", "turn", "message", "run", "depth").agg(F.sort_array(F.collect_list(F.struct("pos", "norm"))).alias("l"))
    return out.select("conv_id", "turn", "message", "depth", F.col("l.norm").alias("lines"), F.col("l.pos").alias("at"), F.array_join("l.norm", " ").alias("norm"))


def _holders(messages: DataFrame, units: DataFrame) -> DataFrame:
    """conv_id, norm, turn: every turn whose own words have the words of ``norm`` one after the other.

    A unit's first ANCHOR words find the places, one join for all turns; each message then compares its places' words.
    """
    words = F.split("norm", " ")
    units = units.select("conv_id", "norm", F.size(words).alias("n"), F.xxhash64(F.array_join(F.slice(words, 1, ANCHOR), " ")).alias("anchor"))
    own = messages.select("conv_id", "turn", F.xxhash64("text").alias("id"), _own_words(F.col("text")).alias("words"))
    at = lambda k: F.transform("words", lambda w, i: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice("words", i + 1, k), " ")).alias("anchor")))
    grams = own.select("conv_id", "turn", "id", F.explode(F.array_distinct(F.flatten(F.array(*(at(k) for k in range(1, ANCHOR + 1)))))).alias("g")).select("conv_id", "turn", "id", "g.*")
    places = grams.join(units, ["conv_id", "anchor"]).groupBy("conv_id", "turn", "id").agg(F.collect_set(F.struct("at", "n", "norm")).alias("places"))
    same = F.filter("places", lambda p: F.array_join(F.slice("words", p["at"] + 1, p["n"]), " ") == p["norm"])
    return own.join(places, ["conv_id", "turn", "id"]).select("conv_id", "turn", F.explode(F.array_distinct(F.transform(same, lambda p: p["norm"]))).alias("norm")).distinct()


def _best_before(asks: DataFrame, held: DataFrame) -> DataFrame:
    """conv_id, norm, turn, original of ``asks``: of the earlier turns in ``held`` the one with most covered, the latest on ties.

    A running maximum in two levels, so that a passage that a whole conversation quotes is not sorted in one task: of
    ranges of RANGE turns, then within a range.
    """
    keys = ["conv_id", "norm"]
    ask = asks.select(*keys, "turn").distinct().withColumn("point", F.lit(None).cast("struct<covered:bigint,turn:bigint>"))
    rows = held.select(*keys, "turn", F.struct(F.col("covered").cast("bigint").alias("covered"), F.col("turn").cast("bigint").alias("turn")).alias("point"))
    rows = rows.withColumn("ask", F.lit(False)).unionByName(ask.withColumn("ask", F.lit(True))).withColumn("range", F.floor(F.col("turn") / RANGE))
    earlier = lambda part, by: Window.partitionBy(*part).orderBy(by).rangeBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "range").agg(F.max("point").alias("most")).select(*keys, "range", F.max("most").over(earlier(keys, "range")).alias("before"))
    within = rows.withColumn("inside", F.max("point").over(earlier([*keys, "range"], "turn"))).filter("ask")
    return within.join(ranges, [*keys, "range"]).select(*keys, "turn", F.greatest("before", "inside")["turn"].alias("original"), F.greatest("before", "inside")["covered"].alias("covered"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, reply_to, thread, position, n_quoted, n_linked, quote_depth: one row for each row of
    ``messages``. Ordered by (conv_id, thread, position) they are conversations in reply order.

    reply_to is the turn of the message answered, null without a linked quote; thread the turn of the first message of
    the reply chain, its own turn at least; position counts the messages of the thread that come before, every reply (and
    all that follows from it) before the next reply to the same message; n_quoted is the number of quoted lines with
    words, n_linked those whose words an earlier turn has, quote_depth the deepest nesting. text loses the linked lines
    only. Messages with a null conv_id or turn link with nothing and have a null thread where turn is null; null texts
    stay null. Repeated (conv_id, turn) rows quote together, have one position, and each row is returned. Other columns
    are not read.

    Every earlier turn is a candidate. A passage that one of them has whole goes to the latest such turn, by a running maximum,
    linear in quotes and originals. Only passages that none has whole are compared line by line: each distinct one
    meets all turns that have one of its lines. Only conversations with quotes go beyond the first aggregation.
    """
    base = messages.select("conv_id", "turn", "role", "text")
    usable = base.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("message"), "text")
    quoted = materialise(_passages(usable.filter(F.col("text").rlike("(?m)" + MARKS))), "quoted")
    if quoted.isEmpty():
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        return base.select("conv_id", "turn", "role", "text", none.alias("reply_to"), F.col("turn").cast("bigint").alias("thread"), zero.alias("position"), zero.alias("n_quoted"), zero.alias("n_linked"), zero.alias("quote_depth"))

    lines = quoted.select("conv_id", F.explode("lines").alias("norm"))
    units = quoted.select("conv_id", "norm").unionByName(lines).distinct()
    talks = materialise(quoted.select("conv_id").distinct(), "talks")
    own = usable.join(F.broadcast(talks) if talks.count() <= BROADCAST_ROWS else talks, "conv_id", "left_semi")
    held = materialise(_holders(own, units), "held")

    whole = _best_before(quoted, held.join(quoted.select("conv_id", "norm").distinct(), ["conv_id", "norm"], "left_semi").withColumn("covered", F.length("norm")))
    whole = materialise(quoted.join(whole, ["conv_id", "norm", "turn"], "left"), "whole")
    rest = whole.filter("original IS NULL AND size(lines) > 1").drop("original", "covered")
    each = rest.select("conv_id", "norm", "lines").distinct().select("conv_id", F.col("norm").alias("passage"), F.explode("lines").alias("norm"))
    parts = each.join(held, ["conv_id", "norm"]).groupBy("conv_id", F.col("passage").alias("norm"), "turn").agg(F.sum(F.length(each["norm"])).alias("covered"))
    first = held.groupBy("conv_id", F.col("norm").alias("line")).agg(F.min("turn").alias("first"))
    seen = rest.select("conv_id", "turn", "norm").distinct().join(each.select("conv_id", F.col("norm").alias("line"), F.col("passage").alias("norm")).distinct(), ["conv_id", "norm"])
    seen = seen.join(first, ["conv_id", "line"]).filter("first < turn").groupBy("conv_id", "norm", "turn").agg(F.collect_set("line").alias("linked"))
    some = rest.join(_best_before(rest, parts), ["conv_id", "norm", "turn"], "left").join(seen, ["conv_id", "norm", "turn"], "left")
    found = whole.filter("original IS NOT NULL OR size(lines) = 1").withColumn("linked", F.when(F.col("original").isNotNull(), F.array_distinct("lines"))).unionByName(some)
    found = materialise(_hits(found), "found")

    votes = found.groupBy("conv_id", "turn", "original").agg(F.sum(F.size("lines")).alias("lines"), F.min("depth").alias("near"), F.max("depth").alias("far"), F.sum("covered").alias("chars"), F.sum(F.size("hits")).alias("linked"))
    best = F.struct(-F.col("near"), F.col("chars"), F.col("original"))
    reply = votes.groupBy("conv_id", "turn").agg(
        F.max_by("original", F.when(F.col("original").isNotNull(), best)).alias("reply_to"),
        F.sum("lines").alias("n_quoted"),
        F.sum("linked").alias("n_linked"),
        F.max("far").alias("quote_depth"),
    )
    reply = materialise(reply, "reply")
    for frame in (quoted, held, whole):
        release(frame)
    placed = _placed(reply)
    gone = found.select("conv_id", "turn", "message", F.explode("hits").alias("pos")).distinct()
    shorter = _without_quotes(usable, gone)
    facts = base.withColumn("message", F.md5(F.col("text").cast("binary"))).join(reply, ["conv_id", "turn"], "left")
    facts = facts.join(placed, ["conv_id", "turn"], "left") if placed is not None else facts.withColumn("thread", F.lit(None).cast("bigint")).withColumn("position", F.lit(None).cast("bigint"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return facts.join(shorter, ["conv_id", "turn", "message"], "left").select(
        "conv_id", "turn", "role", F.coalesce("own", "text").alias("text"), "reply_to",
        F.coalesce("thread", "turn").cast("bigint").alias("thread"), zero("position"), zero("n_quoted"), zero("n_linked"), zero("quote_depth"),
    )


def _hits(found: DataFrame) -> DataFrame:
    """``found`` with hits: the numbers of its lines that are linked. One row a line between, so long passages take linear time."""
    rows = found.withColumn("id", F.xxhash64("conv_id", "turn", "message", "at"))
    hit = rows.select("id", F.explode(F.arrays_zip("lines", "at")).alias("x")).select("id", "x.lines", "x.at")
    linked = rows.select("id", F.explode("linked").alias("lines")).distinct()
    hits = hit.join(linked, ["id", "lines"], "left_semi").groupBy("id").agg(F.collect_set("at").alias("hits"))
    return rows.join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>"))).drop("id", "linked")


def _doubled(steps: DataFrame, tag: str) -> DataFrame:
    """conv_id, node, count, last of ``steps`` (conv_id, node, next, count): counts summed along next up to the last node,
    by doubling: as many rounds as the logarithm of the longest way."""
    now = materialise(steps.withColumn("last", F.col("node")), tag)
    while not now.filter("next IS NOT NULL").isEmpty():
        over = now.select("conv_id", F.col("node").alias("next"), F.col("next").alias("n"), F.col("count").alias("c"), F.col("last").alias("l"))
        new = now.join(over, ["conv_id", "next"], "left").select("conv_id", "node", F.col("n").alias("next"), (F.col("count") + F.coalesce("c", F.lit(0))).alias("count"), F.coalesce("l", "last").alias("last"))
        new = materialise(new, tag)
        release(now)
        now = new
    return now


def _placed(reply: DataFrame) -> DataFrame | None:
    """conv_id, turn, thread, position of the messages of reply trees; None without a reply.

    A tree is walked down to the first reply, from there to the next, and back up; the walk is a list of two nodes a message,
    ranked by doubling. The next reply to a message is looked up in ranges of RANGE turns, so that a message with very
    many replies is not sorted in one task.
    """
    up = reply.filter("reply_to IS NOT NULL").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("reply_to").alias("parent"))
    if up.isEmpty():
        return None
    up = up.withColumn("range", F.floor(F.col("turn") / RANGE))
    key = ["conv_id", "parent"]
    ranges = up.groupBy(*key, "range").agg(F.min("turn").alias("least")).withColumn("after", F.lead("least").over(Window.partitionBy(*key).orderBy("range"))).select(*key, "range", "after")
    inside = F.lead("turn").over(Window.partitionBy(*key, "range").orderBy("turn"))
    up = up.withColumn("inside", inside).join(ranges, [*key, "range"]).select(*key, "turn", F.coalesce("inside", "after").alias("sibling"))
    up = materialise(up, "up")
    nodes = up.select("conv_id", "turn").unionByName(up.select("conv_id", F.col("parent").alias("turn"))).distinct()
    nodes = nodes.join(up, ["conv_id", "turn"], "left").join(up.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child")), ["conv_id", "turn"], "left")
    node = lambda turn, back: F.struct(F.col(turn).alias("turn"), F.lit(back).alias("back"))
    onward = F.when(F.col("sibling").isNotNull(), node("sibling", False)).when(F.col("parent").isNotNull(), node("parent", True))
    down = nodes.select("conv_id", node("turn", False).alias("node"), F.when(F.col("child").isNotNull(), node("child", False)).otherwise(node("turn", True)).alias("next"), F.lit(1).cast("bigint").alias("count"))
    back = nodes.select("conv_id", node("turn", True).alias("node"), onward.alias("next"), F.lit(0).cast("bigint").alias("count"))
    ranked = _doubled(down.unionByName(back), "walk").filter("NOT node.back").select("conv_id", "node.turn", F.col("last.turn").alias("thread"), "count")
    whole = ranked.filter("turn = thread").select("conv_id", "thread", F.col("count").alias("all"))
    return ranked.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", "thread", (F.col("all") - F.col("count")).alias("position"))
