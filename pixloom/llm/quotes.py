"""Chat formatting by quotation linking, by DataFrame operations only.

Lines of a message are parsed into quote levels (marks ``>`` before the text). Adjoining lines of one
level form a passage; the outermost passages of a message are what it answers. Passages are
normalised and hashed, joined to the messages whose own words they are, and each message is hung on
the message it quotes. Conversations are the trees so made, in reply order, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm.frame import saved, without
from pixloom.llm.registry import query, table


def marks(line: Column) -> Column:
    """The quote marks before a line, blanks between them included."""
    return F.regexp_extract(line, r"^((?:[ \t]{0,3}>)*)", 1)


def parsed(text: Column) -> Column:
    """Array of (level, body) of the lines of a text."""
    return F.transform(
        F.split(text, r"\r?\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
            F.regexp_replace(F.substr(x, F.length(marks(x)) + 1), r"^ ", "").alias("body"),
        ),
    )


def words(bodies: Column) -> Column:
    """Normal form of some lines: lower-case words, one space apart."""
    return F.trim(F.regexp_replace(F.lower(F.array_join(bodies, " ")), r"\s+", " "))


def at_level(lines: Column, level: int) -> Column:
    return F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["body"])


def passages(lines: Column) -> Column:
    """Normal forms of the runs of first-level lines; own and deeper lines end a run."""
    one = F.transform(lines, lambda x: F.when(x["level"] == 1, x["body"]).otherwise(F.lit("\x01")))
    runs = F.transform(F.split(F.array_join(one, "\n"), "\x01", -1), lambda r: words(F.array(r)))
    return F.array_distinct(F.filter(runs, lambda r: r != ""))


RESULT = ("root", "reply_to", "depth", "own_text")


def link_quotes(
    messages: DataFrame, *, message_id: str = "message_id", text: str = "text", scope: str | None = None, order: str | None = None
) -> DataFrame:
    """Add root, reply_to, depth and own_text (the text without quotes) to each message.

    A message answers the latest earlier message (by ``order``, else by id; within its ``scope``, if
    given) of which it quotes all own words or a whole paragraph. Of several with the same words
    only the first counts, so words that a third of all messages share are one row of the join. A
    message that quotes nothing known, a null or an empty one begins a conversation of its own; one
    without id, order or scope is not linked (root and depth are null). Repeated rows of an id are
    one message. Columns with the names of the results are replaced. Sorted by root and order, a
    conversation stands in reply order, as answers always come after what they quote.
    """
    base = without(messages, RESULT)
    rows = base.select(
        F.col(message_id).alias("id"),
        (F.col(scope) if scope else F.lit(0)).alias("scope"),
        F.col(order or message_id).alias("place"),
        parsed(F.coalesce(F.col(text), F.lit(""))).alias("lines"),
    ).where("id IS NOT NULL AND scope IS NOT NULL AND place IS NOT NULL")
    own = at_level(F.col("lines"), 0)
    rows = saved(
        rows.select("id", "scope", "place", own.alias("own"), F.when(F.exists("lines", lambda x: x["level"] == 1), passages(F.col("lines"))).alias("quoted")),
        "messages",
    )
    paragraphs = F.transform(F.split(F.array_join("own", "\n"), r"\n\s*\n", -1), lambda p: words(F.array(p)))
    parts = F.array_distinct(F.array_append(paragraphs, words(F.col("own"))))

    def hashed(df: DataFrame, *columns) -> DataFrame:
        return df.where("part <> ''").select(
            *columns, "scope", F.xxhash64("part").alias("h1"), F.xxhash64(F.lit(1), F.col("part")).alias("h2")
        )

    # the first message with some words stands for all that have them
    sources = (
        hashed(rows.select("id", "scope", "place", F.explode(parts).alias("part")), "id", "place")
        .groupBy("scope", "h1", "h2")
        .agg(F.min(F.struct("place", "id")).alias("source"))
    )
    quotes = hashed(
        rows.where("quoted IS NOT NULL").select(F.col("id").alias("child"), F.col("place").alias("child_place"), "scope", F.explode("quoted").alias("part")),
        "child", "child_place",
    )
    links = (
        quotes.join(sources, ["scope", "h1", "h2"])
        .where(F.col("source.place") < F.col("child_place"))
        .groupBy("child")
        .agg(F.max("source").alias("source"))
        .select(F.col("child").alias("id"), F.col("source.id").alias("parent"))
    )
    # pointer jumping: each round doubles the known way up, so rounds grow with the logarithm of the depth
    tree = saved(
        rows.select("id").distinct().join(links, "id", "left").select(
            "id", F.col("parent").alias("reply_to"), F.col("parent").alias("up"), F.coalesce("parent", "id").alias("root"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        ),
        "tree",
    )
    while not tree.where("up IS NOT NULL").isEmpty():
        above = tree.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        # only messages that have not reached their root take part
        further = tree.where("up IS NOT NULL").join(above, "up", "left").select(
            "id", "reply_to", F.col("next").alias("up"), F.coalesce("top", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
        tree = saved(tree.where("up IS NULL").select("id", "reply_to", "up", "root", "depth").union(further), "tree")
    found = tree.select(F.col("id").alias("__id"), "root", "reply_to", "depth")
    joined = base.withColumn("__id", F.col(message_id)).join(found, "__id", "left").drop("__id")
    return joined.withColumn("own_text", F.btrim(F.array_join(at_level(parsed(F.col(text)), 0), "\n"), F.lit(" \t\r\n")))


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """The turns as mail: each quotes the turn before it, and at a second level the one before that."""
    turns = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def before(k: int) -> DataFrame:
        return turns.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"before_{k}"))

    def quoted(text: str, mark: str) -> Column:
        lines = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit(mark), x)), "\n")
        return F.when(F.col(text).isNotNull(), F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))

    mail = conversations.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    return mail.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("message_id"),
        F.concat(quoted("before_2", ">> "), quoted("before_1", "> "), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"),
    )


@query("op8_quotation_linking")
def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as quoting mail, and found again from the quotes."""
    mail = quoting_messages(table(spark, sf_dir, "conversations"))
    linked = link_quotes(mail, scope="conv_id", order="turn")
    return linked.select("conv_id", "turn", "role", "root", "reply_to", "depth", F.sha2("own_text", 256).alias("own_sha256"))
