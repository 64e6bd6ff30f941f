"""Chat formatting of reply trees, in DataFrame operations alone.

Messages name their parent. Self-joins that double the jump (parent, grandparent, ...) give
every message its depth and the score of the path above it in logarithmically many rounds;
leaves are ranked by the mean score of their branch; the same jumps, largest first, enumerate
each chosen branch from leaf to root; and each branch is formatted as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Texts and roles are escaped
reversibly: a backslash is doubled and put behind the first character of a control string of
this or another common template. The loss mask is a list of spans (code points) that cover the
escaped text of every assistant turn.

A null or unknown parent makes a root. Null texts and roles are empty, null scores 0. Messages on a
cycle have no root and no leaf, and what hangs below a cycle is left out. Message ids are
unique within a tree; of repeated ids the smallest (role, text) stays. An empty table gives
no rows, and other columns are not read. In `chain`, all rows without a conv_id make one conversation, a null turn comes
first, and repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of chat templates, as a pattern: first character and rest.
CONTROLS = r"(<)(\|)|(<)(/?s>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROLS, r"$1$3$5\\$2$4$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree, node, up) by 1, 2, 4, ... messages, and (tree, node, depth, total) of all with a root."""
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    now = stored(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("known"), 1).otherwise(0).alias("depth"), "total"))
    most = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = []
    while 1 << len(levels) < most and not now.filter("up is not null").isEmpty():
        levels.append(now.filter("up is not null").select("tree", "node", "up"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        moved = now.filter("up is not null").join(above, ["tree", "up"], "left")
        now = stored(now.filter("up is null").unionByName(moved.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))))
    return levels, now.filter("up is null").drop("up")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, turn): the messages of the `keep` best branches of every tree, root at turn 0."""
    levels, rooted = jumps(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    best = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    path = stored(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("turn")))
    for k in reversed(range(len(levels))):
        step = path.join(levels[k], ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("turn") - (1 << k)).alias("turn"))
        path = stored(path.union(step))
    return path


def conversations(messages: DataFrame, keep: int = 1, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss array<struct<start, length>>) per chosen branch.

    messages: tree long, node long, parent long, role, text, score.
    """
    one = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", "score")).alias("m"))
    rows = stored(one.select("tree", "node", "m.*"))
    turns = branches(rows.select("tree", "node", "parent", "score"), keep).join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
    header = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    made = turns.withColumn("_head", header).withColumn("_body", escape(F.col("text")))
    made = made.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    order = Window.partitionBy("tree", "leaf").orderBy("turn")
    before = F.coalesce(F.sum(F.char_length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.char_length("_head")).alias("start"), F.char_length("_body").cast("long").alias("length"))
    piece = F.struct("turn", F.col("_piece").alias("piece"), F.when(F.col("role") == trained, span).alias("span"))
    got = made.select("tree", "leaf", "rank", piece.alias("p")).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return got.select(
        "tree", "leaf", "rank", F.size("ps").cast("long").alias("n_turns"),
        F.array_join(F.col("ps.piece"), "").alias("formatted"), F.filter(F.col("ps.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.transform(F.filter(F.split(formatted, "<\\|im_end\\|>\n", -1), lambda p: p != ""), lambda p: F.substring(p, len(START) + 1, 2**31 - 1))
    role = lambda p: F.regexp_extract(p, "(?s)^((?:[^\\\\\n]++|\\\\.)*+)\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + 2)).alias("text")))


def chain(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without side branches; ties in turn by role and text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))))))
    out = stored(conversations(chain(convs.unionByName(own))))
    told = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return out.withColumn("_loss", loss).select(
        F.when(F.col("tree") != -(2**63), F.col("tree")).alias("conv_id"), F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_PIECES = r"regexp_replace(replace({0}, '\', '\\'), '(<)(\|)|(<)(/?s>)|(\[)(/?INST\])', '\1\3\5\\\2\4\6', 'g')"
#: No length of the escaped text depends on how it is read back, so SQL counts it from the rows.
OP7_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START) + len(END) + 2} + length({_PIECES.format("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_PIECES.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
