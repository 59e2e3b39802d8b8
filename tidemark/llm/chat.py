"""Chat formatting of reply trees, by DataFrame operations only.

Messages name the message that they reply to. Paths from root to leaf are enumerated by iterative self-joins: each round
joins the paths found so far with a table of jumps twice as long, so that the number of rounds grows with the logarithm
of the depth. Branches are ranked by score, and each chosen path is formatted as one conversation.

A turn is `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Inside roles and texts
a backslash is doubled, `<|` is written with a backslash between, and a line feed in a role is written `<\\:`; a single
backslash after `<` stands nowhere else, so that the text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm import common

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("<\\:"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\:"))


def paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf and path (the ids from root to leaf) of every leaf; messages has conv_id, msg_id and parent_id (null: a root).

    A message whose parent isn't there is a root. Ids are unique in a conversation. Messages that reply in a circle have no root, and
    neither have those that hang off one: none of them has a path. Such a path is known by being longer than its conversation.
    """
    m = messages.select("conv_id", "msg_id", "parent_id")
    known = m.select(F.col("conv_id"), F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    m = m.join(known, ["conv_id", "parent_id"], "left").select("conv_id", "msg_id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id"))
    m = common.written(m.join(messages.groupBy("conv_id").agg(F.count("*").alias("most")), "conv_id"))
    parents = m.where("parent_id is not null").select("conv_id", F.col("parent_id").alias("msg_id")).distinct()
    # A path's array goes from its top message to the leaf; next is the one above the top. A jump does the same from any message.
    found = common.written(m.join(parents, ["conv_id", "msg_id"], "left_anti").select("conv_id", "most", F.col("msg_id").alias("leaf"), F.array("msg_id").alias("path"), F.col("parent_id").alias("next")))
    jumps, rounds = m.select("conv_id", "most", F.col("msg_id").alias("next"), F.array("msg_id").alias("up"), F.col("parent_id").alias("after")), 0
    while not found.where("next is not null").isEmpty():
        before = [found]
        if rounds:  # jumps twice as long; those that would go beyond a root stay as they are, and are taken by no path twice
            above = jumps.select("conv_id", F.col("next").alias("after"), F.col("up").alias("up2"), F.col("after").alias("after2"))
            longer = jumps.where("after is not null").join(above, ["conv_id", "after"]).select("conv_id", "most", "next", F.concat("up2", "up").alias("up"), F.col("after2").alias("after"))
            before += [jumps] if rounds > 1 else []
            jumps = common.written(longer.where(_ends("up", "after")).unionByName(jumps.where("after is null")))
        open_paths = found.where("next is not null").join(jumps.drop("most"), ["conv_id", "next"]).select("conv_id", "most", "leaf", F.concat("up", "path").alias("path"), F.col("after").alias("next"))
        found = common.written(open_paths.where(_ends("path", "next")).unionByName(found.where("next is null")))
        common.discard(*before)
        rounds += 1
    return found.select("conv_id", "leaf", "path")


def _ends(path: str, next_id: str) -> Column:
    """Whether a path, or what is left of it, may come to a root: one as long as its conversation that goes on is in a circle."""
    return F.col(next_id).isNull() | (F.size(path) < F.col("most"))


def chosen(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """paths with rank (from 1, by the mean score of a path's messages, then by leaf); branches: as many a conversation at most, all if None."""
    p = paths(messages)
    step = p.select("conv_id", "leaf", F.explode("path").alias("msg_id"))
    mean = step.join(messages.select("conv_id", "msg_id", "score"), ["conv_id", "msg_id"]).groupBy("conv_id", "leaf").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))
    ranked = p.join(mean, ["conv_id", "leaf"]).withColumn("rank", F.row_number().over(W.Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "leaf")))
    return ranked if branches is None else ranked.where(F.col("rank") <= branches)


def format_paths(messages: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """conv_id, rank, score, n_turns, formatted, and loss: the places (from 1) and lengths of the texts of loss_role in formatted.

    messages has conv_id, msg_id, parent_id, role, text and score. Null roles and texts are empty. Rows whose conv_id or
    msg_id is null are left out, as joins by key do; a struct around a nullable conv_id keeps them. Empty: no rows.
    """
    picked = chosen(messages, branches)
    steps = picked.select("conv_id", "rank", "score", F.posexplode("path").alias("at", "msg_id"))
    said = steps.join(messages.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"])
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = said.select("conv_id", "rank", "score", F.struct("at", head.alias("head"), body.alias("body"), F.col("role").eqNullSafe(F.lit(loss_role)).alias("loss")).alias("turn"))
    whole = turns.groupBy("conv_id", "rank", "score").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = END + "\n"
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    sizes = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["loss"].alias("loss")))
    whole = whole.select("conv_id", "rank", "score", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), sizes.alias("sizes"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,length:int>>").alias("loss"))
    placed = F.aggregate(
        "sizes",
        start,
        lambda s, t: F.struct(
            (s["at"] + t["head"] + t["body"] + F.lit(len(tail))).alias("at"),
            F.when(t["loss"], F.concat(s["loss"], F.array(F.struct((s["at"] + t["head"]).alias("at"), t["body"].alias("length"))))).otherwise(s["loss"]).alias("loss"),
        ),
        lambda s: s["loss"],
    )
    return whole.select("conv_id", "rank", "score", "n_turns", "formatted", placed.alias("loss"))


def turns(formatted: Column) -> Column:
    """Reads a formatted conversation back: an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    inside = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(inside, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def threads(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each row replies to the one before it.

    Rows of a conversation are ordered by turn, null turns first, then by role and text; all rows stay, repeated ones too.
    """
    order = W.Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    return m.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.length("text").cast("double").alias("score"))


def report(formatted: DataFrame) -> DataFrame:
    """What is read back of formatted conversations: turns and the texts under the loss mask, as counts and digests."""
    back = formatted.withColumn("back", turns(F.col("formatted"))).withColumn("masked", F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["at"], x["length"]))), ""))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SAID = f"{END}{START}assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    # As a struct, a null id is a key like any other.
    keyed = rows.unionByName(more).withColumn("conv_id", F.struct("conv_id"))
    messages = common.written(threads(keyed))
    return report(format_paths(messages)).withColumn("conv_id", F.col("conv_id.conv_id"))


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length(replace(replace(coalesce(role, ''), '\\', '\\\\'), '<|', '<\\|')) + 2 * (length(coalesce(role, '')) - length(replace(coalesce(role, ''), chr(10), ''))) AS role_chars,
         length(replace(replace(coalesce(text, ''), '\\', '\\\\'), '<|', '<\\|')) AS text_chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START)} + role_chars + 1 + text_chars + {len(END) + 1}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
