"""Chat formatting over a prefix tree of conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(c: Column) -> Column:
    """Puts a backslash between `<` and `|` (and before any backslashes there), so no control string stands in a text."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(s: str) -> str:
    return ESCAPED.sub(r"<\1|", s)


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def segments(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokenizer: str | None) -> DataFrame:
    """A scratch table of the turns: uid, conv_id, turn, role, segment (formatted text), loss_start, loss_end, h1, h2, length (and tokens)."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    t = t.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    mask = F.when(F.col("role") == "assistant", F.length("head"))
    t = t.select("conv_id", "turn", "role", F.concat("head", "body", F.lit(END)).alias("segment"), mask.alias("loss_start"), (mask + F.length("body")).alias("loss_end"))
    t = t.withColumns({"uid": F.monotonically_increasing_id(), "h1": F.xxhash64(F.lit(1), "segment"), "h2": F.xxhash64(F.lit(2), "segment")})
    t = t.withColumn("tokens", _ids(tokenizer)) if tokenizer else t
    return materialize(t.withColumn("length", (F.size("tokens") if tokenizer else F.length("segment")).cast("long")))


def _ids(tokenizer: str) -> Column:
    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([e.ids for e in t.encode_batch(texts.tolist(), add_special_tokens=False)])

    return ids("segment")


def steps_of(parts: DataFrame) -> DataFrame:
    """A scratch table of all turns as nodes of the tree: conv_id, c (number of the conversation), uid, depth, a, b, pa, pb, length, position.

    A node (a, b) is named by 128 bits of hash of all turns from the root to it, each with its depth, so conversations that share
    initial turns share nodes; (pa, pb) is its parent. These are running sums over narrow rows: no text, no array.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "h1", "uid")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = parts.select("conv_id", "turn", "role", "h1", "uid", "h2", "length")
    t = t.select("*", (F.row_number().over(w) - 1).alias("depth"), F.first("uid").over(upto).alias("c"), (F.sum("length").over(upto) - F.col("length")).alias("position"))
    # Sums of 32-bit parts: they neither overflow nor depend on anything but the turns and their depths.
    each = [F.xxhash64("h1", "depth"), F.xxhash64("h2", "depth")]
    low = [F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF))).over(upto) for x in each]
    high = [F.sum(F.shiftrightunsigned(x, 32)).over(upto) for x in each]
    t = t.select("conv_id", "c", "turn", "role", "h1", "uid", "depth", "length", "position", *(F.xxhash64(F.lit(i), "depth", *low, *high).alias(n) for i, n in ((1, "a"), (2, "b"))))
    return materialize(t.select("conv_id", "c", "uid", "depth", "a", "b", F.lag("a").over(w).alias("pa"), F.lag("b").over(w).alias("pb"), "length", "position"))


def prefix_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges conversations that share initial turns and emits every distinct prefix once, depth first.

    Returns (nodes, conversations). nodes: a, b (name), depth, role, segment (formatted text of this turn), loss_start and
    loss_end (characters of the segment under the loss mask; both null unless the role is assistant), start (place of its
    first token in the depth-first stream), length, position (position id of that token: tokens of its ancestors),
    attention (stretches of the stream that its tokens see: its ancestors and itself, touching ones merged), and tokens
    if a byte-level tokenizer file is given; else the characters are the tokens. conversations: conv_id, c, depth, a, b, one row per turn.

    Depth first: conversations are sorted by the nodes at which they part from others, so those that share a prefix are
    neighbours. A node belongs to the first conversation that has it, and the nodes of a conversation, which are the end of
    its path, follow each other by depth. That order is dealt out by ranges, numbered within partitions and shifted by the
    totals of earlier ones (one row per partition). A first turn shared by very many conversations is one row
    of the tree, and the subtree under it spreads over partitions. A node's ancestors before its own conversation's stretch are
    gathered once for the stretch, one interval for each earlier stretch that they lie in.
    Turns are ordered by turn, then role and hash (null turns first); null roles and texts are empty; rows with a null
    conv_id are one conversation; repeated rows are repeated turns; empty turns give no rows; other columns are ignored.
    """
    spark = turns.sparkSession
    parts = segments(turns, conv, turn, role, text, tokenizer)
    steps = steps_of(parts)
    fixed = ("depth", "pa", "pb", "length", "position")
    nodes = materialize(steps.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("uid").alias("uid"), *(F.min(c).alias(c) for c in fixed)))

    # Nodes at which some conversations leave the others: all that tells the order of two conversations.
    up = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n").alias("above"))
    parting = nodes.join(up, ["pa", "pb"], "left").where("above is null or n != above").select("a", "b")
    path = F.array_sort(F.collect_list(F.struct("depth", "a", "b"))).alias("path")
    paths = steps.join(parting, ["a", "b"], "left_semi").groupBy("c").agg(path)
    ranks = materialize(paths.repartitionByRange("path", "c").sortWithinPartitions("path", "c").select("c", F.monotonically_increasing_id().alias("r")))
    ranked = steps.select("c", "depth", "a", "b").join(ranks, "c")
    owner = ranked.groupBy("a", "b").agg(F.min("r").alias("r"))
    ordered = nodes.join(owner, ["a", "b"]).repartitionByRange("r", "depth").sortWithinPartitions("r", "depth")
    ordered = ordered.select("a", "b", "uid", "depth", "length", "position", "r", F.spark_partition_id().alias("pid"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for batch in batches:
            length = batch["length"].to_numpy()
            yield batch.assign(start=at + np.cumsum(length) - length)
            at += int(length.sum())

    placed = materialize(ordered.mapInPandas(number, "a long, b long, uid long, depth int, length long, position long, r long, pid int, start long"))
    shift, base = [], 0
    for x in placed.groupBy("pid").agg(F.sum("length").alias("n")).orderBy("pid").collect():
        shift.append((x["pid"], base))
        base += x["n"]
    shifts = spark.createDataFrame(shift, "pid int, shift long")
    placed = placed.join(F.broadcast(shifts), "pid").withColumn("start", F.col("start") + F.col("shift")).drop("pid", "shift")

    stretches = placed.groupBy("r").agg(F.min("start").alias("first"), F.min("depth").alias("top"))
    above = ranked.join(stretches.where("top > 0"), "r").where("depth < top").select(F.col("r").alias("of"), "a", "b")
    hops = above.join(placed.select("a", "b", "r", "start", "length"), ["a", "b"]).groupBy("of", "r").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    spans = hops.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    known = stretches.join(spans.withColumnRenamed("of", "r"), "r", "left").select("r", "first", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    own = F.struct(F.col("first").alias("start"), (F.col("start") + F.col("length")).alias("end"))
    merged = F.aggregate(
        F.concat("spans", F.array(own)),
        F.slice("spans", 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] == x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), x["end"].alias("end"))))).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    tree = placed.join(known, "r").select("a", "b", "uid", "depth", "start", "length", "position", merged.alias("attention"))
    content = parts.select("uid", "role", "segment", "loss_start", "loss_end", *(["tokens"] if tokenizer else []))
    return tree.join(content, "uid").drop("uid"), steps.select("conv_id", "c", "depth", "a", "b")


def formatted(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every turn of every conversation as the tree has it: conv_id, c, depth, segment, loss_start, loss_end."""
    return conversations.join(nodes.select("a", "b", "segment", "loss_start", "loss_end"), ["a", "b"]).drop("a", "b")


def _parsed(segment: str, loss_start: float, loss_end: float) -> tuple[str, str, str]:
    """Role, text and text under the loss mask of a formatted turn."""
    (turn,) = segment.split(START)[1:]
    role, _, text = turn.partition("\n")
    loss = "" if loss_start is None or loss_start != loss_start else segment[int(loss_start) : int(loss_end)]
    return unescape_role(role), unescape(text.removesuffix(END)), unescape(loss)


def read_back(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns read back from the tree: conv_id, c, depth, role, text, loss (text under the mask), one row per turn.

    Conversations with a null conv_id are one; an empty tree gives no rows.
    """

    @F.pandas_udf("role string, text string, loss string")
    def parse(segment: pd.Series, loss_start: pd.Series, loss_end: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parsed(*x) for x in zip(segment, loss_start, loss_end)], columns=["role", "text", "loss"])

    return formatted(nodes, conversations).select("conv_id", "c", "depth", parse("segment", "loss_start", "loss_end").alias("p")).select("conv_id", "c", "depth", "p.*")


def digests(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Lengths and SHA-256 digests of each conversation, read back turn by turn: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through their task in order, so a conversation of any length takes no memory. The one with a null conv_id
    has its row like others; an empty tree gives no rows.
    """
    kind = dict(conversations.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, conv, held = None, None, None
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row() -> tuple:
            n, turns, chars, loss, total = held
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            rows = []
            for conv_id, c, segment, a, b in zip(batch["conv_id"], batch["c"], batch["segment"], batch["loss_start"], batch["loss_end"]):
                if c != now:
                    if held:
                        rows.append(row())
                    now, conv, held = c, None if pd.isna(conv_id) else conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss = _parsed(segment, a, b)
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                held[2] += len(loss)
                held[3].update(loss.encode("utf-8", "replace"))
                held[4] += len(segment)
            yield _typed(rows, columns, kind)
        if held:
            yield _typed([row()], columns, kind)

    turns = formatted(nodes, conversations).repartition("c").sortWithinPartitions("c", "depth")
    return turns.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _typed(rows: list[tuple], columns: list[str], kind: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"conv_id": "Int64"}) if kind in ("tinyint", "smallint", "int", "bigint") else out
