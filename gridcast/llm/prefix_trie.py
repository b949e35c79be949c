"""Prefix trie of conversations with subtree totals by depth bands.

A node is a sequence of turns that some conversation starts with. It is named by a digest (128 bits of
SHA-256) of the sequence, so equal prefixes meet by an ordinary aggregation. Digests are made band by
band: within a band of fixed height turn by turn, across bands from the digests of whole bands, which
are a sequence a band's height shorter and are named the same way. So neither a task nor a row holds
more of a conversation than one band, and the number of rounds is the logarithm of the longest one.

Subtree totals go the same two ways. Each node is exploded to its ancestors within its band, no more
than the band's height, and combined on the map side. The tops of bands form a trie of their own,
whose levels are bands: it is rolled up by the same rule first, and its completed totals are handed
down to the nodes that the bands hang on, before those are exploded.

Turns follow each other by `turn` (null first), those with one number by the digest of role and text.
Null role or text counts as empty. Rows without a conv_id belong to no conversation and are left out.
Repeated rows are turns of their own. Very long texts are only read, to hash them and count words; very
long conversations are numbered over all tasks. Columns other than conv_id, turn, role and text are not
read. An empty table has no conversation and so no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.common import WORD, lookup, materialize
from gridcast.llm.registry import register, table
from gridcast.operators.ordered import MAX_GROUP_ROWS, ordered_rows

#: Height of a band: most ancestors that a node is exploded to.
BAND = 8
#: Digest of no turns, the name of the root.
ROOT = bytes(16)
#: Range of ids that are joined into one piece of text.
PIECE = 4096


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def numbered_turns(conversations: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """conv_id, place (from 0), token (digest of role and text), words, one row per turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    largest = conversations.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= max_group_rows:
        window = Window.partitionBy("conv_id").orderBy("turn", "content")
        rows = turns.withColumn("place", (F.row_number().over(window) - 1).cast("long"))
    else:  # a conversation too long for one task: all rows are numbered, then each conversation from its first
        rows = ordered_rows(turns, ["conv_id", "turn", "content"], "row").df
        starts = rows.groupBy("conv_id").agg(F.min("row").alias("start"))
        rows = lookup(rows, starts, "conv_id").withColumn("place", F.col("row") - F.col("start"))
    token = F.unhex(F.substring("content", 1, 32))
    return materialize(rows.select("conv_id", "place", token.alias("token"), "words"), "turns")


def regrown(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group, and their turns.

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % (most + 1), and goes on
    with its own after the first h. Gives (conv_id) and (conv_id, place, token, words).
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") % group == 0))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(  # `most` turns at most
        F.sort_array(F.collect_list(F.struct("place", "token", "words"))).alias("head")
    )
    found = turns.groupBy("conv_id").count().withColumn("base", base).withColumn("h", h.cast("int"))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    convs = found.join(heads, "base", "left").withColumn("head", head)
    convs = materialize(convs.select("conv_id", "count", "head", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).alias("taken")), "conversations")
    first = convs.where("taken > 0").select("conv_id", F.inline("head"))
    own = turns.where(F.col("place") >= h)
    rest = lookup(own, convs.select("conv_id", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("place") - h + F.col("taken")).alias("place"), "token", "words")
    return convs.select("conv_id"), first.unionByName(rest)


def _running(tokens: Column, start: Column) -> Column:
    """`start` and the digests of it with the first, the first two, … tokens."""
    return F.aggregate(tokens, F.array(start), lambda held, token: F.concat(held, F.array(_digest(F.element_at(held, -1), token))))


def bands(sequence: DataFrame, band: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, block, above, nodes, extra…: of each band of a conversation its nodes and the node they hang on.

    `sequence` has conv_id, place (from 0, without gaps), token.
    """
    block = F.expr(f"place DIV {band}")
    items = F.sort_array(F.collect_list(F.struct("place", "token", *extra)))
    blocks = sequence.groupBy("conv_id", block.alias("block")).agg(items.alias("items"))  # `band` items at most
    blocks = materialize(blocks, "bands")
    last = blocks.agg(F.max("block")).first()[0] or 0
    if last == 0:
        begun = blocks.withColumn("begin", F.lit(ROOT))
    else:
        whole = F.aggregate(F.col("items.token"), F.lit(ROOT), lambda held, token: _digest(held, token))
        shorter = blocks.where(F.size("items") == band).select("conv_id", F.col("block").alias("place"), whole.alias("token"))
        names = bands(shorter, band).select("conv_id", F.posexplode("nodes").alias("j", "begin"), "block")
        before = names.select("conv_id", (F.col("block") * band + F.col("j") + 1).alias("block"), "begin")
        begun = blocks.join(before, ["conv_id", "block"], "left").withColumn("begin", F.coalesce("begin", F.lit(ROOT)))
    running = F.slice(_running(F.col("items.token"), F.col("begin")), F.lit(2), F.size("items"))
    named = begun.select("conv_id", "block", running.alias("nodes"), *(F.col(f"items.{c}").alias(c) for c in extra))
    if last == 0:
        return materialize(named.withColumn("above", F.lit(ROOT)), "named")
    named = materialize(named, "named")
    ends = named.select("conv_id", (F.col("block") + 1).alias("block"), F.element_at("nodes", -1).alias("above"))
    return named.join(ends, ["conv_id", "block"], "left").withColumn("above", F.coalesce("above", F.lit(ROOT)))


def rollup(nodes: DataFrame, paths: DataFrame, sums: list[str], band: int) -> DataFrame:
    """Sums over subtrees: node, sums…

    `nodes` has node, parent, chain (its ancestors within the band from the top, and itself) and the columns to
    sum; `paths` has conv_id, block, top: the tops of bands on the way of each conversation.
    """
    add = [F.sum(c).alias(c) for c in sums]
    nodes = nodes.select("node", "parent", "chain", *sums)
    if paths.where("block > 0").limit(1).count():
        within = nodes.groupBy(F.element_at("chain", 1).alias("node")).agg(*add)
        upper = paths.groupBy("conv_id", F.expr(f"block DIV {band}").alias("upper"))
        upper = upper.agg(F.sort_array(F.collect_list(F.struct("block", "top"))).alias("items"))  # `band` items at most
        upper = materialize(upper.select("conv_id", F.col("upper").alias("block"), F.col("items.top").alias("tops")), "upper")
        chains = upper.select(F.posexplode("tops").alias("j", "node"), "tops")
        chains = chains.groupBy("node").agg(F.first(F.slice("tops", F.lit(1), F.col("j") + 1)).alias("chain"))
        tops = nodes.where(F.size("chain") == 1).select("node", "parent")
        # The parent of a top within the trie of tops is the top of the band that its parent is in.
        upper_parent = nodes.select(F.col("node").alias("parent"), F.element_at("chain", 1).alias("above"))
        tops = materialize(tops.join(within, "node").join(chains, "node"), "tops")
        linked = lookup(tops, upper_parent, "parent", "left")
        linked = linked.select("node", F.coalesce("above", F.lit(ROOT)).alias("parent"), "chain", *sums)
        ways = upper.select("conv_id", "block", F.element_at("tops", 1).alias("top"))
        done = materialize(rollup(linked, ways, sums, band), "completed")
        handed = tops.select("node", "parent").join(done, "node").groupBy(F.col("parent").alias("node")).agg(*add)
        handed = handed.select("node", *(F.col(c).alias(f"_{c}") for c in sums))
        nodes = nodes.join(handed, "node", "left")
        nodes = nodes.select("chain", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums))
    return nodes.select(F.explode("chain").alias("node"), *sums).groupBy("node").agg(*add)


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): SHA-256 of the node's ids in ascending order, with commas between.

    Ids are joined into pieces by ranges of ids, in parallel; the pieces of a node then stream through one hash.
    """
    pieces = ends.groupBy("node", F.expr(f"conv_id DIV {PIECE}").alias("piece"))
    joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")))
    pieces = pieces.agg(joined.cast("binary").alias("ids"))  # two pieces' ranges at most: those around 0
    dealt = pieces.repartition("node").sortWithinPartitions("node", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(ids)
                else:
                    digest.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], _ENDS)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], _ENDS)

    return dealt.select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


_ENDS = ["node", "ends_sha256"]


def prefix_trie(convs: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node: node (digest), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    `convs` has conv_id, without repeats; `turns` has conv_id, place (from 0, without gaps), token, words.
    """
    bands_ = bands(turns, band, ("words",))
    rows = bands_.select("conv_id", "block", "above", "nodes", F.posexplode(F.arrays_zip("nodes", "words")).alias("j", "own"))
    parent = F.when(F.col("j") == 0, F.col("above")).otherwise(F.element_at("nodes", F.greatest(F.col("j"), F.lit(1))))
    rows = rows.select(
        "conv_id",
        F.col("own.nodes").alias("node"),
        F.col("own.words").alias("words"),
        (F.col("block") * band + F.col("j") + 1).alias("depth"),
        F.struct(parent.alias("parent"), F.slice("nodes", F.lit(1), F.col("j") + 1).alias("chain")).alias("way"),
    )
    nodes = rows.groupBy("node").agg(  # the rows of a node agree in all but conv_id
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"),
        F.max("words").alias("words"), F.first("way").alias("way"),
    )
    nodes = materialize(nodes.select("node", "conv_id", "n_convs", "depth", "words", "way.*"), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = full.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    full = materialize(full.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "weighed")
    paths = bands_.select("conv_id", "block", F.element_at("nodes", 1).alias("top"))
    sums = ["n_leaves", "saved_tokens"]
    totals = materialize(rollup(full, paths, sums, band), "totals")

    last = bands_.groupBy("conv_id").agg(F.max_by(F.element_at("nodes", -1), "block").alias("node"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node"))
    digests = ends_digests(ends)

    deeper = materialize(full.drop(*sums).join(totals, "node").select("node", "parent", "conv_id", "depth", "n_convs", "n_children", *sums), "joined")
    named = deeper.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    named = named.unionByName(top.select(F.lit(ROOT).alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    placed = lookup(deeper, named, "parent")
    first = deeper.where("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    root = top.crossJoin(first).select(  # one row each
        F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    every = placed.select(*root.columns).unionByName(root).join(digests, "node", "left")
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


SQL = r"""
WITH ordered AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'body': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heights AS (
  SELECT conv_id, turns, CAST(xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS BIGINT) AS h FROM ordered
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS path
  FROM heights c LEFT JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT list_slice(path, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
  FROM members GROUP BY 1, 2
), children AS (
  SELECT list_slice(prefix, 1, depth - 1) AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].body, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN children c ON n.prefix = c.prefix AND n.depth = c.depth
), totals AS (
  SELECT a.prefix, a.depth, count(*) FILTER (s.n_children = 0) AS n_leaves, sum(s.saved) AS saved_tokens
  FROM full_nodes a JOIN full_nodes s ON s.depth >= a.depth AND list_slice(s.prefix, 1, a.depth) = a.prefix GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN totals t ON n.prefix = t.prefix AND n.depth = t.depth
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
"""


@register("op11_prefix_trie", sql=SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = regrown(numbered_turns(table(spark, sf_dir, "conversations")), group=20, most=3)
    return prefix_trie(convs, turns).drop("node")
