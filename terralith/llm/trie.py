"""Prefix trie of conversations by fixed-length block hashing.

Turns become 128-bit digests; a sorted stream chains them, so that every prefix has a name, and cuts each
conversation into blocks of BLOCK turns. Conversations are grouped by whole blocks first: equal (prefix before,
prefix after) pairs are one block with its number of members. Where a prefix is followed by one block only, the
block's turns are a chain and need no grouping; where siblings diverge, turn boundaries inside their distinct
blocks are refined into nodes.

A node is owned by its least member. What a conversation owns is the end of its path, so a subtree's sum is the
sum over the subtree's members of all they own, less what the node's owner owns above the node: two groupings
of blocks give every node's figures, at any depth.

Defined results: null roles and texts are empty; rows without a conv_id take no part; rows of one turn follow by
role, then by their digest (equal rows are turns of their own); other columns are ignored; an empty table has
no nodes. Conversations stream through a task turn by turn, and hold BLOCK digests of memory; a prefix that a
third of all conversations share is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import joined_by_key, materialize, merged, streamed_sha256, table

#: Turns of a block, turns that a group of conversations takes over at most, and its size.
BLOCK, HEAD, GROUP = 4, 3, 20
#: Members of a node are listed in pieces of so many successive ids.
IDS = 4096
ROOT = b""
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, words of every turn, in order."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)), 1, 16)
    rows = rows.select("conv_id", "turn", "role", named.alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", (F.row_number().over(order).cast("long") - 1).alias("pos"), "digest", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, one row each), and the turns of their rebuilt forms."""
    named = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    convs = own.select("conv_id").distinct().select("conv_id", named.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    turn = F.struct("pos", "digest", "words")
    heads = own.where((F.col("pos") < HEAD) & (F.col("conv_id") % GROUP == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = merged(convs, heads, "base", "left").select("conv_id", "h", F.slice("head", F.lit(1), F.col("h").cast("int")).alias("head"))
    taken = F.coalesce(F.size("head"), F.lit(0))
    convs = convs.select("conv_id", "h", "head", F.when(F.col("head").isNull(), 0).otherwise(taken).alias("taken"))
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    rest = merged(own, convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return convs.select("conv_id"), first.unionByName(rest)


def blocks(rows: DataFrame) -> DataFrame:
    """conv_id, depth and prefix before and after each block, its turns (prefix, words), and whether it is the last."""

    def cut(batches):
        import hashlib

        import pyarrow as pa

        turn = pa.struct([("prefix", pa.binary()), ("words", pa.int32())])
        names = ["conv_id", "depth", "before", "after", "turns", "last"]
        conv, depth, before, held = None, 0, ROOT, []
        done = []

        def close(last):
            nonlocal depth, before, held
            if held:
                done.append((conv, depth, before, held[-1]["prefix"], held, last))
                depth, before, held = depth + len(held), held[-1]["prefix"], []

        def batch():
            cols = list(zip(*done, strict=True)) if done else [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(turn), pa.bool_()), strict=True)], names)

        for b in batches:
            for c, digest, words in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if c != conv:
                    close(True)
                    conv, depth, before, held = c, 0, ROOT, []
                elif len(held) == BLOCK:
                    close(False)
                prefix = held[-1]["prefix"] if held else before
                held.append({"prefix": hashlib.sha256(prefix + digest).digest()[:16], "words": words})
            yield batch()
        close(True)
        yield batch()

    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "words")
    return rows.mapInArrow(cut, "conv_id bigint, depth bigint, before binary, after binary, turns array<struct<prefix:binary,words:int>>, last boolean")


def per_node(parts: DataFrame, sums: list[str], least: list[str] = ()) -> DataFrame:
    """Figures of whole blocks as figures of nodes: parts has before, after, depth, turns and the columns of figures.

    Blocks after a prefix that no other block follows are opened as they are; the turns of siblings are grouped.
    """
    alone = parts.groupBy("before").agg(F.count("*").alias("m"))
    marked = joined_by_key(parts, alone, "before", parts.count())
    above = lambda i, at: F.when(i == 0, F.col("before")).otherwise(F.get(F.col("turns"), i - 1)["prefix"])
    step = F.transform("turns", lambda t, i: F.struct((F.col("depth") + i + 1).alias("depth"), above(i, t).alias("parent"), t["prefix"].alias("prefix"), t["words"].alias("words")))
    figures = [*sums, *least]
    each = lambda df: df.select(F.explode(step).alias("n"), *figures).select("n.*", *figures)
    grouped = each(marked.where("m > 1")).groupBy("prefix").agg(*[F.any_value(c).alias(c) for c in ("depth", "parent", "words")], *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least])
    return each(marked.where("m = 1")).unionByName(grouped)


def nodes(conversations: DataFrame) -> DataFrame:
    """One row a node, as op13_trie returns them."""
    own = materialize(turns(conversations), "trie-turns")
    convs, rows = rebuilt(own)
    convs = materialize(convs, "trie-conversations")
    cut = materialize(blocks(rows), "trie-blocks", "zstd")
    whole = ["before", "after", "depth"]
    parts = cut.groupBy(*whole).agg(F.any_value("turns").alias("turns"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(ROOT).alias("prefix"), F.lit(0).alias("words"), "n_convs", "conv_id")
    found = per_node(materialize(parts, "trie-parts", "zstd"), ["n_convs"], ["conv_id"]).unionByName(root)
    children = found.groupBy("parent").agg(F.count("*").alias("n_children")).where("parent IS NOT NULL").withColumnRenamed("parent", "prefix")
    found = merged(found, children, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    found = materialize(found, "trie-nodes")
    # what each conversation owns: tokens saved at its nodes, and its leaf
    value = (F.col("n_convs") - 1) * F.col("words")
    owned = found.groupBy("conv_id").agg(F.sum(value).alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")).where("saved > 0 OR leaves > 0")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    tops = found.where("n_convs > 1").select("prefix", F.coalesce(F.sum(value).over(above), F.lit(0)).alias("above"))
    below = merged(cut, owned, "conv_id").groupBy(*whole).agg(F.any_value("turns").alias("turns"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    below = per_node(materialize(below, "trie-below", "zstd"), ["saved", "leaves"]).select("prefix", "saved", "leaves")
    below = below.unionByName(owned.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(F.lit(ROOT).alias("prefix"), "saved", "leaves"))
    out = merged(merged(found, below, "prefix"), tops, "prefix", "left")
    up = found.where("n_children > 0").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("m"))
    parents = joined_by_key(found.where("depth > 0").select("prefix", "parent"), up, "parent", found.count()).select("prefix", "parent_conv_id")
    out = merged(merged(out, parents, "prefix", "left"), members_ending(convs, cut), "prefix", "left")
    sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    # below a node with one member nothing is shared
    saved = F.when(F.col("n_convs") == 1, 0).otherwise(F.col("saved") - F.coalesce("above", F.lit(0))).alias("saved_tokens")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved, sha)


def members_ending(convs: DataFrame, cut: DataFrame) -> DataFrame:
    """prefix, sha256 of the ids of the conversations that end there, in order."""
    ends = cut.where("last").select("conv_id", F.col("after").alias("prefix"))
    empty = merged(convs, cut.where("depth = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("prefix"))
    piece = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")))
    listed = ends.unionByName(empty).groupBy("prefix", F.floor(F.col("conv_id") / IDS).alias("at")).agg(piece.alias("piece"))
    return streamed_sha256(listed, "prefix", "at", ",")


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations"))


def oracle_sql() -> str:
    from terralith.llm.repair import CRC, CRC_TABLE

    return f"""WITH t AS {CRC_TABLE},
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': sha256(length(role) || ':' || role || ':' || text), 'w': len(regexp_extract_all(text, '{WORD}'))}} ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS turns FROM rows GROUP BY conv_id),
heads AS (SELECT o.*, {CRC.format('CAST(conv_id AS VARCHAR)')} % {HEAD + 1} AS h FROM own o, t),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {GROUP}),
paths AS (SELECT conv_id, d, len(turns) = d AS ends, array_to_string(list_transform(turns[1:d], lambda x: x.k), '') AS prefix, array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), '') AS parent,
  CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS words FROM rebuilt, unnest(range(len(turns) + 1)) AS u(d)),
node AS (SELECT prefix, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY prefix, d),
kids AS (SELECT parent, count(*) AS n FROM node WHERE d > 0 GROUP BY parent),
full_node AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM node n LEFT JOIN kids k ON k.parent = n.prefix),
sums AS (SELECT left(n.prefix, 64 * CAST(u.d AS INTEGER)) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM full_node n, unnest(range(n.d + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_node n JOIN sums s USING (prefix) LEFT JOIN node p ON p.prefix = n.parent AND n.d > 0"""
