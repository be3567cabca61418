r"""Prefix trie of conversations, built level by level.

The turns of a conversation are put in order by a range sort over (conversation, turn), so one that holds a large share of
all rows lies in many partitions; what stays of a turn is its digest and its length. Then, depth by depth, the live
conversations are grouped by (parent node, next turn), and the least id of a group names the node. Conversations of one and the same
sequence go as one, with their number. A node that holds a single sequence has no further branch: what is below it is
a chain in closed form, so levels end where the last two unlike sequences part. From the deepest level up, each
level's leaves and savings are summed by parent and joined to the level above.

A third of all conversations may share a turn: groups combine before they are shuffled, and of what is joined back to the
conversations hot nodes (bounded by number) are broadcast, the others dealt by node. The digest of the ids that end at
a node is one stream, as SHA-256 is; it gets them sorted and holds none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import columns_kept, cut, parts, read, ship, stored
from granary.operators.scan import in_ranges, joined, running

BLOCK, HEADS = 5, 9
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NONE = hashlib.sha256(b"").hexdigest()
_LANES = ("l0", "l1", "l2", "length")


def own_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, digest, bytes, pos, before): each conversation's turns in order, with their place from 0 and the bytes of
    those up to and with each."""
    ship(rows.sparkSession)
    own = columns_kept(rows, {c: c for c in ("conv_id", "turn", "role", "text")}).filter("conv_id IS NOT NULL")
    said = own.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    short = [F.col("turn"), *[F.substring(c, 1, 32) for c in ("role", "text")]]
    ranged = in_ranges(said, parts(rows.sparkSession), "conv_id", ["turn", "role", "text"], short)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    held = cut(ranged.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")))
    return running(held, "conv_id", ["bytes"], rank="pos", prefix="upto_").withColumnRenamed("upto_bytes", "upto")


def heads_kept(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes, below) of every turn of every rebuilt conversation, ``below`` the bytes from it on;
    and (conv_id, length) of the conversations, those without a turn included."""
    turns = cut(turns)
    head = F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS - 1, F.struct("pos", "digest", "bytes"))))
    info = cut(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"), head.alias("heads")))
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    bases = info.select(F.col("conv_id").alias("base"), F.col("heads").alias("first"))
    convs = info.withColumns({"h": heads_kept(F.col("conv_id")).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % BLOCK}).join(bases, "base", "left")
    first = F.slice(F.coalesce("first", F.array().cast(bases.schema["first"].dataType)), F.lit(1), F.col("h"))
    convs = convs.withColumn("first", first).withColumn("k", F.size("first")).withColumn("rest", F.col("total") - add(F.slice("heads", F.lit(1), F.col("h"))))
    convs = cut(convs.select("conv_id", "n", "h", "k", "total", "rest", "first", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")))
    own = joined(turns.filter(F.col("pos") >= heads_kept(F.col("conv_id"))), convs.select("conv_id", "n", "h", "k", "total"), ["conv_id"], "n", total)
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k") + 1).cast("long").alias("depth"), "digest", "bytes", (F.col("total") - F.col("upto") + F.col("bytes")).alias("below"))
    lead = convs.select("conv_id", "rest", "first", F.posexplode("first").alias("at", "turn"))
    left = add(F.slice("first", F.col("at") + 1, F.size("first"))) + F.col("rest")
    lead = lead.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), F.col("turn.digest").alias("digest"), F.col("turn.bytes").alias("bytes"), left.alias("below"))
    return stored(in_ranges(own.unionByName(lead), parts(spark), "depth", ["conv_id"])), convs.select("conv_id", "length")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal sequences: its least id, their number, the digest of their ids."""
    key, rep, n, state = None, 0, 0, hashlib.sha256()
    names, kinds = ["rep", "weight", "length", "ends"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def out(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        done = []
        for *lanes, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if lanes == key:
                state.update(b",%d" % conv)
                n += 1
                continue
            if key is not None:
                done.append((rep, n, key[-1], state.hexdigest()))
            key, rep, n, state = lanes, conv, 1, hashlib.sha256(b"%d" % conv)
        if done:
            yield out(done)
    if key is not None:
        yield out([(rep, n, key[-1], state.hexdigest())])


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, weight, length, ends): each distinct sequence, its least conversation, their number, the digest of their ids.

    A sequence is told by three lanes of 64 bits over its (depth, turn) pairs, which combine in any order.
    """
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), "depth", "digest", F.lit(k))).alias(f"l{k}") for k in range(3)]
    told = convs.join(turns.groupBy("conv_id").agg(*lanes), "conv_id", "left").select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _LANES], "conv_id")
    return told.repartition(parts(convs.sparkSession), *_LANES).sortWithinPartitions(*_LANES, "conv_id").mapInArrow(_ends, "rep long, weight long, length long, ends string")


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``rows`` has conv_id, turn, role and text. A null turn comes first; rows of one turn follow each other by role and
    text; repeated rows are turns of their own; null roles and texts are empty. Rows without a conv_id belong to no
    conversation. Texts are compared whole, however long, by their SHA-256. Other columns don't matter, whatever their
    names. An empty table has no conversation and so no node.
    """
    spark = rows.sparkSession
    turns, convs = rebuilt(spark, own_turns(rows))
    kinds = stored(sequences(turns, convs))
    total = convs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_kinds, n_convs, least = kinds.agg(F.count(F.lit(1)), F.sum("weight"), F.min("rep")).first()
    if not n_kinds:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE))
    root = kinds.agg(F.max(F.when(F.col("length") == 0, F.col("ends"))).alias("ends")).select(F.lit(least).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(2).cast("long").alias("n_kinds"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("length"), "ends")
    levels, live, n = [stored(root)], kinds.filter("length > 0").withColumn("node", F.lit(least).cast("long")), n_kinds
    while not live.isEmpty():
        depth = len(levels)
        here = live.join(turns.filter(F.col("depth") == depth).select(F.col("conv_id").alias("rep"), "digest", "bytes", "below"), "rep")
        nodes = here.groupBy(F.col("node").alias("parent"), "digest").agg(
            F.min("rep").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.count(F.lit(1)).alias("n_kinds"),
            F.max("bytes").alias("bytes"),
            F.max("below").alias("below"),
            F.max("length").alias("length"),
            F.max(F.when(F.col("length") == depth, F.col("ends"))).alias("ends"),
        )
        nodes = stored(nodes)
        levels.append(nodes)
        several = nodes.filter("n_kinds > 1").select(F.col("parent").alias("node"), "digest", F.col("conv_id").alias("next"), "n_kinds")
        on = joined(here.filter(F.col("length") > depth), several, ["node", "digest"], "n_kinds", n)
        live = stored(on.select("rep", "weight", "length", "ends", F.col("next").alias("node")))
        n = live.count()
    done, above = [], None
    for depth in reversed(range(len(levels))):
        single, own = F.col("n_kinds") == 1, (F.col("n_convs") - 1) * F.col("bytes")
        x = levels[depth]
        if above is None:
            x = x.withColumns({"c": F.lit(0).cast("long"), "lv": F.lit(0).cast("long"), "sv": F.lit(0).cast("long")})
        else:
            kids = above.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("lv"), F.sum("saved_tokens").alias("sv"))
            x = x.join(kids, "conv_id", "left")
        count = F.coalesce("c", F.lit(0).cast("long"))
        above = stored(
            x.select(
                "conv_id",
                "parent",
                "n_convs",
                F.when(single, (F.col("length") > depth).cast("long")).otherwise(count).alias("n_children"),
                F.when(single | (count == 0), F.lit(1).cast("long")).otherwise(F.col("lv")).alias("n_leaves"),
                F.when(single, (F.col("n_convs") - 1) * F.col("below")).otherwise(own + F.coalesce("sv", F.lit(0).cast("long"))).alias("saved_tokens"),
                "ends",
            )
        )
        done.append(above.select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256")))
    chains = [x.filter((F.col("n_kinds") == 1) & (F.col("length") > d)).select("conv_id", F.lit(d).cast("long").alias("from")) for d, x in enumerate(levels) if d]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    if chains:
        starts = chains[0]
        for x in chains[1:]:
            starts = starts.unionByName(x)
        known = starts.join(kinds.withColumnRenamed("rep", "conv_id"), "conv_id")
        tails = joined(turns, known, ["conv_id"], "length", total, stored).filter(F.col("depth") > F.col("from"))
        last = F.col("depth") == F.col("length")
        out = out.unionByName(tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * F.col("below")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(_NONE)).alias("ends_sha256")))
    return out.select(*_NODE)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))),
      4294967295::BIGINT), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY part, pos) AS depth, role, text
  FROM (SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND pos < h
        UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos >= h) c
), paths AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
    sha256(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
), linked AS (
  SELECT n.*, p.path AS above, m.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes m ON m.path = p.path AND m.depth = p.depth
), kids AS (
  SELECT above AS path, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE above IS NOT NULL GROUP BY ALL
), sums AS (
  SELECT p.path, p.depth, sum((k.path IS NULL)::INT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n LEFT JOIN kids k USING (path, depth) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked LEFT JOIN kids USING (path, depth) JOIN sums USING (path, depth)
"""
