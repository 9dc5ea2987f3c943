"""Prefix trie of conversations by ROLLUP over positional turn ids.

A conversation is cut into blocks of ``WIDTH`` turns, one row a block with a column for each position. The row also
holds the key of the node where the block before it ended, so ``GROUP BY block, key, ROLLUP(t0, .., t7)`` aggregates
the prefixes of all conversations, short or long, in one pass; ``grouping_id`` tells the depth of each group.

A node's key is the exclusive or of 64-bit hashes of (turn, position) along its path, twice with different seeds;
equality of the 128 bits, and of the 128-bit digests of turns, stands for equality. A key of any depth is a running
total, which :func:`reviewloom.operators.ranks.running` cuts at any place, so no conversation has to fit in a task.

What is summed over a subtree needs no walk along the tree: each node belongs to its smallest member, the nodes of a
member are the lower end of its path, and so the sum over a subtree is the sum over its members of what they own, less
what the node's own member owns above it. That is a second ROLLUP of the same blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep
from reviewloom.operators.ranks import running

#: Turns of a block: columns of the ROLLUP, which makes ``WIDTH + 1`` copies of a block's row.
WIDTH = 8
#: Ids of one digest row: at most so many different ids share a quotient.
IDS = 4096
NODE = ["depth", "k1", "k2"]


def turn_ids(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, id, bytes)``: turns numbered from 1 by ``(turn, digest of role and text)``, null turns first.

    ``id`` is the digest and ``bytes`` the UTF-8 length of the text. Null roles and texts are empty; rows without a
    conversation are left out; repeated rows are repeated turns.
    """
    said = F.coalesce(F.col(role), F.lit(""))
    words = F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, words))).alias("id"),
        F.octet_length(words).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    return running(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("id").asc()], {"pos": ("one", "sum")}).select(
        "conv", "pos", "id", "bytes")


def with_shared_heads(placed: DataFrame, every: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and all conversations: ``(conv, pos, id, bytes)`` and ``(conv)``.

    With ``h`` the CRC-32 of the decimal id modulo ``longest``, a conversation ``c`` gets the first ``h`` turns of
    conversation ``c - c % every``, as far as there are any, and then its own turns after its first ``h``.
    """
    base = F.col("conv") - F.col("conv") % every
    h = F.crc32(F.col("conv").cast("string")) % longest
    convs = placed.select("conv").distinct().withColumn("base", base).withColumn("h", h)
    heads = placed.where((F.col("conv") % every == 0) & (F.col("pos") < longest)).withColumnRenamed("conv", "base")
    counts = heads.groupBy("base").agg(F.count("*").alias("n"))
    convs = convs.join(counts, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))).drop("n")
    shared = convs.where("conv <> base").join(heads, "base").where("pos <= h").select("conv", "pos", "id", "bytes")
    own = placed.withColumn("base", base).withColumn("h", h).where("conv = base OR pos > h")
    own = own.join(counts, "base", "left").select("conv", F.when(F.col("conv") == F.col("base"), F.col("pos")).otherwise(
        F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("pos"), "id", "bytes")
    return shared.unionByName(own), convs.select("conv")


def _term(turn_id: Column, pos: Column, seed: int) -> Column:
    return F.xxhash64(turn_id, pos.cast("long"), F.lit(seed))


def blocks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """``(conv, block, p1, p2, e1, e2, size, t0 ..)``: key before and after the block, and its turns by position.

    Every member has a block 0, so that one without turns belongs to the root.
    """
    at = (F.col("pos") - 1) % WIDTH
    rows = turns.select(
        "conv", F.floor((F.col("pos") - 1) / WIDTH).cast("long").alias("block"), at.cast("int").alias("at"), "id", "bytes",
        _term(F.col("id"), F.col("pos"), 1).alias("x1"), _term(F.col("id"), F.col("pos"), 2).alias("x2"))
    stub = members.select("conv", F.lit(0).cast("long").alias("block"), F.lit(None).cast("int").alias("at"),
                          F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("bytes"),
                          F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
    turn = F.when(F.col("at").isNotNull(), F.struct("at", "id", "bytes"))
    found = rows.unionByName(stub).groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    found = running(found, ["conv"], [F.col("block").asc()], {"e1": ("x1", "xor"), "e2": ("x2", "xor")})
    columns = [F.when(F.get("turns", F.lit(i)).isNotNull(), F.struct(
        F.get("turns", F.lit(i))["id"].alias("id"), F.get("turns", F.lit(i))["bytes"].alias("bytes"))).alias(f"t{i}")
        for i in range(WIDTH)]
    return found.select("conv", "block", F.col("e1").bitwiseXOR(F.col("x1")).alias("p1"),
                        F.col("e2").bitwiseXOR(F.col("x2")).alias("p2"), "e1", "e2", F.size("turns").alias("size"), *columns)


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes of the blocks; ``d`` is the depth inside the block. A block's own beginning is no node but at the root."""
    turns = ", ".join(f"t{i}" for i in range(WIDTH))
    groups = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {turns}, {WIDTH} - bit_count(grouping_id()) AS d, {aggregates} FROM {{rows}} "
        f"GROUP BY block, p1, p2, ROLLUP ({turns})", rows=rows)
    # A conversation that ends inside the block has no turn at the deeper levels.
    last = F.element_at(F.array(*[f"t{i}" for i in range(WIDTH)]), F.greatest(F.col("d"), F.lit(1)))
    groups = groups.withColumn("last", F.when(F.col("d") > 0, last))
    return groups.where("CASE WHEN d = 0 THEN block = 0 ELSE last IS NOT NULL END").withColumn("depth", F.col("block") * WIDTH + F.col("d"))


def _nodes(rows: DataFrame) -> DataFrame:
    groups = _rollup(rows, "min(conv) AS conv_id, count(*) AS n_convs")
    zero = F.lit(0).cast("long")
    for seed in (1, 2):
        key = F.col(f"p{seed}")
        for i in range(WIDTH):
            key = key.bitwiseXOR(F.when(F.col("d") > i, _term(F.col(f"t{i}.id"), F.col("block") * WIDTH + i + 1, seed)).otherwise(zero))
        groups = groups.withColumn(f"k{seed}", key)
        groups = groups.withColumn(f"q{seed}", F.when(F.col("d") > 0, F.col(f"k{seed}").bitwiseXOR(
            _term(F.col("last.id"), F.col("depth"), seed))))
    return groups.select(*NODE, "q1", "q2", "conv_id", "n_convs",
                         (F.coalesce(F.col("last.bytes"), zero) * (F.col("n_convs") - 1)).alias("value"))


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ids of each node, comma-joined; ids reach a task as joined runs and are hashed as they come."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if key != node:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 4, schema)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), schema)], schema=schema)

    runs = ends.groupBy(*NODE, F.floor(F.col("conv") / IDS).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return (runs.repartition(*NODE).sortWithinPartitions(*NODE, "run").select(*NODE, "ids")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of all prefixes, and the node where each conversation ends.

    ``turns`` is ``(conv, pos, id, bytes)`` with positions from 1 without gaps, as :func:`turn_ids` gives; ``members``
    may add conversations without turns. Nodes: ``depth, k1, k2`` (key), ``conv_id`` (smallest member),
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (bytes of last texts
    times members but one) over the subtree. Ends: ``conv, depth, k1, k2``. No conversation, no node.
    """
    found = turns.select("conv").distinct() if members is None else members.select("conv").distinct()
    rows = keep(blocks(turns, found), "trie-blocks")
    nodes = keep(_nodes(rows), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    # A member's nodes from the top: what it owns above each, and its topmost node, the only one whose parent is another's.
    nodes = keep(running(nodes, ["conv_id"], [F.col("depth").asc()], {"owned": ("value", "sum"), "top": ("depth", "min")}), "trie-owned")
    owners = nodes.groupBy("conv_id").agg(F.sum("value").alias("w"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    owning = rows.join(owners.withColumnRenamed("conv_id", "conv"), "conv")
    sums = _rollup(owning, "min(conv) AS conv_id, sum(w) AS w, sum(leaves) AS n_leaves").select("conv_id", "depth", "w", "n_leaves")
    whole = nodes.join(sums, ["conv_id", "depth"]).withColumn("saved_tokens", F.col("w") - F.col("owned") + F.col("value"))

    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"),
                           F.col("conv_id").alias("above"))
    deep = (F.col("depth") > 1) & (F.col("depth") == F.col("top"))
    tops = whole.where(deep).join(parents, ["depth", "q1", "q2"]).withColumnRenamed("above", "parent_conv_id")
    # All other parents are the member itself or the root, which is one row.
    rest = whole.where(~deep).crossJoin(F.broadcast(root)).withColumn("parent_conv_id", F.when(
        F.col("depth") == 1, F.col("root")).when(F.col("depth") > 1, F.col("conv_id")))
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = rows.groupBy("conv").agg(F.max(F.struct((F.col("block") * WIDTH + F.col("size")).alias("depth"), F.col("e1").alias("k1"),
                                                   F.col("e2").alias("k2"))).alias("end")).select("conv", "end.*")
    return tops.select(*columns).unionByName(rest.select(*columns)), ends


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256`` over the conversations that end there."""
    return nodes.join(_digests(ends), NODE, "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])
