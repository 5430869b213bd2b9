"""Prefix trie of conversations by fixed-length block hashing.

1. Turns become digests and byte counts, with dense positions; texts are read
   once and never shuffled.  Consecutive turns of a conversation are kept in
   pieces of ``PIECE``, so no task holds a long conversation.
2. Blocks of ``BLOCK`` turns are hashed in a chain: a block's id stands for all
   turns up to its end.  Conversations are grouped by block ids first.
3. Where a parent block has one child block only, all its conversations share
   every turn of it: its nodes need no grouping.  Only blocks whose siblings
   diverge (and the first ones, siblings under the root) are opened, one copy of
   each, and their turn boundaries grouped.
4. A node belongs to its smallest member.  A conversation owns the end of its own
   path, from the first turn that no smaller one shares; so every sum over a
   subtree is a sum over the members of its top, and combines before the shuffle.

Ids are SHA-256 of content, taken as equal only for equal content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm.inputs import or_empty
from pairforge.llm.spans import text_bytes
from pairforge.operators.ordering import dense_position
from pairforge.operators.skew import hot_keys, skew_join
from pairforge.session import stage

#: Turns of a block, and of a piece of a conversation that is worked on at once.
BLOCK, PIECE = 4, 4096
#: Turn numbers of one bucket when positions are counted.
TURNS = 4096
#: Conversation ids of one chunk when the ids that end at a node are hashed.
CHUNK = 8192
ROOT = bytes(32)

_ITEMS = ["pos", "digest", "n_bytes"]
_BLOCK = "k: bigint, parent: binary, id: binary, turns: binary, sizes: array<bigint>, bytes: bigint, until: bigint"


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, n_bytes`` of every turn, positions from 0 in the order of turns.

    A null turn comes first, equal ones stand by digest.  Null role and text are
    empty.  Rows without ``conv_id`` are of no conversation and left out.
    """
    role, text = or_empty("role"), or_empty("text")
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _sha(F.length(role).cast("string"), F.lit(":"), role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = stage(narrow, "turns")
    turn = F.col("turn")
    buckets = [
        turn.isNotNull().cast("int"),
        F.coalesce(F.floor(turn / F.lit(TURNS)), F.lit(0)),
        F.when(turn.isNull(), F.substring(F.hex("digest"), 1, 3)).otherwise(""),
    ]
    placed = dense_position(rows, buckets, [turn.asc_nulls_first(), F.col("digest")], within=["conv_id"])
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "n_bytes")


def _piece_of(pos: str | Column) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(PIECE))


def _by_piece(convs: DataFrame, turns: str) -> DataFrame:
    """Repeat each conversation for its pieces, so that a join by (conv_id, piece) meets a bounded number of turns."""
    last = F.greatest(F.col(turns) - 1, F.lit(0).cast("long"))
    return convs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), _piece_of(last))))


def rebuild(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Give conversation c the first h turns of conversation ``c - c % every`` and its own after its first h.

    h is the CRC-32 of c in decimals modulo ``most``; a base with fewer turns
    gives all, an absent one none.  Returns the new turns (with ``n_turns`` of their
    conversation) and one row (``conv_id, n_turns``) for each conversation, turnless
    ones too.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    grafts = sizes.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    )
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    grafts = (
        grafts.join(base, "base", "left")
        .withColumn("head", head)
        .withColumn("n_turns", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    # At most ``most`` - 1 turns of a base go to each conversation that is grafted on it.
    first = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    heads = first.join(grafts.drop("n"), "base").filter(F.col("pos") < F.col("head"))
    own = (
        turns.withColumn("piece", _piece_of("pos"))
        .join(_by_piece(grafts, "n"), ["conv_id", "piece"])
        .filter(F.col("pos") >= F.col("h"))
        .withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    )
    columns = ["conv_id", "n_turns", *_ITEMS]
    return heads.select(columns).unionByName(own.select(columns)), grafts.select("conv_id", "n_turns")


def _chain(items: pa.Array, piece: pa.Array, seed: pa.Array, before: pa.Array) -> pa.Array:
    """Blocks of pieces: ids continue from ``seed``, byte counts from ``before``."""
    flat = items.flatten()
    raw = text_bytes(flat.field("digest"))[0].tobytes()
    sizes = np.asarray(flat.field("n_bytes"))
    ends = np.cumsum(np.asarray(items.value_lengths())).tolist()
    total = np.concatenate([[0], np.cumsum(sizes)])
    ks, parents, ids, packed, firsts, lasts, until, counts = [], [], [], [], [], [], [], []
    at = 0
    for end, number, state, ahead in zip(ends, piece.to_pylist(), seed.to_pylist(), before.to_pylist()):
        start = at
        while at < end:
            to = min(at + BLOCK, end)
            block = raw[32 * at : 32 * to]
            ks.append(number * (PIECE // BLOCK) + (at - start) // BLOCK)
            parents.append(state)
            state = hashlib.sha256(state + block).digest()
            ids.append(state)
            packed.append(block)
            firsts.append(at)
            lasts.append(to)
            until.append(ahead + int(total[to] - total[start]))
            at = to
        counts.append(len(ks))
    firsts, lasts = np.asarray(firsts, np.int64), np.asarray(lasts, np.int64)
    # Blocks stand side by side, so their turns' sizes are one list after the other.
    values = [
        pa.array(ks, pa.int64()), pa.array(parents, pa.binary()), pa.array(ids, pa.binary()), pa.array(packed, pa.binary()),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lasts]).astype(np.int32)), pa.array(sizes.astype(np.int64))),
        pa.array(total[lasts] - total[firsts], pa.int64()), pa.array(until, pa.int64()),
    ]
    rows = pa.StructArray.from_arrays(values, ["k", "parent", "id", "turns", "sizes", "bytes", "until"])
    return pa.ListArray.from_arrays(pa.array(np.asarray([0, *counts], np.int32)), rows)


def _fold(totals: pa.Array) -> pa.Array:
    """Ids of what comes before each piece but the first, from the digests of the pieces before."""
    out = []
    for row in totals:
        state, ahead, seeds = ROOT, 0, []
        for total in row.as_py():
            state, ahead = hashlib.sha256(state + total["digest"]).digest(), ahead + total["n_bytes"]
            seeds.append({"piece": total["piece"] + 1, "seed": state, "before": ahead})
        out.append(seeds)
    return pa.array(out, pa.list_(pa.struct([("piece", pa.int64()), ("seed", pa.binary()), ("before", pa.int64())])))


def _digest_of(items: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(b"".join(x["digest"] for x in row.as_py())).digest() for row in items], pa.binary())


def _blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` and the fields of ``_BLOCK`` of every block of every conversation; written once."""
    rows = turns.groupBy("conv_id", "n_turns", _piece_of("pos").alias("piece")).agg(F.array_sort(F.collect_list(F.struct(*_ITEMS))).alias("items"))
    pieces = stage(rows, "pieces")
    # Only a full piece can have a next one.
    sums = F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x.n_bytes)
    full = pieces.filter(F.size("items") == PIECE).select(
        "conv_id", F.struct("piece", F.arrow_udf(_digest_of, "binary")("items").alias("digest"), sums.alias("n_bytes")).alias("total")
    )
    folded = F.arrow_udf(_fold, "array<struct<piece: bigint, seed: binary, before: bigint>>")
    lists = full.groupBy("conv_id").agg(F.array_sort(F.collect_list("total")).alias("totals"))
    seeds = lists.select("conv_id", F.inline(folded("totals")))
    begun = pieces.filter("piece = 0").withColumns({"seed": F.lit(ROOT), "before": F.lit(0).cast("long")})
    seeded = begun.unionByName(pieces.filter("piece > 0").join(seeds, ["conv_id", "piece"]))
    chain = F.arrow_udf(_chain, f"array<struct<{_BLOCK}>>")
    return stage(seeded.select("conv_id", "n_turns", F.inline(chain("items", "piece", "seed", "before"))), "blocks")


def _end(turns: Column) -> Column:
    """Depth at the end of a block."""
    return F.col("k") * BLOCK + F.size(turns)


def _prefix_id(turn: Column) -> Column:
    """Id of the node after the first ``turn`` turns of a block."""
    return _sha(F.col("parent"), F.substring(F.col("turns"), F.lit(1), (turn * 32).cast("int")))


def _distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row per block id with its content and ``split``: whether siblings diverge in it; written once."""
    groups = blocks.groupBy("id", "parent", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("longest")
    )
    # All first blocks are siblings under the root; deeper ones meet their parent's count.
    deep = groups.filter("k > 0")
    kids = deep.groupBy("parent").agg(F.count(F.lit(1)).alias("n_kids")).filter("n_kids > 1")
    told = skew_join(deep, kids, "parent", "left", ["id"], hot_keys(kids, "parent", "n_kids"))
    judged = told.withColumn("split", F.col("n_kids").isNotNull()).drop("n_kids")
    judged = judged.unionByName(groups.filter("k = 0").withColumn("split", F.lit(True)))
    content = blocks.select("conv_id", "k", "turns", "sizes", "bytes")
    return stage(judged.join(content, ["conv_id", "k"]), "distinct-blocks")


def _opened(blocks: DataFrame, *columns: str | Column) -> DataFrame:
    """One row for each turn of each block: ``node`` (id), ``depth``, ``turn`` (from 1) and ``columns``."""
    turned = blocks.withColumn("turn", F.explode(F.sequence(F.lit(1), F.size("sizes"))))
    return turned.select(_prefix_id(F.col("turn")).alias("node"), (F.col("k") * BLOCK + F.col("turn")).alias("depth"), "turn", *columns)


def _paths(distinct: DataFrame, blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """For each conversation ``n_turns``, how many turns (``shared``) and bytes (``shared_bytes``) a smaller one has too, and whether it owns a leaf."""
    whole = distinct.filter("NOT split").select(
        "conv_id", F.size("sizes").cast("long").alias("n_own"), F.col("bytes").alias("own_bytes"), (F.col("longest") == _end(F.col("sizes"))).alias("leaf")
    )
    opened = _opened(distinct.filter("split"), "conv_id", "longest", F.element_at("sizes", F.col("turn")).alias("size"))
    nodes = opened.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("longest").alias("longest"), F.max("depth").alias("depth"), F.max("size").alias("own_bytes")
    )
    single = nodes.select("conv_id", F.lit(1).cast("long").alias("n_own"), "own_bytes", (F.col("longest") == F.col("depth")).alias("leaf"))
    owned = whole.unionByName(single).groupBy("conv_id").agg(
        F.sum("n_own").alias("n_own"), F.sum("own_bytes").alias("own_bytes"), F.max(F.col("leaf").cast("long")).alias("leaf")
    )
    totals = blocks.groupBy("conv_id").agg(F.max("until").alias("total"))
    zero = F.lit(0).cast("long")
    known = convs.join(totals, "conv_id", "left").join(owned, "conv_id", "left")
    return stage(
        known.select(
            "conv_id", "n_turns",
            (F.col("n_turns") - F.coalesce("n_own", zero)).alias("shared"),
            (F.coalesce("total", zero) - F.coalesce("own_bytes", zero)).alias("shared_bytes"),
            F.coalesce("leaf", zero).alias("leaf"),
        ),
        "paths",
    )


def _nodes(distinct: DataFrame, placed: DataFrame, paths: DataFrame) -> DataFrame:
    """All nodes with ``node``, ``depth``, ``conv_id`` and their sums; written once."""
    end = _end(F.col("sizes"))
    beyond = F.when(F.col("shared") > end, F.col("shared_bytes") - F.col("until")).otherwise(0)
    goes_on = ((F.col("shared") <= end) & (F.col("n_turns") > end)).cast("long")
    sums = placed.groupBy("id").agg(
        # Only the smallest member leaves the smaller conversations inside the block.
        F.min("shared").alias("shared"), F.sum(beyond).alias("beyond"), F.sum(goes_on).alias("goes_on"), F.sum("leaf").alias("leaves")
    )
    turn, size = F.col("turn"), F.size("sizes")
    bytes_of = lambda first, last: F.aggregate(
        F.slice("sizes", first, F.greatest(last - first + 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    among = F.least(F.col("shared") - F.col("k") * BLOCK, size.cast("long")).cast("int")
    rows = _opened(
        distinct.join(sums, "id"),
        "split", "conv_id", "n", "leaves",
        (F.col("beyond") + (F.col("n") - 1) * bytes_of(turn, size) + bytes_of(turn, among)).alias("saved"),
        F.when(turn < size, (F.col("shared") <= F.col("k") * BLOCK + turn).cast("long")).otherwise(F.col("goes_on")).alias("children"),
    ).drop("turn")
    merged = rows.filter("split").groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")]
    )
    root = paths.agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.sum("leaf"), F.lit(1).cast("long")).alias("leaves"),
        F.sum("shared_bytes").alias("saved"),
        F.sum(((F.col("shared") == 0) & (F.col("n_turns") > 0)).cast("long")).alias("children"),
    ).filter("n > 0")
    top = root.select(F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), "*")
    return stage(rows.filter("NOT split").drop("split").unionByName(merged).unionByName(top), "nodes")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (node, chunk) to one digest per node; only the running hash is held."""
    node, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for now, text in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
            if now != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = now, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends"])


def _ends(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """For each node where conversations end, the digest of their ids in order.

    Ids are sorted and written in chunks of an id range first, so that a chunk is
    bounded; one digest needs its chunks one after the other, as any SHA-256 does.
    """
    last = blocks.filter(F.col("n_turns") == _end(F.col("sizes"))).select(F.col("id").alias("node"), "conv_id")
    turnless = paths.filter("n_turns = 0").select(F.lit(ROOT).alias("node"), "conv_id")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = last.unionByName(turnless).groupBy("node", F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = chunks.repartition("node").sortWithinPartitions("node", "chunk")
    return ordered.select("node", "ids").mapInArrow(_hash_lists, "node binary, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of all conversations' turn sequences.

    ``turns`` (``conv_id, n_turns, pos, digest, n_bytes``) and ``convs`` come from
    ``rebuild``.  One row per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over the subtree, bytes of a node's turn for each member beyond the first) and
    ``ends_sha256``.  The root is always there unless there is no conversation.
    """
    blocks = _blocks(turns)
    distinct = _distinct_blocks(blocks)
    paths = _paths(distinct, blocks, convs)
    in_piece = F.floor(F.col("k") / F.lit(PIECE // BLOCK)).alias("piece")
    placed = blocks.select("*", in_piece).join(_by_piece(paths.drop("n_turns").join(convs, "conv_id"), "n_turns").drop("n_turns"), ["conv_id", "piece"])
    nodes = _nodes(distinct, placed, paths)
    # A conversation's first own node hangs on a node of a smaller one.
    start = F.col("k") * BLOCK
    branch = placed.filter((F.col("shared") > start) & (F.col("shared") <= _end(F.col("sizes"))) & (F.col("shared") < F.col("n_turns")))
    branch = branch.select("conv_id", (F.col("shared") + 1).alias("depth"), _prefix_id(F.col("shared") - start).alias("node"))
    inner = nodes.filter("children > 0 AND depth > 0").select("node", F.col("conv_id").alias("above"), "children")
    tops = skew_join(branch, inner.drop("children"), "node", "inner", ["conv_id"], hot_keys(inner, "node", "children")).drop("node")
    least = paths.agg(F.min("conv_id").alias("least")).scalar()
    parent = F.when(F.col("depth") == 1, least).when(F.col("depth") > 1, F.coalesce("above", "conv_id"))
    placed_nodes = nodes.join(tops, ["conv_id", "depth"], "left").join(_ends(blocks, paths), "node", "left")
    return placed_nodes.select(
        "conv_id", "depth",
        parent.alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations (``conv_id, turn, role, text``); other columns are ignored.

    Repeated rows are turns of their own, placed one after the other.
    """
    return prefix_trie(*rebuild(number_turns(conversations)))
