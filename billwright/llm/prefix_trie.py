"""Conversation prefix tries by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of those
that end there. A sequence that is a proper prefix of another is found by an
anti-join; what is left are the leaves. The prefixes of the weighted sequences
are aggregated to nodes.

A prefix is known by the exclusive or of 128-bit hashes of its turns, each
hashed with its place. That is associative, so it can be summed over pieces: a
conversation is cut into segments of a fixed number of turns and none is held
by one task because it is long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billwright.llm import common
from billwright.session import staged

#: Turns of a segment, and ids of one piece of an end list.
SEGMENT = 4096
PIECE = 1024

NODE = ["depth", "f1", "f2"]

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _running(rows: DataFrame, key: str, segment: Column, order: list[Column], later: list[Column], sums: dict[str, tuple[Callable, Callable, Column]]) -> DataFrame:
    """``rows`` with running totals per ``key`` in ``order``, summed by segments of the key.

    ``later`` orders the segments. Of ``sums`` each is an aggregate, how two
    totals make one, and what is added up; the total includes the row itself.
    """
    rows = rows.withColumn("_segment", segment)
    within = Window.partitionBy(key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(*later).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_segment").agg(*[agg(value).alias(f"_all_{name}") for name, (agg, _, value) in sums.items()])
    carried = totals.select(key, "_segment", *[agg(f"_all_{name}").over(before).alias(f"_all_{name}") for name, (agg, _, _) in sums.items()])
    run = rows.select("*", *[agg(value).over(within).alias(name) for name, (agg, _, value) in sums.items()])
    zero = F.lit(0).cast("long")
    total = {name: plus(F.col(name), F.coalesce(f"_all_{name}", zero)) for name, (_, plus, _) in sums.items()}
    return run.join(carried, [key, "_segment"]).withColumns(total).drop("_segment", *[f"_all_{name}" for name in sums])


def _add(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def numbered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, place (from 1), digest and bytes of every turn; ``place`` by turn (null first), then digest.

    Rows without a conversation id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("_turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = staged(rows, "turns")
    segment = F.coalesce(F.floor(F.col("_turn") / SEGMENT).cast("long"), F.lit(-(1 << 62)))
    one = {"place": (F.sum, _add, F.lit(1).cast("long"))}
    return _running(rows, "conv", segment, [F.asc_nulls_first("_turn"), F.asc("digest")], [F.asc("_segment")], one).drop("_turn")


def rebuilt(turns: DataFrame, conversations: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The turns of every conversation rebuilt: the first ``head`` of ``base``, then its own after as many.

    ``turns`` as ``numbered`` gives them, ``conversations`` has ``conv`` once
    each; ``base`` and ``head`` (at most ``most``) are columns of ``conv``.
    """
    plan = conversations.select("conv", base.cast("long").alias("base"), head.cast("long").alias("head"))
    # a long conversation lends its first turns only
    heads = staged(turns.where(F.col("place") <= most).select(F.col("conv").alias("base"), "place", "digest", "bytes"), "heads")
    lent = plan.join(heads, "base").where(F.col("place") <= F.col("head")).select("conv", "place", "digest", "bytes")
    known = heads.groupBy("base").agg(F.max("place").alias("known"))
    shift = plan.join(known, "base", "left").select("conv", "head", F.least("head", F.coalesce("known", F.lit(0).cast("long"))).alias("taken"))
    # the join goes by (conv, segment) so that one long conversation is no single task
    piece = F.floor(F.col("place") / SEGMENT).cast("long")
    most_piece = turns.groupBy("conv").agg(F.max(piece).alias("_last"))
    spread = shift.join(most_piece, "conv").select("conv", "head", "taken", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_piece"))
    own = (
        turns.withColumn("_piece", piece)
        .join(spread, ["conv", "_piece"])
        .where(F.col("place") > F.col("head"))
        .select("conv", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "digest", "bytes")
    )
    return lent.unionByName(own)


def _end_lists(conversations: DataFrame) -> DataFrame:
    """``NODE`` columns and ``ends_sha256`` of the ids, ascending and comma-joined, of conversations that end in one node.

    Ids are gathered in pieces of a bounded range; the digest, which can't be
    split, is fed piece by piece by one task a node, in constant memory.
    """
    pieces = conversations.groupBy(*NODE, F.floor(F.col("conv") / PIECE).cast("long").alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    sorted_pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
            for *key, ids in zip(*columns):
                if key == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
            yield _end_batch(done)
        if node is not None:
            yield _end_batch([(*node, digest.hexdigest())])

    return sorted_pieces.mapInArrow(run, "depth long, f1 long, f2 long, ends_sha256 string")


def _end_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[*NODE, "ends_sha256"])


def build_trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations``, whose turns are ``rows`` (conv, place, digest, bytes).

    A node is a distinct sequence of first turns; the root has none. Gives
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    spark = rows.sparkSession
    common.ship(spark)
    hashed = staged(
        rows.select("conv", "place", "bytes", F.xxhash64("place", "digest").alias("z1"), F.xxhash64("digest", F.lit("2"), "place").alias("z2")), "rebuilt"
    )
    zero = F.lit(0).cast("long")
    whole = hashed.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("z1").alias("f1"), F.bit_xor("z2").alias("f2"))
    whole = staged(
        conversations.select("conv").join(whole, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in NODE]), "whole"
    )
    # identical conversations collapse; the smallest id speaks for a sequence
    sequences = staged(whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv")), "sequences")
    own = hashed.join(sequences.select("conv"), "conv", "left_semi")
    xor = {"f1": (F.bit_xor, _xor, F.col("z1")), "f2": (F.bit_xor, _xor, F.col("z2"))}
    below = _running(own, "conv", F.floor((F.col("place") - 1) / SEGMENT).cast("long"), [F.asc("place")], [F.asc("_segment")], xor)
    root = sequences.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("bytes"), zero.alias("up1"), zero.alias("up2"))
    prefixes = staged(
        below.select("conv", F.col("place").alias("depth"), "f1", "f2", "bytes", _xor(F.col("f1"), F.col("z1")).alias("up1"), _xor(F.col("f2"), F.col("z2")).alias("up2")).unionByName(root),
        "prefixes",
    )
    # a sequence is no leaf if it is a proper prefix of another
    ends = sequences.select(F.col("conv"), F.col("depth").alias("_len"), "weight")
    weighted = prefixes.join(ends, "conv")
    proper = weighted.where(F.col("depth") < F.col("_len")).select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    weighted = weighted.join(leaves, "conv", "left").withColumn("leaf", F.coalesce("leaf", zero))
    nodes = staged(
        weighted.groupBy(*NODE).agg(
            F.min("conv").alias("conv"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.min("bytes").alias("bytes"),
            F.min("up1").alias("up1"),
            F.min("up2").alias("up2"),
        ),
        "nodes",
    )
    # every node counts on one sequence that holds it, so sums over sequences count it once
    value = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    valued = prefixes.select("conv", *NODE).join(value, ["conv", "depth"], "left").withColumn("value", F.coalesce("value", zero))
    back = {"rest": (F.sum, _add, F.col("value"))}
    rest = _running(valued, "conv", F.floor(F.col("depth") / SEGMENT).cast("long"), [F.desc("depth")], [F.desc("_segment")], back)
    saved = rest.groupBy(*NODE).agg(F.sum("rest").alias("saved_tokens"))
    upper = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("f1"), F.col("up2").alias("f2")]
    children = nodes.where("depth > 0").groupBy(*upper).agg(F.count(F.lit(1)).alias("n_children"))
    full = staged(
        nodes.join(saved, NODE)
        .join(children, NODE, "left")
        .join(_end_lists(whole), NODE, "left")
        .select(*NODE, "conv", "up1", "up2", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256")),
        "full-nodes",
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("up1"), F.col("f2").alias("up2"), F.col("conv").alias("parent_conv_id"))
    # a node may have a third of all nodes for children: the join is the last step, so that it can be split
    return full.join(parents, ["depth", "up1", "up2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def conversation_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 5, heads: int = 9
) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the first turns of one of its group.

    A conversation c takes the first h turns of conversation c - c % ``group``
    (all if it has fewer, none if it is not there), then its own after its
    first h; h is the CRC-32 of c's decimal digits modulo ``heads``. With
    ``heads`` 1 conversations stay as they are.

    Turns are ordered by ``turn_col``, null first, ties by a digest of role
    and text, so that repeated rows count as turns of their own. Null roles
    and texts are empty. Rows without a conversation id are left out. An empty
    table has no nodes, not even a root. Other columns are not read.
    """
    spaced = staged(numbered(turns, id_col, turn_col, role_col, text_col), "numbered")
    conversations = staged(spaced.select("conv").distinct(), "conversations")
    base, head = F.col("conv") - F.col("conv") % group, F.crc32(F.col("conv").cast("string")) % heads
    return build_trie(rebuilt(spaced, conversations, base, head, heads - 1), conversations)
