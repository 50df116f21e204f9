"""Jaccard join of word n-grams, and the groups of texts that it links.

Texts with the same n-gram set are one class. Two classes that link share an
n-gram among the rarest few of each (the prefix filter), so each class is
listed under these. Within a list classes meet in tiles of one size band and
the next; hashed bitmaps tell by bit counts how much two sets can overlap at
most, and what passes is settled by intersecting sorted arrays, made of the two
texts where they meet: packed texts are what travels. Classes that links
connect already need not be compared again: a first round compares each class
with one of a list only, and each further round tests just the pairs that would
join what is still apart, in tiles that have more of them. So large groups of
near copies give as many pairs as they have classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common, graph, spans
from billwright.session import handed, scratch, staged

#: Counters of hashed words, by which n-grams are ordered from rare to common.
WORD_BUCKETS = 1 << 16
#: Bits of a class's bitmap.
BITS = 2048
#: Classes of a tile; a band with more is split into pairs of tiles.
TILE = 1000
BATCH_BYTES = 1 << 20


def _word_ranks(docs: DataFrame, text_col: str) -> np.ndarray:
    """For each bucket of words the log2 of its count over all texts: ``WORD_BUCKETS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WORD_BUCKETS, np.int64)
        for whole in batches:
            for batch in common.slices(whole, 0, BATCH_BYTES):
                words, _ = _words(batch.column(0))
                sums += np.bincount((words >> np.uint64(48)).astype(np.int64), minlength=WORD_BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
    ranks = np.zeros(WORD_BUCKETS, np.uint64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        ranks[bucket] = int(math.log2(n))
    return ranks


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the first word of each text."""
    data, offsets = spans.column_bytes(column)
    data = spans.LOWER[data]
    starts, ends, first = spans.word_spans(data, offsets, spans.NOT_SPACE)
    return spans.stretch_hash(spans.prefix_sums(data, 0), starts, ends), first


def _shingles(words: np.ndarray, first: np.ndarray, size: int, ranks: np.ndarray | None = None):
    """For each text the sorted hashes of its distinct n-grams, with their ranks if asked for.

    A text of fewer words has its whole sequence as its one n-gram.
    """
    n = len(words)
    grams = np.zeros(n, np.uint64)
    rank = np.full(n, 63, np.uint64)
    per_word = ranks[(words >> np.uint64(48)).astype(np.int64)] if ranks is not None else None
    reach = max(0, n - size + 1)
    for k in range(size):
        grams[:reach] = grams[:reach] * np.uint64(0x9E3779B97F4A7C15) + words[k : k + reach]
        if per_word is not None:
            rank[:reach] = np.minimum(rank[:reach], per_word[k : k + reach])
    grams[:reach] = spans.mixed(grams[:reach])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            found, at = np.unique(grams[a : b - size + 1], return_index=True)
            yield found, rank[a : b - size + 1][at]
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1]
            yield spans.mixed(whole), per_word[a:b].min(keepdims=True) if per_word is not None else rank[:1]
        else:
            yield grams[:0], rank[:0]


def _set_hash(grams: np.ndarray, which: int) -> int:
    return int(np.bitwise_xor.reduce(spans.mixed(grams + np.uint64(which))) if which else spans.mixed(grams).sum()) if len(grams) else 0


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _profiles(docs: DataFrame, id_col: str, text_col: str, size: int, part: int, whole: int) -> DataFrame:
    """A row for each row: ``id``, ``key``, ``n`` n-grams, the set's hash, its bitmap and its rarest n-grams."""
    ranks = _word_ranks(docs, text_col)
    schema = T.StructType(
        [
            common.field(docs, id_col, "id"),
            T.StructField("key", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
            T.StructField("bitmap", T.BinaryType()),
            T.StructField("tokens", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for batch in common.slices(given, 2, BATCH_BYTES):
                sizes, ones, twos, maps, tokens = [], [], [], [], []
                for grams, rank in _shingles(*_words(batch.column(2)), size, ranks):
                    n = len(grams)
                    sizes.append(n)
                    ones.append(_set_hash(grams, 0))
                    twos.append(_set_hash(grams, 1))
                    odd = np.bincount((grams & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                    maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
                    order = np.sort((rank << np.uint64(58)) | (grams >> np.uint64(6)))
                    tokens.append(order[: n - -(-part * n // whole) + 1 if n else 0].view(np.int64))
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), _signed(ones), _signed(twos), pa.array(maps, pa.binary()), lists],
                    names=schema.names,
                )

    key = common.row_key(id_col, text_col)
    return staged(docs.select(F.col(id_col), key.alias("key"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema), "profiles")


def _may_link(n1: np.ndarray, n2: np.ndarray, apart: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Whether sets of these sizes whose bitmaps differ in so many bits can be similar enough."""
    overlap = np.minimum((n1 + n2 - apart) // 2, np.minimum(n1, n2))
    return whole * overlap >= part * (n1 + n2 - overlap)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _packed(column: pa.Array) -> pa.Array:
    """Texts compressed one by one, after their length; hashes of their n-grams would take more and can't be compressed."""
    codec = pa.Codec("zstd", compression_level=6)
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    return pa.array([len(t).to_bytes(4, "little") + codec.compress(t, asbytes=True) for t in texts], pa.binary())


def _unpacked(packed: list[bytes]) -> Iterator[pa.Array]:
    """The texts again, in order, in columns of about ``BATCH_BYTES``."""
    held, size = [], 0
    for body in packed:
        n = int.from_bytes(body[:4], "little")
        if held and size + n > BATCH_BYTES:
            yield pa.array(held, pa.large_binary())
            held, size = [], 0
        held.append(pa.decompress(body[4:], n, "zstd", asbytes=True))
        size += n
    if held:
        yield pa.array(held, pa.large_binary())


def _settled(pairs: DataFrame, classes: DataFrame, docs: DataFrame, *settings) -> DataFrame:
    """The pairs ``a``, ``b`` of classes that link; whole texts travel, so in small batches."""
    with common.small_batches(docs.sparkSession, 200), scratch(docs.sparkSession, inner=True):
        return _settled_pairs(pairs, classes, docs, *settings)


def _settled_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, part: int, whole: int) -> DataFrame:

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n1, n2 = (b.column(k).to_numpy(zero_copy_only=False) for k in ("n1", "n2"))
                apart = np.bitwise_count(_bits(b.column("m1")) ^ _bits(b.column("m2"))).sum(1).astype(np.int64)
                yield b.select(["a", "b"]).filter(pa.array(_may_link(n1, n2, apart, part, whole)))

    sides = [classes.select(F.col("c").alias(x), F.col("n").alias(f"n{k}"), F.col("bitmap").alias(f"m{k}")) for x, k in (("a", 1), ("b", 2))]
    likely = staged(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n1", "n2", "m1", "m2").mapInArrow(bound, "a long, b long"), "likely")
    needed = likely.select(F.col("a").alias("c")).union(likely.select("b")).distinct()
    owners = staged(classes.join(needed, "c").select("c", "key", "h1", "h2"), "owners")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for batch in common.slices(given, 3, BATCH_BYTES):
                sets = [g for g, _ in _shingles(*_words(batch.column(3)), size)]
                hashes = [_signed([_set_hash(g, which) for g in sets]) for which in (0, 1)]
                same = pc.and_(pc.equal(batch.column(1), hashes[0]), pc.equal(batch.column(2), hashes[1]))
                batch = batch.filter(same)
                yield pa.RecordBatch.from_arrays([batch.column(0), _packed(batch.column(3))], names=["c", "body"])

    rows = docs.select(common.row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("_text"))
    few = owners.count() <= common.BROADCAST_IDS // 4  # four numbers a row
    texts = rows.join(F.broadcast(owners) if few else owners, "key").select("c", "h1", "h2", "_text")
    sets = staged(texts.mapInArrow(bodies, "c long, body binary"), "sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [body for pair in zip(b.column("b1").to_pylist(), b.column("b2").to_pylist()) for body in pair]
            sets = (g for texts in _unpacked(packed) for g, _ in _shingles(*_words(texts), size))
            same = []
            for x, y in zip(sets, sets):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                same.append(whole * shared >= part * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    met = likely.join(sets.select(F.col("c").alias("a"), F.col("body").alias("b1")), "a").join(sets.select(F.col("c").alias("b"), F.col("body").alias("b2")), "b")
    return handed(met.select("a", "b", "b1", "b2").mapInArrow(exact, "a long, b long").distinct(), "links")


def _tile_pairs(rows: DataFrame, count: int, forests: int, part: int, whole: int) -> DataFrame:
    """Pairs that would connect unlike labels of a tile if they link, as many as ``forests`` forests have.

    ``rows`` of tile, own, block, c, n, label and bitmap, ``count`` in all, and
    of tile, c and ``unlike``: a class of the tile that c was found not to link
    with. A tile with more such pairs gives a row of -1 and the tile.
    """

    def compare(table: pa.Table) -> pa.Table:
        common.give_back()
        failed: dict[int, list[int]] = {}
        told = table.column("unlike").is_valid()
        for c, u in zip(*(table.filter(told).column(k).to_pylist() for k in ("c", "unlike"))):
            failed.setdefault(c, []).append(u)
            failed.setdefault(u, []).append(c)
        table = table.filter(pc.invert(told))
        columns = [table.column(k).to_numpy() for k in ("tile", "own", "block", "c", "n", "label")]
        order = np.argsort(columns[0], kind="stable")
        tile, own, block, c, n, label = (x[order] for x in columns)
        bits = _bits(table.column("bitmap"))[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]]) if len(tile) else np.zeros(1, np.int64)
        found: set[tuple[int, int]] = set()
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            split = len(np.unique(block[s:e])) > 1
            # what may link is looked up once; forests are grown from it, each of pairs no other has
            near: list[tuple[int, np.ndarray]] = []
            for i in np.flatnonzero(own[s:e]).tolist():
                keep = (label[s:e] != label[s + i]) & (whole * np.minimum(n[s:e], n[s + i]) >= part * np.maximum(n[s:e], n[s + i]))
                keep &= ~own[s:e] | (np.arange(e - s) > i)  # pairs of owned rows once
                if split:
                    keep &= block[s:e] != block[s + i]
                js = np.flatnonzero(keep)
                if len(js) and int(c[s + i]) in failed:
                    js = js[~np.isin(c[s + js], failed[int(c[s + i])])]
                if len(js):
                    apart = np.bitwise_count(bits[s + js] ^ bits[s + i]).sum(1).astype(np.int64)
                    likely = _may_link(n[s + js], n[s + i], apart, part, whole)
                    js = js[likely][np.argsort(apart[likely], kind="stable")]
                if len(js):
                    near.append((i, js))
            for _ in range(forests):
                if not near:
                    break
                root, left = label[s:e].copy(), []
                for i, js in near:
                    used = np.zeros(len(js), bool)
                    for k in np.flatnonzero(root[js] != root[i]).tolist():
                        j = int(js[k])
                        if root[j] != root[i]:
                            used[k] = True
                            found.add((min(int(c[s + i]), int(c[s + j])), max(int(c[s + i]), int(c[s + j]))))
                            root[root == root[j]] = root[i]
                    if not used.all():
                        left.append((i, js[~used]))
                near = left
            if near:
                found.add((-1, int(tile[s])))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    groups = max(1, count // TILE)
    return rows.withColumn("_group", F.pmod(F.xxhash64("tile"), F.lit(groups))).groupBy("_group").applyInArrow(compare, "a long, b long").distinct()


def _tiles(listed: DataFrame) -> DataFrame:
    """Rows of tile, own, block, c, n for the bands of lists that have unlike labels."""
    open_lists = listed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    left = staged(listed.join(open_lists, "token", "left_semi"), "open")
    tiled = left.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("tile_band", F.col("band") - F.when(F.col("own"), 0).otherwise(1))
    sizes = (
        tiled.groupBy("token", "tile_band")
        .agg(F.count(F.lit(1)).alias("g"), F.count(F.when(F.col("own"), 1)).alias("owned"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("owned > 0 and lo < hi")
        .select("token", "tile_band", F.ceil(F.col("g") / TILE).alias("k"))
    )
    tiled = tiled.join(sizes, ["token", "tile_band"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("k")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other")
    return tiled.select("*", other).select(
        F.xxhash64("token", "tile_band", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "own", "block", "c", "n"
    )


def cluster(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row the group of texts that links reach: the id column, ``n_shingles``, ``component_id``,
    ``stays`` (whether this row is the group's first, by id) and ``row_key``.

    Words are stretches without white space, after A-Z are lower-cased. Two
    texts link if ``whole * common >= part * union`` of their distinct
    ``size``-word n-grams. ``component_id`` is the least id of the group,
    itself included. A text that is null or without words links with nothing
    and is its own group. Repeated rows are equal texts and link; rows that
    share an id but not the text are apart; null ids take part, but a group's
    id is null only if all its ids are. Other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    # n-grams and bitmaps of all texts are the most that is written: they go when the lists are made
    with scratch(spark, inner=True):
        with scratch(spark, inner=True):
            profiles = _profiles(docs, id_col, text_col, size, part, whole)
            rows = handed(profiles.select("id", "key", "h1", "h2", "n"), "rows", out=2)
            classes = handed(
                profiles.where("n > 0")
                .groupBy("h1", "h2", "n")
                .agg(F.min("key").alias("key"), F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("least"), F.first("bitmap").alias("bitmap"), F.first("tokens").alias("tokens"))
                .withColumn("c", F.monotonically_increasing_id()),
                "classes",
            )
        listed = classes.select("c", F.explode("tokens").alias("token"))
        # most n-grams have one class only: they are told by a plain count
        shared = listed.groupBy("token").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("token")
        listed = staged(listed.join(shared, "token", "left_semi"), "shared")
        members = [F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")]
        # of lists with the same members one is enough
        lists = listed.groupBy("token").agg(*members).groupBy("g", "x", "y").agg(F.min("token").alias("token"))
        band = F.floor(F.log("n") / F.lit(math.log(whole / part) if part < whole else 1.0))
        kept = staged(listed.join(lists.select("token"), "token"), "listed")
        several = handed(classes.drop("tokens").join(kept.select("c").distinct(), "c", "left_semi"), "listed-classes")
        listed = handed(kept.join(several.select("c", "n", band.alias("band")), "c"), "banded")
        named = handed(classes.select("c", "h1", "h2", "n", "least"), "class-names")

    pivots = listed.groupBy("token", "band").agg(F.min("c").alias("a"))
    stars = listed.join(pivots, ["token", "band"]).where("a < c").groupBy(F.col("c").alias("b")).agg(F.min("a").alias("a"))
    stars = staged(stars.select("a", "b"), "stars")
    settings = (several, docs, id_col, text_col, size, part, whole)
    tested, links = stars, _settled(stars, *settings)
    roots = graph.components(links)
    tiles = staged(_tiles(_labelled(listed, roots)), "tiles")
    failed = None
    forests = 4
    while not tiles.isEmpty():
        dealt = _labelled(tiles, roots).join(several.select("c", "bitmap"), "c")
        if failed is not None:
            within = tiles.select("tile", "c").distinct()
            told = failed.join(within, "c").join(within.withColumnRenamed("c", "unlike"), ["tile", "unlike"], "left_semi")
            dealt = dealt.unionByName(told.select("tile", "c", "unlike"), allowMissingColumns=True)
        else:
            dealt = dealt.withColumn("unlike", F.lit(None).cast("long"))
        found = staged(_tile_pairs(dealt, tiles.count(), forests, part, whole), "tile-pairs")
        pairs = found.where("a >= 0")
        if pairs.isEmpty():
            break
        tested, links = tested.unionByName(pairs), links.unionByName(_settled(pairs, *settings))
        roots = graph.components(links)
        # what has been tested in full is done: no other pair of it may link
        tiles = staged(tiles.join(found.where("a < 0").select(F.col("b").alias("tile")), "tile", "left_semi"), "tiles")
        failed = staged(tested.join(links, ["a", "b"], "left_anti").select(F.col("a").alias("c"), F.col("b").alias("unlike")), "failed")
        forests *= 8

    named = _labelled(named, roots)
    least = named.groupBy("label").agg(F.min("least").alias("first"))
    named = named.join(least, "label").select("h1", "h2", "n", "first")
    linked = rows.where("n > 0").join(named, ["h1", "h2", "n"]).select("id", "key", "n", F.col("first.id").alias("component_id"), (F.col("key") == F.col("first.key")).alias("stays"))
    alone = rows.where("n = 0").select("id", "key", "n", F.col("id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "stays", F.col("key").alias("row_key")
    )


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of classes ``c`` with the root of their component as ``label``."""
    return rows.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("root", "c")).drop("root")
