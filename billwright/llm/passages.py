"""Long passages that repeat within or across documents, by run-length indexes.

Every window of ``length`` bytes has an anchor, the stretch of ``GRAM`` bytes
in it with the least hash. Equal windows have equal anchors, so the text is cut
into segments of consecutive windows with one anchor, and only segments of the
same anchor are compared: equal ones are counted, unlike ones meet in a block
of bounded size. Of a block a run-length Burrows-Wheeler index is built: the
common prefix with the neighbour before is kept at the first suffix of each run
and with the neighbour after at the last. Streamed along the text, the values
in between follow by counting down, and give for each place the longest match
elsewhere. Anchors with too many unlike segments for one block are refined: a
segment is split by the place of the anchor in the window, and parts are
grouped by the bytes that all windows of that part share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.llm import common, spans
from billwright.session import staged

#: Bytes of an anchor.
GRAM = 64
#: Window starts that are worked on at once, so that a place in them takes 20 bits.
PIECE = 1 << 19
#: Unlike segments of one anchor that go to one block; more are refined.
BLOCK_SEGMENTS = 1000
#: Bytes of a block, about.
BLOCK_BYTES = 1 << 20
#: Places of the anchor in the window that share a part, for each step of refining.
WIDTHS = (32, 4, 1)
BATCH_BYTES = 1 << 19

_PLACE = np.uint64((1 << 20) - 1)


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int):
    """Segments of all texts: text, first window, windows, anchor, hash, place of the anchor."""
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
    wide = length - GRAM + 1
    for low in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[low : low + PIECE + length - 1]
        sums = spans.prefix_sums(part, 0)
        at = np.arange(len(part) - GRAM + 1)
        grams = spans.stretch_hash(sums, at, at + GRAM)
        least = (grams & ~_PLACE) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < wide:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        starts = np.arange(len(least))
        doc = np.searchsorted(offsets, starts + low, "right") - 1
        starts = starts[starts + low + length <= offsets[np.minimum(doc + 1, len(offsets) - 1)]]
        if not len(starts):
            continue
        doc = doc[starts]
        anchor = (least[starts] & _PLACE).astype(np.int64)
        change = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0) | (np.diff(starts) != 1)])
        begin = np.flatnonzero(change)
        n = np.diff(np.append(begin, len(starts)))
        first = starts[begin]
        found.append(
            (doc[begin], first + low - offsets[doc[begin]], n, grams[anchor[begin]], spans.stretch_hash(sums, first, first + n - 1 + length))
        )
    return [np.concatenate(x) for x in zip(*found)]


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """A row for each segment of each text of ``key``, ``n_bytes``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                doc, first, n, anchor, seg = _anchored(*spans.column_bytes(batch.column(2)), length)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(first), pa.array(n), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))],
                    names=["key", "n_bytes", "start", "n", "anchor", "seg"],
                )

    return docs.mapInArrow(run, "key long, n_bytes long, start long, n long, anchor long, seg long")


def _place_of_anchor(sums: np.ndarray, size: int, n: int, length: int) -> int:
    """Where the anchor is in a segment's bytes: inside all its windows."""
    low, high = n - 1, min(length, size) - GRAM
    at = np.arange(low, high + 1)
    grams = spans.stretch_hash(sums, at, at + GRAM)
    return low + int(np.argmin(grams & ~_PLACE))


def _refined(piece: np.ndarray, n: int, anchor: int, length: int, width: int, place: int):
    """Parts of a segment: first window, windows, shared key, hash."""
    sums = spans.prefix_sums(piece, 0)
    kind = (place - np.arange(n)) // width
    begin = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1])
    count = np.diff(np.append(begin, n))
    kind = kind[begin]
    shared = spans.stretch_hash(sums, place - kind * width, place - (kind + 1) * width + 1 + length)
    key = spans.mixed(shared + np.uint64(anchor) + spans.mixed(kind.astype(np.uint64) + np.uint64(width << 20)))
    return begin, count, key, spans.stretch_hash(sums, begin, begin + count - 1 + length)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    return rank, order


def longest_matches(pieces: list[np.ndarray]) -> np.ndarray:
    """For each place of the joined pieces, a place more at the end of each, the longest match elsewhere."""
    sizes = [len(p) + 1 for p in pieces]
    ends = np.cumsum(sizes) - 1
    text = np.zeros(ends[-1] + 1, np.int64)
    text[ends] = np.arange(len(pieces))  # no two ends are alike
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.concatenate(pieces).astype(np.int64) + len(pieces)
    size = len(text)

    def after(values: np.ndarray, step: int) -> np.ndarray:
        return np.concatenate([values[step:] + 1, np.zeros(min(step, size), np.int64)])[:size]

    levels = [(1, text)]
    step, rank, order = 1, text, None
    while order is None or (rank[order[-1]] < size - 1 and step < max(sizes)):
        rank, order = _ranked(rank * (size + len(pieces) + 300) + after(rank, step))
        step *= 2
        levels.append((step, rank))
    # the transform, its runs, and samples at their ends
    before = text[order - 1]
    change = before[1:] != before[:-1]
    heads = np.concatenate([[False], change])
    tails = np.concatenate([change, [False]])

    def common_prefix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros(len(p), np.int64)
        for step, rank in reversed(levels):
            ok = (p + total < size) & (q + total < size)
            same = ok & (rank[np.minimum(p + total, size - 1)] == rank[np.minimum(q + total, size - 1)])
            total += step * same
        return total

    out = np.zeros(size, np.int64)
    place = np.arange(size)
    for sampled, shift in ((heads, -1), (tails, 1)):
        at = np.flatnonzero(sampled)
        value = np.full(size, -1, np.int64)
        value[order[at]] = common_prefix(order[at], order[at + shift])
        value[order[0 if shift < 0 else -1]] = 0
        known = value >= 0
        known[0] = True
        value[0] = max(value[0], 0)
        last = np.maximum.accumulate(np.where(known, place, 0))
        out = np.maximum(out, value[last] - (place - last))
    return out


def _block_matches(length: int):
    """Windows of single segments that are elsewhere in the block, as stretches of their documents."""

    def run(table: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(b, np.uint8) for b in table.column("bytes").to_pylist()]
        match = longest_matches(pieces) >= length
        out: list[tuple[int, int, int, int]] = []
        at = 0
        rows = zip(*(table.column(k).to_pylist() for k in ("key", "n_bytes", "start", "n", "copies")))
        for piece, (key, n_bytes, start, n, copies) in zip(pieces, rows):
            if copies == 1:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], match[at : at + n].view(np.int8), [0]])))
                for a, b in edges.reshape(-1, 2).tolist():
                    out.append((key, n_bytes, start + a, start + b - 1 + length))
            at += len(piece) + 1
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["key", "n_bytes", "low", "high"])

    return run


def _with_bytes(pieces: DataFrame, docs: DataFrame, length: int, width: int | None) -> DataFrame:
    """The pieces with their bytes, or split into parts of anchor places of ``width``."""
    wanted = staged(pieces, "pieces")
    per_doc = wanted.groupBy("key", "n_bytes").agg(F.collect_list(F.struct("start", "n", "anchor", "copies", "place")).alias("pieces"))
    texts = common.semi_by_id(docs, wanted.select("key").distinct(), "key")
    joined = texts.join(per_doc, ["key", "n_bytes"]).select("key", "n_bytes", F.col("text").cast("binary").alias("text"), "pieces")
    names = ["key", "n_bytes", "start", "n", "anchor", "copies", "place", *(["bytes"] if width is None else ["seg"])]
    kinds = [pa.int64()] * 7 + [pa.binary() if width is None else pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                rows: list[tuple] = []
                for key, n_bytes, text, listed in zip(*(c.to_pylist() for c in batch.columns)):
                    data = np.frombuffer(text, np.uint8)
                    for p in listed:
                        start, n, anchor, copies, place = (p[k] for k in ("start", "n", "anchor", "copies", "place"))
                        piece = data[start : start + n - 1 + length]
                        if width is None:
                            rows.append((key, n_bytes, start, n, anchor, copies, place, piece.tobytes()))
                            continue
                        if place < 0:
                            place = _place_of_anchor(spans.prefix_sums(piece, 0), len(piece), n, length)
                        for a, m, k, s in zip(*(x.tolist() for x in _refined(piece, n, anchor % (1 << 64), length, width, place))):
                            rows.append((key, n_bytes, start + a, m, k - (k >> 63 << 64), copies, place - a, s - (s >> 63 << 64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    ddl = ", ".join(f"{n} {'binary' if n == 'bytes' else 'long'}" for n in names)
    return joined.mapInArrow(run, ddl)


def _sorted_out(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stretches of segments that have equals, then pieces to compare in blocks, then pieces to refine.

    ``rows`` of segments with ``copies``, how many segments of the input each stands for.
    """
    repeated = rows.groupBy("anchor").agg(F.sum("copies").alias("t")).where("t > 1").select("anchor")
    # counts by anchor are written, so that a hot anchor's side of the join can be split
    rows = staged(rows.join(staged(repeated, "repeated-anchors"), "anchor", "left_semi"), "repeated")
    segments = staged(
        rows.groupBy("anchor", "seg").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "n_bytes", "start", "n", "place")).alias("one")),
        "segments",
    )
    same = segments.where("copies > 1").select("anchor", "seg")  # read from a table, so the join can be split
    equal = rows.where("copies = 1").join(same, ["anchor", "seg"]).select("key", "n_bytes", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + length).alias("high"))
    kinds = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    unlike = segments.join(staged(kinds.select("anchor", "kinds"), "kinds"), "anchor").select("one.*", "anchor", "copies", "kinds")
    return equal, unlike.where(F.col("kinds") <= BLOCK_SEGMENTS), unlike.where(F.col("kinds") > BLOCK_SEGMENTS)


def repeated_stretches(docs: DataFrame, length: int) -> DataFrame:
    """Stretches ``low`` to ``high`` of texts (``key``, ``n_bytes``, ``text``) whose windows all occur elsewhere too.

    The segments of a text are read whole; a row for each maximal run of
    windows of one segment, so stretches may touch or overlap.
    """
    rows = staged(_segments(docs, length), "anchors")
    rows = rows.withColumns({"copies": F.lit(1).cast("long"), "place": F.lit(-1).cast("long")})
    found, blocks = [], []
    for width in (*WIDTHS, None):
        equal, unlike, many = _sorted_out(rows, length)
        found.append(equal)
        blocks.append(unlike)
        if width is None or many.isEmpty():
            break
        rows = staged(_with_bytes(many.drop("kinds"), docs, length, width), "refined")
    pieces = blocks[0]
    for more in blocks[1:]:
        pieces = pieces.unionByName(more)
    pieces = staged(_with_bytes(pieces.drop("kinds"), docs, length, None), "block-pieces")
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    grouped = pieces.withColumn("_block", F.pmod(F.xxhash64("anchor"), F.lit(total // BLOCK_BYTES + 1))).groupBy("_block")
    out = grouped.applyInArrow(_block_matches(length), "key long, n_bytes long, low long, high long")
    for equal in found:
        out = out.unionByName(equal)
    return staged(out, "stretches")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every text without the bytes of any ``length``-byte string that starts anywhere else as well.

    Places are judged on the input: all copies go, overlapping ones in one
    text too. Gives the id column, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept_sha256`` and, if asked for, ``kept`` (the
    bytes left). A null text counts as empty and loses nothing, as does any
    text shorter than ``length``. Every row is a text of its own: repeated
    rows repeat each other and lose what is long enough. Null ids are kept,
    other columns are not read.
    """
    common.ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    stretches = repeated_stretches(rows.drop("id").where(F.col("n_bytes") >= length), length)
    keys = stretches.select("key").distinct()
    per_doc = stretches.groupBy("key", "n_bytes").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
    hit = common.semi_by_id(rows, keys, "key").join(per_doc, ["key", "n_bytes"], "left")
    id_field = common.field(docs, id_col, "id")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                made = []
                for text, listed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    kept, last, removed, n_spans, done = [], 0, 0, 0, -1
                    for low, high in sorted((s["low"], s["high"]) for s in listed or ()):
                        if low > done:
                            kept.append(text[last:low])
                            n_spans += 1
                        removed += max(0, high - max(low, last))
                        last = done = max(last, high)
                    kept = b"".join([*kept, text[last:]])
                    made.append((removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = [list(x) for x in zip(*made)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays[: len(names) - 2]], names=names)

    ddl = f"id {id_field.dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    parts = hit.select("id", "n_bytes", F.col("text").cast("binary").alias("text"), "stretches").mapInArrow(cut, ddl)
    none = F.lit(0).cast("long")
    clean = common.anti_by_id(rows, keys, ["key"]).select(
        "id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        *([F.col("text").cast("binary").alias("kept")] if keep_text else []),
    )
    return parts.unionByName(clean).withColumnRenamed("id", id_col)
