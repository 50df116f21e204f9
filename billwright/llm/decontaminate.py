"""Benchmark passages in documents, by a positional inverted index.

The index is kept in segments of whole documents. A segment numbers its words
through, with a gap between documents, and has for each word the sorted list of
its places. A window of an item is looked for where its rarest word occurs:
the word's list, moved by the word's offset in the window, is intersected with
the lists of the other words from rare to common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common, spans
from billwright.session import staged

#: A segment is closed at so many words, at the end of a document.
SEGMENT_WORDS = 700_000
BATCH_BYTES = 1 << 20

_ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class _Segment:
    """Words of consecutive documents until they are written as index rows."""

    def __init__(self, gap: int):
        self.gap = gap
        self.data: list[np.ndarray] = []
        self.words: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.bytes = self.n_words = self.next = 0

    def add(self, ids: pa.Array, text: pa.Array) -> None:
        data, offsets = spans.column_bytes(text)
        data = spans.LOWER[data]
        starts, ends, first = spans.word_spans(data, offsets, spans.WORD)
        counts = np.diff(first)
        begins = self.next + np.concatenate([[0], np.cumsum(counts + self.gap)])
        places = np.arange(len(starts)) + np.repeat(begins[:-1] - first[:-1], counts)
        hashes = [spans.stretch_hash(spans.prefix_sums(data, k), starts, ends) for k in (0, 1)]
        self.words.append((*hashes, places.astype(np.uint32), starts + self.bytes, (ends - starts).astype(np.int32)))
        self.data.append(data)
        self.docs.append((ids, begins[:-1], counts))
        self.bytes += len(data)
        self.n_words += len(starts)
        self.next = int(begins[-1])

    def rows(self, part: int, schema: pa.Schema) -> pa.RecordBatch:
        one, two, places, starts, sizes = (np.concatenate(x) for x in zip(*self.words))
        data = np.concatenate(self.data)
        order = np.argsort(one, kind="stable")  # places stay in order
        change = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        change[1:] = (one[a] != one[b]) | (two[a] != two[b]) | (sizes[a] != sizes[b])
        at = np.flatnonzero(change)
        lead = order[at]
        bounds = np.append(at, len(order))
        words = spans.gathered(data, starts[lead], starts[lead] + sizes[lead], pa.string())
        lists = pa.Array.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(places[order].tobytes())]
        )
        ids = pa.concat_arrays([d[0] for d in self.docs])
        begins, counts = (np.concatenate([d[k] for d in self.docs]) for k in (1, 2))
        n, m = len(at), len(ids)
        columns = [
            pa.array(np.full(n + m, part), pa.int64()),
            pa.concat_arrays([words, pa.nulls(m, pa.string())]),
            pa.array(np.concatenate([np.diff(bounds), counts]), pa.int64()),
            pa.array(np.concatenate([np.zeros(n, np.int64), begins]), pa.int64()),
            pa.concat_arrays([lists, pa.nulls(m, pa.binary())]),
            pa.concat_arrays([pa.nulls(n, ids.type), ids]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def build_index(docs: DataFrame, gap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: rows of a segment's words, and of its documents (``word`` null).

    Word rows: ``part``, ``word``, ``n`` and the ``places`` as unsigned 32-bit
    integers. Document rows: ``part``, ``id``, ``n`` words and ``begin``, the
    number of the first. Every input row has a document row.
    """
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("word", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("begin", T.LongType()),
            T.StructField("places", T.BinaryType()),
            common.field(docs, id_col, "id"),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        segment, arrow = _Segment(gap), None
        for whole in batches:
            arrow = pa.schema(
                [("part", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("begin", pa.int64()), ("places", pa.binary()), ("id", whole.column(0).type)]
            )
            for batch in common.slices(whole, 1, BATCH_BYTES):
                segment.add(batch.column(0), batch.column(1))
                if segment.n_words >= SEGMENT_WORDS:
                    yield segment.rows(part, arrow)
                    part, segment = part + 1, _Segment(gap)
                    common.give_back()
        if segment.docs:
            yield segment.rows(part, arrow)
        del segment
        common.give_back()

    return staged(docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema), "postings")


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (as text) and the ``words`` of each of its windows; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), common.texts(batch, 1)):
                words = _ITEM_WORD.findall(text.translate(_UPPER))
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    windows.append(words[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.list_(pa.string()))], names=["item", "words"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "item string, words array<string>").distinct()


def _intersect(lists: list[np.ndarray], offsets: np.ndarray, slop: int) -> np.ndarray:
    """Starts at which each list has a place within ``slop`` of its offset, rarest list first."""
    shifts = np.arange(-slop, slop + 1)
    starts = np.unique((lists[0].astype(np.int64) - offsets[0])[:, None] + shifts)
    for places, offset in zip(lists[1:], offsets[1:]):
        if not len(starts):
            break
        wanted = starts + offset
        at = np.searchsorted(places, np.maximum(wanted - slop, 0))
        found = places[np.minimum(at, len(places) - 1)].astype(np.int64)
        starts = starts[(at < len(places)) & (np.abs(found - wanted) <= slop)]
    return starts


def find_matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document row its words, its words inside matches, and the items that match.

    Words are ``[0-9a-z]`` and everything outside ASCII, after A-Z are
    lower-cased. With ``slop`` 0 a window matches where its words stand side
    by side in order; with more, where each word stands within so many places
    of where the phrase would have it (proximity). Gives the id column,
    ``n_words``, ``n_hit`` (words inside any match) and ``items``, the sorted
    ids of matching items as text (empty if none). Row by row: repeated rows
    give repeated rows; a null or empty text has no words; null ids are kept;
    items without words or id match nothing; other columns are not read.
    """
    common.ship(docs.sparkSession)
    index = build_index(docs, size + 2 * slop + 1, id_col, text_col)
    postings = index.where(F.col("word").isNotNull()).select("part", "word", "n", "places")
    windows = staged(item_windows(items, size), "item-windows")
    numbered = staged(windows.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    places = numbered.select("win", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
    words = staged(places.select("word").distinct(), "item-words")
    # the postings of the items' words: many places, but few words
    few = words.count() <= common.BROADCAST_IDS // 8 and (words.agg(F.max(F.length("word"))).first()[0] or 0) <= 256
    wanted = postings.join(F.broadcast(words) if few else words, "word", "left_semi")
    totals = wanted.groupBy("word").agg(F.sum("n").alias("total"))
    # windows with a word that no document has are left out; the others' words go from rare to common
    ordered = staged(
        places.join(totals, "word")
        .groupBy("win", "size")
        .agg(F.sort_array(F.collect_list(F.struct("total", "at", "word"))).alias("terms"))
        .where(F.size("terms") == F.col("size"))
        .select("win", F.col("terms.word").alias("terms"), F.col("terms.at").alias("offsets")),
        "ordered-windows",
    )
    none = F.lit(None)
    local = (
        wanted.join(ordered.select("win", "terms", "offsets", F.col("terms")[0].alias("word")), "word")
        .select("part", F.lit(1).alias("kind"), "terms", "offsets", F.col("win").alias("a"), none.cast("long").alias("b"), none.cast("binary").alias("places"))
    )
    no_list = [none.cast("array<int>").alias("offsets")]
    # the segment's lists, its windows and its documents meet; a segment is of bounded size
    lists = wanted.select("part", F.lit(0).alias("kind"), F.array("word").alias("terms"), *no_list, none.cast("long").alias("a"), none.cast("long").alias("b"), "places")
    numbered_docs = index.where(F.col("word").isNull())
    segment_docs = numbered_docs.select(
        "part", F.lit(2).alias("kind"), none.cast("array<string>").alias("terms"), *no_list,
        F.col("begin").alias("a"), F.col("n").alias("b"), none.cast("binary").alias("places"),
    )

    def match(table: pa.Table) -> pa.Table:
        common.give_back()  # what the segment before took
        part = table.column("part")[0].as_py() if table.num_rows else 0
        kind = table.column("kind").to_numpy()
        held = table.filter(pa.array(kind == 0))
        found = {t[0]: np.frombuffer(p, np.uint32) for t, p in zip(held.column("terms").to_pylist(), held.column("places").to_pylist())}
        docs_at = table.filter(pa.array(kind == 2))
        begins = docs_at.column("a").to_numpy()
        order = np.argsort(begins, kind="stable")
        begins, counts = begins[order], docs_at.column("b").to_numpy()[order]
        wins = table.filter(pa.array(kind == 1))
        starts, sizes, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for win, terms, offsets in zip(wins.column("a").to_pylist(), wins.column("terms").to_pylist(), wins.column("offsets").to_pylist()):
            rows = [found.get(t) for t in terms]
            if any(r is None for r in rows):
                continue
            at = _intersect(rows, np.array(offsets), slop)
            starts.append(at)
            sizes.append(np.full(len(at), len(terms)))
            of.append(np.full(len(at), win))
        starts, sizes, of = map(np.concatenate, (starts, sizes, of))
        doc = np.searchsorted(begins, starts + slop, "right") - 1
        ends = np.minimum(starts + sizes, (begins + counts)[doc])
        starts = np.maximum(starts, begins[doc])
        sizes = ends - starts
        out: dict[str, list] = {"part": [], "begin": [], "n_hit": [], "wins": []}
        by_doc = np.lexsort((starts, doc))
        starts, sizes, of, doc = starts[by_doc], sizes[by_doc], of[by_doc], doc[by_doc]
        for a, b in zip(*_runs(doc)):
            ends = np.maximum.accumulate(starts[a:b] + sizes[a:b])
            before = np.concatenate([[starts[a]], ends[:-1]])
            out["part"].append(part)
            out["begin"].append(int(begins[doc[a]]))
            out["n_hit"].append(int(np.maximum(ends - np.maximum(before, starts[a:b]), 0).sum()))
            out["wins"].append(np.unique(of[a:b]).tolist())
        return pa.table(out, pa.schema([("part", pa.int64()), ("begin", pa.int64()), ("n_hit", pa.int64()), ("wins", pa.list_(pa.int64()))]))

    hits = staged(
        lists.unionByName(local).unionByName(segment_docs).groupBy("part").applyInArrow(match, "part long, begin long, n_hit long, wins array<long>"),
        "hits",
    )
    of_item = windows.join(numbered, "words").select("item", "win")
    matched = (
        hits.select("part", "begin", F.explode("wins").alias("win"))
        .join(of_item, "win")
        .groupBy("part", "begin")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    decided = hits.select("part", "begin", "n_hit").join(matched, ["part", "begin"])
    return numbered_docs.join(decided, ["part", "begin"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal values start and end in a sorted array."""
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    at = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    return at, np.append(at[1:], len(values))
