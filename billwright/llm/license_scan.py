"""License texts inside documents: MinHash bands of windows, then exact containment.

Templates of similar length share a width of windows, a little over the
template's, laid at steps of a tenth of it, so one window holds any copy whole.
A window with 0.8 of a template's n-grams then has a Jaccard similarity of at
least 0.55 with it, and 24 bands of two MinHash values collide with a
probability of over 0.9998. What collides is settled by counting n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common, spans

#: Words of an n-gram; a template needs at least as many.
SIZE = 5
BANDS = 24
ROWS = 2
#: Templates of one pass over the documents; more are scanned in further passes.
TEMPLATES_A_PASS = 2000
BATCH_BYTES = 1 << 20

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIXERS = np.random.default_rng(8).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, first n-gram and number of each text."""
    data, offsets = spans.column_bytes(column)
    data = spans.LOWER[data]
    starts, ends, first = spans.word_spans(data, offsets, spans.WORD)
    words = spans.stretch_hash(spans.prefix_sums(data, 0), starts, ends)
    reach = max(0, len(words) - SIZE + 1)
    grams = np.zeros(reach, np.uint64)
    for k in range(SIZE):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + reach]
    return spans.mixed(grams), first[:-1], np.maximum(np.diff(first) - SIZE + 1, 0)


def _bands(grams: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows over one text's n-grams, and the band keys of each."""
    n = len(grams)
    starts = np.arange(0, max(1, n - width + step), step)
    blocks = -(-width // step)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    padded = np.full((len(starts) + blocks) * step, np.iinfo(np.uint64).max, np.uint64)
    for k, (seed, mixer) in enumerate(zip(_SEEDS, _MIXERS)):
        values = (grams ^ seed) * mixer
        padded[:n] = values ^ (values >> np.uint64(31))
        least = padded.reshape(-1, step).min(1)
        windows = np.lib.stride_tricks.sliding_window_view(least, blocks).min(1)[: len(starts)]
        keys[:, k // ROWS] = keys[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + windows
    return starts, keys


class Templates:
    """Bounded set of templates: their n-grams, and by width of windows their band keys."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        found = [ngrams(pa.array([texts[name]]))[0] for name in self.names]
        self.grams = [np.unique(g) for g in found]
        self.every = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))
        self.widths: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for k, g in enumerate(found):
            if len(g):
                step = max(1, len(g) // 10)
                groups.setdefault(((len(g) + step - 1 + step - 1) // step * step, step), []).append(k)
        for (width, step), members in groups.items():
            keys = np.concatenate([_bands(found[k], len(found[k]) + step, len(found[k]) + step)[1][:1] for k in members])
            self.widths[width, step] = (np.array(members), keys)

    def scan(self, grams: np.ndarray) -> dict[int, float]:
        """Templates in one text's n-grams, with the greatest share of their n-grams in a window."""
        out: dict[int, float] = {}
        if not len(grams) or not np.isin(grams, self.every).any():
            return out  # shares no n-gram with any template
        for (width, step), (members, keys) in self.widths.items():
            starts, bands = _bands(grams, width, step)
            for k, key in zip(members.tolist(), keys):
                for at in starts[(bands == key).any(1)].tolist():
                    share = np.isin(self.grams[k], grams[at : at + width]).mean()
                    if share >= 0.8:
                        out[k] = max(out.get(k, 0.0), float(share))
        return out


def scan(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``licenses`` (sorted template names) and ``shares`` of every row.

    A template is found if a window of the text holds at least 0.8 of its
    distinct five-word n-grams; words are letters, digits and everything
    outside ASCII, after A-Z are lower-cased. Row by row: repeated rows give
    repeated rows, a null or empty text has no license, null ids are kept,
    other columns are not read; templates of fewer than five words, or no
    templates, find nothing.
    """
    common.ship(docs.sparkSession)
    names = sorted(texts)
    passes = [Templates({n: texts[n] for n in names[i : i + TEMPLATES_A_PASS]}) for i in range(0, max(1, len(names)), TEMPLATES_A_PASS)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    for k, templates in enumerate(passes):
        rows = _scanned(rows, templates, bool(k))
    return rows.select(F.col("id").alias(id_col), "licenses", "shares")


def _scanned(rows: DataFrame, templates: Templates, more: bool) -> DataFrame:
    """Rows with what these templates find added; the text is kept for further passes."""
    schema = T.StructType(
        [rows.schema["id"], rows.schema["text"], T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                grams, first, count = ngrams(batch.column(1))
                found = [templates.scan(grams[a : a + n]) for a, n in zip(first.tolist(), count.tolist())]
                names = [[templates.names[k] for k in sorted(f)] for f in found]
                shares = [[f[k] for k in sorted(f)] for f in found]
                if more:
                    names = [a + b for a, b in zip(batch.column(2).to_pylist(), names)]
                    shares = [a + b for a, b in zip(batch.column(3).to_pylist(), shares)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    names=["id", "text", "licenses", "shares"],
                )

    return rows.mapInArrow(run, schema)
