"""Language of texts by error-correcting output codes.

Every language has a codeword. For each bit a binary naive Bayes classifier on
hashed byte trigrams tells the languages with that bit from the rest. A text's
margins are compared with the codewords: the language of least weighted loss
is chosen. A bit's weight for a language is the margin that its classifier has
on average on that language's own trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common

#: Buckets of hashed trigrams: the model has this many weights a bit.
BUCKETS = 1 << 15
#: Up to so many languages the code has every split of them into two parts.
EXHAUSTIVE = 6
#: Bits of the code for more languages, times log2 of their number.
BITS_FACTOR = 15
#: A score under this is flagged as ambiguous.
CLEAR = 0.6
#: How sharply losses are turned into a score.
SHARPNESS = 6.0
BATCH_BYTES = 1 << 20

UNKNOWN = "und"

_KEEP = np.frombuffer(bytes(c if c >= 0x80 or chr(c).islower() else 32 for c in range(256)), np.uint8)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1 that differ pairwise in about half of their bits."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        bits = np.vstack([np.zeros(len(splits), int), (splits >> np.arange(n - 1)[:, None]) & 1])
    else:
        length = int(np.ceil(BITS_FACTOR * np.log2(n)))
        drawn = np.random.default_rng(n).integers(0, 2, (n, 4 * length))
        bits = drawn[:, (drawn.min(0) == 0) & (drawn.max(0) == 1)][:, :length]
    return (1 - 2 * bits).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, and where each text's trigrams start."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = _KEEP[np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    starts = np.cumsum([0] + [len(r) + 2 for r in raw])
    value = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    wanted = (value & 0xFFFF) != 0x2020  # not two spaces at the end: none spans two texts
    wanted &= (value >> 8) != 0x2020
    before = np.concatenate([[0], np.cumsum(wanted)])
    bucket = ((value[wanted] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return bucket, before[np.minimum(starts, len(value))]


class Model:
    """Codewords and the weights of each bit's classifier."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if languages else counts
        weights, bit_weights = [], []
        for bit in self.code.T if languages else ():
            plus = share[bit > 0].mean(0)
            minus = share[bit < 0].mean(0) if (bit < 0).any() else plus
            weights.append(np.log(plus / minus))
            bit_weights.append(np.maximum(bit * (share @ weights[-1]), 1e-3))
        self.weights = np.array(weights, np.float32).T if languages else np.zeros((BUCKETS, 0), np.float32)
        bit_weights = np.array(bit_weights).T if languages else np.zeros((0, 0))
        self.scale = 1 / np.maximum(bit_weights.mean(0), 1e-3) if languages else np.zeros(0)
        self.bit_weights = bit_weights / bit_weights.sum(1, keepdims=True) if languages else bit_weights

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether another language is nearly as near."""
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(self.languages)
        score = np.zeros(len(texts))
        best = np.zeros(len(texts), int)
        if self.languages and known.any():
            bucket, starts = trigrams(texts)
            ends, n = starts[1:], np.diff(starts)
            margins = np.zeros((len(texts), self.code.shape[1]))
            full = n > 0
            if full.any():
                for k in range(self.code.shape[1]):
                    # a text without trigrams is left out, so each start begins its own sum
                    margins[full, k] = np.add.reduceat(self.weights[bucket, k].astype(np.float64), starts[:-1][full])
            assert len(ends) == len(texts)
            margins = margins / np.maximum(n, 1)[:, None] * self.scale
            loss = np.einsum("lb,dlb->dl", self.bit_weights, np.log1p(np.exp(-np.clip(self.code[None] * margins[:, None] * 4, -50, 50))))
            odds = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
            best = loss.argmin(1)
            score = odds.max(1) / odds.sum(1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        score = np.where(known, score, 0.0)
        return names, score, score < CLEAR


def held_out(id_col: str, fold: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == rest, F.lit(False))


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from all rows whose label and text are not null.

    Tasks send trigram counts only: for each language at most ``BUCKETS``
    sums come to the driver. Without labelled rows it knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                bucket, starts = trigrams(common.texts(batch, 1))
                names = batch.column(0).to_pylist()
                kinds = {name: k for k, name in enumerate(dict.fromkeys(names))}
                of = np.repeat([kinds[name] for name in names], np.diff(starts))
                found = np.bincount(of * BUCKETS + bucket, minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
                for name, k in kinds.items():
                    sums[name] = sums.get(name, 0) + found[k]
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))],
                names=["label", "bucket", "n"],
            )

    common.ship(rows.sparkSession)
    labelled = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")
    )
    sums = labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.label for r in sums})
    at = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for r in sums:
        counts[at[r.label], r.bucket] = r.n
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every row.

    Row by row; repeated rows give repeated rows, a null id is kept, other
    columns are not read. A text that is null or has no letter, and any text
    if the model knows no language, is ``und`` with score 0. Between equally
    near codewords the first language by name is taken.
    """
    common.ship(docs.sparkSession)
    schema = T.StructType(
        [
            common.field(docs, id_col),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                names, score, unclear = model.predict(common.texts(batch, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unclear)], names=schema.names
                )

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
