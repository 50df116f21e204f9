"""Token counts of whole texts by a tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common

#: Bytes of text of one encoding batch.
BATCH_BYTES = 1 << 20
#: Characters of remembered parts before the memory of a worker is emptied.
MEMORY_CHARS = 4_000_000

_COUNTERS: dict[str, PartCounts] = {}


class PartCounts:
    """Counts tokens of texts by their safe parts; lengths of parts seen are remembered."""

    def __init__(self, lengths: Callable[[list[str]], list[int]], whole: bool = False):
        self._lengths = lengths
        self._whole = whole
        self._inner: dict[str, int] = {}
        self._first: dict[str, int] = {}
        self._chars = 0

    def _learn(self, known: dict[str, int], parts: set[str], before: str) -> None:
        batch: list[str] = []
        held = 0
        for part in sorted(p for p in parts if p not in known):
            batch.append(part)
            held += len(part)
            if held > BATCH_BYTES:
                known.update(zip(batch, self._lengths([before + p for p in batch])))
                batch, held = [], 0
            self._chars += len(part) + 24
        if batch:
            known.update(zip(batch, self._lengths([before + p for p in batch])))

    def count(self, texts: list[str]) -> list[int]:
        if self._whole:
            return self._lengths(texts)
        if self._chars > MEMORY_CHARS * 4:
            self._inner.clear()
            self._first.clear()
            self._chars = 0
        split = [common.safe_parts(t) for t in texts]
        firsts = [parts.pop(0) for parts in split]
        self._learn(self._first, set(firsts), "")
        self._learn(self._inner, set().union(*split), " ")
        inner, first = self._inner.__getitem__, self._first.__getitem__
        return [first(f) + sum(map(inner, parts)) for f, parts in zip(firsts, split)]


def _counter(path: str) -> PartCounts:
    """One counter a worker and file. Parts are safe for byte-level vocabularies; others take whole texts."""
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = PartCounts(lambda t: [len(x) for x in pieces.encode(t, num_threads=1)], whole=True)
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            byte_level = isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and tokenizer.normalizer is None
            _COUNTERS[path] = PartCounts(
                lambda t: [len(x) for x in tokenizer.encode_batch_fast(t, add_special_tokens=False)],
                whole=not byte_level or tokenizer.pre_tokenizer.add_prefix_space,
            )
    return _COUNTERS[path]


def _release() -> None:
    """Named here, so that tasks call this module's own: what a nested function holds is sent to them as a copy."""
    _COUNTERS.clear()


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """Bytes and tokens of every text; ``over_limit`` tells texts of more than ``limit`` tokens.

    Row by row, without a shuffle: each row gives one row, repeated rows too.
    A null or empty text has 0 bytes and 0 tokens; a null id is kept. Only the
    two named columns are read, so further columns may have any name. Only
    lengths leave the Arrow function. Long texts are cut at safe boundaries
    and their parts encoded in batches of about ``BATCH_BYTES``.
    """
    common.ship(docs.sparkSession)
    schema = T.StructType(
        [
            common.field(docs, id_col),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES, _release):
                texts = common.texts(batch, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(counter.count(texts), pa.int64()),
                    ],
                    names=[id_col, "n_bytes", "n_tokens"],
                )

    counted = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
