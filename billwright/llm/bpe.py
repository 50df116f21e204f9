"""Byte-level BPE: encoding by a transducer, streaming decode.

The merges are compiled into a finite-state transducer, determinised as bytes
are met. A state is the bytes read since the last boundary between tokens that
no further byte can undo. Every prefix of a piece has one last token, and two
tokens may stand side by side if the merges give just these two for their
joined bytes. So the tokens of a prefix form a chain of boundaries, and any
chain of a longer prefix passes through one of the boundaries that a token
could still start from. What these boundaries have in common is final: its
tokens are emitted, after a lookahead of less than the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common

BATCH_BYTES = 1 << 20
#: Entries after which a worker's memory of transitions or pairs starts anew, or of parts becomes the older one of two.
MEMORY_ENTRIES = 200_000
PART_ENTRIES = 300_000
#: Ids of one step of the streaming decoder.
DECODE_STEP = 1 << 16

_CODECS: dict[tuple[str, str], Codec] = {}


class State:
    """Undecided bytes, the boundary before the last token of each prefix, and the edges met so far."""

    __slots__ = ("data", "before", "edges", "end")

    def __init__(self, data: bytes, before: list[int]):
        self.data = data
        self.before = before
        self.edges: dict[int, tuple[tuple[int, ...], State]] = {}
        self.end: tuple[int, ...] | None = None


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._longest = max(map(len, ranks))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self._start = State(b"", [0])
        self._states = {b"": self._start}
        self._n_edges = 0

    def _merged(self, piece: bytes, but: bytes = b"") -> list[bytes]:
        """The merge rule itself: always the pair of the least rank, leftmost first; ``but`` is not made."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [a + b for a, b in zip(parts, parts[1:])]
            rank, at = min((self.ranks.get(x, 1 << 60) if x != but else 1 << 60, i) for i, x in enumerate(joined))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge gives the token; None if none does, or if a part comes later than the token itself."""
        if token not in self._splits:
            parts = self._merged(token, but=token)
            regular = len(parts) == 2 and all(len(x) == 1 or self.ranks[x] < self.ranks[token] for x in parts)
            self._splits[token] = (parts[0], parts[1]) if regular else None
        return self._splits[token]

    def _stay_apart(self, left: bytes, right: bytes) -> bool | None:
        """Whether the merges of two tokens go past each other, read backwards; None if that can't be told so.

        The later merge of the two is undone, and the pair then across the
        middle must not have come before it; of equal pairs the left one did.
        """
        limit = 1 << 60
        while True:
            if self.ranks.get(left + right, 1 << 60) < limit:
                return False
            one, two = (self.ranks[x] if len(x) > 1 else -1 for x in (left, right))
            if one < 0 and two < 0:
                return True
            undone = self._split(left if one > two else right)
            if undone is None:
                return None
            if one > two:
                limit, left = one, undone[1]
            else:
                limit, right = two + 1, undone[0]

    def _side_by_side(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) > MEMORY_ENTRIES:
                self._pairs.clear()
            regular = all(len(x) < 2 or self._split(x) for x in pair)
            known = (self._stay_apart(left, right) if left else True) if regular else None
            if known is None:
                known = self._merged(left + right) == ([left, right] if left else [right])
            self._pairs[pair] = known
        return known

    def _last(self, data: bytes, before: list[int]) -> int:
        """The boundary before the last token of ``data``; ``before`` has those of its prefixes."""
        end = len(data)
        for start in range(max(0, end - self._longest), end):
            token = data[start:]
            if token in self.ranks and self._side_by_side(data[before[start] : start], token):
                return start
        return end - 1

    def _ids(self, data: bytes, before: list[int], end: int) -> tuple[int, ...]:
        out = []
        while end:
            out.append(self.ranks[data[before[end] : end]])
            end = before[end]
        return tuple(reversed(out))

    def _state(self, data: bytes) -> State:
        state = self._states.get(data)
        if state is None:
            before = [0]
            for end in range(1, len(data) + 1):
                before.append(self._last(data[:end], before))
            state = self._states[data] = State(data, before)
        return state

    def _edge(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        data = state.data + bytes((byte,))
        before = [*state.before, self._last(data, state.before)]
        final = len(data)
        for start in range(max(1, len(data) - self._longest), len(data)):
            if data[start:] in self._prefixes:
                other = start
                while final != other:
                    if final > other:
                        final = before[final]
                    else:
                        other = before[other]
        if final and len(data) <= self._longest and data in self._prefixes:
            final = 0
        if final:
            step = (self._ids(data, before, final), self._state(data[final:]))
        else:
            step = ((), self._states.setdefault(data, State(data, before)))
        self._n_edges += 1
        state.edges[byte] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self._n_edges > MEMORY_ENTRIES:
            self._forget()
        out: list[int] = []
        state = self._start
        for byte in piece:
            step = state.edges.get(byte) or self._edge(state, byte)
            if step[0]:
                out += step[0]
            state = step[1]
        if state.data:
            if state.end is None:
                state.end = self._ids(state.data, state.before, len(state.data))
            out += state.end
        return out


class Utf8Stream:
    """Bytes in, text out; a character that is cut by the end of a chunk waits for the next.

    The state is the bytes held of an unfinished character: a lead byte tells
    how many follow it, and only the last three bytes can be unfinished.
    Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if byte & 0xF0 == 0xE0 else 4 if 0xF0 <= byte <= 0xF4 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self._held + data
        cut = len(data) - self._unfinished(data)
        self._held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._held = self._held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """Texts to ids, as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.transducer = Transducer(ranks)
        self._pattern = regex.compile(pattern)
        self._tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._tokens[rank] = token
        # parts met lately, and those met before them
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _encoded(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self._pattern.findall(part):
            ids += self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        first, *parts = common.safe_parts(text)
        need = set(parts)
        if len(self._parts) + len(need) > PART_ENTRIES:
            self._parts, self._older = {}, self._parts
        known, older = self._parts, self._older
        for part in need.difference(known):
            known[part] = older.get(part) or self._encoded(" " + part)
        return self._encoded(first) + b"".join(map(known.__getitem__, parts))

    def decode_steps(self, ids: bytes) -> Iterator[bytes]:
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), DECODE_STEP):
            yield b"".join(map(self._tokens.__getitem__, numbers[at : at + DECODE_STEP].tolist()))

    def decode(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(step) for step in self.decode_steps(ids)] + [stream.close()])


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _release() -> None:
    """Named here, so that tasks call this module's own: what a nested function holds is sent to them as a copy."""
    _CODECS.clear()


def _mapped(rows: DataFrame, id_col: str, value: str, kind: str, fields: list[T.StructField], row) -> DataFrame:
    """``row`` applied to each value, batch by batch, beside the id."""
    common.ship(rows.sparkSession)
    schema = T.StructType([common.field(rows, id_col), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES, _release):
                made = list(zip(*(row(x) for x in batch.column(1).to_pylist())))
                kinds = [{"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()] for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(m, k) for m, k in zip(made, kinds))], names=schema.names
                )

    return rows.select(id_col, F.col(value).cast(kind).alias("_value")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every row.

    Row by row, without a shuffle: repeated rows give repeated rows, a null or
    empty text has no ids, a null id is kept, other columns are not read.
    """

    def row(text):
        ids = _codec(path, pattern).encode(text or "")
        return len(ids) // 4, ids

    return _mapped(docs, id_col, text_col, "string", [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], row)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and the ``text`` that the ids stand for; null ids give ''."""
    return _mapped(
        encoded, id_col, ids_col, "binary", [T.StructField("text", T.StringType())],
        lambda ids: (_codec(path, pattern).decode(ids or b""),),
    )


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again in one pass; counts and digests of both.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` of the decoded bytes. Edge cases as in ``encode``.
    """

    def row(text):
        codec = _codec(path, pattern)
        ids = codec.encode(text or "")
        decoded = hashlib.sha256()
        stream = Utf8Stream()
        for step in codec.decode_steps(ids):
            decoded.update(stream.feed(step).encode())
        decoded.update(stream.close().encode())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()

    return _mapped(
        docs, id_col, text_col, "string",
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())],
        row,
    )
