"""Toxic spans and document scores by a linear-chain conditional random field.

Labels mark documents, tokens are labelled from them: in a toxic document the
tokens whose word or word start is far commoner in toxic documents than in
others are toxic, every other token is not. The field is fitted to these
tokens; its forward-backward marginals give spans and document scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common
from billwright.session import staged

#: Labelled rows that the field is fitted to, drawn by a hash of the id: so many of each label at most.
SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
#: Of these, so many of each label are used for the weights; all are used to label tokens.
FIT_DOCS = 400
#: Longer texts (in characters) are not drawn for the sample; they are scored like all others.
SAMPLE_CHARS = 20_000
#: A word or word start labels tokens if it is at least so many times as frequent in toxic
#: documents, with at least this likelihood ratio (G squared).
MIN_RATIO = 12.0
MIN_EVIDENCE = 24.0
STARTS = (4, 5, 6)
STEPS = 60
RIDGE = 0.3
#: A token of at least this marginal belongs to a span.
SPAN = 0.5
BATCH_BYTES = 1 << 20
#: Words of which a worker keeps the scores.
MEMORY_WORDS = 300_000

_TOKEN = re.compile(r"[^\W_]+")


def _features(word: str) -> list[str]:
    return ["w" + word, *(f"{n}{word[:n]}" for n in STARTS if len(word) >= n)]


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Marginals of the toxic tag for a run of token chains, and the summed pairs of tags.

    ``emission``: log odds of each token; ``first``: whether a token begins a
    chain; ``start`` and ``move``: weights (not logs) of tags and pairs. The
    run is folded into rows; all rows are multiplied up together, then joined,
    then gone through again with what comes before and after each row.
    """
    n = len(emission)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    step = np.empty((rows * width, 2, 2))
    step[:n] = np.where(first[:, None, None], start[None, None, :], move[None])
    step[:n, :, 1] *= np.exp(np.clip(emission, -30, 30))[:, None]
    step[n:] = np.eye(2)
    step = step.reshape(rows, width, 2, 2)

    def scaled(x):
        return x / x.sum(axis=-1, keepdims=True) if x.ndim < 3 else x / x.sum(axis=(-2, -1), keepdims=True)

    def times(a, b):
        out = np.empty(a.shape)
        for i in range(2):
            for j in range(2):
                out[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        return scaled(out)

    whole = step[:, 0]
    for c in range(1, width):
        whole = times(whole, step[:, c])
    ahead = np.empty((rows, 2))
    behind = np.empty((rows, 2))
    a = np.array([0.5, 0.5])
    b = np.array([0.5, 0.5])
    for r in range(rows):
        ahead[r] = a
        a = scaled(a @ whole[r])
    for r in reversed(range(rows)):
        behind[r] = b
        b = scaled(whole[r] @ b)
    alpha = np.empty((rows, width, 2))
    for c in range(width):
        m = step[:, c]
        ahead = scaled(np.stack([ahead[:, 0] * m[:, 0, j] + ahead[:, 1] * m[:, 1, j] for j in range(2)], 1))
        alpha[:, c] = ahead
    beta = np.empty((rows, width, 2))
    for c in reversed(range(width)):
        beta[:, c] = behind
        m = step[:, c]
        behind = scaled(np.stack([m[:, i, 0] * behind[:, 0] + m[:, i, 1] * behind[:, 1] for i in range(2)], 1))
    alpha, beta, step = (x.reshape(rows * width, *x.shape[2:])[:n] for x in (alpha, beta, step))
    joint = alpha * beta
    toxic = joint[:, 1] / joint.sum(1)
    inner = np.flatnonzero(~first)
    pair = alpha[inner - 1][:, :, None] * step[inner] * beta[inner][:, None, :]
    pairs = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return toxic, pairs


@dataclass
class Field:
    """The fitted weights: of a token's word and word starts, and of tags and pairs of tags."""

    own: dict[str, float]
    bias: float
    start: np.ndarray
    move: np.ndarray
    words: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > MEMORY_WORDS:
                self.words.clear()
            found = self.words[word] = self.bias + sum(self.own.get(x, 0.0) for x in _features(word))
        return found

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens of the texts, and where each text's tokens start."""
        tokens = [_TOKEN.findall(t.lower()) for t in texts]
        starts = np.cumsum([0, *map(len, tokens)])
        if not starts[-1]:
            return np.zeros(0), starts
        kinds: dict[str, int] = {}
        of = np.fromiter((kinds.setdefault(w, len(kinds)) for t in tokens for w in t), np.int64, starts[-1])
        scores = np.array([self.word(w) for w in kinds])
        first = np.zeros(starts[-1], bool)
        first[starts[:-1][starts[:-1] < starts[-1]]] = True
        return marginals(scores[of], first, self.start, self.move)[0], starts


def _evidence(k: float, j: float, n: int, m: int) -> float:
    """G squared of k of n against j of m, 0 if the first share is not much the greater."""
    if k / n < MIN_RATIO * ((j + 0.5) / (m + 1)):
        return 0.0
    share = (k + j) / (n + m)
    cells = ((k, n * share), (j, m * share), (n - k, n - n * share), (m - j, m - m * share))
    return 2 * sum(o * np.log(o / e) for o, e in cells if o > 0 and e > 0)


def _marking(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Words and word starts that tell toxic documents from others.

    The strongest is taken first. A toxic document counts less for the next
    the more marks it has, so words that copies of one toxic document happen
    to share are not taken for marks.
    """
    found: dict[str, list[int]] = {}
    for d, words in enumerate(toxic):
        for x in {f for w in set(words) for f in _features(w)}:
            found.setdefault(x, []).append(d)
    other = Counter(x for words in clean for x in {f for w in set(words) for f in _features(w)} if x in found)
    n, m = len(toxic), len(clean)
    ranked = sorted(((_evidence(len(d), other[x], n, m), x) for x, d in found.items() if len(d) > 1), reverse=True)
    weight = np.ones(n)
    out = set()
    for evidence, x in ranked:
        if evidence < MIN_EVIDENCE:
            break
        if _evidence(weight[found[x]].sum(), other[x], n, m) >= MIN_EVIDENCE:
            out.add(x)
            weight[found[x]] *= 0.75
    return out


def fit(toxic: list[str], clean: list[str]) -> Field:
    """The field for documents of both labels; without either it finds nothing toxic."""
    nothing = Field({}, 0.0, np.array([1.0, 1e-6]), np.array([[1.0, 1e-6], [1.0, 1e-6]]))
    if not toxic or not clean:
        return nothing
    words = [[_TOKEN.findall(t.lower()) for t in side] for side in (toxic, clean)]
    marking = _marking(*words)
    if not marking:
        return nothing
    chains = [(w, True) for w in words[0][:FIT_DOCS] if w] + [(w, False) for w in words[1][:FIT_DOCS] if w]
    kinds: dict[str, int] = {}
    of = np.array([kinds.setdefault(w, len(kinds)) for chain, _ in chains for w in chain])
    starts = np.cumsum([0, *(len(chain) for chain, _ in chains)])
    first = np.zeros(len(of), bool)
    first[starts[:-1]] = True
    marked = np.array([not marking.isdisjoint(_features(w)) for w in kinds])
    label = np.concatenate([marked[of[s:e]] & bad for (_, bad), s, e in zip(chains, starts, starts[1:])]).astype(float)

    names: dict[str, int] = {}
    rows, cols = [], []
    for k, word in enumerate(kinds):
        for x in _features(word):
            rows.append(k)
            cols.append(names.setdefault(x, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    n, v = len(names), len(kinds)
    inner = ~first[1:]
    prior = np.log(max(label.mean(), 1e-6))
    weights = np.concatenate([np.zeros(n), [prior, 0.0, 0.0, 0.0, 0.0]])  # features, bias, start, O to T, T to O, T to T
    tags = label.astype(int)
    seen = np.bincount((2 * tags[:-1] + tags[1:])[inner], minlength=4).reshape(2, 2)
    momentum, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, STEPS + 1):
        start, move = _tags(weights)
        per_word = np.bincount(rows, weights[cols], v) + weights[n]
        guess, pairs = marginals(per_word[of], first, start, move)
        miss = guess - label
        per_feature = np.bincount(cols, np.bincount(of, miss, v)[rows], n)
        slope = np.concatenate([per_feature, [miss.sum(), miss[first].sum()], (pairs - seen).ravel()[1:]])
        slope[:n] += RIDGE * weights[:n]
        slope[n + 1 :] += RIDGE * weights[n + 1 :]
        momentum = 0.9 * momentum + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        weights -= 0.25 * (momentum / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-3)
    own = {x: float(weights[k]) for x, k in names.items() if abs(weights[k]) > 1e-3}
    return Field(own, float(weights[n]), *_tags(weights))


def _tags(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and pair weights from the last four parameters."""
    start, out_in, in_out, in_in = weights[-4:]
    return np.exp(np.array([0.0, start])), np.exp(np.array([[0.0, out_in], [in_out, in_in]]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field from a bounded sample of labelled rows: see ``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` and ``SAMPLE_CHARS``.

    The sample follows a hash of the id, so it is the same on each run. Null
    labels, null texts and null ids are not learned from; labels of one id
    that differ count as toxic. Of several texts with one id one is drawn.
    """
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    )
    # one text per id, the same on each run; only ids and hashes are compared
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.length(text_col).alias("_chars"))
    firsts = read.where(F.col("_chars").between(1, SAMPLE_CHARS)).groupBy("_id").agg(F.min("_hash").alias("_hash"))
    usable = firsts.join(marks, "_id").withColumn("_at", F.xxhash64("_id"))
    of_label = [usable.where(F.col("_label") == label).orderBy("_at", "_id").limit(most) for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    drawn = staged(of_label[0].unionByName(of_label[1]), "drawn")  # at most the sample's size
    full = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text").between(1, SAMPLE_CHARS))
    found = full.withColumn("_hash", F.xxhash64("_text")).join(F.broadcast(drawn), ["_id", "_hash"])
    rows = found.groupBy("_id", "_label", "_at").agg(F.min("_text").alias("_text")).orderBy("_at", "_id").collect()
    return fit(*([r["_text"] for r in rows if r["_label"] == label] for label in (1, 0)))


def score(docs: DataFrame, crf: Field, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """The id column, ``score`` and ``spans`` of every row.

    The score is the greatest marginal of a token, 0 for a text that is null
    or has no token. Spans are maximal runs of tokens with a marginal of at
    least ``SPAN``: start and end in characters, and their greatest marginal.
    Row by row: repeated rows give repeated rows, a null id is kept, other
    columns are not read.
    """
    common.ship(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([common.field(docs, id_col), T.StructField("score", T.DoubleType())])
    if spans:
        schema.add("spans", T.ArrayType(span))
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                texts = common.texts(batch, 1)
                toxic, starts = crf.tag(texts)
                best = np.zeros(len(texts))
                full = np.diff(starts) > 0
                if full.any():
                    best[full] = np.maximum.reduceat(toxic, starts[:-1][full])
                columns = [batch.column(0), pa.array(best)]
                if spans:
                    found = [
                        _spans(t, toxic[a:b]) if top >= SPAN else [] for t, a, b, top in zip(texts, starts, starts[1:], best)
                    ]
                    columns.append(pa.array(found, arrow_span))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    # lower() keeps nearly every text's length; the few others are matched on the lowered text
    low = text.lower()
    for k, match in enumerate(_TOKEN.finditer(text if len(low) == len(text) else low)):
        if k < len(toxic) and toxic[k] >= SPAN:
            if last == k - 1:
                out[-1]["end"] = match.end()
                out[-1]["score"] = max(out[-1]["score"], float(toxic[k]))
            else:
                out.append({"start": match.start(), "end": match.end(), "score": float(toxic[k])})
            last = k
    return out
