"""Token counts, byte-level BPE, language and toxicity: libraries, round trips, held-out accuracy, odd rows."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF, frame, odd_rows
from pyspark import cloudpickle
from tokenizers import Tokenizer

from billwright.llm import bpe, common, language, license_scan, license_texts, queries, token_counts, toxicity
from billwright.llm.common import table

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    rnd = random.Random(4)
    odd = ["", " ", "  a  b\n\n c ", "don't  we'll\t x", " lead", "trail ", "日本語" * 40, "<|endoftext|> a <|endoftext|>b", "\x85 \xa0 x", "a" * 700, "\x1c a"]
    return odd + ["".join(rnd.choice("abcehinost' 019.\n\té日 ") for _ in range(rnd.randint(1, 150))) for _ in range(n)]


def test_transducer_gives_the_librarys_ids(reference):
    codec = bpe.Codec(RANKS, P.PATTERN)
    tokens = list(codec.transducer.ranks)
    rnd = random.Random(9)
    texts = random_texts(800) + [b"".join(rnd.choice(tokens) for _ in range(9)).decode("utf8", "ignore") for _ in range(800)]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text


def test_utf8_stream_waits_for_cut_characters():
    data = "aé日😀".encode()
    for cut in itertools.combinations(range(len(data) + 1), 2):
        stream = bpe.Utf8Stream()
        parts = [stream.feed(data[a:b]) for a, b in zip((0, *cut), (*cut, len(data)))]
        assert "".join(parts) + stream.close() == "aé日😀"
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xff\xe6") + stream.close() == "a��"


def test_token_counts_of_parts_are_those_of_whole_texts():
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = random_texts(500)
    counter = token_counts._counter(queries.TOKENIZER)
    assert counter.count(texts) == [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_and_round_trip_on_odd_rows(spark, odd, empty, reference):
    rows = sorted(odd_rows(), key=repr)
    counts = sorted((tuple(r) for r in token_counts.count_tokens(odd, queries.TOKENIZER).collect()), key=repr)
    trips = sorted((tuple(r) for r in bpe.round_trip(odd, RANKS, P.PATTERN).collect()), key=repr)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    expected = []
    for i, t, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert counts == sorted(expected, key=repr)
    digests = []
    for i, t, _ in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        digests.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert trips == sorted(digests, key=repr)
    assert token_counts.count_tokens(empty, queries.TOKENIZER).count() == 0
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("module, kept", [(bpe, "_CODECS"), (token_counts, "_COUNTERS")])
def test_a_task_frees_what_the_one_before_it_kept(spark, monkeypatch, module, kept):
    # the functions as a worker gets them
    sent = []
    docs = spark.createDataFrame([(1, "some words to encode")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: sent.append(cloudpickle.dumps(run)) or docs.selectExpr("*", "1 AS n_tokens"))
    if module is bpe:
        bpe.encode(docs, RANKS, P.PATTERN)
    else:
        token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(module, kept, {})
    monkeypatch.setattr(common, "_KEPT", [])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words to encode"]})
    for _ in range(2):
        assert len(list(cloudpickle.loads(sent[0])(iter([batch])))) == 1
    held = getattr(module, kept)
    assert len(held) == 1
    assert len(list(common.slices(batch, 1, 100))) == 1
    assert not held and not common._KEPT


def test_encode_then_decode_gives_the_texts(spark):
    docs = table(spark, SF, "documents")
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in docs.select("doc_id", "text").collect())


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (d in held) for d in docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_on_odd_rows(spark, odd, empty):
    model = language.train(odd)
    assert model.languages == ["de", "en", "fr"]
    got = [(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()]
    assert len(got) == len(odd_rows())
    assert {i for i, lang in got if lang == "und"} == {3, 4, 5, 6}
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.predict(odd, language.train(empty)).collect())
    assert language.predict(empty, model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 30])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    emission, first = rng.normal(size=9), np.zeros(9, bool)
    first[[0, 4]] = True
    start, move = np.array([1, 0.3]), np.array([[1, 0.2], [0.5, 2.0]])
    got, pairs = toxicity.marginals(emission, first, start, move)
    total, marked, seen = 0.0, np.zeros(9), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=9):
        w = np.prod([(start[y[t]] if first[t] else move[y[t - 1], y[t]]) * np.exp(emission[t] * y[t]) for t in range(9)])
        total += w
        marked += w * np.array(y)
        for t in np.flatnonzero(~first):
            seen[y[t - 1], y[t]] += w
    assert np.allclose(got, marked / total) and np.allclose(pairs, seen / total)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == labels[i] for i in held) / len(held)
    assert right > 0.97 and all(got[i].held_out for i in held)
    assert all(bool(r.spans) == (r.predicted == 1) for r in got.values())


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    crf = toxicity.train(odd, labels)
    rows = toxicity.score(odd, crf).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(odd, toxicity.train(empty, labels)).where("score > 0.5").count() == 0
    assert toxicity.score(empty, crf).count() == 0


def test_spans_name_the_offending_places():
    bad = [f"they said zorgle to us on day {i} word{i}" for i in range(60)]
    good = [f"they said hello to us on day {i} term{i}" for i in range(120)]
    crf = toxicity.fit(bad, good)
    text = "Well, ZORGLE zorgle! they said"
    marginals, _ = crf.tag([text])
    spans = toxicity._spans(text, marginals)
    assert [(text[s["start"] : s["end"]]) for s in spans] == ["ZORGLE zorgle"]


def test_licenses_by_brute_force(spark, empty):
    rnd = random.Random(2)
    noise = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(n))
    rows, expected = [(0, None, None), (1, "", None)], {0: [], 1: []}
    for name, text in license_texts.TEMPLATES.items():
        for cut in (0, 1):
            words = text.split()
            if cut and len(words) > 60:
                del words[20]  # a changed copy
            elif cut:
                continue
            rows.append((len(rows), f"{noise(rnd.randint(0, 90))} {' '.join(words)} {noise(rnd.randint(0, 90))}", None))
            expected[len(rows) - 1] = sorted({name} | {n for n, t in license_texts.TEMPLATES.items() if t in text})
    got = {r.doc_id: r.licenses for r in license_scan.scan(frame(spark, rows), license_texts.TEMPLATES).collect()}
    assert got == expected
    assert license_scan.scan(empty, license_texts.TEMPLATES).count() == 0


def test_license_query_by_containment(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.licenses for r in queries.op2_license_scan(spark, sf).collect()}
    for d in table(spark, sf, "documents").collect():
        want = sorted(n for n, t in license_texts.TEMPLATES.items() if t.lower().rstrip(".") in (d.text or "").lower())
        assert got[d.doc_id] == ",".join(want)
