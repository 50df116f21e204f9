"""Archives, conversation tries and periodic runs: brute force, the format itself and odd rows."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import SF, frame, odd_rows
from pyspark.sql import functions as F

from billwright.llm import periodic, prefix_trie, queries, warc
from billwright.llm.common import table
from billwright.session import shared_folder

# periodic runs


def runs_of(words, exponent=4, least=6):
    """Every period is tried on every place."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            shorter = any(all(words[k] == words[k + p] for k in range(a, e - p)) for p in range(1, q))
            if e - a >= max(least, exponent * q) and not shorter:
                out.append((a, e - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            n, k = rnd.choice([0, 1, 5, 6, 7, 30, 60]), rnd.choice([1, 2, 3])
            words = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a, p = n // 4, rnd.randint(1, 5)
                words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
            docs.append(np.array(words, np.int32))
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            assert periodic.find_runs(docs, exponent, least) == [runs_of(list(d), exponent, least) for d in docs]


def test_suffix_arrays_are_sorted_with_common_prefixes():
    rnd = random.Random(6)
    words = np.array([rnd.randrange(3) for _ in range(80)] + [7] + [1] * 40 + [8], np.int64)
    doc = np.r_[np.zeros(81, np.int64), np.ones(41, np.int64)]
    index = periodic.SuffixArray(words, doc)
    suffix = [(doc[i], words[i:].tolist()) for i in range(len(words))]
    assert index.suffixes.tolist() == sorted(range(len(words)), key=lambda i: suffix[i])
    for k in range(1, len(words)):
        (x, a), (y, b) = suffix[index.suffixes[k - 1]], suffix[index.suffixes[k]]
        common = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert index.lcp[k] == (common if x == y else 0)


def test_long_texts_of_one_word_and_of_nested_periods():
    one = np.zeros(200_000, np.int32)
    assert periodic.find_runs([one]) == [[(0, 200_000, 1)]]
    nested = np.array(([0] * 8 + [1]) * 5, np.int32)
    assert periodic.find_runs([nested]) == [runs_of(nested.tolist())]


def test_runs_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").where(F.length("text") < 4000).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    checked = docs.withColumn("checksum", F.crc32(F.col("doc_id").cast("string")))
    got = periodic.collapse_runs(checked, loop="checksum").select(RUN_COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(runs_row(*r) for r in rows)
    assert sum(r.n_runs for r in got) > 5
    whole = {r.doc_id: tuple(r[c] for c in RUN_COLUMNS) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(whole) == table(spark, SF, "documents").count() and all(whole[r.doc_id] == tuple(r) for r in got)


def test_runs_on_odd_rows(spark, odd, empty):
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000] + [(21, "no " * 9, None), (22, "a b\tc a b\x0bc a b c a b c ", None)]
    got = periodic.collapse_runs(frame(spark, rows)).select(RUN_COLUMNS).collect()
    plain = [runs_row(None, t) for _, t, _ in rows]
    assert sorted(((r.doc_id, *tuple(r)[1:]) for r in got), key=repr) == sorted(((i, *p[1:]) for (i, _, _), p in zip(rows, plain)), key=repr)
    assert periodic.collapse_runs(odd).count() == len(odd_rows()) and periodic.collapse_runs(empty).count() == 0
    text = periodic.collapse_runs(frame(spark, [(1, "x no no no no no no y", None)])).collect()[0]
    assert (text.collapsed, text.runs[0].asDict()) == ("x no y", {"start": 1, "length": 6, "period": 1})


# conversation tries


def trie_of(rows, group=5, heads=9):
    """Nodes of a trie built prefix by prefix; rows of (conv, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            digest = hashlib.md5(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).digest()
            turns[c].append(((turn is not None, turn or 0, digest), pair))
    ordered = {c: [p for _, p in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(ordered.get(c - c % group, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, convs in members.items():
        below = [v for v in members if v[: len(k)] == k]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        leaves = sum(not children[v] for v in below)
        ids = ",".join(map(str, sorted(ends[k])))
        out.append((min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), len(children[k]), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(spark, rows):
    """Conversations with columns whose names the operator uses inside."""
    extra = "conv long, place long, digest string, bytes long, depth long, _segment long, f1 long, n_convs long"
    return spark.createDataFrame([(*r, 1, 2, "d", 3, 4, 5, 6, 7) for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def some_talks():
    rnd = random.Random(8)
    rows = []
    for c in [*range(60), 1000, 1001, 1004, 5003]:
        first = ["hello", "hi", None, ""][rnd.randrange(4)] if c % 3 else "hello"
        for t in range(rnd.choice([0, 1, 2, 4, 7, 12])):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", None, "assistant"]), first if t == 0 else rnd.choice(["a", "é", "b" * 50])))
    rows += [(7, 3, "user", "again")] * 3 + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("segment,piece,heads", [(4096, 1024, 9), (2, 3, 9), (3, 5, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, piece, heads):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = some_talks()
    got = prefix_trie.conversation_trie(talks(spark, rows), heads=heads)
    assert sorted(map(tuple, got.collect()), key=repr) == trie_of(rows, heads=heads)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(talks(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(talks(spark, [(None, 1, "u", "x")])).count() == 0
    # the base is not there and the own turns are fewer than the first h: nothing is left
    c = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    only = prefix_trie.conversation_trie(talks(spark, [(c, 1, "u", "x")])).collect()
    assert sorted(map(tuple, only)) == trie_of([(c, 1, "u", "x")]) and len(only) == 1


def test_copies_of_one_conversation_are_one_path(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    got = prefix_trie.conversation_trie(talks(spark, rows), heads=1)
    assert sorted(map(tuple, got.collect()), key=repr) == trie_of(rows, heads=1)
    assert got.count() == 4


# archives


def pages(spark, rows):
    extra = "digest binary, size long, record_id string, payload string, first long, _id long"
    return spark.createDataFrame([(*r, b"x", 1, "r", "p", 2, 3) for r in rows], f"page_id long, url string, html string, {extra}")


BIG, OTHER = "<p>" + "é" * 80 + "</p>\r\n\r\nWARC/1.1\r\n", "y" * 100
PAGES = [
    (5, "http://a/ b\r\nX: 1", BIG), (3, "http://b", BIG), (9, None, BIG), (None, "u", BIG), (4, "u", OTHER), (4, "u", OTHER), (8, "u", OTHER),
    (1, "u", "short"), (2, "u", "short"), (6, "u", None), (7, "u", ""), (-3, "u", "z" * 99), (-4, "u", "z" * 99), (None, "u", "n" * 200),
    (10, "u", "long " * 200_000), (11, "u", "long " * 200_000),
]


def archived(rows):
    least = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            least[html] = min(i, least.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = least.get(html)
        again = first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pages_come_back_from_their_archives(spark, compression, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0 if compression == "none" else 9)
    got = warc.archive_pages(pages(spark, PAGES), shared_folder(spark, "warc"), compression=compression)
    assert sorted(map(tuple, got.collect()), key=repr) == archived(PAGES)


def test_no_pages_no_archives(spark):
    path = shared_folder(spark, "warc")
    assert warc.archive_pages(pages(spark, []), path).collect() == []
    assert warc.read_warc(spark, path + "-missing").count() == 0


def write(spark, path, rows, **options):
    warc.register(spark)
    records = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary").coalesce(1)
    records.write.format("warc").mode("append").options(**options).save(path)
    return sorted(Path(path).glob("*.warc*"))


RECORDS = [(f"urn:{i}", ["response", "resource", "metadata"][i % 3], f"http://h{i % 4}/{i}", b"%d " % i * 5000) for i in range(60)]


def block_size(record):
    return len(warc.record_bytes(dict(zip(("record_id", "record_type", "target_uri", "payload"), record)), "")[1])


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_predicates_are_taken_over(spark, compression):
    path = shared_folder(spark, "warc")
    files = write(spark, path, RECORDS, compression=compression, maxFileBytes="2000")
    assert len(files) > 3
    all_records = warc.read_warc(spark, path)
    assert all_records.count() == 60 and all_records.rdd.getNumPartitions() == 1
    cases = {
        "record_type = 'resource'": lambda r: r[1] == "resource",
        "record_type IN ('resource', 'metadata') AND target_uri LIKE 'http://h1/%'": lambda r: r[1] != "response" and r[2].startswith("http://h1/"),
        "record_type <> 'response' AND target_uri IS NOT NULL": lambda r: r[1] != "response",
        "refers_to IS NOT NULL": lambda r: False,
        "content_length >= 15000 AND NOT record_type = 'metadata'": lambda r: block_size(r) >= 15000 and r[1] != "metadata",
        "target_uri LIKE '%/7' OR record_type = 'metadata'": lambda r: r[2].endswith("/7") or r[1] == "metadata",
    }
    for condition, keeps in cases.items():
        got = warc.read_warc(spark, path, ["record_id", "payload"], condition).collect()
        assert sorted(map(tuple, got)) == sorted((r[0], r[3]) for r in RECORDS if keeps(r)), condition
    plan = warc.read_warc(spark, path, where="record_type = 'resource'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan" in plan


def test_a_frame_without_a_predicate_may_be_used_twice_in_a_plan(spark):
    path = shared_folder(spark, "warc")
    write(spark, path, RECORDS)
    records = warc.read_warc(spark, path, ["record_id", "record_type"])
    both = records.where("record_type = 'resource'").union(records.where("record_type = 'metadata'"))
    assert both.groupBy("record_type").count().count() == 2 and both.count() == 40 and records.count() == 60
    archived_pages = warc.archive_pages(pages(spark, PAGES), shared_folder(spark, "warc"))
    kinds = [archived_pages.where(f"record_type = '{k}'") for k in ("response", "revisit")]
    assert kinds[0].union(kinds[1]).count() == len(PAGES)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_unwanted_payloads_are_not_decoded(spark, compression):
    """Payload bytes are destroyed; only reading them can notice."""
    path = shared_folder(spark, "warc")
    rnd = random.Random(1)
    noise = [(f"urn:{i}", "response" if i % 2 else "resource", None, rnd.randbytes(200_000)) for i in range(6)]
    (file,) = write(spark, path, noise, compression=compression)
    data = bytearray(file.read_bytes())
    offsets = [r.offset for r in warc.read_warc(spark, path, ["record_id", "offset"]).orderBy("offset").collect()]
    assert len(offsets) == 6
    for at in offsets[::2]:  # resources
        data[at + 100_000 : at + 100_100] = b"\xff" * 100
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    kept = warc.read_warc(spark, path, ["record_id", "payload"], "record_type = 'response'").collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in kept) == sorted((r[0], r[3]) for r in noise if r[1] == "response")
    assert warc.read_warc(spark, path, ["record_id", "content_length"]).count() == 6
    if compression == "gzip":
        with pytest.raises(Exception, match="record at"):
            spark.createDataFrame(warc.read_warc(spark, path, ["payload"]).collect()).count()


def test_archives_of_others(spark):
    """Members without lengths, with names, bare line ends, folded and repeated fields."""
    path = Path(shared_folder(spark, "warc"))
    path.mkdir()
    def record(kind, body, extra=b""):
        return b"WARC/1.0\r\nwarc-type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    one = record(b"warcinfo", b"software: x\r\n\r\n")
    two = record(b"response", b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\nhello", b"Content-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://a\r\n /b\r\n")
    three = record(b"metadata", b"")
    (path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(three))
    (path / "b.warc").write_bytes(one + two + three)
    (path / "_hidden").mkdir()
    (path / "_hidden" / "c.warc").write_bytes(b"no archive")
    (path / "notes.txt").write_bytes(b"no archive")
    got = warc.read_warc(spark, str(path)).select("record_type", "target_uri", "payload", "payload_length").collect()
    each = [("metadata", None, b"", 0), ("response", "http://a /b", b"hello", 5), ("warcinfo", None, b"software: x\r\n\r\n", 15)]
    assert sorted((r[0], r[1], bytes(r[2]), r[3]) for r in got) == sorted(each * 2)
    assert warc.read_warc(spark, str(path), where="record_type = 'metadata'").count() == 2
    assert warc.read_warc(spark, f"file://{path}/b.warc").count() == 3
    (path / "d.warc").write_bytes(one + two[:-6])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, str(path / "d.warc")).select("payload").collect()


def test_small_files_share_a_task_and_lost_attempts_leave_nothing(spark):
    path = shared_folder(spark, "warc")
    for _ in range(5):
        write(spark, path, RECORDS[:3], compression="gzip")
    reader = warc.WarcReader({"path": path, "maxPartitionBytes": "1"}, warc.SCHEMA)
    assert [len(p.paths) for p in reader.partitions()] == [1] * 5
    assert [len(p.paths) for p in warc.WarcReader({"path": path}, warc.SCHEMA).partitions()] == [5]
    assert not list(Path(path).glob("_job-*"))
    writer = warc.WarcWriter({"path": path}, warc.T.StructType([warc.SCHEMA["record_id"], warc.SCHEMA["record_type"]]), False)
    batch = [warc.pa.RecordBatch.from_pylist([{"record_id": "urn:a", "record_type": "metadata"}])]
    writer.write(iter(batch))  # an attempt that is lost
    writer.commit([writer.write(iter(batch)), None])
    assert warc.read_warc(spark, path, where="record_id = 'urn:a'").count() == 1 and not list(Path(path).glob("_job-*"))
