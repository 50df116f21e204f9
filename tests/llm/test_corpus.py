"""Copies, near copies, passages, leaks, lines and the pipeline: brute force, SQL and odd rows."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from compare import compare, connect
from conftest import SF, frame, odd_rows

import __spark_entry__ as entry_points
import corpus_pipeline
from billwright.llm import bpe, decontaminate, exact_dedup, graph, line_dedup, ngram_join, passages, queries
from billwright.llm.common import table
from billwright.session import handed, scratch, staged

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").translate(UP)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    same, message = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert same, message


def test_queries_are_registered():
    names = entry_points.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


# exact copies


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[fold(t)].append(i)
    out = []
    for i, t, _ in rows:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_copies_on_odd_rows(spark, odd, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block if block == 4096 else 3001)
    rows = odd_rows()
    got = exact_dedup.find_duplicates(odd).drop("row_key").collect()
    assert sorted(map(tuple, got), key=repr) == exact_expected(rows)


def test_exact_copies_need_more_than_length_and_checksum(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4)
    # plumless and buckeroo have the same CRC-32
    rows = [(1, "plumless", None), (2, "buckeroo", None), (3, "PLUMLESS", None), (4, "buckeroo", None), (5, "", None), (6, None, None)]
    got = exact_dedup.find_duplicates(frame(spark, rows)).drop("row_key").collect()
    assert sorted(map(tuple, got), key=repr) == exact_expected(rows)


def test_exact_copies_of_nothing(spark, empty):
    assert exact_dedup.find_duplicates(empty).count() == 0


# near copies


def near_expected(rows, size, part):
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = [grams(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= part * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[k][0], len(sets[k]), least[group[k]]) for k in range(len(rows))), key=repr)


def near_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for base in range(4):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(30, 120))]
        for _ in range(n):
            copy = list(words)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randint(0, 50)}"
            if rnd.random() < 0.3:
                copy += [f"u{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 9))]
            rows.append((len(rows) + 1, " ".join(copy), None))
    return rows


@pytest.mark.parametrize(("size", "part", "tile"), [(4, 85, 1000), (3, 70, 8)])
def test_near_copies_by_brute_force(spark, monkeypatch, size, part, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)  # small tiles: bands are split
    rows = near_rows(20, size)
    got = ngram_join.cluster(frame(spark, rows), size, part).drop("stays", "row_key").collect()
    assert sorted(map(tuple, got), key=repr) == near_expected(rows, size, part)


def test_near_copies_travel_as_packed_texts(spark, monkeypatch):
    kept, staged = {}, ngram_join.staged

    def keep(df, purpose):
        rows = staged(df, purpose)
        kept.setdefault(purpose, rows)
        return rows

    monkeypatch.setattr(ngram_join, "staged", keep)
    rows = near_rows(20, 4)
    ngram_join.cluster(frame(spark, rows), 4, 85).count()
    body = next(c for c, kind in kept["sets"].dtypes if kind == "binary")
    packed = kept["sets"].selectExpr("count(*)", f"sum(octet_length({body}))").first()
    longest = sorted((len(t) for _, t, _ in rows), reverse=True)[: packed[0]]
    assert 0 < packed[1] < sum(longest)


def test_packed_texts_come_back_in_order(monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH_BYTES", 100)
    texts = ["x", None, "é" * 80, "a b c " * 50, "", "q"]
    parts = [p.to_pylist() for p in ngram_join._unpacked(ngram_join._packed(pa.array(texts)).to_pylist())]
    assert [t for p in parts for t in p] == [(t or "").encode() for t in texts]
    assert len(parts) > 2


def test_near_copies_on_odd_rows(spark, odd, empty):
    got = ngram_join.cluster(odd, 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == near_expected(odd_rows(), 4, 85)
    assert ngram_join.cluster(empty, 4, 85).count() == 0


def test_near_copies_keep_no_profiles_or_packed_texts(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr("billwright.session.shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    texts = [(100 + i, " ".join(f"word{j}" for j in range(i, i + 80)), "en") for i in range(6)]
    with scratch(spark):
        found = handed(ngram_join.cluster(frame(spark, odd_rows() + texts)), "groups")
        held = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in tmp_path.iterdir()}
    assert {"rows", "class-names", "banded"} <= held and not held & {"profiles", "classes", "shared", "listed", "likely", "owners", "sets"}
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["groups"]
    assert found.count() == len(odd_rows()) + 6 and found.where("doc_id >= 100").select("component_id").distinct().count() == 1


def test_scratch_tables_go_with_their_scope(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("billwright.session.shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    rows = spark.range(20).groupBy((F.col("id") % 3).alias("k")).count()
    left = lambda: sorted(p.name for p in tmp_path.iterdir())
    with scratch(spark, inner=True):
        assert spark.conf.get(key, None) == before
    with scratch(spark):
        with pytest.raises(ZeroDivisionError), scratch(spark):
            staged(rows, "inner")
            one, two = handed(rows, "one"), handed(rows, "two", out=2)
            assert left() == ["inner", "one", "two"] and spark.conf.get(key) == "true"
            1 / 0
        assert left() == ["one", "two"] and one.count() == 3
    assert left() == ["two"] and two.count() == 3 and staged(rows, "plain").count() == 3
    assert left() == ["plain", "two"] and spark.conf.get(key, None) == before


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    rnd.shuffle(links)
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {200 + i: 200 for i in range(1, 9)}
    assert got == want


# passages


def passages_expected(rows, length):
    seen = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(hashlib.blake2b(b[i : i + length], digest_size=12).digest() for i in range(len(b) - length + 1))
    out = []
    for d, t, _ in rows:
        b = (t or "").encode()
        mark, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=12).digest()] > 1:
                for x in range(max(i, end), i + length):
                    mark[x] = 1
                end = i + length
        kept = bytes(x for x, y in zip(b, mark) if not y)
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((d, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_longest_matches_by_brute_force():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(15):
        pieces = [np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))), np.uint8) for _ in range(rnd.randint(1, 6))]
        places = [(p, i) for p in pieces for i in range(len(p) + 1)]
        want = []
        for k, (p, i) in enumerate(places):
            best = 0
            for m, (q, j) in enumerate(places):
                n = 0
                while m != k and n < min(len(p) - i, len(q) - j) and p[i + n] == q[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best)
        assert passages.longest_matches(pieces).tolist() == want


def passage_rows():
    rnd = random.Random(5)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    shared = text("abcdefgh ", 900)
    rows = []
    for i in range(40):
        at = rnd.randint(0, 300)
        rows.append((i, text("ijklmnop ", rnd.randint(0, 500)) + shared[at : at + rnd.randint(380, 600)] + text("ijklmnop ", rnd.randint(0, 500)), None))
    return rows + [(100, "xy" * 500, None), (101, "z" * 1000, None), (104, "q" * 399, None), (105, "é" * 300, None)]


@pytest.mark.parametrize("most", [1000, 3])
def test_passages_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "BLOCK_SEGMENTS", most)  # few: anchors are refined
    rows = passage_rows()
    assert sorted(map(tuple, passages.remove_repeats(frame(spark, rows)).collect()), key=repr) == passages_expected(rows, 400)


def test_passages_on_odd_rows(spark, odd, empty):
    assert sorted(map(tuple, passages.remove_repeats(odd).collect()), key=repr) == passages_expected(odd_rows(), 400)
    assert passages.remove_repeats(empty).count() == 0


def test_passage_query_by_brute_force(spark):
    rows = [(d.doc_id, d.text, None) for d in table(spark, SF, "documents").collect()]
    got = queries.op8_repeated_passages(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == passages_expected(rows, 400)


# leaks


def test_leaks_on_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "QUICK brown fox"), (1, "QUICK brown fox"), (2, None), (3, ""), (4, "fox quick"), (None, "quick brown"), (5, "das und nicht, mit ein eine")],
        "item_id long, text string",
    )
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find_matches(odd, items).collect()), key=repr)
    want = []
    for i, t, _ in odd_rows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        hit = 3 if "quick" in words else 6 if "nicht" in words else 0
        want.append((i, len(words), hit, ("1",) if hit == 3 else ("5",) if hit else ()))
    assert got == sorted(want, key=repr)
    assert decontaminate.find_matches(empty, items).count() == 0
    assert decontaminate.find_matches(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    docs = frame(spark, [(1, "a b c d", None), (2, "a x b c d", None), (3, "b a c d", None), (4, "a x x x b c d", None)])
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    near = {r.doc_id for r in decontaminate.find_matches(docs, items, slop=1).where("n_hit > 0").collect()}
    assert near == {1, 2, 3}
    assert {r.doc_id for r in decontaminate.find_matches(docs, items).where("n_hit > 0").collect()} == {1}


# lines


def test_lines_on_odd_pages(spark):
    nav = "<nav><a href='/'>Home</a></nav><p>Page {} text</p><footer>All rights</footer>"
    pages = [(i, f"http://U@Host.example:80/{i}", nav.format(i)) for i in range(6)]
    pages += [(0, "http://host.example/0", nav.format(0)), (7, None, "<p>x</p><p>x</p>"), (8, "no host", None), (None, "http://b.example/", ""), (9, "http://b.example/", "a<br>b<script>c</script>")]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, lines int")
    got = sorted((tuple(r) for r in line_dedup.drop_boilerplate(df).collect()), key=repr)
    want = [(i, "host.example", 3, 2, f"Page {i} text") for i in range(6)] + [(0, "host.example", 3, 2, "Page 0 text")]
    want += [(7, "", 2, 0, "x\nx"), (8, "", 0, 0, ""), (None, "b.example", 0, 0, ""), (9, "b.example", 2, 0, "a\nb")]
    assert got == sorted(want, key=repr)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_lines_of_small_hosts_and_of_very_long_pages(spark):
    """Hosts of two pages lose their common lines too; what is never closed is read once."""
    rows = [(1, "http://a/1", "<p>menu</p><p>one</p>"), (2, "http://a/2", "<p>menu</p><p>two</p>"), (3, "http://b/", "<p>menu</p>")]
    rows += [(10 + i, "http://long/", "<p>x</p>" + part * 60_000) for i, part in enumerate(["<!-- ", "<script ", "<p ", "<", "</div", "<style>"])]
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].n_dropped, got[i].text) for i in (1, 2, 3)] == [(1, "one"), (1, "two"), (0, "menu")]
    assert all(got[10 + i].text == "" and got[10 + i].n_dropped == 1 for i in range(6))


# pipeline


def test_pipeline_by_brute_force(spark, tmp_path):
    docs = [(d.doc_id, d.text, d.lang) for d in table(spark, SF, "documents").collect()] + odd_rows()[2:7]
    path = str(tmp_path)
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, path).collect())

    left = [(i, t) for i, t, _ in docs if t and any(map(str.isalpha, t))]
    last = {}
    for i, t in left:
        last[fold(t)] = max(i, last.get(fold(t), i))
    left = list(dict.fromkeys((i, t) for i, t in left if last[fold(t)] == i))
    groups = near_expected([(i, t, None) for i, t in left], 5, 80)
    stays = {i for i, _, least in groups if i == least}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {tuple(w[k : k + 10]) for w in (words(t) for _, t in items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    leaks = {i for i, t in left for w in [words(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows}
    assert got == sorted(i for i, _ in left if i in stays and i not in leaks)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and bpe is not None


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, empty, at):
    """Rows come out as they went in, whatever other columns are called."""
    _, stage = corpus_pipeline.STAGES[at]
    clashing = odd.withColumn("row_key", F.col("n") * 7).withColumn("kept", F.lit("k")).withColumn("stays", F.lit("s"))
    out = stage(spark, clashing, SF)
    assert out.columns == clashing.columns
    rows, kept = Counter(map(tuple, clashing.collect())), Counter(map(tuple, out.collect()))
    assert kept and not kept - rows
    nothing = stage(spark, empty, SF)
    assert nothing.columns == empty.columns and nothing.count() == 0
