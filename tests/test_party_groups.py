"""Groups of duplicate parties against every pair of rows."""

import random

import pytest
from pyspark.sql import functions as F

from billwright.operators import groups, party_groups


def similar(a, b, containment):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if containment and (a in b or b in a):
        return 0.8
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def grouped(rows, threshold, containment):
    """Rows of (id, tenant, name, code, address)."""
    parent = {r[0]: r[0] for r in rows}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            m, n = a[2].lower().strip(), b[2].lower().strip()
            same = (a[3] and a[3] == b[3]) or (a[4] == b[4] and similar(m, n, containment) > threshold)
            if a[1] == b[1] and same:
                x, y = find(parent, a[0]), find(parent, b[0])
                parent[max(x, y)] = min(x, y)
    roots = {i: find(parent, i) for i in parent}
    sizes = {}
    for r in roots.values():
        sizes[r] = sizes.get(r, 0) + 1
    return sorted((r[1], r[0], roots[r[0]], sizes[roots[r[0]]]) for r in rows if sizes[roots[r[0]]] > 1)


SCHEMA = "id string, tenant_id string, name string, code string, address string"


def found(spark, rows, threshold, containment):
    df = spark.createDataFrame(rows, SCHEMA)
    got = party_groups.duplicate_groups(df, {"code": F.col("code")}, ["address"], threshold, containment)
    return sorted(map(tuple, got.select("tenant_id", "id", "group_id", "members").collect()))


@pytest.mark.parametrize("threshold,containment", [(0.8, True), (0.9, False), (0.8, False)])
@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, threshold, containment, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(24)]
    rows, names = [], []
    for i in range(300):
        if names and rng.random() < 0.7:  # a name like another one
            name = rng.choice(names).split()
            for _ in range(rng.randint(0, 4)):
                if name and rng.random() < 0.5:
                    name.pop(rng.randrange(len(name)))
                else:
                    name.insert(rng.randrange(len(name) + 1), rng.choice(words))
            if rng.random() < 0.2:
                rng.shuffle(name)
            name = " ".join(name)
        else:
            name = " ".join(rng.sample(words, rng.choice([1, 2, 4, 5, 6, 8, 10, 11, 12, 14, 15, 16, 18, 21, 24])))
        names.append(name)
        name = name.upper() if rng.random() < 0.2 else f" {name}  " if rng.random() < 0.1 else name
        rows.append((f"id{i:04d}", rng.choice(["t1", "t2"]), name, rng.choice([None, "", "", f"x{i % 70}"]) if rng.random() < 0.3 else "", rng.choice(["a", "b", None])))
    want = grouped(rows, threshold, containment)
    assert found(spark, rows, threshold, containment) == want and len(want) > 50


def test_many_variants_at_one_address_are_linear(spark, monkeypatch):
    """Every two of 3,000 names are similar; links stay in the order of the names."""
    core = " ".join(f"word{i}" for i in range(12))
    rows = [(f"id{i:05d}", "t", f"{core} unit{i}", "", None) for i in range(3000)]
    names = spark.createDataFrame([(r[1], "{}", r[2], r[0]) for r in rows], "tenant_id string, address string, name string, first_id string")
    assert party_groups.similar_links(names, 0.8, True).count() < 20 * len(rows)
    got = found(spark, rows, 0.8, True)
    assert len(got) == 3000 and {g[2:] for g in got} == {("id00000", 3000)}


def test_a_name_held_by_others_joins_none_by_itself(spark):
    """Names that hold each other are not similar, whatever their words; a third name may still join them."""
    rows = [("a", "t", "one two three four five six", "", None), ("b", "t", "one two three four five six seven", "", None)]
    assert found(spark, rows, 0.8, True) == []
    rows.append(("c", "t", "six one two three four five seven", "", None))
    assert found(spark, rows, 0.8, True) == grouped(rows, 0.8, True)


def test_chains_and_stars_of_links(spark):
    n = 3000
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(n)]
    star = [("s", f"t{i}") for i in range(n)]
    rng = random.Random(4)
    some = [(f"r{rng.randrange(800):03d}", f"r{rng.randrange(800):03d}") for _ in range(700)]
    got = dict(map(tuple, groups.linked_groups(spark.createDataFrame(chain + star + some + [("x", "x")], "a string, b string")).collect()))
    parent = {x: x for pair in chain + star + some for x in pair}
    for a, b in chain + star + some:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in chain + star + some if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    assert groups.linked_groups(spark.createDataFrame([], "a string, b string")).count() == 0
