from collections import defaultdict

import pytest

from foliant.operators import grid as G
from foliant.operators import relations as R
from foliant.queries import relations as Q

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def cells(spark):
    return [(r.l_suppkey, r.l_partkey % 500 + 1, int(r.l_quantity), r.l_returnflag) for r in table(spark, "lineitem")]


def test_whole_merges(spark):
    areas = defaultdict(list)
    for r in table(spark, "orders"):
        top, left = r.o_orderkey % 450 + 1, r.o_orderkey % 40 + 1
        areas[r.o_custkey % 100 + 1].append((r.o_orderkey, top, top + r.o_orderkey % 90, left, left + 9))
    want = set()
    for s, row, col in {c[:3] for c in cells(spark)}:
        if inside := [k for k, t, b, l, r in areas[s] if t <= row <= b and l <= col <= r]:
            want.add((s, row, col, min(inside)))
    got = [tuple(r) for r in Q.merge_range_join(spark, SF).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_whole_grid(spark):
    rows = defaultdict(dict)
    for s, row, col, t in cells(spark):
        rows[s, row][col] = min(t, rows[s, row].get(col, t))
    letter = lambda c: chr(64 + c) if c <= 26 else chr(64 + (c - 1) // 26) + chr(65 + (c - 1) % 26)
    want = {(s, r): f"| {r} | " + " | ".join(f"{letter(c)}{r}: {t}" for c, t in sorted(v.items())) + " |" for (s, r), v in rows.items()}
    got = Q.addressed_grid(spark, SF).collect()
    assert len(got) == len(want) and {(r.sheet, r.row): r.line for r in got} == want


def test_whole_orders(spark):
    orders = table(spark, "orders")
    want, runs = {}, []
    for r in orders:
        k = r.o_orderkey
        native, shown = 2 if k % 3 == 0 else 1, 3 if k % 4 == 0 else 1
        both = native == shown
        state = next((s for n, s in ((11, "error"), (7, "missing"), (5, "blank")) if k % n == 0), "value")
        fallback = r.o_orderpriority if both else "[blank]" if state == "blank" else r.o_orderstatus
        want[k % 10, k, native] = {"error": r.o_orderstatus, "missing": "[missing cached result]"}.get(state, fallback)
        if not both:
            want[k % 10, k, shown] = r.o_orderpriority
        if k % 3:
            runs += [(k, 1 + i, 1 + j, r.o_orderstatus, "cell") for i in range(k % 4 + 1) for j in range(k % 3 + 1)]
        else:
            runs.append((k, 1, 1, None, "blank-range"))
    got = Q.readable_cells(spark, SF).collect()
    assert len(got) == len(want) and {(r.sheet, r.row, r.col): r.text for r in got} == want
    assert sorted(map(str, map(tuple, Q.repeat_expansion(spark, SF).collect()))) == sorted(map(str, runs))


def test_whole_trees_and_formulas(spark):
    sf = "/root/testdata/sf0.01"
    orders = table(spark, "orders", sf)
    own = {r.o_orderkey: r.o_orderstatus if r.o_orderkey % 7 == 0 else None for r in orders}

    def nearest(n):
        while n and own.get(n) is None:
            n //= 4
        return own.get(n)

    assert {r.id: r.rotation for r in Q.inherited_attributes(spark, sf).collect()} == {k: nearest(k) for k in own}
    got = {(r.sheet, r.row): r.formula for r in Q.shared_formulas(spark, sf).collect()}
    want = {}
    for k in own:
        sheet, row = divmod(k, 2000)
        master = row % 20 + 1
        want[sheet, row + 1] = f"SUM(A{row + 1}:$B$1)+C{1 + row + 1 - master}"
    assert len(orders) > 2000 and got == want


def test_whole_fallbacks(spark):
    part = {r.p_partkey: r for r in table(spark, "part", "/root/testdata/sf0.01")}

    def follow(k):
        seen = set()
        while k in part and k not in seen:
            if part[k].p_size > 25:
                return k
            seen.add(k)
            k = k * 7 % len(part) + 1 if k % 9 else None
        return None

    assert len(part) > 300
    assert {r.id: r.target for r in Q.fallback_chain(spark, "/root/testdata/sf0.01").collect()} == {k: follow(k) for k in part}


def test_chains_of_any_length(spark):
    rows = [(i, i == 300, i + 1) for i in range(301)] + [(1000, False, 1001), (1001, False, 1000), (1002, False, 1000), (1003, False, 9999), (1004, None, 300), (1005, False, None)]
    got = {r.id: r.target for r in R.fallback_chain(spark, spark.createDataFrame(rows, "id long, usable boolean, fallback long")).collect()}
    assert got == {i: 300 if i <= 300 else None for i, _, _ in rows}
    with pytest.raises(ValueError):
        R.fallback_chain(spark, spark.createDataFrame([(1, False, 2), (1, False, 3)], "id long, usable boolean, fallback long"))


def test_equal_areas_keep_the_first(spark):
    c = spark.createDataFrame([(1, 5, 5)], "sheet int, row long, col long")
    a = spark.createDataFrame([(1, 1, 1, 9, 9, k) for k in (7, 3, 8)], "sheet int, top long, left long, bottom long, right long, ord long")
    assert [r.merge_ord for r in G.merged_cells(c, a, ["sheet"]).collect()] == [3]


def test_inherited_values_are_not_broadcast(spark):
    """Values and results grow with the nodes: a broadcast of either ends on the driver's memory."""
    rows = [(i, "v" if i % 7 == 0 else None, [0, i // 2, i] if i > 1 else list(range(i + 1))) for i in range(40)]
    df = R.inherited(spark.createDataFrame(rows, "id long, rotation string, path array<long>"), "rotation")
    assert {r.id: r.rotation for r in df.collect()} == {i: "v" for i, _, _ in rows}
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
