"""The band join against all pairs in plain Python."""

import heapq
import math
import random
import zlib

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, rest string"
ITEMS = "item_id long, price double, rest string"


def cents(x):
    return None if x is None or math.isnan(x) or abs(x) > 4e13 else math.floor(100 * x + 0.5)


def brute(items, lines, k=10):
    """{item: [(first k, n, gap sum, crc sum)]} by holding each item against each line."""
    points = []
    for sale, no, item, quantity, amount in (r[:5] for r in lines):
        a = cents(amount)
        if None not in (sale, item, quantity, a) and quantity:
            points.append(((2 * a + quantity) // (2 * quantity), sale, no, item, zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())))
    out = {}
    for item, price in (r[:2] for r in items):
        p, near = cents(price), []
        for u, sale, no, other, crc in points if p is not None else ():
            gap = abs(u - p)
            if other != item and (gap <= 50 or 1000 * gap <= 5 * min(u, p)):
                near.append(((gap, u, sale, -1 if no is None else no, other), crc))
        first = [x for x, _ in heapq.nsmallest(k, near)]
        out.setdefault(item, []).append((first, len(near), sum(x[0] for x, _ in near), sum(c for _, c in near)))
    return out


def joined(spark, items, lines, **options):
    from almanack.llm.band_join import near_prices

    got = near_prices(spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, LINES), **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.item_id is not None, r.item_id or 0, r.rank)):
        if r.rank <= 1:
            out.setdefault(r.item_id, []).append(([], r.n_pairs, r.gap_sum, r.lines_crc))
        if r.rank:
            first = out[r.item_id][-1][0]
            first.append((r.gap, r.u, r.sale_id, -1 if r.line_no is None else r.line_no, r.line_item_id))
            assert r.rank == len(first)
    return out


def test_against_all_pairs(spark, monkeypatch):
    from almanack.llm import band_join

    monkeypatch.setattr(band_join, "BLOCK", 16)
    monkeypatch.setattr(band_join, "CHUNK_ROWS", 700)
    rng = random.Random(1)
    price = lambda: round(rng.choice([rng.uniform(1, 9), rng.uniform(90, 110), rng.lognormvariate(5, 3)]), 2)
    items = [(i, price(), "x") for i in range(120)]
    lines = []
    for s in range(3000):
        item = 7 if rng.random() < 0.34 else rng.randrange(130)
        q = rng.randint(1, 9)
        base = items[item][1] if item < 120 else price()
        lines.append((s // 3, s % 3, item, q, round(base * q * rng.choice([1, 1, 0.97, 1.004]), 2), "y"))
    lines += lines[:40] * 3  # repeated lines count and take a rank each
    assert joined(spark, items, lines) == brute(items, lines)
    assert joined(spark, items, lines, k=3) == brute(items, lines, k=3)


def test_odd_rows(spark):
    """Nulls never pair; ties go by sale, line and item; an item alone, a null price and a price beyond reach are rank 0."""
    items = [(1, 10.0, None), (2, 10.0, ""), (3, None, ""), (4, 5e4, ""), (5, float("nan"), ""), (6, 1e300, ""), (7, 10.0, ""), (8, -10.0, ""), (9, 0.0, "")]
    lines = [(None, 1, 1, 1, 10.0, ""), (1, 1, None, 1, 10.0, ""), (1, 1, 1, None, 10.0, ""), (1, 1, 1, 1, None, ""), (1, 1, 1, 0, 10.0, ""), (1, 1, 1, 1, float("inf"), "")]
    lines += [(2, n, 1, 2, 20.0, "") for n in (3, None, 1)] + [(2, 1, 2, 1, 10.5, ""), (2, 1, 2, 1, 9.5, ""), (2, 1, 2, 1, 10.51, ""), (3, 1, 8, 3, -30.1, ""), (3, 1, 9, -3, 30.1, ""), (4, 1, 3, 7, 0.01, "")]
    want = brute(items, lines)
    assert joined(spark, items, lines) == want
    assert want[4][0][1] == want[3][0][1] == 0 and want[7][0][1] > 0


def test_empty_tables(spark):
    assert joined(spark, [], [(1, 1, 1, 1, 1.0, "")]) == {}
    assert joined(spark, [(1, 1.0, "")], []) == {1: [([], 0, 0, 0)]}
    assert joined(spark, [(1, 1.0, ""), (1, 1.0, "")], [(1, 1, 2, 1, 1.0, "")]) == brute([(1, 1.0), (1, 1.0)], [(1, 1, 2, 1, 1.0)])


def test_zone_maps_find_every_overlap_once(spark):
    from almanack.llm.band_join import overlapping

    rng = random.Random(4)

    def side(n):
        out, at = [], -500
        for _ in range(n):
            lo = at + rng.randint(1, 40)
            hi = lo + rng.choice([0, 3, 50, 4000])
            out.append((lo, (hi - lo).bit_length(), lo, hi))
            at = hi
        return out

    left, right = side(60), [(lo, (hi + 30 - lo).bit_length(), lo - 15, hi + 15) for lo, _, _, hi in side(80)]
    schema = "lo long, level int, reach_lo long, reach_hi long"
    got = [tuple(r) for r in overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()]
    want = {(a[0], b[0]) for a in left for b in right if a[2] <= b[3] and b[2] <= a[3]}
    assert len(got) == len(set(got)) and set(got) == want
