"""Hidden items are ranked range by range, by brute force and without rows of candidates or kept lines."""

import hashlib
import math
import random
from collections import Counter
from datetime import date

import pytest

from tillgrain import queries
from tillgrain.operators import holdout, recommender

DAY = date(2010, 6, 1)


def brute(rows, least, most):
    lines = {}
    for invoice, day, who, code in set(rows):
        lines.setdefault(invoice, []).append((day, code))
    train, test = {}, {}
    for invoice, own in lines.items():
        if invoice is not None and 2 <= len(own) <= most:
            train[invoice] = {c for d, c in own if d and d < DAY}
            test[invoice] = {c for d, c in own if d and d >= DAY}
    n = Counter(c for own in train.values() for c in own)
    n = {c: k for c, k in n.items() if k >= least}
    both = Counter((a, b) for own in train.values() for a in own & n.keys() for b in own & n.keys() if a != b)
    out = {}
    for invoice, own in test.items():
        known = sorted(own & n.keys(), key=lambda c: (hashlib.md5(f"{invoice}|{c}".encode()).hexdigest(), c))
        if len(known) >= 2:
            hidden, *shown = known
            score = {c: round(sum(both[i, c] / math.sqrt(n[i] * n[c]) for i in shown), 9) for c in n if c not in shown}
            out[invoice] = sum(x > score[hidden] for x in score.values()), sum(n[c] > n[hidden] for c in n if c not in shown)
    return out


@pytest.mark.parametrize(("pairs", "lines", "block", "at_once"), [(1 << 23, 1 << 18, 1 << 14, 1 << 21), (40, 16, 5, 7)])
def test_ranks_by_brute_force_in_any_ranges(spark, monkeypatch, pairs, lines, block, at_once):
    for name, value in (("PAIRS", pairs), ("LINES", lines), ("BLOCK", block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(holdout, name, value)
    rng = random.Random(7)
    rows = []
    for i in range(260):
        day = rng.choice([date(2010, 5, 1), date(2010, 5, 1), date(2010, 7, 1), None if i % 50 == 0 else date(2010, 4, 1)])
        for _ in range(rng.choice([1, 2, 3, 4, 8])):
            when = rng.choice([day, date(2010, 6, 1)]) if i % 20 == 0 else day
            rows += [(f"i{i}" if i % 70 else None, when, rng.choice([i, None]), f"c{int(rng.random() ** 2 * 30):02}")] * rng.choice([1, 2])
    basket = spark.createDataFrame(rows, "invoice string, invoice_date date, customer_id int, stock_code string")
    got = holdout.ranks(holdout.stored(holdout.gathered(basket, DAY, 7)), 3).collect()
    want = brute(rows, 3, 7)
    assert len(want) > 20 and any(a for a, _ in want.values()) and any(b for _, b in want.values())
    assert len(got) == len(want) and {r.invoice: (r.by_similarity, r.by_popularity) for r in got} == want


def test_no_known_item_gives_no_rows(spark):
    rows = [("a", date(2010, 7, 1), 1, "x"), ("a", date(2010, 7, 1), 1, "y")]
    basket = spark.createDataFrame(rows, "invoice string, invoice_date date, customer_id int, stock_code string")
    assert holdout.ranks(holdout.stored(holdout.gathered(basket, DAY, 9)), 1).collect() == []


def test_holdout_queries_keep_no_lines_and_pair_no_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "_WAREHOUSES", {})
    monkeypatch.setattr(queries, "_MORE", {})
    monkeypatch.setattr(recommender, "similarity", lambda *_: pytest.fail("all pairs are made as rows"))
    for name in ("holdout_ranks", "holdout_hit_rate"):
        queries.QUERIES[name](spark, folder).collect()
    assert not {"_narrow", "raw_lines", "stg_lines", "fact_sales"} & set(queries.warehouse(spark, folder).__dict__)
