import zlib
from collections import Counter, defaultdict

import pytest
from conftest import words

from tillgrain.llm import sharding
from tillgrain.llm.queries import op5


def held(rows, shards, slack=1.0):
    """Slots are gapless; sizes are near equal as far as the largest row or kept group allows; groups stay whole that fit."""
    slots, sizes, groups, group_bytes = defaultdict(list), Counter(), defaultdict(set), Counter()
    for r in rows:
        size = len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
        sizes[r.shard] += size
        groups[r.text or ""].add(r.shard)
        group_bytes[r.text or ""] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    for text, where in groups.items():
        assert len(where) == 1 or group_bytes[text] > mean
    largest = max((b for b in group_bytes.values() if b <= mean), default=0)
    assert all(abs(sizes[s] - mean) <= slack * (largest + mean / sharding.FINE) + 1 for s in range(shards))


def test_laws_hold_with_a_hot_group(spark, frame, rng):
    rows = [(i, words(rng, rng.randrange(1, 80)), "en", "s") for i in range(600)]
    rows += [(1000 + i, "hot text " * 30) for i in range(900)] + [(3000 + i, "warm text") for i in range(40)]
    got = sharding.assign(frame(rows, extra=True), 8)
    assert {"shard", "slot", "row", "piece", "k"} <= set(got.columns)
    out = got.collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    held(out, 8)


def test_splitters_are_quantiles_by_size(spark, frame, rng):
    rows = [(i, words(rng, rng.randrange(1, 80)), "en", "s") for i in range(3000)]
    text = sharding.F.col("text")
    keyed = frame(rows).select(sharding.F.col("doc_id").alias("k"), sharding.group_of(text).alias("g"), sharding.size_of(text).alias("size"))
    plan = sharding.make_plan(keyed, 6)
    groups = Counter()
    for r in keyed.collect():
        groups[r.g] += r["size"]
    at, total, order = 0, sum(groups.values()), sorted(groups)
    assert plan.splitters == sorted(set(plan.splitters)) and len(plan.splitters) == 6 * sharding.SPLITS - 1
    for i, cut in enumerate(plan.splitters, 1):  # all rows are drawn here, so the cuts are near the quantiles by size
        below = sum(groups[g] for g in order if g < cut)
        assert abs(below / total - i / (6 * sharding.SPLITS)) < 0.05
    assert plan.before == [sum(groups[g] for g in order if sum(c <= g for c in plan.splitters) < r) for r in range(len(plan.splitters) + 1)]


def test_clashing_outputs_lose(spark, frame):
    df = frame([(i, str(i)) for i in range(9)]).selectExpr("*", "'mine' AS shard", "'mine' AS Slot", "'mine' AS g")
    out = sharding.assign(df, 2)
    assert out.columns.count("shard") == 1 and dict(out.dtypes)["shard"] == "int" and {r.g for r in out.collect()} == {"mine"}


def test_odd_rows(spark, frame, odd):
    out = sharding.assign(frame(odd), 3).collect()
    assert len(out) == len(odd) and Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in odd)
    held(out, 3, slack=1e6)  # one row is larger than a shard
    assert sharding.assign(frame([]), 3).count() == 0
    assert sharding.assign(frame([(1, None)]), 24).count() == 1


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_key_and_text_are_divided(spark, frame, rng, monkeypatch, key):
    rows = [(i, words(rng, rng.randrange(1, 80)), "en", "s") for i in range(600)]
    rows += [(key, "same text " * 20, "en", "s")] * 700
    df = frame(rows, extra=True)
    most = []
    place = sharding.place

    def watched(keyed, plan):
        most.extend(r["count"] for r in sharding._with_piece(keyed, plan).where("piece IS NOT NULL").groupBy("g", "piece").count().collect())
        return place(keyed, plan)

    monkeypatch.setattr(sharding, "place", watched)
    out = sharding.assign(df, 6)
    assert out.columns == [*df.columns, "shard", "slot"]
    out = out.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    held(out, 6)
    assert max(most) < 700 / 6  # no task has them all


def test_write(spark, frame, tmp_path):
    sharding.write_shards(frame([(i, str(i)) for i in range(50)]), 4, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).select("shard").distinct().count() == 4


def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = op5.query(spark, folder).collect()
    assert len(out) == len(texts)
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)


@pytest.mark.parametrize("n", [0, 1, 2, 17, 400])
def test_range_lookup(spark, n, rng):
    splitters = sorted(rng.sample(range(-1000, 1000), n))
    df = spark.range(-1005, 1005).withColumn("r", sharding._range_of(splitters, sharding.F.col("id")))
    assert all(r.r == sum(s <= r.id for s in splitters) for r in df.collect())
