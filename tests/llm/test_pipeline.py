import corpus_pipeline as p
import pytest

from tillgrain.llm import decontaminate, jaccard, toxicity
from tillgrain.llm.session import stored, table


@pytest.fixture(scope="module")
def staged(spark, folder):
    docs, out = table(spark, folder, "documents"), []
    for name, stage in p.STAGES:
        after = stored(stage(spark, docs, folder))
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_documents(staged):
    names = [n for n, _, _ in staged]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    for _, before, after in staged[:-1]:
        assert after.columns == staged[0][1].columns
    assert staged[-1][2].columns == [*staged[0][1].columns, "shard", "slot"]


def test_toxic_documents_go_and_others_stay(spark, folder, staged):
    _, before, after = staged[0]
    net = toxicity.train(before, table(spark, folder, "labels"))
    flagged = {r.doc_id for r in toxicity.score(before, net).where("flagged").collect()}
    assert flagged and ids(after) == sorted(set(ids(before)) - flagged)


def test_one_of_each_group_stays(spark, staged):
    _, before, after = staged[1]
    groups = jaccard.join(before, n=5, num=80).where("n_shingles = 0 OR doc = component")
    assert ids(after) == sorted(r.doc for r in groups.collect()) and after.count() < before.count()


def test_benchmark_goes(spark, folder, staged):
    _, before, after = staged[2]
    bad = {r.doc_id for r in decontaminate.contaminated(before, table(spark, folder, "benchmark")).collect()}
    assert bad and ids(after) == sorted(set(ids(before)) - bad)


def test_mix_and_shards(staged):
    _, before, after = staged[3]
    words = [sum(len(r.text.split()) for r in df.collect()) for df in (before, after)]
    assert abs(words[1] / words[0] - 1.5) < 0.02
    _, before, after = staged[4]
    assert ids(before) == ids(after) and after.select("shard").distinct().count() == p.SHARDS


def test_run(spark, folder):
    assert p.ORACLE_SQL is None and p.run(spark, folder).count() > 0
