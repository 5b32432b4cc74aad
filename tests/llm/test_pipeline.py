import os
import random

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.session import materialize, release, scratch
from tests.llm.helpers import ODD, frame, prose, rows, words


def test_stages_are_five_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "substring_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_by_brute_force(spark, tmp_path):
    rng = random.Random(1)
    passage = prose(rng, "de", 70)
    texts = [prose(rng, "en", rng.randint(60, 200)) for _ in range(60)]
    texts += [texts[i] for i in range(6)] + [texts[7] + " more", None, ""]
    texts += [prose(rng, "en", 60) + " " + passage + " " + prose(rng, "en", 60) for _ in range(3)]
    toxic = [prose(rng, "en", 40) + " vilescum rotfilth vilescum" for _ in range(20)]
    data = rows(texts + toxic, None, [f"s{i % 4}" for i in range(len(texts) + len(toxic))])
    frame(spark, data).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    n, m = len(texts), len(texts) + len(toxic)
    spark.createDataFrame([(i, 1, int(i >= n)) for i in range(0, m, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(sf + "/documents.parquet")
    # stage by stage against plain Python
    s1 = corpus_pipeline.toxicity(spark, docs, sf)
    model = toxicity.fit(docs, spark.read.parquet(sf + "/labels.parquet"))
    scorer = toxicity.Scorer(model)
    kept = {i for i, t in enumerate(texts + toxic) if scorer.score(t) < 0.5}
    assert {r.doc_id for r in s1.collect()} == kept and set(range(n)) - kept == set() and not kept & set(range(n, m))
    assert s1.columns == docs.columns
    s2 = corpus_pipeline.minhash_dedup(spark, s1, sf)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(texts[i])) else set() for i in range(n)}
    gone = {j for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {r.doc_id for r in s2.collect()} == set(range(n)) - gone and s2.columns == docs.columns
    s3 = corpus_pipeline.substring_dedup(spark, s2, sf)
    got = {r.doc_id: r.text for r in s3.collect()}
    for k in range(n - 3, n):
        has = passage in got[k]
        assert has == (k == n - 3)
    assert all(got[i] == texts[i] for i in got if i < n - 3) and s3.columns == docs.columns
    s4 = corpus_pipeline.mixing(spark, s3, sf)
    assert {r.doc_id for r in s4.collect()} <= set(got) and s4.columns == docs.columns
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in s4.collect()}
    total = {}
    for r in last:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 1024


def test_stages_on_odd_repeated_and_empty_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names and an empty table, through every stage one after another."""
    rng = random.Random(2)
    long_ = prose(rng, "en", 120)
    texts = [*ODD, long_, prose(rng, "en", 80)]
    data = [*rows(texts), *rows([*ODD[:4], "another text of the same id"]), (len(ODD) + 1, long_ + " tail", None, "s", 1, "x", "y", "z", 1), (None, long_, None, None, 1, "x", "y", "z", 1), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (frame(spark, data), frame(spark, data).limit(0)):
        n, columns = docs.count(), docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert (len(last) > 0) == (n > 0)
    # one row for each repeated id after the near-dedup, the longest
    kept = corpus_pipeline.minhash_dedup(spark, frame(spark, data), str(tmp_path)).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and next(r.text for r in kept if r.doc_id == 4) == "another text of the same id"
    assert sum(r.doc_id is None for r in kept) == 2


def test_stage_files_are_deleted(spark):
    with scratch(spark):
        gone = materialize(spark.range(3))
        stays = materialize(spark.range(4), outlives=True)
    assert stays.count() == 4 and not os.path.exists(gone._siltstone_path)
    release(stays)
    assert not os.path.exists(stays._siltstone_path)
    release(spark.range(1))
