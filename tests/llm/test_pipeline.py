"""The pipeline's stages against brute force over a small table."""

from collections import Counter

import corpus_pipeline
from cases import documents, rows
from test_documents import check_packing, components

from kerbline.llm import lang_id, mixing
from kerbline.llm.shared import stored


def test_each_stage_works_on_what_the_one_before_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mixture", "sequences"]
    stages = dict(corpus_pipeline.STAGES)
    first = stored(stages["language"](spark, docs, small), "test-language")
    model = lang_id.fit(docs)
    assert Counter(r.doc_id for r in first.collect()) == Counter(r.doc_id for r in docs.collect() if not model.predict(r.text)[3])
    second = stored(stages["near_duplicates"](spark, first, small), "test-near")
    want = components([(r.doc_id, r.text) for r in first.collect()], 5)
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, c in want.items() if i == c)
    third = stored(stages["mixture"](spark, second, small), "test-mix")
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(second).collect() if r.size}
    assert Counter(r.doc_id for r in third.collect()) == Counter({i: n for i, n in taken.items() if n})
    for df in (first, second, third):
        assert sorted(df.columns) == sorted(docs.columns)
    once = third.dropDuplicates(["doc_id"])
    assert check_packing(stages["sequences"](spark, once, small).collect(), {r.doc_id: r.text for r in once.collect()}) < 0.01
    assert corpus_pipeline.run(spark, small).count() > 0


def test_stages_bear_odd_rows_and_empty_tables(spark, small):
    odd = documents(spark, rows())
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stored(stage(spark, docs, small), f"test-odd-{name}")
            assert kept.columns == docs.columns
            assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
            docs = kept
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert packed.count() >= docs.count()
    assert packed.count() == 0
    # Rows with a null id stay, whether they are copies or not; null and empty texts have no set and stay too.
    near = stored(corpus_pipeline.near_duplicates(spark, odd, small), "test-odd-near")
    assert Counter(r.doc_id for r in near.collect())[None] == 2 and {5, 6, 7} <= {r.doc_id for r in near.collect()}
    # What has no words is taken no words.
    assert not {5, 6, 7} & {r.doc_id for r in corpus_pipeline.mixture(spark, odd, small).collect()}
