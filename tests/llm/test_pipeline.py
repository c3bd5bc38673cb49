from test_decontamination import plain
from test_jaccard import expected as components_of
from test_lines import expected as lines_of

import corpus_pipeline
from insight_spark.llm import toxicity
from insight_spark.llm.common import table
from insight_spark.session import stored

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect()} if name == "toxicity" else {}
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            assert set(after) == {d for d, p in scores.items() if not p} and len(after) < len(before)
        elif name == "line dedup":
            want = lines_of([(r.doc_id, r.text, r.source) for r in before.values()], 10)
            assert {d: after[d].text for d in after} == {d: text for d, text, _, _ in want}
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
        elif name == "n-gram jaccard join":
            want = components_of([(r.doc_id, r.text) for r in before.values()], 5, 80)
            assert set(after) == {d for d, (_, c) in want.items() if c == d} and len(after) < len(before)
        else:
            items = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
            exact = {d for d, r in before.items() if any(x in plain(r.text) for x in items)}
            gone = set(before) - set(after)
            assert exact and exact <= gone and len(gone - exact) <= 2
        assert all(after[d] == before[d] for d in after) or name == "line dedup"
        kept = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, rows))


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_nulls_repeated_rows_and_clashing_names(spark):
    """Every name that the operators use inside as an extra column, null texts and ids, rows twice."""
    names = ["gone", "doc", "taken", "left", "bad", "leak", "deal", "open", "row", "rep", "v", "c", "item", "kind", "score", "predicted", "__gone", "__bad", "__leak", "__open"]
    docs = table(spark, SF, "documents").limit(60)
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (900_001, None), (900_002, ""), (900_003, " \n\t")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    docs = stored(docs.unionByName(docs.where("doc_id % 7 = 0")).select("*", *(toxicity.F.lit(k).alias(n) for k, n in enumerate(names))))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF))
        assert kept.columns == docs.columns
        assert kept.select(*names).distinct().collect() == [tuple(range(len(names)))]
        before, after = (sorted((str(r.doc_id), r.source or "") for r in x.collect()) for x in (docs, kept))
        assert not [x for x in after if after.count(x) != before.count(x)]  # rows of one id go or stay together
        assert {x[0] for x in after} >= {"None", "900001", "900002", "900003"}
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
