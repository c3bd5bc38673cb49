from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from insight_spark.llm import tokencounts, tokens
from insight_spark.llm.common import table

VERSIONS = {"words-49k": public_tokenizers.path("word_bpe_49k.json"), "bytes-50k": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def brute(rows):
    word, byte = Tokenizer.from_file(VERSIONS["words-49k"]), tokens.byte_ids(VERSIONS["bytes-50k"])
    count = {
        "words-49k": lambda t: len(word.encode(t, add_special_tokens=False).ids),
        "bytes-50k": lambda t: len(byte.encode_ordinary(t)),
    }
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = Counter()
    for d, t, source, lang in rows:
        t = t or ""
        if d is not None and first[t] < d:
            continue
        text = "\n".join(dict.fromkeys(t.split("\n")))
        for name, f in count.items():
            out[source, lang, name, "docs"] += 1
            out[source, lang, name, "tokens"] += f(text)
    return {k: v for k, v in out.items() if v}


def result(df):
    out = {}
    for r in df.collect():
        out[r.source, r.lang, r.tokenizer, "docs"] = r.n_docs
        out[r.source, r.lang, r.tokenizer, "tokens"] = r.n_tokens
    return {k: v for k, v in out.items() if v}


def test_totals_equal_a_recount(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    assert result(tokencounts.corpus_rollup(docs, VERSIONS)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None, "a", "en"), (2, "", None, None), (3, "x\ny\nx", "a", None), (4, "x\ny\nx", "b", "de"), (4, "x\ny\nx", "b", "de")]
    rows += [(None, "x\ny\nx", "a", "en"), (5, "word " * 40000, "a", "en"), (6, "<|endoftext|> A<|STARTOFTEXT|> é\x1cb", "a", "en")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, lang string, tokens int, tokenizer string")
    assert result(tokencounts.corpus_rollup(docs, VERSIONS)) == brute(rows)
    assert tokencounts.corpus_rollup(docs.limit(0), VERSIONS).count() == 0


def test_batches_commit_once(spark, folder):
    rollup = tokencounts.Rollup(spark, folder)
    change = spark.createDataFrame([("s", "en", "v", 1, 10), ("s", "en", "v", 1, 5)], "source string, lang string, tokenizer string, docs int, change long")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", change) and not rollup.commit("a", change.limit(1))
    assert rollup.totals().collect()[0][3:] == (2, 15)
    assert rollup.commit("b", change.limit(0)) and rollup.batches() == ["a", "b"]
    # a batch whose job died has no marker: it does not count, and is written anew
    change.write.parquet(f"{folder}/batch=c")
    files, at = rollup._files(f"{folder}/batch=c/_SUCCESS")
    files.delete(at, False)
    assert rollup.batches() == ["a", "b"] and rollup.totals().collect()[0][4] == 15
    minus = change.withColumns({"docs": -change.docs, "change": -change.change})
    assert rollup.commit("c", minus) and rollup.totals().count() == 0


@pytest.mark.parametrize("most", [600_000, 50])
def test_memoised_ids_equal_the_tokenizer(spark, most):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").limit(150).collect()]
    texts += ["", "don't STOP.\nIt's, e.g., a.b. c.\x85d", "İstanbul ΑΣ é a.,  b .", "<|endoftext|>x <|ENDOFTEXT|> <|", "q" * 5000, "x, y. z.\x0bw, \x1c, 1,"]
    own = Tokenizer.from_file(VERSIONS["words-49k"])
    encoder = tokens.ChunkIds(VERSIONS["words-49k"], most)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        got = [memoryview(x).cast("I").tolist() for x in encoder.encode([t.encode() for t in part])]
        assert got == [own.encode(t, add_special_tokens=False).ids for t in part]


def test_batch_ids_of_any_form_and_compaction(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "rollup"))
    change = lambda n, tokens: spark.createDataFrame([("s", None, "t", n, tokens)], "source string, lang string, tokenizer string, docs int, change long")
    assert rollup.commit("2024/01 a=b", change(1, 10)) and not rollup.commit("2024/01 a=b", change(1, 10))
    assert rollup.commit("x", change(2, -3)) and rollup.batches() == ["2024/01 a=b", "x"]
    want = [("s", None, "t", 3, 7)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == want and not rollup.commit("x", change(5, 5))
    assert rollup.commit("later", change(-3, -7)) and rollup.totals().count() == 0
    rollup.compact()
    rollup.compact()
    assert rollup.totals().count() == 0 and rollup.commit("last", change(1, 1))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", None, "t", 1, 1)]
