"""Token counts kept as rollups: signed changes by source, language and tokenizer, in idempotent batches."""

from __future__ import annotations

import hashlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.llm.common import prepare, texts
from insight_spark.llm.tokens import byte_ids, word_ids
from insight_spark.session import shared_folder, stored

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, digest, tokenizer, tokens, revised for every row of docs and tokenizer.

    tokenizers: version name -> vocabulary file (.json: word ends, .tiktoken: byte level). digest is
    the md5 of the text; revised is the count after lines that repeat an earlier line of the text are
    left out. Null text is empty: no tokens. A null source or language stays null.
    """
    versions = sorted(tokenizers.items())

    def without_repeats(text: bytes) -> bytes:
        return b"\n".join(dict.fromkeys(text.split(b"\n")))

    def sizes(path: str, body: list[bytes]) -> list[int]:
        if path.endswith(".json"):
            return [len(ids) // 4 for ids in word_ids(path).encode(body)]
        encoder = byte_ids(path)
        return [len(encoder.encode_ordinary(t.decode("utf-8", "replace"))) for t in body]

    def run(batches):
        for batch in batches:
            body = batch.column(3).to_pylist()
            digest = pa.array([hashlib.md5(t).hexdigest() for t in body])
            shorter = [without_repeats(t) for t in body]
            changed = [k for k, (a, b) in enumerate(zip(body, shorter, strict=True)) if a != b]
            for name, path in versions:
                tokens = sizes(path, body)
                revised = list(tokens)
                for k, n in zip(changed, sizes(path, [shorter[k] for k in changed]), strict=True):
                    revised[k] = n
                columns = [*(batch.column(k) for k in range(3)), digest, pa.array([name] * len(body)), pa.array(tokens, pa.int64()), pa.array(revised, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "digest", "tokenizer", "tokens", "revised"])

    prepare(docs.sparkSession)
    labelled = texts(docs, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    schema = "doc_id long, source string, lang string, digest string, tokenizer string, tokens long, revised long"
    return labelled.mapInArrow(run, schema)


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).alias("docs"), F.col("tokens").alias("change"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("change"))


def revisions(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(0).alias("docs"), (F.col("revised") - F.col("tokens")).alias("change"))


class Rollup:
    """Additive totals by source, language and tokenizer version in one folder.

    commit adds a batch of signed changes under its id: it is summed by key first and becomes visible
    only as a whole, and a batch id that is there already is left as it is, so a repeated job changes
    nothing; a batch whose job died is written anew. totals sums what was committed. A batch of no changes counts
    as committed. Keys whose documents and tokens both sum to zero vanish; null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare(spark), path.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _done(self, path: str) -> bool:
        files, at = self._files(f"{path}/_SUCCESS")
        return files.exists(at)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        files, at = self._files(self.path)
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
        return sorted(unquote(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and self._done(f"{self.path}/{n}"))

    def _folder(self, batch: str) -> str:
        """A batch's folder; ids may hold any characters."""
        return f"{self.path}/batch={quote(batch, safe='')}"

    def _base(self) -> int | None:
        """The newest whole base, which holds the sum of batches that it names."""
        files, at = self._files(self.path)
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        whole = [int(n.removeprefix("base-")) for n in names if n.startswith("base-") and self._done(f"{self.path}/{n}/totals")]
        return max(whole, default=None)

    def compact(self) -> None:
        """Sum all committed batches into a base, so that totals reads it and later batches only. The base
        counts once it is whole; a job that died leaves the older one in place."""
        batches, base = self.batches(), self._base()
        path = f"{self.path}/base-{0 if base is None else base + 1}"
        summed = self._summed(batches, base)
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{path}/batches")
        summed.write.mode("overwrite").parquet(f"{path}/totals")

    def _summed(self, batches: list[str], base: int | None) -> DataFrame:
        held, paths = set(), []
        if base is not None:
            held = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/base-{base}/batches").collect()}
            paths.append(f"{self.path}/base-{base}/totals")
        paths += [self._folder(b) for b in batches if b not in held]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes (KEYS, docs, change) as this batch; False if it was there."""
        path = self._folder(batch)
        if self._done(path):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("change").cast("long").alias("n_tokens"))
        summed.select(*KEYS, "n_docs", "n_tokens").write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._summed(self.batches(), self._base()).where("n_docs <> 0 OR n_tokens <> 0")


def duplicates(rows: DataFrame) -> DataFrame:
    """Those counted rows whose text a smaller doc_id has."""
    first = rows.groupBy("digest", "tokenizer").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["digest", "tokenizer"]).where("doc_id > first")


def corpus_rollup(docs: DataFrame, tokenizers: dict[str, str], path: str | None = None) -> DataFrame:
    """Totals after three batches: every document is inserted, documents whose text a smaller doc_id has are
    deleted, and what is left is revised to its text without repeated lines. Each is committed twice, the
    second time without effect.

    source, lang, tokenizer, n_docs, n_tokens. A null text is empty and counts as a document of no tokens; of
    rows with one text those of the smallest doc_id stay, all of them if that repeats, and rows without
    doc_id always; null sources and languages are keys. Other columns are ignored; an empty table has no total."""
    spark = prepare(docs.sparkSession)
    rollup = Rollup(spark, path or shared_folder(spark, "token-counts"))
    rows = stored(counted(docs, tokenizers))
    gone = stored(duplicates(rows).drop("first", "n"))
    for _ in range(2):
        rollup.commit("load", inserts(rows))
        rollup.commit("copies", deletes(gone))
        rollup.commit("repeats", revisions(rows).unionByName(revisions(gone).withColumn("change", -F.col("change"))))
    return rollup.totals()
