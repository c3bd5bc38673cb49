import math
import zlib

import numpy as np

from insight_spark.llm import toxicity
from insight_spark.llm.common import table


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    hit = sum(r.predicted == r.toxic == 1 for r in held)
    said, are = sum(r.predicted for r in held), sum(r.toxic for r in held)
    print(len(held), are, said, hit)
    # some of the labels belong to texts without any toxic word
    assert hit >= 0.8 * are and hit >= 0.95 * said


def test_held_out_labels_are_not_read(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    one, two = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, turned))
    assert one == two and len(one) == docs.count()


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"ab", b"an idiot\n", b"x" * 9, "\u00e9 A\tb".encode(), b"last"]
    owner, value = toxicity.present(texts)
    for k, text in enumerate(texts):
        alone = toxicity.present([text])[1]
        assert sorted(value[owner == k].tolist()) == sorted(alone.tolist())
    assert toxicity.present([])[0].size == 0 and toxicity.present([b""])[1].size == 0


def test_edge_cases(spark):
    rows = [(k, "you are an idiot scum" if k % 4 == 0 else f"a kind word {k}", k) for k in range(80)]
    rows += [(None, "idiot", 1), (200, None, 1), (201, "", 1), (202, "x" * 300000, 1), (4, rows[4][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)] + [(None, 1), (201, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in out if r.doc_id is not None and r.doc_id < 80)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 200, 201, 1, 2, 3}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def plain_features(text):
    """Runs of 4 to 7 characters of each line, as the operator's own hash names them, one after the other."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\x0b\x0c\r" else c for c in " " + text + " ")
    found = set()
    for line in text.split("\n"):
        for n in toxicity.LENGTHS:
            for k in range(len(line) - n + 1):
                value = 0
                for c in line[k : k + n]:
                    value = (value * int(toxicity.SPREAD) + ord(c)) % 2**64
                found.add(value * int(toxicity.FACTORS[n]) % 2**64 >> 64 - toxicity.BITS)
    return found


def test_features_are_characters():
    texts = ["", "Ab", "\u65e5\u672c\u8a9e\u3067\u3059 \U0001f600x", "two\nLINES\tof it", "\u00e9" * 9]
    owner, value = toxicity.present([t.encode() for t in texts])
    for k, text in enumerate(texts):
        assert set(value[owner == k].tolist()) == plain_features(text)


def test_ratios_fit_and_scores_by_brute_force(spark):
    """Counts, log-count ratios, chosen n-grams, the optimum of the loss, and scores, each computed anew."""
    rng = np.random.default_rng(4)
    words, rude = ["kind", "warm", "\u00e9t\u00e9", "house", "tree"], ["scum", "idiot", "\u5927\u99ac\u9e7f\u8005\u3081"]
    rows = []
    for k in range(90):
        said = list(rng.choice(words, 4)) + ([str(rng.choice(rude))] if k % 3 == 0 else [])
        rows.append((k, " ".join(rng.permutation(said))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(k, 1) for k in range(1000, 1100)], "doc_id long, toxic int")
    l2, most = 2e-3, 40
    model = toxicity.fit(docs, labels, most_rows=90, most_features=most, l2=l2)
    y = np.array([k % 3 == 0 for k in range(90)], float)
    sets = [plain_features(t) for _, t in rows]
    every = sorted(set().union(*sets))
    a = np.array([sum(f in s for s, t in zip(sets, y) if t) for f in every], float)
    b = np.array([sum(f in s for s, t in zip(sets, y) if not t) for f in every], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    share = (a + b) / (n1 + n0)
    z = np.abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    seen = [k for k in range(len(every)) if a[k] + b[k] >= 3]
    top = sorted(seen, key=lambda k: (-round(z[k], 9), every[k]))[:most]
    chosen = set(np.flatnonzero(model.weights).tolist())
    least = min(z[k] for k in top)
    assert chosen <= {every[k] for k in seen if z[k] >= least - 1e-9} and len(chosen) <= most
    assert {every[k] for k in top if z[k] > least + 1e-9} <= chosen | {every[k] for k in top if a[k] / n1 == b[k] / n0}
    # a minimum of the mean loss with l2 on weights in units of the ratios
    ratio = {every[k]: math.log((a[k] + 1) / (n1 + 2) / ((b[k] + 1) / (n0 + 2))) for k in range(len(every))}
    x = np.array([[ratio[f] if f in s else 0.0 for f in sorted(chosen)] for s in sets])
    w = np.array([model.weights[f] / ratio[f] for f in sorted(chosen)])
    score = 1 / (1 + np.exp(-(x @ w + model.bias)))
    gradient = x.T @ (score - y) / len(y) + l2 * w
    assert np.abs(gradient).max() < 2e-3 and abs((score - y).mean()) < 5e-3
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert np.allclose([got[k] for k in range(90)], score, atol=1e-9)


def test_labels_without_documents_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(k, "you idiot" if k % 4 == 0 else "all is well") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)] + [(k, 0) for k in range(1000, 9000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_rows=80)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in got)
