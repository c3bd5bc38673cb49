import numpy as np
import pytest

from insight_spark.llm import decontamination as dec
from insight_spark.llm import pigeonhole as exact_search
from insight_spark.llm.common import table


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern):
        new = [k + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(text):
    return " ".join("".join(c.lower() if c.isascii() else c for c in text).split())


def disturbed(rng, text, share):
    out = list(text)
    for _ in range(int(len(text) * share)):
        at = int(rng.integers(0, len(out)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            out[at] = "q"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "q")
    return "".join(out)


def test_best_fit_equals_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = ("".join(rng.choice(list("abé "), int(rng.integers(1, 25)))) for _ in range(2))
        best, end = exact_search.best_fit_of(a, b)
        assert best == distance(a, b)
        assert best == min([len(a)] + [distance_whole(a, b[s:end]) for s in range(end + 1)])


def distance_whole(a, b):
    row = list(range(len(b) + 1))
    for k, p in enumerate(a):
        new = [k + 1]
        for j, c in enumerate(b):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_exact_passages_of_the_whole_table(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r for r in dec.leaks(docs, items).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    item = {r.item_id: r.text for r in items.collect()}
    exact = {(d, i) for d, t in text.items() for i, x in item.items() if plain(x) in plain(t)}
    assert exact and exact <= set(got)
    for (d, i), r in got.items():
        piece = plain(text[d][r.start : r.end])
        assert distance_whole(plain(item[i]), piece) == r.edits <= len(plain(item[i])) // 10


def test_recall_of_disturbed_copies_and_clean_texts(spark):
    rng = np.random.default_rng(3)
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    clean = [t for (t,) in table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(60).collect()]
    rows, planted = [], set()
    for k, (i, t) in enumerate(items):
        base = clean[k % 60]
        at = int(rng.integers(0, len(base)))
        copy = disturbed(rng, t, (0.0, 0.04, 0.08)[k % 3]).replace(" ", "\n\t" if k % 5 == 0 else " ")
        rows.append((k, base[:at] + " " + "".join(c.upper() if c.isascii() else c for c in copy) + " " + base[at:]))
        planted.add((k, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dec.leaks(docs, table(spark, "/root/testdata/sf0.001", "benchmark")).collect()}
    exact = {p for k, p in enumerate(sorted(planted)) if k % 3 == 0}
    assert exact <= found
    assert len(planted & found) >= 0.95 * len(planted)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    whole = sorted(map(tuple, exact_search.exact_leaks(docs, items).collect()))
    monkeypatch.setattr(exact_search, "BLOCK_BYTES", 8000)
    assert sorted(map(tuple, exact_search.exact_leaks(docs, items).collect())) == whole
    # undisturbed and lightly disturbed passages are all found by the walks, at the same places
    assert sorted(map(tuple, dec.leaks(docs, items).collect())) == whole


def test_edge_cases(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    items = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, "short", 0), (4, None, 0), (None, item + " again and again", 0)], "item_id long, text string, doc_id int")
    rows = [(1, item), (2, "é  " + item.upper() + " tail"), (3, None), (4, ""), (5, "short"), (6, item[:30]), (None, item), (7, item + " " + item), (8, "x " * 40000 + item)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id, r.edits, r.start, r.end) for r in dec.leaks(docs, items).collect()}
    n = len(item)
    want = [(1, 0, 0), (2, 0, 3), (None, 0, 0), (7, 0, 0), (8, 0, 80000)]
    assert got == {(d, i, e, s, s + n) for d, e, s in want for i in (1, 2)} | {(5, 3, 0, 0, 5)}
    kept = dec.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 6, None]
    assert dec.leaks(docs.limit(0), items).count() == 0
    assert dec.leaks(docs, items.limit(0)).count() == 0


def spread(rng, text, edits, kind):
    """As many edits as given, the same distance apart: substitutions, deletions, insertions or all in turn."""
    out, step = list(text), len(text) / max(1, edits)
    for k in reversed(range(edits)):
        at = min(len(text) - 1, int((k + rng.random() * 0.2 + 0.4) * step))
        what = kind if kind < 3 else k % 3
        if what == 0:
            out[at] = "#"
        elif what == 1:
            del out[at]
        else:
            out.insert(at, "#")
    return "".join(out)


def test_every_copy_at_the_bound_is_found_like_brute_force(spark):
    rng = np.random.default_rng(11)
    source = [plain(r.text) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    items, rows = [], []
    for size in (36, 48, 64, 81, 120, 200, 300):
        for kind in range(4):
            for _ in range(3):
                text = next(t for t in (source[int(rng.integers(len(source)))] for _ in range(500)) if len(t) >= size)[:size].strip()
                items.append((len(items), text))
                for over in (0, 1):
                    copy = spread(rng, text, len(text) // 10 + over, kind)
                    rows.append((len(rows), source[len(rows) % 90][:60] + copy + source[len(rows) % 70][:60]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in exact_search.exact_leaks(docs, bench).collect()}
    least = {(d, i): exact_search.best_fit_of(t, plain(x))[0] for d, x in rows for i, t in items}
    want = {p: e for p, e in least.items() if e <= len(items[p[1]][1]) // 10}
    assert got == want
    # a deletion between two spaces is one edit more once they are one space
    assert sum((2 * i, i) in want for i, _ in items) > 0.9 * len(items)


def test_copies_without_white_space(spark):
    rng = np.random.default_rng(5)
    han = ["".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 900, n)) for n in (33, 60, 150)]
    code = ["".join(rng.choice(list("abcdefghijklmnop_"), n)) for n in (40, 90)]
    thai = ["".join(chr(0x0E01 + int(x)) for x in rng.integers(0, 46, 70))]
    items = list(enumerate(han + code + thai))
    around = "".join(chr(0x5E00 + int(x)) for x in rng.integers(0, 900, 500))
    rows = []
    for i, t in items:
        rows.append((2 * i, around[:200] + t + around[200:]))
        rows.append((2 * i + 1, "x" * 50 + disturbed(rng, t, 0.1) + "y" * 50))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for search in (exact_search.exact_leaks, dec.leaks):
        got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in search(docs, bench).collect()}
        assert set(got) == {(2 * i + k, i) for i, _ in items for k in (0, 1)}
        assert all(got[2 * i, i] == (0, 200, 200 + len(t)) for i, t in items)


def test_short_items_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    source = [plain(r.text) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    sizes = [1, 3, 5, 6, 7, 9, 10, 12, 16, 19, 20, 25, 30, 35, 40]
    items = [(k, source[k % 40][:n].strip()) for k, n in enumerate(sizes)] + [(90, "ñandúé"), (91, "  日本語  "), (92, " ")]
    rows = []
    for k, (i, t) in enumerate(items):
        rows += [(3 * k, source[39 - k] + t + "zz"), (3 * k + 1, "zz" + spread(rng, t, len(t) // 10, k % 4) + "zz"), (3 * k + 2, "zz" + spread(rng, t, len(t) // 10 + 1, k % 4) + "zz")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for least in (1, 6):
        got = {(r.doc_id, r.item_id): r.edits for r in exact_search.exact_leaks(docs, bench, min_chars=least).collect()}
        want = {(d, i): e for d, x in rows for i, t in items if len(plain(t)) >= least and (e := distance(plain(t), plain(x))) <= len(plain(t)) // 10}
        assert got == want
    assert (3 * 3, 3) in got and (3 * 15, 90) in got
    assert {(r.doc_id, r.item_id) for r in exact_search.exact_leaks(docs, bench).collect()} == set(want)
    for least in (1, 6):
        got = {(r.doc_id, r.item_id): r.edits for r in dec.leaks(docs, bench, min_chars=least).collect()}
        want = {(r.doc_id, r.item_id): r.edits for r in exact_search.exact_leaks(docs, bench, min_chars=least).collect()}
        sure = {p for p in want if len(plain(dict(items)[p[1]])) < 10 or want[p] == 0}
        assert sure <= set(got) and got.items() <= want.items() and len(got) >= 0.95 * len(want)


BOUNDS = {"short": (10, 24), "medium": (24, 64), "long": (64, 120), "longer": (130, 400)}


@pytest.mark.parametrize("band", BOUNDS)
def test_recall_by_length_at_the_full_bound(spark, band):
    """Copies with as many evenly spread edits as are allowed, of every kind, held against the exact search."""
    rng, (low, high) = np.random.default_rng(low_of(band)), BOUNDS[band]
    source = plain(" ".join(r.text for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()))
    items, rows = [], []
    for k in range(120):
        size, at = int(rng.integers(low, high)), int(rng.integers(0, len(source) - 500))
        text = source[at : at + size].strip()
        items.append((k, text))
        rows.append((k, source[at - 300 : at - 280] + spread(rng, text, len(text) // 10, k % 4) + source[at + 600 : at + 640]))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id): r.edits for r in exact_search.exact_leaks(docs, bench).collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in dec.leaks(docs, bench, recall=0.95).collect()}
    assert len(want) > 90 and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want), (len(got), len(want))
    assert sum(got[p] == want[p] for p in got) >= 0.98 * len(got)


def low_of(band):
    return BOUNDS[band][0]


def test_tables_follow_from_recall_and_share_of_edits():
    band = dec.BANDS[2]
    assert dec.tables_for(band, 0, 0.95) == 1
    assert dec.tables_for(band, 10, 0.5) <= dec.tables_for(band, 10, 0.98) <= dec.tables_for(band, 16, 0.98)


def test_documents_are_read_once_for_all_items(spark):
    """Many items in one search: each document's windows are made once, whatever the number of items."""
    source = plain(" ".join(r.text for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()))
    items = [(k, source[k * 9 : k * 9 + 14]) for k in range(3000)]
    docs = spark.createDataFrame([(k, f"new {k} " + source[k * 90 : k * 90 + 50]) for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(docs, bench).collect()}
    want = {(r.doc_id, r.item_id) for r in exact_search.exact_leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {(d, 10 * d + k) for d in range(60) for k in range(5)} - {p for p in got if p in want} == set()


def test_repeated_and_very_long_items(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK_BYTES", 500)
    text, other = "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs"
    long = " ".join(f"word{k}" for k in range(400))
    items = [(1, text)] * 100 + [(2, other), (3, long), (4, other.upper()), (None, text)]
    docs = spark.createDataFrame([(1, "so " + text), (2, other), (3, long), (4, "none")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for search in (exact_search.exact_leaks, dec.leaks):
        got = sorted(((r.doc_id, r.item_id) for r in search(docs, bench).collect()), key=str)
        assert got == sorted([(1, 1)] * 100 + [(1, None), (2, 2), (2, 4), (3, 3)], key=str)
    kept = dec.without_leaks(docs, bench)
    assert [r.doc_id for r in kept.collect()] == [4]
