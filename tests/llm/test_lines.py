from insight_spark.llm import lines


def expected(rows, min_sites):
    sites, first = {}, {}
    for d, t, s in rows:
        for x in (t.split("\n") if t is not None else []):
            k = x.strip(" \t\r")
            if k:
                sites.setdefault(k, set()).update({s} - {None})
                if d is not None:
                    first[k] = min(d, first.get(k, d))
    out = []
    for d, t, _ in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        own = t.split("\n")
        kept = [x for x in own if len(sites.get(x.strip(" \t\r"), ())) < min_sites or (d is not None and d <= first[x.strip(" \t\r")])]
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def test_lines_near_and_far_from_the_threshold(spark):
    rows = []
    for d in range(300):
        body = [f"own {d}", "", " everywhere\t"] + [f"seen by {n}" for n in range(1, 30) if d % 40 < n]
        rows.append((d + 5, "\n".join(body), f"site{d % 40}"))
    rows += [(1, None, "a"), (2, "", "b"), (3, "everywhere", None), (None, "everywhere\nx", "c"), (7, "own\neverywhere\neverywhere", "d")]
    rows += [(7, "own\neverywhere\neverywhere", "d")]
    docs = spark.createDataFrame([(*r, 9, "k", 1) for r in rows], "doc_id long, text string, source string, n_lines int, key string, first int")
    for threshold in (2, 10, 20):
        out = lines.remove_boilerplate(docs, threshold)
        assert out.columns == ["doc_id", "text", "source", "key", "first", "n_lines", "n_removed"]
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
        assert got == expected(rows, threshold)


def test_first_copy_stays_and_length_follows(spark):
    rows = [(d, "shared line\nand one", f"s{d}", 19) for d in range(12)] + [(50, "shared line\nother", "s1", 17)]
    out = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), 10)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[0] == ("shared line\nand one", 19) and got[5] == ("", 0) and got[50] == ("other", 5)


def test_empty_table(spark):
    assert lines.remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_very_long_text(spark):
    """A text of half a million lines, with a common line among them and one of a million characters."""
    own = "\n".join(["shared", *(f"own {k}" for k in range(500_000)), "x" * 1_000_000, "shared "])
    rows = [(100, own, "s0")] + [(d, f"shared\nline {d}", f"s{d}") for d in range(1, 13)]
    out = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10)
    got = {r.doc_id: r for r in out.collect()}
    assert (got[100].n_lines, got[100].n_removed) == (500_003, 2) and got[100].text == own[len("shared\n") : -len("\nshared ")]
    assert got[1].n_removed == 0 and got[2].text == "line 2"


def test_internal_names_as_columns(spark):
    """Columns that carry the names used inside pass through as they are."""
    names = ["doc", "taken", "left", "gone", "first", "key", "site", "sites", "line", "n", "__gone", "__doc", "__kept", "__at"]
    rows = [(d, f"shared\nline {d}", f"s{d}", *range(len(names))) for d in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = lines.remove_boilerplate(df, 10)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, *(r[n] for n in names)) for r in out.collect()) == [
        (d, f"shared\nline {d}" if d == 0 else f"line {d}", *range(len(names))) for d in range(12)
    ]
