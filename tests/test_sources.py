import io
import os
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight_spark.functions import fixed
from insight_spark.plans import catalog
from insight_spark.sources import csv, files

CSV = (
    "a,b,c,d,a,A,,flag,n,big\n"
    "1, NA,True,x,,1,p,TRUE,1e3,99999999999999999999\n"
    '2,NA,false,"",3,2,q,false,.5,3\n'
    "\n"
    ' 3 ,5,TRUE,None,4,3,"r, ""s""",,inf,4\n'
)


def write(path, name, data):
    os.makedirs(path, exist_ok=True)
    target = os.path.join(path, name)
    with open(target, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return target


def test_csv_types_and_values(spark, folder):
    spark.conf.set("spark.sql.caseSensitive", "true")  # the header has both "a" and "A"
    try:
        check_types_and_values(spark, folder)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def check_types_and_values(spark, folder):
    frame = csv.read_csv(spark, write(folder, "x.csv", CSV))
    want = pd.read_csv(io.StringIO(CSV))
    assert frame.columns == list(want.columns)
    types = dict(frame.dtypes)
    assert types == {
        "a": "bigint", "b": "string", "c": "boolean", "d": "string", "a.1": "bigint",
        "A": "bigint", "Unnamed: 6": "string", "flag": "boolean", "n": "double", "big": "double",
    }
    rows = frame.orderBy(F.col("`a`")).collect()
    assert [r["a"] for r in rows] == [1, 2, 3]
    assert [r["b"] for r in rows] == [" NA", None, "5"]
    assert [r["c"] for r in rows] == [True, False, True]
    assert [r["d"] for r in rows] == ["x", None, None]
    assert [r["a.1"] for r in rows] == [None, 3, 4]
    assert [r["Unnamed: 6"] for r in rows] == ["p", "q", 'r, "s"']
    assert [r["flag"] for r in rows] == [True, False, None]
    assert [r["n"] for r in rows] == [1000.0, 0.5, float("inf")]


def test_header_names():
    raw = ["a", "a", None, "a.1", "", "a"]
    want = list(pd.read_csv(io.StringIO("a,a,,a.1,,a\n1,2,3,4,5,6\n")).columns)
    assert csv.header_names(raw) == want


@pytest.mark.parametrize("token", fixed.NULL_TOKENS)
def test_every_null_token(spark, folder, token):
    path = write(folder, "x.csv", f"k,v\n1,{token}\n2,7\n")
    strings, names = csv.read_strings(spark, path, multi_line=False)
    assert names == ["k", "v"] and [r._1 for r in strings.orderBy("_0").collect()] == [None, "7"]


def test_quoted_line_breaks(spark, folder):
    path = write(folder, "x.csv", 'k,v\n1,"two\nlines"\n2,plain\n')
    assert csv.has_multiline_fields(spark, path)
    assert [r.v for r in csv.read_csv(spark, path).orderBy("k").collect()] == ["two\nlines", "plain"]
    flat = write(folder + "2", "x.csv", 'k,v\n1,"say ""hi"""\n')
    assert not csv.has_multiline_fields(spark, flat)
    assert csv.read_csv(spark, flat).first().v == 'say "hi"'


def test_empty_column_and_header_only(spark, folder):
    frame = csv.read_csv(spark, write(folder, "x.csv", "a,b\n1,\n2,NA\n"))
    assert dict(frame.dtypes) == {"a": "bigint", "b": "double"}
    bare = csv.read_csv(spark, write(folder + "2", "y.csv", "a,b\n"))
    assert bare.columns == ["a", "b"] and bare.count() == 0


def test_folder_of_files(spark, folder):
    for i in range(3):
        write(folder, f"{i}.csv", f"a,b\n{i},x{i}\n")
    assert sorted(r.b for r in csv.read_csv(spark, folder).collect()) == ["x0", "x1", "x2"]


def test_csv_round_trip(spark, folder):
    rows = [(1, 2.5, " padded ", True), (2, None, 'quote " and, comma', False), (3, 1e20, "two\nlines", None)]
    frame = spark.createDataFrame(rows, "k bigint, v double, t string, f boolean")
    csv.write_csv(frame, folder)
    back = csv.read_csv(spark, folder)
    assert dict(back.dtypes) == dict(frame.dtypes)
    assert [tuple(r) for r in back.orderBy("k").collect()] == rows
    with open(next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".csv"))) as f:
        assert f.readline() == "k,v,t,f\n"


def test_text_files(spark, folder):
    write(folder, "a.txt", b"one\xff\r\ntwo\n")
    write(folder, "b.txt", b"\n")
    texts = files.read_text(spark, folder).withColumn("doc_id", F.substring_index("path", "/", -1))
    assert {r.doc_id: r.text for r in texts.collect()} == {"a.txt": "one\r\ntwo\n", "b.txt": "\n"}
    lines = files.text_lines(texts).collect()
    assert sorted((r.doc_id, r.line_no, r.text) for r in lines) == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("b.txt", 0, "")]


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = zlib.compress(b"".join(b"\0" + b"\0" * 3 * width for _ in range(height)))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def riff(kind, data):
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBP" + kind + struct.pack("<I", len(data)) + data


WEBPS = {
    "lossy": riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480)),
    "lossless": riff(b"VP8L", b"\x2f" + struct.pack("<I", (300 - 1) | ((200 - 1) << 14))),
    "extended": riff(b"VP8X", b"\0\0\0\0" + (1000 - 1).to_bytes(3, "little") + (70_000 - 1).to_bytes(3, "little")),
}


def test_images(spark, folder):
    write(folder, "a.png", png(3, 2))
    for name, data in WEBPS.items():
        write(folder, f"{name}.webp", data)
    write(folder, "broken.png", b"nothing")
    got = {r.path.rsplit("/", 1)[1]: (r.image_width, r.image_height) for r in files.read_image_metadata(spark, folder).collect()}
    assert got == {
        "a.png": (3, 2), "lossy.webp": (640, 480), "lossless.webp": (300, 200), "extended.webp": (1000, 70_000),
        "broken.png": (None, None),
    }


def test_built_in_image_source_agrees(spark, folder):
    path = write(folder, "a.png", png(5, 4))
    row = spark.read.format("image").load(path).select("image.width", "image.height").first()
    assert tuple(row) == (5, 4)


def test_jpeg_goes_through_the_decoder(spark, folder):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(7, 6, 1)
    os.makedirs(folder)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(os.path.join(folder, "p.JPG")))
    row = files.read_image_metadata(spark, folder).first()
    assert (row.image_width, row.image_height) == (7, 6)


def test_inventory(spark, folder, plan):
    for name in ("a.CSV", "b.txt", "c.webp", "noext", ".csv", "d.tar.gz"):
        write(folder, name, "x" * 10)
    listed = files.list_files(spark, folder)
    assert "content" not in plan(listed)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.file_inventory(listed).collect()}
    assert {k: r.mode for k, r in rows.items() if not k.startswith(".")} == {
        "a.CSV": "structured", "b.txt": "text", "c.webp": "image", "noext": None, "d.tar.gz": None
    }
    assert rows["noext"].reason == "Unsupported file type." and rows["noext"].suffix == ""


def test_size_guard(spark):
    frame = spark.createDataFrame([("a.csv", 200 * 1024 * 1024), ("b.csv", 1234 * 1024 * 1024)], "path string, length bigint")
    small, big = files.file_inventory(frame).orderBy("path").collect()
    assert small.size_ok and small.reason == ""
    assert not big.size_ok and big.reason == "File is 1234.0MB. Max allowed size is 200MB."


def test_text_export(spark, folder):
    frame = spark.createDataFrame([("line one",), ("line two",)], "report string")
    files.write_text(frame, folder)
    assert sorted(r.value for r in spark.read.text(folder).collect()) == ["line one", "line two"]


def test_headers_are_matched_by_name(spark, folder):
    write(folder, "1.csv", "a,b\n1,2\n")
    write(folder, "2 x.csv", "b,a\n10,20\n")
    assert sorted((r.a, r.b) for r in csv.read_csv(spark, folder).collect()) == [(1, 2), (20, 10)]
    write(folder, "3.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="different columns"):
        csv.read_csv(spark, folder)


def test_surplus_cells_are_loud(spark, folder):
    path = write(folder, "x.csv", "a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception, match="more than the 2 cells"):
        csv.read_csv(spark, path, ["bigint", "bigint"]).collect()
    marked, names = csv.read_strings(spark, path, surplus="mark")
    assert names == ["a", "b", "__surplus"]
    assert sorted(map(tuple, marked.collect())) == [("1", "2", False), ("3", "4", True), ("6", None, False)]


def test_a_stray_quote_does_not_unsplit(spark, folder):
    path = write(folder, "x.csv", 'k,v\n1,5" pipe\n2,"a ""b"" c"\n')
    assert not csv.has_multiline_fields(spark, path)
    assert [r.v for r in csv.read_csv(spark, path).orderBy("k").collect()] == ['5" pipe', 'a "b" c']


def test_one_column_round_trip(spark, folder):
    frame = spark.createDataFrame([(" x ",), ("",), (None,), ("007 b",)], "t string")
    csv.write_csv(frame, folder)
    assert sorted(map(str, (r.t for r in csv.read_csv(spark, folder).collect()))) == [" x ", "007 b", "None", "None"]


def test_jpeg_markers_and_unreadable_images(spark, folder):
    body = b"\xff\xd8\xff\xe1" + struct.pack(">H", 10) + b"x" * 8 + b"\xff\xff\xfe" + struct.pack(">H", 4) + b"yy"
    body += b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 400)
    write(folder, "a.jpg", body)
    write(folder, "cut.jpeg", body[:20])
    write(folder, "no.png", b"text")
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in files.read_image_metadata(spark, folder).collect()}
    lost = (None, None, "Image header cannot be read.")
    assert got == {"a.jpg": (400, 300, ""), "cut.jpeg": lost, "no.png": lost}


def test_image_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One input task; a repeated number gives a file, and so a row, each time."""
    monkeypatch.setattr(catalog, "shared_folder", lambda *_: str(tmp_path / "images"))
    rows = [(n // 2 if n < 10 else n - 60, [0.5] * (n % 7 + 1), n % 5) for n in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.image_metadata(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((k, len(v), label + 1) for k, v, label in rows)
    files = list((tmp_path / "images").rglob("*.txt"))
    assert len(files) == 100 and len({f.name[:10] for f in files}) > 20
    # a job lists no more folders by itself than there are shares
    assert len(list((tmp_path / "images").glob("*/"))) <= catalog.IMAGE_SHARES
