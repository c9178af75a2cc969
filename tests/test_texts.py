"""Roots of paths and captions without dates, on cases that the tables don't hold."""

import os.path

from pyspark.sql import functions as F

from medialake.functions import paths as P
from medialake.functions import text as T


def root(paths):
    paths = [p.replace("\\", "/") for p in paths if p]
    if not paths:
        return ""
    prefix = os.path.commonprefix(paths)
    return prefix.rsplit("/", 1)[0] if len(paths) == 1 or "/" in prefix else ""


def test_common_root(spark):
    groups = [["/mnt/photo/a/b.jpg"], ["/mnt/photo/a/b.jpg"] * 2, ["/mnt/photo/Fotos/x", "/mnt/photo/Fun/y"], ["/a/b", "/a/b/c"], ["a/b", "ab/c"], ["x.jpg"], ["x.jpg", "x.jpg"], ["D:\\Fotos\\a.jpg", "D:/Fotos/b.jpg"], [None, ""], [None, "/p/q/r"], ["/a", "/b"], ["/a/x/1", "/a/y/1", "/a/x/2"]]
    rows = spark.createDataFrame([(i, p) for i, g in enumerate(groups) for p in g], "g int, path string")
    got = {r.g: r.root for r in rows.groupBy("g").agg(P.common_root(F.col("path")).alias("root")).collect()}
    assert got == {i: root(g) for i, g in enumerate(groups)}


def test_captions_without_dates(spark):
    cases = [
        ("WM 2014 Trikot", "2018-06-01", "WM 2014 Trikot"), ("WM 2014 Trikot", "2014-06-01", "WM Trikot"), ("Ein Hund, aufgenommen im Juni 2008", None, "Ein Hund"),
        ("Am See, aufgenommen am 12. März 2010, mit Anna.", "2010", "Am See, mit Anna."), ("Das Foto wurde am 3. Mai 2019 aufgenommen.", "2019-05-03", ""), ("Fest. Das Foto entstand 2003 in der Stadt.", None, "Fest."),
        ("Feier vom 3.10.99 , dann", None, "Feier, dann"), ("Bei uns im DEZEMBER 1999..", None, "Bei uns."), ("Raum 2014a", "2014-01-01", "Raum 2014a"), (None, "2014", None), ("", None, ""), ("Abi 08", "2008", "Abi 08"),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, text string, date string")
    got = {r.i: r.out for r in rows.select("i", T.caption_clean(F.col("text"), F.col("date")).alias("out")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
