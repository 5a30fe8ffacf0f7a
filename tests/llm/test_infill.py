"""Fill-in-the-middle texts against the rule written out, and read back."""

import hashlib
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quaver.llm import infill

ODD = [
    (1, None), (2, ""), (3, "x"), (4, "a<P"), (5, "<S>"), (6, "S>é漢😀\n\r\n\x00 tail"), (7, "<M"), (None, "no id at all"), (9, "one two  three four five " * 40_000), (9, "same id"), (9, "same id"), (11, "😀" * 50), (12, "P><"), (13, ">" * 30), (14, "<" * 31),
]


def by_rule(doc_id, text):
    """The contract of the query, with lists."""
    t, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in ODD], "doc_id long, text string, _text string, draws int")
    out = infill.fill_in_middle(docs)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(((i, *by_rule(i, t)) for i, t in ODD), key=key)
    back = out.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(tuple(r) for r in back if r[0]) == sorted((i, t or "") for i, t in ODD if i)
    assert infill.fill_in_middle(docs.where("false")).collect() == []


def test_query(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = infill.q_fill_in_middle(spark, small).collect()
    assert len(got) == len(docs) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, a, b, output = by_rule(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_units_of_words_and_lines(spark):
    text = " one two\nthree  four five six\nseven\n"
    for unit in (r"\S+", r"[^\n]*\n", r"zzz"):
        match = re.compile(unit)
        spans = [m.end() for m in match.finditer(text)]
        assert infill.units(match, text) == len(spans)
        for a in range(len(spans) + 1):
            for b in range(a, len(spans) + 1):
                assert infill.ends(match, text, (a, b)) == [spans[a - 1] if a else 0, spans[b - 1] if b else 0]
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    out = infill.fill_in_middle(docs, unit=r"\S+", sentinels=("[pre]", "[suf]", "[mid]"), plain=100, spm=50)
    back = out.select("form", infill.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("t")).collect()
    assert {r.form for r in back} == {"psm", "spm"} and {r.t for r in back} == {text}


def test_sentinels_that_could_be_misread():
    for bad in (("<P>", "<S>"), ("", "b", "c"), ("a", "a", "b"), ("ab", "bc", "x"), ("aba", "x", "y"), ("xay", "a", "q")):
        with pytest.raises(ValueError):
            infill.check_sentinels(bad)
    infill.check_sentinels(infill.SENTINELS)


def test_no_unit_is_stored():
    match, text = re.compile(infill.CODE_POINT), "ab" * 500_000
    tracemalloc.start()
    n = infill.units(match, text)
    cuts = infill.ends(match, text, (n // 3, n - 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, cuts) == (1_000_000, [333_333, 999_999]) and peak < 20_000


def test_kept_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, form string")
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, keep=("doc_id", "form"))
    assert infill.fill_in_middle(docs.withColumnRenamed("form", "lang"), keep=("lang", "doc_id")).first().lang == "en"
