"""Tokens and scores against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import bm25, decoded_length, display, idf, length_norm, norm_inverse, normalize_term, quantized_length, tokenize, tokenize_text


def plain_tokens(text):
    out, run = [], ""
    for c in text or "":
        if c.isalpha() or c.isdecimal():
            run += "i" if c == "İ" else c.lower()
        elif run:
            out.append(run)
            run = ""
    out += [run] if run else []
    return [t[i : i + 255] for t in out for i in range(0, len(t), 255)]


TEXTS = [None, "", "   !!!  ", "The quick-brown fox", "café naïve Ünicode ЖУРНАЛ 日本語 emoji", "ΟΔΟΣ İstanbul", "a" * 600, "x1 2y ٣٤", "tab\tnew\nline"]


def test_tokenize(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").select("i", tokenize(F.col("text")).alias("t"), normalize_term(F.col("text")).alias("n")).collect()
    for r in rows:
        assert list(r.t) == plain_tokens(TEXTS[r.i])
        assert r.n == (plain_tokens(TEXTS[r.i]) or [None])[0]
    assert tokenize_text(spark, "Foo-bar") == ["foo", "bar"]


def test_lengths(spark):
    rows = spark.range(1, 70_000).select("id", quantized_length(F.col("id").cast("int")).alias("q"), length_norm(F.col("id").cast("int")).alias("n")).collect()
    decoded = {}
    for r in rows:
        assert r.q <= r.id and (r.id >= 40 or r.q == r.id)
        assert decoded.setdefault(r.n, r.q) == r.q  # a byte stands for one length
    by = {r.id: r.n for r in rows}
    assert [by[i] for i in (1, 23, 39, 63, 64, 255, 256, 1023)] == [1, 23, 39, 49, 50, 70, 70, 87]
    assert sorted(decoded.values()) == [q for _, q in sorted(decoded.items())]


@pytest.mark.parametrize("n,df,tf,dl,average", [(2, 2, 1, 2, 4.0), (1000, 3, 7, 200, 385.5), (10, 10, 5000, 5000, 33.3)])
def test_scores(spark, n, df, tf, dl, average):
    row = spark.range(1).select(
        idf(F.lit(n), F.lit(df)).alias("w"), norm_inverse(quantized_length(F.lit(dl)), F.lit(average).cast("float")).alias("ni")
    ).select("w", "ni", bm25(F.col("w"), F.lit(tf), F.col("ni")).alias("s")).first()
    f = np.float32
    assert row.w == pytest.approx(math.log(1 + (n - df + 0.5) / (df + 0.5)), rel=1e-6)
    q = dl if dl < 40 else 24 + ((dl - 24) >> ((dl - 24).bit_length() - 4) << ((dl - 24).bit_length() - 4))
    ni = f(1) / (f(1.2) * (f(0.25) + f(0.75) * f(q) / f(average)))
    assert row.ni == pytest.approx(float(ni), rel=1e-7)
    assert row.s == pytest.approx(float(f(row.w) - f(row.w) / (f(1) + f(tf) * ni)), rel=1e-6)


def test_decoded_length(spark):
    wrong = spark.range(1, 70_000).select(F.col("id").cast("int").alias("n")).where(decoded_length(length_norm(F.col("n")).cast("short")) != quantized_length(F.col("n")))
    assert wrong.count() == 0


def test_display(spark):
    rows = spark.createDataFrame([(0.0,), (9.94,), (10.0,), (999.4,), (1500.0,), (2048.0,), (1e5,), (1234567.0,), (3e13,)], "x double")
    shown = rows.select(display.grouped(F.col("x").cast("long")), display.shown_score(F.col("x")), display.shown_millis(F.col("x")), display.shown_bytes(F.col("x"))).collect()
    assert [r[0] for r in shown][-2:] == ["1,234,567", "30,000,000,000,000"] and shown[1][1] == "9.9400"
    assert [r[2] for r in shown][:5] == ["0.0 ms", "9.9 ms", "10 ms", "999 ms", "1.50 s"]
    assert [r[3] for r in shown] == ["0 B", "9 B", "10 B", "999 B", "1.5 KB", "2.0 KB", "98 KB", "1.2 MB", "27 TB"]
    pairs = spark.createDataFrame([(5.0, 10.0), (0.01, 10.0), (11.0, 10.0), (1.0, 0.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(display.score_share(F.col("a"), F.col("b"))).collect()] == [0.5, 0.02, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_sizes_round_halves_to_even(spark):
    kilobytes = [9, 10, 1280, 1290, 1792, 2304, 10239, 10240, 10752, 11776]
    rows = spark.createDataFrame([(k << 10,) for k in kilobytes], "b long").select("b", display.shown_bytes(F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == ["9.0 KB", "10 KB", "1.2 MB", "1.3 MB", "1.8 MB", "2.2 MB", "10.0 MB", "10 MB", "10 MB", "12 MB"]
