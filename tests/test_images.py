import base64
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlens import schemas
from screenlens.conf import Settings, flag, number
from screenlens.operators import chartvis, series
from screenlens.plans import screens
from screenlens.plans.analysis import analyze, capabilities
from screenlens.sources import captions, images, ocr
from screenlens.streaming.analysis import analyze_stream, read_stream


def test_png_filters():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (images.decode(images.encode_png(a)) == a).all()
    assert (images.decode(images.encode_png(a[:, :, 0])) == a[:, :, :1]).all()
    # each filter by hand: the filtered lines must give the pixels again
    import struct
    import zlib

    flat = a.reshape(7, -1).astype(int)
    out = bytearray()
    for y in range(7):
        up = flat[y - 1] if y else np.zeros(15, int)
        left = np.concatenate([np.zeros(3, int), flat[y][:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        d = np.abs([p - left, p - up, p - corner])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        kind = y % 5
        out.append(kind)
        out += bytes(((flat[y] - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tolist())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(out)))
    assert (images.decode(png) == a).all()
    for bad in (b"", None, b"\x89PNG\r\n\x1a\n", png[:60], b"P6 x", b"BM"):
        assert images.decode(bad) is None


def test_base64():
    assert images.from_base64(" data:image/png;base64,QUJD ") == b"ABC"
    assert images.from_base64("Q!U*JD") == b"ABC" and images.from_base64("QUJ") == b"" and images.from_base64(None) == b""


def test_charts(spark):
    got = {r.name: r for r in screens.drawn(spark).select("name", images.inspect("content").alias("i")).select("name", "i.*").collect()}
    kind = lambda n: (got[n].chart_visual.kind, got[n].chart_visual.trend)
    assert kind("bar_up") == ("bar", "upward") and kind("bar_down") == ("bar", "downward") and got["bar_up"].chart_visual.series_count == 4
    assert kind("line_up") == ("line", "upward") and kind("line_down") == ("line", "downward")
    assert got["plain"].ok and got["plain"].chart_visual is None and not got["broken"].ok and not got["empty"].ok


def test_retry_image():
    a = np.full((100, 200, 3), 128, np.uint8)
    a[:50] = 100
    b = images.retry_image(a)
    assert b.shape == (200, 400, 3) and b.min() == 0 and b.max() == 255
    assert images.retry_size(2560, 1000) == (2560, 1000) and images.retry_size(2000, 1000) == (2560, 1280)


def lines(*texts):
    return [(x, 20.0, 20.0 + 30 * k, 100.0, 20.0) for k, x in enumerate(texts)]


def test_analysis(spark):
    df = screens.drawn(spark)
    key = lambda n: F.sha2(F.lit(dict((r.name, bytes(r.content)) for r in df.collect() if r.content)[n]), 256)
    one = spark.createDataFrame([("plain", ("abc 12", lines("abc 12"), "windows"))], f"n string, ocr {schemas.OCR}").select(key("plain").alias("key"), "ocr")
    text = "Settings Network Bluetooth Display Battery Privacy Power mode Screen brightness"
    two = spark.createDataFrame([("plain", (text, [(text, 40.0, 40.0, 900.0, 40.0)], "tesseract"))], f"n string, ocr {schemas.OCR}").select(key("plain").alias("key"), "ocr")
    cap = spark.createDataFrame([("line_up", "a chart")], "n string, caption string").select(key("line_up").alias("key"), "caption")
    got = {r.name: r.record for r in analyze(spark, df, provider=ocr.precomputed(one, two), captioner=captions.precomputed(cap)).collect()}
    assert len(got) == 8 and list(got["plain"].asDict()) == list(schemas.RECORD)
    p = got["plain"]
    assert (p.scene, p.ocr_backend, p.ocr_text, p.size) == ("settings", "tesseract", text, "640x660")
    assert got["line_up"].scene == "chart" and got["line_up"].caption == "a chart" and "upward" in got["line_up"].summary and got["line_up"].summary.endswith("Caption hint: a chart.")
    assert got["bar_up"] == got["bar_up_copy"] and got["bar_up"].digest
    for n in ("broken", "empty"):
        assert not got[n].ok and got[n].summary == "Unable to decode the uploaded image." and got[n].layout is None and got[n].digest == ""
    text64 = df.where("content is not null").select("name", F.base64("content").alias("img"), F.lit("mine").alias("text"), F.lit(1).alias("content"), F.lit(2).alias("key"))
    for once in (True, False):
        out = analyze(spark, text64, "img", provider=ocr.empty, dedupe=once)
        assert out.columns == ["name", "text", "content", "key", "record"] and out.where("text = 'mine' and content = 1 and key = 2").count() == 7
    again = {r.name: r.record for r in out.collect()}
    assert again["bar_down"].chart_visual == got["bar_down"].chart_visual and not again["broken"].ok


def test_tsv(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = ["4\t1\t1\t1\t1\t0\t220\t118\t220\t24\t-1\t", "5\t1\t1\t1\t1\t1\t220\t118\t92\t24\t96\tExample", "5\t1\t1\t1\t1\t2\t324\t118\t116\t24\t95\tLogin", "4\t1\t1\t1\t2\t0\t230\t250\t80\t20\t-1\t", "5\t1\t1\t1\t2\t1\t230\t250\t80\t20\t90\tEmail", "4\t1\t1\t1\t3\t0\t1\t1\t1\t1\t-1\t", "x"]
    quoted = head + '5\t1\t1\t1\t1\t1\t5\t6\t7\t8\t96\t"a ""b"" c"\r\n5\t1\t1\t1\t2\t1\t50\t60\t7\t8\t96\t"x\ty"\n'
    table = spark.createDataFrame([(1, head + "\n".join(rows)), (2, ""), (3, None), (4, head), (5, quoted), (6, "no table")], "id int, tsv string")
    got = {r.id: r.o for r in table.select("id", ocr.from_tsv(F.col("tsv"), "tesseract").alias("o")).collect()}
    assert got[1].text == "Example Login Email" and [v.x for v in got[1].lines] == [220, 230] and got[1].lines[0].width == 220 and got[1].backend == "tesseract"
    assert all(got[k].text == "" and got[k].lines == [] for k in (2, 3, 4, 6))
    assert [v.text for v in got[5].lines] == ['a "b" c', "x y"]


def test_backends_and_settings(spark, monkeypatch):
    assert ocr.choose_backend("auto", True, True) == "windows" and ocr.choose_backend("tesseract", True, False) == "" and ocr.choose_backend("x", False, True) == "tesseract"
    for k, v in {"OCR_TIMEOUT": "11", "OCR_BACKEND": "Tesseract", "TESSERACT_PSM": "12", "TESSERACT_LANG": "eng + chi_sim", "CAPTION_BLOCKING": "1", "CAPTION_DOWNLOAD": "true"}.items():
        monkeypatch.setenv("SCREENLENS_" + k, v)
    assert Settings.read() == Settings("tesseract", 11, 12, "eng+chi_sim", True, True)
    assert number("99", 8, 3, 20) == 20 and number("x", 8, 3, 20) == 8 and flag("on") and not flag("no") and flag("", True)
    r = capabilities(spark, False, True, False).first()
    assert r.full_analysis and r["any"] and not r.windows_ocr


def test_tesseract_failures(spark, monkeypatch):
    """Without the program, and with one that fails, payloads are empty."""
    df = screens.drawn(spark).select("name", "content").limit(1)
    run = ocr.tesseract(Settings())(df, "content", False, "o")
    assert run.first().o.text == ""
    j = spark.createDataFrame([('{"text":"t","lines":[{"text":"a","x":1,"y":2,"width":3,"height":4}]}',), ("no json",)], "p string").select(ocr.from_json(F.col("p"), "windows").alias("o")).collect()
    assert j[0].o.text == "t" and len(j[0].o.lines) == 1 and j[1].o.text == "no json" and j[1].o.lines == []
    if ocr.has_tesseract():
        assert subprocess.run(["tesseract", "--version"], capture_output=True, check=False).returncode == 0


def test_series(spark):
    values = [0, 5, 5, 0, 5, 5, 5, 1, 9]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "g string, pos int, v double")
    want = [(1, 2), (4, 6)]
    assert sorted((r.start, r.end) for r in series.active_segments(df, ["g"], "pos", "v", 1, 2).collect()) == want
    one = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a")).select(series.segments_of(F.col("a.v"), F.lit(1), F.lit(2)).alias("s"), series.direction_of(F.col("a.v"), F.lit(3.0)).alias("d")).first()
    assert [tuple(x) for x in one.s] == want == chartvis.segments(np.array(values), 1, 2)
    assert one.d == series.direction(df, ["g"], "pos", "v", 3.0).first().trend == chartvis.direction([float(v) for v in values], 3.0) == "downward"


@pytest.mark.parametrize("copies", [2])
def test_stream(spark, tmp_path, copies):
    (tmp_path / "in").mkdir()
    png = images.encode_png(screens.bar_image([500, 400, 300, 220]))
    for k in range(copies):
        (tmp_path / "in" / f"{k}.png").write_bytes(png)
    (tmp_path / "in" / "x.png").write_bytes(b"broken")
    out = analyze_stream(read_stream(spark, str(tmp_path / "in"), "*.png")).select("path", "record.ok", "record.scene")
    run = out.writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.ok, r.scene) for r in spark.table("records").collect()) == [(False, ""), (True, "chart")]
