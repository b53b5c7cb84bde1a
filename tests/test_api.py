import base64

from pyspark.sql import functions as F

from screenlens import api, schemas
from screenlens.plans import screens
from screenlens.plans.contexts import screen_descriptions, user_contexts
from screenlens.sources import images, ocr


def b64(a):
    return base64.b64encode(images.encode_png(a)).decode()


def test_single_images(spark):
    bar = b64(screens.bar_image([220, 300, 400, 500]))
    r = api.analyze_image("data:image/png;base64," + bar, provider=ocr.empty)
    assert list(r) == list(schemas.RECORD) and r["ok"] and r["scene"] == "chart" and r["layout"] == {} and r["chart_visual"]["trend"] == "downward"
    bad = api.analyze_image("nothing", provider=ocr.empty)
    assert not bad["ok"] and bad["summary"] == "Unable to decode the uploaded image." and bad["chart_visual"] == {} and bad["size"] == ""
    assert api.build_screen_description(bar, provider=ocr.empty) == "This looks like a dashboard featuring a bar chart with a downward left-to-right trend."
    assert api.build_screen_description("", provider=ocr.empty) == "Unable to decode the uploaded image."


def test_contexts(spark):
    bar, plain = b64(screens.bar_image([220, 300, 400, 500])), b64(screens.blank(640, 660))
    c = api.build_user_image_context([" ", bar, plain, "x", bar, bar, bar], user_text=" What \n is it? ", provider=ocr.empty).split("\n")
    assert c[0] == "[LOCAL_IMAGE_CONTEXT]" and c[4] == "User question: What is it?" and c[5] == "Image 1:" and c[6] == "- Scene type: chart"
    assert c[-1] == "2 additional image(s) were omitted from expansion." and "- Image size: 640x660" in c and "- Visual summary: Unable to decode the uploaded image." in c
    assert c.index("Image 4:") > c.index("Image 3:") and "Image 5:" not in c
    assert api.build_user_image_context([]) == api.build_user_image_context(None) == api.build_user_image_context(["", " "]) == ""


def test_tables(spark):
    d = screens.drawn(spark).withColumn("g", F.when(F.col("name").startswith("bar"), "bars").otherwise("rest"))
    got = {r.g: r.context for r in user_contexts(spark, d, ["g"], "name", provider=ocr.empty).collect()}
    assert set(got) == {"bars", "rest"} and got["bars"].count("Image ") == 3 * 2 and "omitted" not in got["bars"]
    assert screen_descriptions(spark, d, provider=ocr.empty).where("description = ''").count() == 0


def test_capabilities(spark):
    c = api.get_local_image_capabilities()
    assert c["full_analysis"] == api.has_local_image_support() and c["caption"] == api.has_caption_support()
    assert c["any"] == (c["full_analysis"] or c["caption"]) and set(c) == {"windows_ocr", "tesseract_ocr", "caption", "full_analysis", "any"}


def test_events_and_sink(spark, tmp_path):
    from screenlens.plans.analysis import analyze, events, write_records

    records = analyze(spark, screens.drawn(spark), provider=ocr.empty)
    assert sorted(r.stage for r in events(records).collect()).count("decode_error") == 2
    assert events(records).where("data['size'] = '1280x800' and data['has_ocr'] = 'false'").count() == 5
    write_records(records, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r.scene: r["count"] for r in back.groupBy("scene").count().collect()} == {"chart": 5, "image": 1, "failed": 2}
    assert back.where("scene = 'chart'").count() == 5
