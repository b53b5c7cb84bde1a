"""Whole records of screens whose lines are known."""

import pytest
from pyspark.sql import functions as F

from screenlens import schemas
from screenlens.operators.lines import merge_lines
from screenlens.plans.analysis import analyze_screens


def L(text, x, y, w, h):
    return (text, float(x), float(y), float(w), float(h))


AXES = [*(L(t, 60, y, 40, 18) for t, y in zip(("80k", "60k", "40k", "20k"), (250, 360, 470, 580), strict=True)), *(L(t, x, 660, 30, 18) for t, x in zip(("Q1", "Q2", "Q3", "Q4"), (260, 470, 680, 890), strict=True))]
B1 = [L("https://example.com/login", 160, 26, 540, 24), L("Example Login", 220, 118, 220, 24), L("Email", 230, 250, 80, 20), L("Password", 230, 320, 110, 20), L("Sign in", 230, 390, 90, 20)]
B2 = [L("https://example.com/login", 160, 26, 540, 24), L("Example Login", 460, 182, 220, 24), L("Email", 420, 240, 80, 20), L("Sign in", 490, 486, 90, 20)]
B3 = [L("https//example.com/logln", 160, 26, 540, 24), L("ExampIe l-ogln", 460, 182, 220, 24), *B2[2:]]
C1 = [L("Alice", 560, 38, 80, 24), L("General", 40, 120, 80, 18), L("Design", 40, 190, 70, 18), L("Can you review this?", 120, 210, 220, 20), L("Sure, send it over", 760, 280, 220, 20), L("Type a message", 420, 660, 180, 20)]
C2 = [*C1[:2], L("Des gn", 40, 190, 70, 18), *C1[3:5], L("Type a mesage", 420, 660, 180, 20)]
K1 = [L("Revenue Dashboard", 80, 70, 240, 24), *AXES, L("Growth +18%", 980, 135, 120, 18)]
G1 = [L("https://example.cn/login", 150, 26, 620, 24), L("示例 Login", 470, 164, 220, 28), L("邮箱", 430, 264, 52, 20), L("密码", 430, 332, 52, 20), L("登录", 518, 468, 52, 20)]
G2 = [*G1[:2], L("邮箱 / Email", 430, 264, 140, 20), L("密码 / Password", 430, 332, 160, 20), L("登录 Sign in", 518, 468, 120, 20)]
G3 = [L("产品群", 286, 22, 68, 18), L("产品", 28, 88, 44, 18), L("Design", 28, 122, 68, 18), L("请 review 一下 PR", 96, 146, 170, 18), L("我看过了，稍后回复", 380, 188, 146, 18), L("输入消息", 236, 322, 86, 18), L("发送", 544, 322, 42, 18)]
G4 = [L("季度营收 Dashboard", 80, 70, 280, 24), *AXES, L("同比 -12%", 980, 135, 110, 18)]
G5 = [L("https//example.cn/account/security", 92, 24, 430, 18), L("Account Security", 252, 104, 166, 20), L("Email", 220, 180, 60, 18), L("密码", 220, 232, 40, 18), L("Sign in", 286, 300, 66, 18)]
G6 = [L("Settings 设置", 110, 74, 160, 24), L("Network 网络", 118, 196, 150, 22), L("Wi-Fi", 118, 252, 68, 22), L("Bluetooth", 118, 308, 90, 22), L("Privacy 隐私", 118, 364, 126, 22), L("Battery 电池", 118, 420, 132, 22)]
G7 = [L("Revenue 趋势 Dashboard", 80, 70, 320, 24), *AXES, L("YoY -18%", 980, 135, 90, 18), L("North America", 930, 178, 120, 18)]
BAR = (True, "bar", "downward", 4, (800, 500))
LINE = (True, "line", "downward", 1, (800, 500))
SCREENS = {"B1": (1280, 720, B1), "B2": (1280, 720, B2), "B3": (1280, 720, B3), "C1": (1280, 720, C1), "C2": (1280, 720, C2), "K1": (1280, 800, K1), "G1": (1365, 768, G1), "G2": (1365, 768, G2), "G3": (640, 360, G3), "G4": (1280, 800, G4), "G5": (720, 405, G5), "G6": (1280, 800, G6), "G7": (1280, 800, G7), "none": (1280, 720, []), "small": (100, 80, [])}


@pytest.fixture(scope="module")
def records(spark):
    extra = {"G3": " 聊天"}
    visual = {"G4": BAR, "G7": LINE}
    rows = [(k, w, h, " ".join(x[0] for x in lines) + extra.get(k, ""), lines, visual.get(k)) for k, (w, h, lines) in SCREENS.items()]
    df = spark.createDataFrame(rows, f"id string, width int, height int, text string, lines array<{schemas.RAW_LINE}>, chart_visual {schemas.CHART_VISUAL}")
    return {r.id: r.record for r in analyze_screens(df).collect()}


def test_browser(records):
    r = records["B1"]
    assert r.scene == "browser" and r.layout.field_labels == ["Email", "Password", "Sign in"]
    assert r.visible_text == "Example Login; https://example.com/login; Email; Password; Sign in"
    assert r.summary == "This appears to be a browser or website page. Layout details: page title: Example Login; address bar: https://example.com/login; visible controls: Email, Password, Sign in. Readable labels include: Email, Password, Sign in, Example Login."
    for k in ("B2", "B3"):
        assert records[k].layout.page_title == "Example Login" and records[k].layout.address_bar == "https://example.com/login"
    assert "logln" not in records["B3"].visible_text


def test_bilingual_browser(records):
    for k, fields in (("G1", ["邮箱", "密码", "登录"]), ("G2", ["邮箱 / Email", "密码 / Password", "登录 Sign in"])):
        assert records[k].scene == "browser" and records[k].layout.field_labels == fields and records[k].layout.page_title == "示例 Login"
    r = records["G5"]
    assert r.scene == "browser" and r.layout.address_bar == "https://example.cn/account/security" and r.layout.page_title == "Account Security" and r.layout.field_labels == ["Email", "密码", "Sign in"]


def test_chat(records):
    for k in ("C1", "C2"):
        a = records[k].layout
        assert (records[k].scene, a.kind, a.title, a.input_hint, a.sidebar_labels) == ("chat", "chat", "Alice", "Type a message", ["General", "Design"])
        assert a.left_messages == ["Can you review this?"] and a.right_messages == ["Sure, send it over"]
    g = records["G3"]
    assert g.scene == "chat" and g.layout.title == "产品群" and g.layout.input_hint == "输入消息" and len(g.layout.sidebar_labels) == 2
    assert "请 review 一下 PR" in g.layout.left_messages and "我看过了，稍后回复" in g.layout.right_messages


def test_chart(records):
    for k, title, legend in (("K1", "Revenue Dashboard", ["Growth +18%"]), ("G4", "季度营收 Dashboard", ["同比 -12%"]), ("G7", "Revenue 趋势 Dashboard", ["YoY -18%", "North America"])):
        r = records[k]
        assert r.scene == "chart" and r.chart_text.title == title and r.chart_text.legend_labels == legend
        assert r.chart_text.x_axis_labels == ["Q1", "Q2", "Q3", "Q4"] and r.chart_text.y_axis_labels == ["80k", "60k", "40k", "20k"]
    assert "bar chart with a downward left-to-right trend arranged by quarter and a visible growth indicator." in records["G4"].summary
    assert "line chart" in records["G7"].summary and "quarter" in records["G7"].summary


def test_settings_and_others(records):
    r = records["G6"]
    assert r.scene == "settings" and r.layout is None
    assert r.summary.startswith("This appears to be a system settings screen focused on battery and display, connectivity, and privacy options. Readable labels include: Settings")
    assert records["none"].scene == "ui" and records["small"].scene == "image"
    assert records["small"].summary == "Unable to extract stable detail from the image." and records["none"].visible_text == ""


def test_merge(spark):
    box = lambda t, x, y, r, b: (t, x, y, r - x, b - y, r, b)
    one = [box("Example LCOin", 460, 142, 527, 152), box("Email", 421, 242, 446, 250)]
    two = [box("ExampIe l-ogln", 460, 142, 528, 152), box("Sign in", 490, 488, 523, 499)]
    df = spark.createDataFrame([(one, two), (one, None), (None, two), ([], [])], f"a {schemas.LINES}, b {schemas.LINES}")
    got = [[v.text for v in r.m] for r in df.select(merge_lines(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [["ExampIe l-ogln", "Email", "Sign in"], ["Example LCOin", "Email"], ["ExampIe l-ogln", "Sign in"], []]
