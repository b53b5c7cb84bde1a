"""Word lists whose members, order and spelling decide results."""

from __future__ import annotations

#: Words that are no labels.
STOP_LABELS = ("page", "screen", "window", "user", "showing", "computer", "desktop", "interface", "button", "mode", "panel", "menu")
#: Keywords of scenes, matched as substrings.
SETTINGS = ("setting", "settings", "设置", "network", "网络", "bluetooth", "蓝牙", "display", "显示", "battery", "电池", "privacy", "隐私", "wifi", "wi-fi", "brightness", "亮度", "power mode", "volume", "音量", "audio", "声音")
CHART = ("chart", "图表", "graph", "dashboard", "仪表盘", "trend", "趋势", "sales", "revenue", "营收", "收入", "growth", "legend", "axis", "metric")
BROWSER = ("browser", "浏览器", "chrome", "edge", "search", "搜索", "tab", "login", "登录", "登入", "sign in", "website", "http", "www", "address bar", "地址栏")
CHAT = ("chat", "聊天", "message", "messages", "消息", "reply", "回复", "assistant", "conversation", "对话", "send", "发送", "typing", "输入", "wechat", "slack", "discord", "telegram")
#: Tokens of browser fields, of what no page title has, and of chat inputs.
FIELD_TOKENS = ("email", "password", "username", "search", "login", "sign in", "submit", "邮箱", "邮件", "密码", "用户名", "搜索", "登录", "登入", "提交")
TITLE_EXCLUDED = ("email", "password", "username", "search", "sign in", "submit", "邮箱", "邮件", "密码", "用户名", "搜索", "提交")
INPUT_TOKENS = ("send", "type", "message", "reply", "input", "write", "chat", "发送", "输入", "消息", "回复")
#: Labels of user interfaces, in order of preference.
CANONICALS = ("Example", "Login", "Example Login", "Log in", "Sign in", "Sign up", "Email", "Password", "Username", "Search", "Settings", "General", "Design", "Send", "Reply", "Message", "Messages", "Type a message", "Dashboard", "Chat")
#: What a settings screen is about, in order.
FOCUS = (
    ("battery and display", ("battery", "power", "brightness", "display", "screen", "电池", "亮度", "显示", "屏幕")),
    ("connectivity", ("network", "bluetooth", "wifi", "wi-fi", "网络", "蓝牙", "无线")),
    ("privacy", ("privacy", "security", "permission", "隐私", "权限", "安全")),
    ("audio", ("volume", "audio", "sound", "音量", "声音", "音频")),
)
#: What looks like a URL.
URL_TOKENS = ("http", "www.", ".com", ".cn", ".net", ".io", ".ai", "://")
