"""Schemas of the engine's values. Absent structs are null, absent texts empty, absent lists empty."""

from __future__ import annotations

RAW_LINE = "struct<text:string,x:double,y:double,width:double,height:double>"
LINE = "struct<text:string,x:int,y:int,width:int,height:int,right:int,bottom:int>"
LINES = f"array<{LINE}>"
OCR = f"struct<text:string,lines:array<{RAW_LINE}>,backend:string>"
CHART_VISUAL = "struct<chart_like:boolean,kind:string,trend:string,series_count:int,bbox:struct<width:int,height:int>>"
CHART_TEXT = "struct<title:string,x_axis_labels:array<string>,y_axis_labels:array<string>,legend_labels:array<string>>"
LAYOUT = "struct<kind:string,address_bar:string,page_title:string,field_labels:array<string>,title:string,left_messages:array<string>,right_messages:array<string>,input_hint:string,sidebar_labels:array<string>>"
IMAGE = f"struct<ok:boolean,width:int,height:int,chart_visual:{CHART_VISUAL}>"
#: The fields of a record, in order.
RECORD = ("ok", "caption", "ocr_text", "visible_text", "summary", "scene", "chart_visual", "chart_text", "layout", "digest", "size", "ocr_backend", "caption_pending")
