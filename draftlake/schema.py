"""Schemas of the drawing tables. Every table is keyed by doc_id; handles are unique inside one drawing."""

from __future__ import annotations

P2 = "struct<x:double,y:double>"
P3 = "struct<x:double,y:double,z:double>"
BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
STROKE = "struct<x1:double,y1:double,x2:double,y2:double>"
AFFINE = "struct<a:double,b:double,c:double,d:double,tx:double,ty:double>"

DRAWINGS = "doc_id string, source string, version string, codepage int, skipped bigint, header string"
LAYERS = "doc_id string, layer_handle bigint, name string, aci int, true_color bigint, has_true boolean"
BLOCKS = f"doc_id string, block_handle bigint, name string, base_pt {P3}"
ENTITIES = f"""doc_id string, handle bigint, seq int, type_name string, space string, owner bigint, layer bigint,
 color struct<index:int,true_color:bigint>,
 points array<{P2}>, radius double, a0 double, a1 double, bulges array<double>, closed boolean,
 text string, tag string, height double, rotation double, h_align int, v_align int, width_factor double, align {P2},
 block bigint, sx double, sy double, attribs array<bigint>"""
DICTIONARIES = "doc_id string, dict_handle bigint, pos int, key string, item_handle bigint"
OBJECTS = "doc_id string, handle bigint, owner bigint, class_name string, fields string"
DXF_PAIRS = "doc_id string, idx bigint, code int, raw string"
SHEETS = "doc_id string, sheet_index int, name string, min_x double, min_y double, max_x double, max_y double"
