import struct
import zlib

import numpy as np

from draftlake.sinks import png


def decoded(data: bytes) -> np.ndarray:
    assert data.startswith(b"\x89PNG\r\n\x1a\n")
    w, h = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 3 * w + 1)[:, 1:].reshape(h, w, 3)


def test_draws_what_it_should():
    image = png.draw(np.array([[0, 0, 10, 0], [5, -100, 5, 100]], float), np.array([0xFF0000, 0x0000FF]), (0, 0, 10, 5), 100)
    assert (decoded(png.encode(image)) == image).all() and image.shape == (50, 100, 3)
    assert tuple(image[49, 10]) == (255, 0, 0) and tuple(image[20, 50]) == (0, 0, 255) and tuple(image[20, 10]) == (255, 255, 255)


def test_renders_sheets(spark):
    prims = spark.sql("SELECT 'd' AS doc_id, 255 AS rgb, array(named_struct('x1', 0D, 'y1', 0D, 'x2', 9D, 'y2', 9D)) AS strokes, CAST(NULL AS STRING) AS text, CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE>) AS at, 1D AS height, 0D AS rotation")
    boxes = spark.sql("SELECT 'd' AS doc_id, i AS sheet_index, i * 10D AS min_x, 0D AS min_y, i * 10D + 10 AS max_x, 10D AS max_y FROM (SELECT explode(array(0, 1)) AS i)")
    got = png.render(prims, boxes, 64).collect()
    assert [r["sheet_index"] for r in got] == [0] and (decoded(bytes(got[0]["png"])) != 255).any()
