"""Images, remote sources, streams, sinks and the command line."""

import json

import numpy as np
from pyspark.sql import functions as F

from parcelforge import diagnostics
from parcelforge.__main__ import main
from parcelforge.functions import pixels
from parcelforge.operators import images
from parcelforge.operators import pages as G
from parcelforge.sources import remote, sinks
from parcelforge.streaming.deeds import DEED, deed_stream, write_stream


def fake_get(url, headers, timeout):
    if "bad" in url:
        raise OSError("no")
    return json.dumps({"url": url, "auth": headers.get("Authorization")})


def page():
    im = np.full((600, 800), 255, np.uint8)
    im[100:102, 100:500] = 0
    im[300:302, 100:500] = 0
    im[100:302, 100:102] = 0
    im[100:302, 498:500] = 0
    im[400:410, 50:90] = 0
    return im


def slow_dilate(m, h, w):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m), strict=True):
        out[max(0, y - (h - 1 - h // 2)) : y + h // 2 + 1, max(0, x - (w - 1 - w // 2)) : x + w // 2 + 1] = True
    return out


def slow_boxes(m):
    seen, out = np.zeros_like(m), []
    for y, x in zip(*np.nonzero(m), strict=True):
        if seen[y, x]:
            continue
        stack, pts = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            pts.append((a, b))
            for i in range(max(0, a - 1), min(m.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(m.shape[1], b + 2)):
                    if m[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
        ys, xs = zip(*pts, strict=True)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(out)


def test_masks():
    rng = np.random.default_rng(2)
    for _ in range(40):
        m = rng.random((rng.integers(3, 25), rng.integers(3, 25))) < 0.3
        h, w = 2 * int(rng.integers(0, 3)) + 1, 2 * int(rng.integers(0, 4)) + 1
        assert (pixels.dilate(m, h, w) == slow_dilate(m, h, w)).all()
        assert sorted(pixels.component_boxes(m)) == slow_boxes(m)
        runs = pixels.long_runs(m, 3, 1)
        text = ["".join("x" if v else " " for v in r) for r in m]
        want = [[any(c == "x" for c in t[i]) and len(next(s for s in pieces if s[0] <= i < s[1])[2]) >= 3 if t[i] == "x" else False for i in range(len(t))] for t in text for pieces in [spans(t)]]
        assert (runs == np.array(want)).all()


def spans(t):
    import re

    return [(m.start(), m.end(), m.group()) for m in re.finditer("x+", t)]


def test_table_boxes(spark):
    im = page()
    rows = [(1, 1, 800, 600, bytearray(im.tobytes())), (2, 1, 800, 600, bytearray(np.full((600, 800), 255, np.uint8).tobytes())), (3, 1, 1, 1, None)]
    got = images.table_boxes(spark.createDataFrame(rows, "doc_id bigint, page_no int, width int, height int, pixels binary")).collect()
    assert [(r.doc_id, r.x, r.y, r.w, r.h) for r in got] == [(1, 79, 79, 442, 244)]
    clean = pixels.without_lines(im)
    assert clean[100:102, 100:500].min() == 255 and clean[400:410, 50:90].max() == 0


class Sizes:
    """An engine that reads the size of what it is given."""

    def read(self, image, language, layout):
        return f"{image.shape[1]}x{image.shape[0]} {language} {layout}"


def test_zones_and_crops(spark, tmp_path):
    im = page()
    one = spark.createDataFrame([(1, 1, 800, 600, bytearray(im.tobytes())), (2, 1, 1, 1, None)], "doc_id bigint, page_no int, width int, height int, pixels binary")
    boxes = spark.createDataFrame([(1, 1, 0, 100, 300, 650, 50), (1, 1, 1, 0, 0, 50, 20)], "doc_id bigint, page_no int, box_idx int, x int, y int, w int, h int")
    assert images.zone_texts(one, boxes, Sizes()).first().text == "120x60 fra 6\n\n670x70 fra 6"
    parts = images.crops(one, boxes)
    assert sorted((r.box_idx, r.width, r.height) for r in parts.collect()) == [(0, 660, 60), (1, 55, 25)]
    images.write_crops(parts, str(tmp_path / "c"))
    assert (tmp_path / "c" / "1_1_1.pgm").read_bytes().startswith(b"P5\n55 25\n255\n")
    assert [r.text for r in images.readings(one, Sizes()).orderBy("pos").limit(1).collect()] == ["1600x1200 fra 3"]


def test_text_boxes():
    p = np.zeros((60, 80))
    p[10:12, 20:40] = 0.9
    assert pixels.text_boxes(p, 800, 600) == [(60, 80, 480, 60)]


def test_prepared_page():
    sharp, bw = pixels.prepared(np.dstack([page()] * 3))
    assert sharp.shape == (1200, 1600) and set(np.unique(bw)) == {0, 255}


def test_service(spark, monkeypatch):
    monkeypatch.setenv("PF_USER", "u")
    monkeypatch.setenv("PF_PASS", "é")
    spark.dataSource.register(remote.JsonService)
    reader = remote.JsonServiceReader({"urls": "http://a/1\nhttp://bad/2\n", "transport": "tests.test_edges:fake_get", "user_env": "PF_USER", "password_env": "PF_PASS"})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in got] == ["ok", "error"] and json.loads(got[0][2])["auth"] == remote.authorization("u", "é")
    df = spark.read.format("json_service").option("urls", "file:///nowhere").load()
    assert [r.status for r in df.collect()] == ["error"]
    url = remote.feature_url("http://x", "a:b", (1, 2, 3, 4), ("idu",), codesite="o'x&y")
    assert "BBOX=1%2C2%2C3%2C4%2CEPSG%3A4326" in url and "codesite=o%27x%26y" in url


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "52003_BE_19900817.pdf", "x"), (1, "52003_BE_19900817.pdf", "x"), (2, "a.pdf", "bail emphytéotique"), (3, None, None)], "doc_id bigint, filename string, text string")
    rows.withColumn("received_at", F.expr("timestamp'2024-01-01'")).select("doc_id", "filename", "text", "received_at").write.parquet(str(tmp_path / "in"))
    write_stream(deed_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.doc_id: (r.site_code, r.document_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("52003", "BE"), 2: (None, "BE"), 3: (None, None)} and DEED


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "été\nx", None)], "doc_id bigint, text string, commune string")
    sinks.write_records(df, str(tmp_path / "j"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "j").glob("*.json"))) == {"doc_id": 1, "text": "été\nx", "commune": None}
    sinks.write_texts(df, str(tmp_path / "t"))
    assert "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "t").rglob("*.txt")) == "été\nx\n"
    got = df.select(sinks.headed_text(F.struct("doc_id", "commune"), F.col("text"))).first()[0]
    assert got == '{"doc_id":1,"commune":null}\n' + "=" * 72 + "\n\nété\nx"


def test_diagnostics(capsys):
    assert next(r for r in diagnostics.run_checks() if r.name == "python").ok
    assert main(["check-env"]) in (0, 1) and "python" in capsys.readouterr().out
    assert not diagnostics.command_details("no-such-program").ok


def test_assembly(spark):
    rows = [(1, 2, " b "), (1, 1, ""), (1, 3, "c"), (1, 2, " b "), (2, 1, None)]
    got = {r.doc_id: r.text for r in G.assembled(spark.createDataFrame(rows, "doc_id bigint, page_no int, text string")).collect()}
    assert got == {1: "--- Page 2 ---\nb\n\n--- Page 3 ---\nc"}
    assert G.load_skip_patterns(["# x", "", " annexe 1 "]) == [(0, "annexe 1")]
