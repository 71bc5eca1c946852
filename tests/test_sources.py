import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import image
from corpusmill.sources import annotations as A
from corpusmill.sources import sinks as S
from corpusmill.sources import text as X


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_glue(spark, tmp_path):
    put(tmp_path / "cola/train.tsv", 's\t1\t\tA "quoted one.\ns\t0\t*\tbad one.\n')
    put(tmp_path / "cola/dev.tsv", "s\t1\t\tDev.\n")
    put(tmp_path / "cola/test.tsv", "index\tsentence\n0\tTest me.\n")
    rows = X.cola(spark, str(tmp_path / "cola")).orderBy("split", "_id").collect()
    assert [(r["split"], r["_id"], r["_class"], r["text"]) for r in rows][-2:] == [("train", 0, 1, 'A "quoted one.'), ("train", 1, 0, "bad one.")]
    assert rows[1]["_class"] is None and rows[1]["text"] == "Test me."
    put(tmp_path / "q/train.tsv", "index\tq\ts\tlabel\n7\ta\tb\tnot_entailment\n")
    put(tmp_path / "q/test.tsv", "index\tq\ts\n8\tc\td\n")
    got = {r["_id"]: (r["_class"], r["texts"]) for r in X.qnli(spark, str(tmp_path / "q"), ("train", "test")).collect()}
    assert got == {"7": (1, ["a", "b"]), "8": (None, ["c", "d"])}
    put(tmp_path / "bad/train.tsv", "index\tq\ts\tlabel\n7\ta\tb\tmaybe\n")
    with pytest.raises(Exception, match="unknown label"):
        X.rte(spark, str(tmp_path / "bad"), ("train",)).collect()
    line = "0\t1\t1p\tfic\tb1\tb2\tp1\tp2\ta\tb"
    put(tmp_path / "m/dev_matched.tsv", "h\n" + line + "\tneutral\tneutral\tentailment\tneutral\tneutral\tneutral\n")
    put(tmp_path / "m/dev_mismatched.tsv", "h\n" + line + "\tneutral\tneutral\tentailment\tneutral\tneutral\tcontradiction\n")
    m = X.mnli(spark, str(tmp_path / "m"), ("dev",)).collect()
    assert sorted(r["_class"] for r in m) == [1, 2] and m[0]["aux_class"] == [1, 1, 0, 1, 1]


def test_chat_round_trips(spark, tmp_path):
    p = put(
        tmp_path / "s.json",
        json.dumps(
            [
                {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "system": "be kind", "tools": "[]"},
                {"conversations": [{"from": "human", "value": "x"}]}
            ]
        )
    )
    d = X.sharegpt(spark, p)
    r = d.orderBy("_id").collect()
    assert r[0]["classes"] == ["system", "human", "gpt"] and r[1]["tools"] is None
    S.as_one_array(d, S.sharegpt(), "_id", str(tmp_path / "out"))
    assert X.sharegpt(spark, str(tmp_path / "out")).orderBy("_id").collect() == r
    p = put(tmp_path / "a.json", json.dumps([{"instruction": "do", "output": "done"}]))
    a = X.alpaca(spark, p).first()
    assert (a["classes"], a["texts"]) == (["instruction", "output"], ["do", "done"])
    p = put(tmp_path / "c.jsonl", '{"messages": [{"role": "user", "content": "hi"}]}\n{"messages": []}\n')
    c = X.chat(spark, p)
    S.one_file(c, S.messages(), "_id", str(tmp_path / "chat"))
    assert X.chat(spark, str(tmp_path / "chat")).collect() == c.collect()
    p = put(tmp_path / "d.jsonl", '{"chosen": "a", "rejected": "b"}\n')
    d = X.preference(spark, p)
    S.one_file(d, S.preference(), "_id", str(tmp_path / "dpo"))
    assert X.preference(spark, str(tmp_path / "dpo")).collect() == d.collect()
    p = put(tmp_path / "t.txt", "1\tone\ttwo\n0\tzero\n")
    assert [(r["_class"], r["text"]) for r in X.simple_text(spark, p).orderBy("_id").collect()] == [("1", "one\ttwo"), ("0", "zero")]


def test_spelling(spark, tmp_path):
    p = put(
        tmp_path / "train.sgml",
        '<ESSAY title="T">\n<TEXT>\n<PASSAGE id="A1">abc</PASSAGE>\n<PASSAGE id="A2">xyz</PASSAGE>\n</TEXT>\n<MISTAKE id="A1" location="2">\n<WRONG>b</WRONG>\n<CORRECTION>q</CORRECTION>\n</MISTAKE>\n</ESSAY>\n'
    )
    r = {x["_id"]: x["mistakes"] for x in X.csc_train(spark, p).collect()}
    assert r["A2"] == [] and tuple(r["A1"][0]) == (2, "b", "q")
    i, t = put(tmp_path / "in.txt", "(pid=B1)\tabc\n(pid=B2)\txyz\n"), put(tmp_path / "truth.txt", "B1, 0\nB2, 1, q, 3, w\n")
    r = {x["_id"]: x["mistakes"] for x in X.csc_test(spark, i, t).collect()}
    assert r["B1"] == [] and [tuple(m) for m in r["B2"]] == [(1, "x", "q"), (3, "z", "w")]


def test_detection(spark, tmp_path):
    p = put(
        tmp_path / "coco.json",
        json.dumps(
            {
                "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 1, "height": 1}],
                "annotations": [{"image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}], "categories": []
            }
        )
    )
    r = {x["_id"]: x for x in A.coco(spark, p).collect()}
    assert tuple(r[1]["bboxes"][0]) == (1, 2, 4, 6) and r[1]["classes"] == [3] and r[2]["bboxes"] == []
    put(
        tmp_path / "voc/x.xml",
        "<annotation><size><width>5</width><height>6</height><depth>3</depth></size><object><name>cat</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    )
    v = A.voc(spark, str(tmp_path / "voc")).first()
    assert tuple(v["bboxes"][0]) == (1, 2, 3, 4) and v["classes"] == ["cat"] and v["difficult"] == [1] and v["size"] == [5, 6, 3]
    put(tmp_path / "yolo/a.txt", "2 0.5 0.5 0.2 0.4\n")
    y = A.yolo(spark, str(tmp_path / "yolo"), F.lit(100.0), F.lit(50.0)).withColumn("width", F.lit(100)).withColumn("height", F.lit(50))
    assert [round(x, 6) for x in y.first()["bboxes"][0]] == [40, 15, 60, 35]
    assert y.select(S.yolo()).first()[0] == "2 0.500000 0.500000 0.200000 0.400000"
    assert y.select(S.yolo_full()).first()[0].endswith("1.000000 -1 -1")
    p = put(tmp_path / "det.txt", 'i/a.jpg\t[{"points": [[1, 2], [5, 2], [5, 9]], "transcription": "hi"}]\n')
    d = A.ocr_detection(spark, p)
    assert tuple(d.first()["bboxes"][0]) == (1, 2, 5, 9)
    S.one_file(d, S.ocr_detection(), "_id", str(tmp_path / "det_out"))
    assert A.ocr_detection(spark, str(tmp_path / "det_out")).collect() == d.collect()
    p = put(tmp_path / "rec.txt", "[\"a.jpg\", \"b.jpg\"]\thello\nc.jpg\tyes\t0.5\n")
    assert sorted((r["_id"], r["text"], r["conf"]) for r in A.ocr_recognition(spark, p).collect()) == [("a", "hello", 1.0), ("b", "hello", 1.0), ("c", "yes", 0.5)]
    put(tmp_path / "ic/g.txt", "0,0,4,0,4,2,0,2,a,b\n0,0,1,0,1,1,0,1,###\n")
    assert A.icdar(spark, str(tmp_path / "ic")).first()["text"] == ["a,b"]


def test_labelling(spark, tmp_path):
    task = [{"data": {"image": "/d/s-7.png", "audio": "/d/s-7.wav"}, "annotations": [{"result": [
        {"type": "rectanglelabels", "original_width": 200, "original_height": 100, "value": {"x": 10, "y": 20, "width": 30, "height": 40, "rectanglelabels": ["cat"]}},
        {"type": "choices", "value": {"choices": ["b"]}}, {"type": "textarea", "value": {"text": ["hi ", "there"]}}, {"type": "labels", "value": {"start": 0.5, "end": 2, "labels": ["speech"]}}]}]}]
    p = put(tmp_path / "l.json", json.dumps(task))
    b = A.labelled_boxes(spark, p).first()
    assert tuple(b["bboxes"][0]) == (20, 20, 80, 60) and b["classes"] == ["cat"] and (b["_id"], b["sub_id"]) == ("7", "s")
    assert A.labelled_classes(spark, p, ["a", "b"]).first()["classes"] == [1]
    assert A.labelled_speech(spark, p).first()["text"] == "hi there"
    assert tuple(A.labelled_spans(spark, p).first()["timestamps"][0]) == (0.5, 2.0)
    d = A.labelled_boxes(spark, p).withColumn("width", F.lit(200)).withColumn("height", F.lit(100))
    S.as_one_array(d, S.labelling_task("path", S.box_results()), "_id", str(tmp_path / "l_out"))
    assert tuple(A.labelled_boxes(spark, str(tmp_path / "l_out")).first()["bboxes"][0]) == (20, 20, 80, 60)


def test_binary(spark, tmp_path):
    (tmp_path / "x.idx").write_bytes(struct.pack(">BBBBIII", 0, 0, 8, 3, 2, 1, 2) + bytes([1, 2, 3, 4]))
    r = A.idx(spark, str(tmp_path / "x.idx")).orderBy("_id").collect()
    assert [(x["_id"], x["shape"], bytes(x["data"])) for x in r] == [(0, [1, 2], b"\x01\x02"), (1, [1, 2], b"\x03\x04")]
    (tmp_path / "c.bin").write_bytes(bytes([3]) + bytes(range(256)) * 12)
    c = A.cifar_binary(spark, str(tmp_path / "c.bin")).first()
    assert c["_class"] == 3 and len(c["data"]) == 3072
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.txt", "hi")
        z.writestr("skip.bin", "no")
    assert [(r["name"], bytes(r["content"])) for r in A.zip_members(spark, str(tmp_path / "z.zip")).collect()] == [("a/b.txt", b"hi")]
    g = A.synthetic_glyphs(spark, 3).collect()
    assert len(g) == 3 and image.to_array(g[0]["image"].asDict()).shape == (7, 20)


def test_unordered_lines_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """No single task has to sort and write whole tables whose order nobody reads."""
    from corpusmill.plans import registry
    from corpusmill.sources import sinks

    def refuse(*_):
        raise AssertionError("one file")

    monkeypatch.setattr(sinks, "one_file", refuse)
    assert registry.QUERIES["source_attributes"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_sentences_keep_their_places_in_any_splits(spark, tmp_path):
    """Files of several splits, cut anywhere, are numbered as when read whole; the last sentence is not closed."""
    import re

    from corpusmill.sources import text

    body = "".join(f"<SENTENCE>\n<TEXT>é{i}{'x' * (i * 7 % 90)}</TEXT><MISTAKE><LOCATION>{i}</LOCATION></MISTAKE></SENTENCE>{' ' * (i % 5)}" for i in range(400))
    for name, extra in (("a", "<ROOT></SENTENCE>\n"), ("b", "")):
        (tmp_path / name).write_text(extra + body + "<SENTENCE><TEXT>open")
    want = sorted([*enumerate(re.findall(r"(?s)<SENTENCE>.*?</SENTENCE>", body))] * 2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (997, 4096, 10**6):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            d = text.numbered_elements(spark, str(tmp_path), "SENTENCE")
            assert sorted((r["_id"], r["s"]) for r in d.collect()) == want
            assert d.rdd.getNumPartitions() > 20 or size > 997
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
