"""Writers.  Large tables go out in parallel as folders of part files; ``as_one_array`` and ``one_file`` write small ones as single files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boxes as B


def text_lines(df: DataFrame, line: Column, path: str, split: bool = False) -> None:
    """A line for each row; with ``split`` in a folder for each split."""
    out = df.select(line.alias("value"), *(["split"] if split else []))
    w = out.write.mode("overwrite")
    (w.partitionBy("split") if split else w).text(path)


def json_lines(df: DataFrame, path: str, split: bool = False) -> None:
    """A JSON object for each row."""
    w = df.write.mode("overwrite")
    (w.partitionBy("split") if split else w).json(path)


def one_file(df: DataFrame, line: Column, order: str, path: str) -> None:
    """Lines in order as a single part file; one task, for outputs of moderate size."""
    df.select(F.col(order).alias("_o"), line.alias("value")).repartitionByRange(1, "_o").sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def as_one_array(df: DataFrame, element: Column, order: str, path: str) -> None:
    """A JSON array of all rows as a single part file, one element a line; commas come from row numbers, nothing is gathered."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.orderBy(order))
    last = F.lead(F.lit(1)).over(W.orderBy(order)).isNull()
    one = df.select(F.concat(F.when(n == 1, "[").otherwise(""), element, F.when(last, "]").otherwise(",")).alias("value"), n.alias("_n"))
    one.coalesce(1).sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def tsv(*columns: str) -> Column:
    """Columns joined by tabs."""
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])


def alpaca(classes: str = "classes", texts: str = "texts") -> Column:
    """Keys and texts as a JSON object."""
    return F.to_json(F.map_from_arrays(classes, texts))


def chat(classes: str = "classes", texts: str = "texts", key: str = "messages") -> Column:
    """Speakers and texts as JSON messages."""
    return F.to_json(
        F.struct(
            F.transform(
                F.arrays_zip(F.col(classes).alias("c"), F.col(texts).alias("t")), lambda x: F.struct(x["c"].alias("role"), x["t"].alias("content"))
            ).alias(key)
        )
    )


def messages(column: str = "messages", key: str = "messages") -> Column:
    """Messages as they are: the inverse of the chat source."""
    return F.to_json(F.struct(F.col(column).alias(key)))


def preference(chosen: str = "chosen", rejected: str = "rejected") -> Column:
    """A chosen and a rejected answer."""
    return F.to_json(F.struct(F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")))


def sharegpt(classes: str = "classes", texts: str = "texts", tools: str = "tools") -> Column:
    """Speakers and texts as a conversation; a first system text goes to its own key."""
    z = F.transform(F.arrays_zip(F.col(classes).alias("c"), F.col(texts).alias("t")), lambda x: F.struct(x["c"].alias("from"), x["t"].alias("value")))
    system = F.get(F.col(classes), F.lit(0)) == "system"
    return F.to_json(
        F.struct(
            F.when(system, F.slice(z, 2, F.size(z))).otherwise(z).alias("conversations"),
            F.when(system, F.get(F.col(texts), F.lit(0))).alias("system"), F.col(tools).alias("tools")
        )
    )


def yolo(boxes: str = "bboxes", classes: str = "classes", width: str = "width", height: str = "height") -> Column:
    """Label lines ``class cx cy w h`` in shares with six decimals, joined by line ends."""
    z = F.arrays_zip(F.col(boxes).alias("b"), F.col(classes).alias("c"))

    def line(x):
        q = B.xyxy_to_xywh(x["b"], True, F.col(width), F.col(height))
        return F.format_string("%d %.6f %.6f %.6f %.6f", x["c"], q["x"], q["y"], q["w"], q["h"])

    return F.array_join(F.transform(z, line), "\n")


def yolo_full(boxes: str = "bboxes", classes: str = "classes", confs: str | None = None, width: str | None = None, height: str | None = None) -> Column:
    """Label lines ``class x1 y1 x2 y2 conf w h``; confidence 1 and sizes -1 where unknown."""
    c = F.col(confs) if confs else F.array_repeat(F.lit(1.0), F.size(boxes))
    w, h = (F.col(width) if width else F.lit(-1)).cast("double"), (F.col(height) if height else F.lit(-1)).cast("double")
    z = F.arrays_zip(F.col(boxes).alias("b"), F.col(classes).alias("c"), c.alias("p"))
    return F.array_join(
        F.transform(
            z,
            lambda x: F.format_string(
                "%d %.6f %.6f %.6f %.6f %.6f %.0f %.0f", x["c"], x["b"]["x1"], x["b"]["y1"], x["b"]["x2"], x["b"]["y2"], x["p"], w, h
            )
        ),
        "\n"
    )


def ocr_detection(path: str = "path", polygons: str = "segmentations", texts: str = "text") -> Column:
    """``path<tab>[{points, transcription}]``."""
    z = F.arrays_zip(F.col(polygons).alias("p"), F.col(texts).alias("t"))
    return F.concat_ws(
        "\t", F.col(path),
        F.to_json(
            F.transform(z, lambda x: F.struct(F.transform(x["p"], lambda q: F.array(q["x"], q["y"])).alias("points"), x["t"].alias("transcription")))
        )
    )


def ocr_crops(df: DataFrame, image: str = "image", boxes: str = "bboxes", texts: str = "text") -> DataFrame:
    """A row for each box: ``_id`` with its number, ``image`` cut out, ``text``."""
    from ..operators.image import on_image

    each = df.select("_id", image, texts, F.posexplode(boxes).alias("_n", "_b"))
    c = lambda k: F.col(f"_b.{k}").cast("int")
    cut = on_image(F.col(image), lambda a, x1, x2, y1, y2: a[max(y1, 0) : y2, max(x1, 0) : x2], c("x1"), c("x2"), c("y1"), c("y2"))
    return each.select(F.concat_ws("_", F.col("_id").cast("string"), F.col("_n").cast("string")).alias("_id"), cut.alias("image"), F.get(F.col(texts), F.col("_n")).alias("text"))


def speech(audio: str = "audio", text: str = "text") -> Column:
    """{source, target} as JSON."""
    return F.to_json(F.struct(F.col(audio).alias("source"), F.col(text).alias("target")))


def labelling_task(path: str, results: Column, key: str = "image") -> Column:
    """A task with one annotation of the given results, as JSON."""
    return F.to_json(F.struct(F.struct(F.col(path).alias(key)).alias("data"), F.array(F.struct(results.alias("result"))).alias("annotations")))


def box_results(boxes: str = "bboxes", classes: str = "classes", width: str = "width", height: str = "height") -> Column:
    """Boxes as percent rectangles."""
    z = F.arrays_zip(F.col(boxes).alias("b"), F.col(classes).alias("c"))
    w, h = F.col(width), F.col(height)
    p = lambda v, n: v * 100.0 / n
    return F.transform(
        z,
        lambda x: F.struct(
            F.lit("rectanglelabels").alias("type"), w.alias("original_width"), h.alias("original_height"),
            F.struct(
                p(x["b"]["x1"], w).alias("x"), p(x["b"]["y1"], h).alias("y"), p(x["b"]["x2"] - x["b"]["x1"], w).alias("width"),
                p(x["b"]["y2"] - x["b"]["y1"], h).alias("height"), F.array(x["c"]).alias("rectanglelabels")
            ).alias("value")
        )
    )


def choice_results(classes: str = "classes") -> Column:
    """Class names as one choice."""
    return F.array(F.struct(F.lit("choices").alias("type"), F.struct(F.col(classes).alias("choices")).alias("value")))


def text_results(text: str = "text") -> Column:
    """A text as a text area."""
    return F.array(F.struct(F.lit("textarea").alias("type"), F.struct(F.array(text).alias("text")).alias("value")))


def span_results(spans: str = "timestamps", classes: str = "classes") -> Column:
    """Labelled intervals."""
    z = F.arrays_zip(F.col(spans).alias("s"), F.col(classes).alias("c"))
    return F.transform(
        z,
        lambda x: F.struct(
            F.lit("labels").alias("type"),
            F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), F.array(x["c"]).alias("labels")).alias("value")
        )
    )


def save_binary(df: DataFrame, path: str, name: str = "name", content: str = "content", folder: str | None = None) -> None:
    """A file for each row, written by the tasks to a folder that all of them share; with ``folder``, a column, to a folder in it.

    Only the last part of a name counts, so that no name leads out of the
    folder; rows without content write nothing; of equal names one stays.
    """
    import os

    def write(rows):
        for r in rows:
            to = os.path.join(path, os.path.basename(str(r[folder])) if folder else "")
            os.makedirs(to, exist_ok=True)
            if r[content] is not None:
                with open(os.path.join(to, os.path.basename(r[name])), "wb") as f:
                    f.write(r[content])

    df.select(name, content, *([folder] if folder else [])).foreachPartition(write)


def save_images(df: DataFrame, path: str, name: str = "name", image: str = "image", folder: str | None = None) -> None:
    """Images as PNG files, in a folder for each class if ``folder`` names its column."""
    from .media import encode_image

    out = df.select(F.concat(F.col(name), F.lit(".png")).alias("_file"), encode_image(F.col(image)).alias("_content"), *([folder] if folder else []))
    save_binary(out, path, "_file", "_content", folder)


def save_sounds(df: DataFrame, path: str, rate: int, name: str = "name", samples: str = "samples", channels: int = 1) -> None:
    """Arrays of samples as WAV files."""
    from .media import encode_sound

    save_binary(df.select(F.concat(F.col(name), F.lit(".wav")).alias("_file"), encode_sound(F.col(samples), rate, channels).alias("_content")), path, "_file", "_content")


def extraction(image: str = "image", bbox: str = "bbox", content: str = "content", result: str = "result_list", prompt: str = "prompt") -> Column:
    """Document extraction records as JSON, images as base64: the inverse of the extraction source."""
    return F.to_json(F.struct(F.base64(F.col(image)).alias("image"), F.col(bbox).alias("bbox"), F.col(content).alias("content"), F.col(result).alias("result_list"), F.col(prompt).alias("prompt")))


def zip_file(df: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """All rows as members of one archive, for tables of moderate size: rows stream through the driver one at a time. ``zip_parts`` writes large ones."""
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for r in df.select(name, content).toLocalIterator():
            z.writestr(r[name], bytes(r[content]))


def zip_parts(df: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """Archives in a folder that all tasks share, one a partition, written side by side; a repeated task replaces its own."""
    import os
    import zipfile

    from pyspark import TaskContext

    def write(rows):
        os.makedirs(path, exist_ok=True)
        part = f"part-{TaskContext.get().partitionId():05d}.zip"
        with zipfile.ZipFile(os.path.join(path, "." + part), "w") as z:
            for r in rows:
                z.writestr(r[name], bytes(r[content]))
        os.replace(os.path.join(path, "." + part), os.path.join(path, part))

    df.select(name, content).foreachPartition(write)
