"""Queries of payload coding, and of encoders, splitters and maps that other queries leave out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import streaming
from ..functions import clean, encode, perturb, split
from ..operators import idmap, image, pipeline, tokenizers
from ..sources import media
from .pixel_queries import _E
from .registry import query
from .text_queries import docs
from .vision_queries import _picture, _wave

_BYTE = "trunc(least(greatest(x * 30 + 128, 0), 255))"


def byte_image(c: Column, colours: bool = False) -> Column:
    """Images of 8 bits; with ``colours`` of three channels."""
    shown = lambda a: np.clip(a * 30 + 128, 0, 255).astype(np.uint8)
    return image.on_image(c, lambda a: shown(image.with_mirrors(a) if colours else a))


@query("image_png", f"{_E} SELECT vec_id, list_transform(v, lambda x: {_BYTE}) AS v FROM i")
def image_png(spark, sf):
    """Gray images written as PNG files and read back."""
    p = media.encode_image(byte_image(F.col("image")))
    return _picture(spark, sf).select("vec_id", image.pixels(media.decode_image(p, True)).alias("v"))


@query("image_png_colour", f"{_E} SELECT vec_id, list_transform(flatten(list_transform(range(64), lambda p: [v[p + 1], f[p + 1], h[p + 1]])), lambda x: {_BYTE}) AS v FROM i")
def image_png_colour(spark, sf):
    """Images of three channels as base64 text of PNG files."""
    p = F.base64(media.encode_image(byte_image(F.col("image"), True)))
    return _picture(spark, sf).select("vec_id", image.pixels(media.decode_image(p, True)).alias("v"))


@query(
    "audio_wav",
    "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: least(greatest(trunc(x * 1000), -32768), 32767) / 32768) AS v, 1600 AS rate FROM embeddings"
)
def audio_wav(spark, sf):
    """Samples of 16 bits written as WAV files and read back.

    Files know no negative zero and no null sound: where a zero is read, its sign is that of the sample written, as in SQL's
    ``trunc``, and sounds that are null have the rate of the others.
    """
    clipped = F.transform("v", lambda x: F.least(F.greatest(x * 1000, F.lit(-32768.0)), F.lit(32767.0)))
    whole = F.transform(clipped, lambda x: F.signum(x) * F.floor(F.abs(x)) / 32768)
    d = _wave(spark, sf).select("vec_id", whole.alias("v")).withColumn("s", media.decode_sound(media.encode_sound(F.col("v"), 1600), True))
    signed = F.zip_with("s.samples", "v", lambda read, written: F.when(read == 0, written * 0.0).otherwise(read))
    return d.select("vec_id", signed.alias("v"), F.coalesce("s.rate", F.lit(1600)).alias("rate"))


_WORDS = r"WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) "
#: A closed vocabulary of words for the encoders' queries.
_VOCABULARY = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "small", "large", "cold", "hot", "widget", "gizmo", "gadget", "bolt", "gear", "red", "blue", "green"])}
_IDS = "CASE w " + " ".join(f"WHEN '{w}' THEN {i}" for w, i in _VOCABULARY.items()) + " ELSE 1 END"


def _part_words(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", F.col("p_name").alias("text"), split.shallow_split(F.col("p_name")).alias("w"))


@query(
    "encode_simple",
    f"""WITH d AS (SELECT p_partkey, p_brand, [{_IDS} FOR w IN string_split(p_name, ' ')] AS i
FROM part), m AS (SELECT p_brand, max(len(i)) AS n FROM d GROUP BY p_brand)
SELECT p_partkey, list_concat(i, list_transform(range(n - len(i)),
lambda j: 0)) AS ids FROM d JOIN m USING (p_brand)"""
)
def encode_simple(spark, sf):
    """Words to ids, padded to the longest row of a brand."""
    return tokenizers.simple(_part_words(spark, sf), "text", _VOCABULARY, 16, "p_brand").select("p_partkey", "ids")


@query(
    "decode_ids",
    f"""WITH d AS (SELECT p_partkey, [{_IDS} FOR w IN string_split(p_name, ' ')] AS i, string_split(p_name, ' ') AS w
FROM part) SELECT p_partkey, array_to_string(list_transform(list_zip(i, w),
lambda z: CASE WHEN z[1] = 1 THEN '[UNK]' ELSE z[2] END), ' ') AS text
FROM d"""
)
def decode_ids(spark, sf):
    ids = encode.encode_words(F.col("w"), _VOCABULARY)
    return _part_words(spark, sf).withColumn("ids", ids).select("p_partkey", F.array_join(encode.decode_ids(F.col("ids"), _VOCABULARY), " ").alias("text"))


@query("one_hot_back", f"SELECT p_partkey, [{_IDS} FOR w IN string_split(p_name, ' ')] AS ids FROM part")
def one_hot_back(spark, sf):
    rows = encode.one_hot(encode.encode_words(F.col("w"), _VOCABULARY), len(_VOCABULARY))
    return _part_words(spark, sf).select("p_partkey", encode.one_hot_back(rows).alias("ids"))


@query("byte_pairs", "SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: ord(c) - 1) AS ids, p_name AS text FROM part WHERE p_name NOT LIKE '%ll%'")
def byte_pairs(spark, sf):
    """Byte pairs with a single merge that these rows do not need, to ids and back."""
    vocabulary = {c: b - 1 for b, c in encode.byte_alphabet().items()} | {"ll": 300}
    d = spark.read.parquet(f"{sf}/part.parquet").where(~F.col("p_name").contains("ll"))
    d = d.withColumn("ids", encode.byte_pair_ids(F.array("p_name"), vocabulary, {("l", "l"): 0}))
    return d.select("p_partkey", "ids", encode.byte_pair_text(F.col("ids"), vocabulary).alias("text"))


@query("end_marks", "SELECT p_partkey, p_name || '.' AS closed, p_name || '!' AS kept FROM part")
def end_marks(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet")
    return d.select("p_partkey", encode.add_end_mark(F.col("p_name")).alias("closed"), encode.add_end_mark(F.concat("p_name", F.lit("!"))).alias("kept"))


@query(
    "joint_pairs",
    """SELECT p_partkey, array_to_string(list_concat(list_concat(string_split(p_name, ' '),
['[SEP]']), list_concat([p_type], ['[SEP]'])), ' ') AS closed, array_to_string(list_concat(list_concat(string_split(p_name,
  ' '), ['[SEP]']), [p_type]), ' ') AS open FROM part"""
)
def joint_pairs(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet").withColumn("r", F.array(split.shallow_split(F.col("p_name")), F.array("p_type")))
    return d.select("p_partkey", F.array_join(encode.joint(F.col("r"), "[SEP]"), " ").alias("closed"), F.array_join(encode.joint(F.col("r"), "[SEP]", False), " ").alias("open"))


@query(
    "join_words",
    _WORDS + """SELECT doc_id, array_to_string(w, '') AS glued, list_reduce(list_transform(w, lambda x: {'t': x, 'a': regexp_full_match(x,
  '[\\x00-\\x7F]*')}), lambda p, x: {'t': CASE WHEN NOT p.a AND NOT x.a THEN p.t || x.t ELSE p.t || ' ' || x.t END,
  'a': x.a}).t AS mixed FROM d WHERE len(w) > 0"""
)
def join_words(spark, sf):
    """Words glued, and with blanks except between non-ASCII neighbours."""
    d = docs(spark, sf).select("doc_id", split.shallow_split(F.col("text")).alias("w")).where(F.size("w") > 0)
    return d.select("doc_id", split.join_words(F.col("w")).alias("glued"), split.join_mixed(F.col("w")).alias("mixed"))


@query("deep_split", _WORDS + "SELECT doc_id, flatten(list_transform(w, lambda x: flatten(list_transform(string_split(x, '-'), lambda y: string_split(y, '.'))))) AS w FROM d")
def deep_split(spark, sf):
    """Words cut at hyphens, then at full stops."""
    at = lambda c: lambda w: split.shallow_split(w, c)
    return docs(spark, sf).select("doc_id", split.deep_split(split.shallow_split(F.col("text")), at("-"), at(".")).alias("w"))


@query("split_characters", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, text AS glued FROM documents")
def split_characters(spark, sf):
    c = split.shallow_split(F.col("text"), "")
    return docs(spark, sf).select("doc_id", F.size(c).alias("n"), F.array_join(c, "").alias("glued"))


@query("merge_continued", "SELECT p_partkey, p_name || p_type AS word, 0.0::DOUBLE AS start, 2.0::DOUBLE AS \"end\", p_brand AS last FROM part")
def merge_continued(spark, sf):
    """Pieces with a mark glued to what follows."""
    s = lambda w, a, b: F.struct(w.alias("word"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    d = spark.read.parquet(f"{sf}/part.parquet")
    d = d.withColumn("m", split.merge_continued(F.array(s(F.concat("p_name", F.lit("@@")), 0.0, 1.0), s(F.col("p_type"), 1.0, 2.0), s(F.col("p_brand"), 2.0, 3.0))))
    first = F.get("m", F.lit(0))
    return d.where(F.size("m") == 2).select(
        "p_partkey", first["word"].alias("word"), first["start"].alias("start"), first["end"].alias("end"), F.get("m", F.lit(1))["word"].alias("last")
    )


@query("merge_single_letters", "SELECT p_partkey, 'AB' AS word, 2.0::DOUBLE AS \"end\", p_name AS last FROM part")
def merge_single_letters(spark, sf):
    s = lambda w, a, b: F.struct(w.alias("word"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    d = spark.read.parquet(f"{sf}/part.parquet")
    d = d.withColumn("m", split.merge_single_letters(F.array(s(F.lit("a"), 0.0, 1.0), s(F.lit("b"), 1.0, 2.0), s(F.col("p_name"), 2.0, 3.0))))
    first = F.get("m", F.lit(0))
    return d.select("p_partkey", first["word"].alias("word"), first["end"].alias("end"), F.get("m", F.lit(1))["word"].alias("last"))


_LINES = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
e AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pid, unnest(ps) AS p
FROM l), o AS (SELECT doc_id, pid, length(p) AS n, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
0) AS b FROM e) """


@query("locate", _LINES + "SELECT doc_id, CAST(b AS BIGINT) AS acid, pid AS part, CAST(0 AS INTEGER) AS at FROM o WHERE n > 0")
def locate(spark, sf):
    """Where each line that has characters begins in the text, and back by arithmetic."""
    d = docs(spark, sf).select(
        "doc_id", split.to_paragraphs(F.col("text")).alias("p")
    ).select("doc_id", "p", F.posexplode("p").alias("part", "line")).where(F.char_length("line") > 0)
    d = d.withColumn("acid", idmap.article_offset(F.col("p"), F.col("part"), F.lit(0)))
    found = idmap.locate(F.col("p"), F.col("acid"))
    return d.select("doc_id", F.col("acid").cast("long").alias("acid"), found["part"].cast("long").alias("part"), found["at"].cast("int").alias("at"))


@query(
    "first_seen",
    "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"
)
def first_seen(spark, sf):
    """The first event of each type of each user."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    return streaming.first_seen(e, "ts", ["user_id", "event_type"])


@query(
    "spelled_integers",
    """SELECT n_nationkey, list_extract(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine',
  'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty',
  'twenty-one', 'twenty-two', 'twenty-three', 'twenty-four'], n_nationkey + 1) AS en, CASE WHEN n_nationkey < 10 THEN substring('零一二三四五六七八九',
  n_nationkey + 1, 1) ELSE CASE WHEN n_nationkey >= 20 THEN '二' ELSE '' END || '十' || CASE WHEN n_nationkey % 10 > 0 THEN substring('零一二三四五六七八九',
  n_nationkey % 10 + 1, 1) ELSE '' END END AS zh FROM nation"""
)
def spelled_integers(spark, sf):
    d = spark.read.parquet(f"{sf}/nation.parquet")
    n = F.col("n_nationkey").cast("string")
    return d.select("n_nationkey", clean.spell_numbers(n, "en").alias("en"), clean.spell_numbers(n, "zh").alias("zh"))


@query("stem_groups", "SELECT p_partkey, 'a_' || p_brand AS stem FROM part")
def stem_groups(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet")
    return d.select("p_partkey", pipeline.stem(F.concat_ws("_", F.lit("a"), "p_brand", F.col("p_partkey").cast("string"))).alias("stem"))


@query("apply_all", "SELECT p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size FROM part WHERE p_size < 20")
def apply_all(spark, sf):
    """Operators in a row."""
    d = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_size")
    return pipeline.apply_all(d, lambda x: x.where("p_size < 20"), lambda x: x.withColumn("p_name", F.upper("p_name")), lambda x: x.withColumn("p_size", F.col("p_size") + 1))


@query("random_choice_all", "SELECT p_partkey, CAST(p_size + 111 AS INTEGER) AS p_size, 3 AS applied FROM part")
def random_choice_all(spark, sf):
    """Three additions in an order drawn for each row: the order does not matter, the sum does."""
    ops = [lambda c, k=k: (c + k).cast("int") for k in (1, 10, 100)]
    d = pipeline.random_choice(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size"), "p_partkey", "p_size", ops, seed=3)
    return d.select("p_partkey", "p_size", F.size("applied").alias("applied"))


@query("event_properties_semi", "SELECT event_id, event_type FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c_acctbal > 0)")
def event_properties_semi(spark, sf):
    """Events of users with a positive balance: a semi-join."""
    c = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return spark.read.parquet(f"{sf}/events.parquet").join(c, "user_id", "left_semi").select("event_id", "event_type")


@query(
    "set_operations",
    """(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both'
FROM supplier) UNION ALL (SELECT c_nationkey, 'first' FROM customer EXCEPT SELECT s_nationkey, 'first'
FROM supplier)"""
)
def set_operations(spark, sf):
    """Nations of customers that have suppliers, and that have none."""
    a = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("k"))
    b = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


_IN = "(" + ", ".join(f"'{w}'" for w in _VOCABULARY if w[0] != "[") + ")"


def _faults(edit):
    """How many tokens of an edit that keeps places are not what their tags say: untouched ones the same, touched ones with their own ids as tags."""

    def run(spark, sf):
        d = _part_words(spark, sf).withColumn("m", edit(F.col("w"), F.col("p_partkey"), _VOCABULARY, 5, 0.5)).withColumn("ids", encode.encode_words(F.col("w"), _VOCABULARY))
        wrong = lambda t, i: F.when(F.get("m.tags", i) == perturb.SKIP, t != F.get("m.tokens", i)).otherwise(F.get("m.tags", i) != F.get("ids", i))
        places = F.transform("w", wrong)
        return d.select("p_partkey", F.size("m.tokens").alias("n"), F.size(F.filter(places, lambda x: x)).alias("wrong"))

    return run


for _name, _edit in (("mask_places", perturb.random_mask), ("replace_places", perturb.random_replace)):
    query(_name, "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, 0 AS wrong FROM part")(_faults(_edit))


@query("append_places", "SELECT p_partkey, p_name AS text, 0 AS wrong FROM part")
def append_places(spark, sf):
    """Without the words that were added the text is as it was, and added words are tagged with their ids."""
    d = _part_words(spark, sf).withColumn(
        "m", perturb.random_append(F.col("w"), F.col("p_partkey"), _VOCABULARY, 5, 0.5)
    ).withColumn("ids", encode.encode_words(F.col("m.tokens"), _VOCABULARY))
    z = F.arrays_zip(F.col("m.tokens").alias("t"), F.col("m.tags").alias("g"), F.col("ids").alias("i"))
    old = F.transform(F.filter(z, lambda x: x["g"] == perturb.SKIP), lambda x: x["t"])
    return d.select("p_partkey", F.array_join(old, " ").alias("text"), F.size(F.filter(z, lambda x: (x["g"] != perturb.SKIP) & (x["g"] != x["i"]))).alias("wrong"))


@query(
    "delete_places",
    f"SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN {_IN} THEN split_part(p_name, ' ', 1) ELSE p_name END AS text FROM part WHERE len(string_split(p_name, ' ')) = 2"
)
def delete_places(spark, sf):
    """Of two words the second goes wherever the first may be hit, as all are."""
    d = _part_words(spark, sf).where(F.size("w") == 2)
    return d.select("p_partkey", F.array_join(perturb.random_delete(F.col("w"), F.col("p_partkey"), _VOCABULARY, 5, 1.0)["tokens"], " ").alias("text"))
