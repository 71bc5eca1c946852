"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character but digits and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space, as used for stripping.
BLANKS = " \t\n\x0b\x0c\r"

_own_dirs: list[str] = []


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Lower-cased words of a text as an array; null or empty gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder of this machine takes its
    place if driver and executors are one process (tests); on a cluster that is
    an error, as executors could not read what others wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that driver and executors share")
        found = "file:" + tempfile.mkdtemp(prefix="corpusmill-")
        _own_dirs.append(found[5:])
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@atexit.register
def _remove_own_dirs() -> None:
    for d in _own_dirs:
        shutil.rmtree(d, ignore_errors=True)


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Later steps start from the files, so a lost executor costs no recomputation
    of what came before, and several readers see the same rows.  A ``narrow``
    table, of a few numbers a row, goes to an eighth as many files as a shuffle
    has partitions: many tiny files cost more than their writing at once saves.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    for paths in _watched:
        paths.append(path)
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


_watched: list[list[str]] = []


@contextlib.contextmanager
def cuts_of():
    """Within the block, the paths of all tables that ``cut`` writes are listed."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched.remove(paths)


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more, through the file system that holds them."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """df, in a session whose Arrow batches have at most ``rows`` rows and about ``size`` bytes: texts are long, and a worker holds a batch several times over.

    The bounds are settings of the session, read when a plan is made; they are
    lowered where they are larger, and stay so.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < _bytes(conf.get(name)) <= most:
            conf.set(name, str(most))
    return df


def _bytes(setting: str) -> int:
    """A number with one of Spark's suffixes."""
    digits = setting.strip().lower().rstrip("bgkmt")
    unit = setting.strip().lower()[len(digits) :].rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", least: int = 64) -> DataFrame:
    """left joined with right, which has one narrow row a key and, in ``count``, how many rows of left have it.

    A key of more than one in 4096 of these rows meets its rows by broadcast
    (there are at most 4096 such keys); the others are shuffled.  So no key's
    rows gather in one task.  Left is read twice; where there is no such key it
    is a plain join.
    """
    total, most = right.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(least, total // 4096)
    if most <= limit:
        return left.join(right, keys, how)
    hot = F.broadcast(right.where(F.col(count) > limit))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= limit), keys, how)
    return left.join(hot, keys).unionByName(rest)


def salted_join(left: DataFrame, right: DataFrame, key: str, least: int = 256) -> DataFrame:
    """left joined with right, which has one row a key, perhaps a wide one.

    A key of more than one in 4096 of left's rows is cut into parts, each with
    a copy of right's row, so no key's rows gather in one task.  Left is read
    twice; where there is no such key it is a plain join.
    """
    n = left.groupBy(key).agg(F.count("*").alias("_n"))
    total, most = n.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(least, total // 4096)
    if most <= limit:
        return left.join(right, key)
    hot = F.broadcast(n.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).alias("_parts")))  # at most 4096 rows
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0).cast("long"))
    a = left.join(hot, key, "left").withColumn("_salt", salt).drop("_parts")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [key, "_salt"]).drop("_salt")


def free(df: DataFrame, name: str) -> str:
    """The name, with as many ``_`` behind it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that work columns beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a driver keeps what it held for a moment otherwise."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_key(text: Column) -> Column:
    """64-bit hash of a text; with the document's id it names a document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def by_bytes(texts: list, limit: int = 1 << 20):
    """Yield index ranges (i, j) of consecutive texts of about ``limit`` characters."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


#: One odd 64-bit multiplier, its powers, and a random value for each byte: the base of a byte-string hash.
_MULT = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63 - 1, 256, dtype=np.uint64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _pow = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _MULT, np.uint64)])
            _inv = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, pow(_MULT, -1, 2**64), np.uint64)])
    return _pow[:n], _inv[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of a uint8 array; equal bytes give equal hashes."""
    p, q = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * p[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
BLANK_BYTE = np.zeros(256, bool)
BLANK_BYTE[[9, 10, 11, 12, 13, 32]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``inside`` is true."""
    m = np.zeros(len(data) + 2, np.int8)
    m[1:-1] = inside[data]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def folded_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with A-Z lower-cased and a blank behind each, and where each text begins."""
    data = _FOLDED[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]].astype(np.int64)
    return data, begin


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, and which text each belongs to; a text of fewer words, but not none, has one n-gram."""
    data, begin = folded_bytes(texts)
    s, e = word_spans(data, WORD_BYTE)
    h = span_hashes(data, s, e)
    doc = np.searchsorted(begin, s, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    first = np.r_[0, np.cumsum(n)[:-1]]
    grams = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            # words beyond the text's end do not count: only a text's first gram can have fewer than ``size`` words, if the text has
            part = h[j:] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
            ok = doc[j:] == doc[: len(doc) - j] if j else slice(None)
            grams[: len(h) - j][ok] += part[ok]
    last = (first + np.maximum(n - size, 0))[doc]
    keep = np.arange(len(h)) <= last
    return mix64(grams[keep]), doc[keep]
