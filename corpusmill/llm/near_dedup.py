"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set: its word five-grams, weighted by (1 + ln tf)
times a smoothed inverse document frequency between 1 and 1 + ``alpha``.
Document frequencies of all rows are summed in a table of ``2**df_bits``
counters by the shingle's hash, less the mean load of a counter, so what the
driver gets has a fixed size.  Shingles in fewer than ``RARE`` of all rows count
as that rare; as frequencies and loads both grow with the table, the weights
are alike at every size.  (The smoothing is deliberate: with raw IDF a group of
thousands of near copies would weigh its shared text next to nothing, and fall
apart.)

``bands`` times ``rows`` consistent samples of every document are banded; at
similarity 0.8 a pair shares no band with probability (1 - 0.8**4)**22 = 9e-6.
Copies are classes of their own from the start (hash of the text), so pairs
are between different texts.  Candidates, all verified by the exact weighted
Jaccard similarity:

1. every member of a bucket with the bucket's smallest member.  Their classes
   are found, then
2. in buckets of up to 64 members all pairs not yet in one class;
3. in larger buckets all pairs of members not yet in one class too, computed in
   blocks of some ``2 * BLOCK`` texts.  Pairs are compared exactly unless fewer
   of their samples agree than five standard deviations below the threshold
   (which a pair at the threshold does with probability 3e-7).  No pair is left
   out, so this grows with the square of a bucket of that many texts that are
   in different classes.

Classes are connected components, found by alternating star contractions on
the verified links, in tables; nothing grows on the driver.  Buckets, hubs and
copies of more than one in 4096 rows are joined by broadcast of their few keys
or cut into parts.

Defined cases: null texts count as empty; texts without words are near only to
equal texts; a text of fewer than five words is one shingle; long texts are
taken whole; repeated rows share a class; ids may be null or repeat, the class
id is the smallest id of the class that is not null; ties of samples go to the
smaller shingle hash; other columns are not read (``representatives`` returns
them as they are); an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, give_back, mix64, remove, salted_join, shingles, small_batches, spread_join

#: Members of a bucket up to which its pairs are listed in a row; larger ones go by blocks.
BUCKET = 64
#: Shingles in a smaller share of the rows all have the largest weight.
RARE = 1 / 512
#: Texts and distinct shingles of half a block, about.
BLOCK, WEIGHT = 512, 500_000


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def document_frequencies(df: DataFrame, text_col: str, bits: int = 19, size: int = 5) -> np.ndarray:
    """How many documents have a shingle in each of 2**bits hash buckets, counting every distinct shingle of a document."""

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            texts = _texts(b.column(0))
            for i, j in by_bytes(texts):
                g, doc = shingles(texts[i:j], size)
                key = _distinct(doc, g)[1]
                total += np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            for i in range(0, len(total), 1 << 12):
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([i >> 12], pa.int32()),
                        "counts": pa.array([zlib.compress(total[i : i + (1 << 12)].tobytes(), 1)], pa.binary())
                    }
                )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        parts = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in frame.counts)
        return pd.DataFrame({"block": [frame.block.iloc[0]], "counts": [zlib.compress(parts.tobytes(), 1)]})

    schema = "block int, counts binary"
    rows = df.select(text_col).mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros(1 << bits, np.int64)
    for r in rows:
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    del rows
    give_back()
    return out


def _distinct(doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document, hash and term frequency, ordered by document."""
    order = np.lexsort((g, doc))
    d, h = doc[order], g[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.r_[at, len(d)])


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """The quantiles (i + 1/2) / n of the gamma distribution of shape 2, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Weights and consistent weighted samples."""

    def __init__(self, df: np.ndarray, documents: int, alpha: float, samples: int, size: int = 5):
        self.size, self.samples = size, samples
        self.shift = np.uint64(64 - int(np.log2(len(df))))
        own = np.maximum(df - df.sum() / len(df), 1)  # less what other shingles add to a counter on average
        self.idf = 1 + alpha * np.clip(np.log((documents + 1) / own) / np.log(1 / RARE), 0, 1)
        rng = np.random.default_rng(7)
        x = gamma_quantiles()
        self.r, self.ln_c = x.astype(np.float32), np.log(x).astype(np.float32)
        self.beta = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        self.turn = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def weighted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, shingle hash and weight of all distinct shingles."""
        g, doc = shingles(texts, self.size)
        d, h, tf = _distinct(doc, g)
        return d, h, (1 + np.log(tf)) * self.idf[(h >> self.shift).astype(np.int64)]

    def signatures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents that have shingles, their total weights, and their samples: one 32-bit name of (shingle, level) each.

        Each sample turns a shingle's hash by a multiplier of its own; three
        separate stretches of 16 bits of the product choose r, c and beta.
        """
        d, h, w = self.weighted(texts)
        if not len(d):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, self.samples), np.uint32)
        begin = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        owner = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(d)]))
        out = np.zeros((len(begin), self.samples), np.uint32)
        ln_w, low, n = np.log(w).astype(np.float32), h.astype(np.uint32), len(h)
        x, y = np.empty(n, np.uint64), np.empty(n, np.uint64)
        r, c, a, t = (np.empty(n, np.float32) for _ in range(4))
        mask = np.uint64(0xFFFF)
        for k in range(self.samples):
            np.multiply(h, self.turn[k], out=x)
            for table, shift, into in ((self.r, 48, r), (self.ln_c, 32, c), (self.beta, 16, a)):
                np.right_shift(x, np.uint64(shift), out=y)
                np.bitwise_and(y, mask, out=y)
                np.take(table, y.view(np.int64), out=into, mode="clip")
            np.divide(ln_w, r, out=t)
            t += a
            np.floor(t, out=t)
            # ln c - r (t + 1 - beta), the smallest of which is the sample
            a -= t
            a -= np.float32(1)
            a *= r
            a += c
            least = np.minimum.reduceat(a, begin)
            hit = np.flatnonzero(a == least[owner])
            if len(hit) != len(begin):
                hit = hit[np.unique(owner[hit], return_index=True)[1]]
            out[:, k] = low[hit] + t[hit].astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        return d[begin], np.add.reduceat(w, begin), out

    def similarity(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Exact weighted Jaccard similarities of pairs of texts."""
        d, h, w = self.weighted([*a, *b])
        pair, n = d % len(a), len(a)
        order = np.lexsort((h, pair))
        p, x, v = pair[order], h[order], w[order]
        same = (p[1:] == p[:-1]) & (x[1:] == x[:-1])
        inter = np.bincount(p[1:][same], np.minimum(v[1:][same], v[:-1][same]), n)
        total = np.bincount(pair, w, n)
        return inter / np.maximum(total - inter, 1e-300)

    def all_similarities(self, texts: list[bytes], often: int = 8, width: int = 2048) -> np.ndarray:
        """Exact weighted Jaccard similarities of all pairs of some texts, as a matrix."""
        n = len(texts)
        g, doc = shingles(texts, self.size)
        d, h, tf = _distinct(doc, g)
        total = np.bincount(d, (1 + np.log(tf)) * self.idf[(h >> self.shift).astype(np.int64)], n)
        # a shingle that occurs tf times is the items (shingle, 1) to (shingle, tf), so that the smaller weight is the sum over common items
        each = np.repeat(np.arange(len(d)), tf)
        k = np.arange(len(each)) - np.repeat(np.cumsum(tf) - tf, tf) + 1
        d, h = d[each], h[each]
        order = np.lexsort((d, k, h))
        d, h, k = d[order], h[order], k[order]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.zeros(0, np.int64)
        count = np.diff(np.r_[at, len(d)])
        level = k[at].astype(float)
        w = np.where(level > 1, np.log(level) - np.log(np.maximum(level - 1, 1)), 1.0) * self.idf[(h[at] >> self.shift).astype(np.int64)]
        inter = np.zeros(n * n)
        for c in range(2, often + 1):
            these = np.flatnonzero(count == c)
            for a in range(c if len(these) else 0):
                for b in range(a + 1, c):
                    inter += np.bincount(d[at[these] + a] * n + d[at[these] + b], w[these], n * n)
        inter = inter.reshape(n, n)
        inter += inter.T
        many = np.flatnonzero(count > often)
        for i in range(0, len(many), width):
            these = many[i : i + width]
            column = np.repeat(np.arange(len(these)), count[these])
            place = np.repeat(at[these] - (np.cumsum(count[these]) - count[these]), count[these]) + np.arange(len(column))
            m = np.zeros((n, len(these)))
            m[d[place], column] = 1
            inter += (m * w[these]) @ m.T
        return inter / np.maximum(total[:, None] + total[None, :] - inter, 1e-300)

    def agreeing(self, texts: list[bytes], threshold: float, step: int = 64) -> np.ndarray:
        """Which pairs of texts have as many samples in common as pairs of this similarity have, but for one in three million; a matrix."""
        least = self.samples * threshold - 5 * np.sqrt(self.samples * threshold * (1 - threshold))
        at, _, s = self.signatures(texts)
        out = np.zeros((len(texts), len(texts)), bool)
        for i in range(0, len(at), step):
            out[np.ix_(at[i : i + step], at)] = (s[i : i + step, None, :] == s[None]).sum(2) >= least
        return out

    def joining(self, texts: list[bytes], label: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Links between texts of different labels that join all labels that any links join: fewer than there are labels."""
        label = np.unique(label, return_inverse=True)[1]
        x, y = np.nonzero(np.triu(self.agreeing(texts, threshold), 1) & (label[:, None] != label[None, :]))
        if len(x) > 8 * len(texts):
            near = self.all_similarities(texts)[x, y] >= threshold - 1e-9
        else:
            near = np.zeros(len(x), bool)
            for i, j in by_bytes([texts[a] + texts[b] for a, b in zip(x, y, strict=True)]):
                near[i:j] = self.similarity([texts[a] for a in x[i:j]], [texts[b] for b in y[i:j]]) >= threshold - 1e-9
        x, y = x[near], y[near]
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        root, out = list(range(len(texts))), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i in np.unique(low * len(texts) + high, return_index=True)[1].tolist():
            a, b = top(int(low[i])), top(int(high[i]))
            if a != b:
                root[a] = b
                out.append((int(x[i]), int(y[i])))
        return out


def _all_stars(e: DataFrame) -> bool:
    """Whether links (u, v), u > v, are stars: each u has one v, and no v is a u."""
    many = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return not many.limit(1).count() and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): ``node`` and ``label``, the smallest node of its component.

    Large and small stars alternate until only stars are left; every step is a
    table in the shared folder, which goes when the next one stands.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), narrow=True)  # u > v
    while not _all_stars(e):
        # large star: a node's larger neighbours go to the smallest of its neighbourhood; hubs have many
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(
            both.groupBy("u").agg(
                F.min("v").alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n")
            ).select("u", F.least("u", "m").alias("m"), "n").where("n > 0"),
            narrow=True
        )
        large = spread_join(
            e.select(F.col("v").alias("u"), F.col("u").alias("v")), least, ["u"], "n"
        ).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = cut(large, narrow=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(
            large.join(low, "u").select(
                F.col("v").alias("u"), F.col("m").alias("v")
            ).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(),
            narrow=True
        )
        remove(spark, e, least, large)
        e = small
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _bucket_pairs(member: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes within the small buckets; member: band, key, node, weight, label."""
    b = member.groupBy("band", "key").agg(F.collect_list(F.struct("node", "weight", "label")).alias("m"))
    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9
    p = b.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    p = p.where((F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & near(F.col("x.weight"), F.col("y.weight")))
    return p.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _blocks(member: DataFrame) -> DataFrame:
    """Members of the large buckets of several classes, dealt to blocks (band, key, i, j) in which any two of different classes meet.

    member: band, key, node, weight, label.
    """
    keys = ["band", "key"]
    size = member.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    several = size.groupBy(*keys).agg(F.count("*").alias("classes")).where("classes > 1").drop("classes")
    size = cut(size.join(several, keys), narrow=True)
    parts = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / WEIGHT))
    # a large class has chunks of its own, which need not meet each other; small ones share chunks, dealt by class
    own = (F.col("n") > BLOCK // 2) | (F.col("w") > WEIGHT / 2)
    large = size.where(own).select(*keys, F.col("label").alias("of"), parts(F.col("n"), F.col("w")).alias("parts"))
    small = size.where(~own).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select(*keys, F.lit(b"").alias("of"), parts(F.col("n"), F.col("w")).alias("parts"))
    parted = large.unionByName(small)
    chunk = parted.select(*keys, "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(*keys, F.struct("of", "part").alias("c"))
    only = chunk.groupBy(*keys).agg(F.count("*").alias("chunks"), F.min("c").alias("i")).where("chunks = 1").select(*keys, "i", F.col("i").alias("j"))
    met = chunk.withColumnRenamed("c", "i").join(chunk.withColumnRenamed("c", "j"), keys).where(
        (F.col("i") < F.col("j")) & ((F.col("i.of") != F.col("j.of")) | (F.col("i.of") == F.lit(b"")))
    ).unionByName(only)
    met = met.select(*keys, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("c"))
    deal = size.select(*keys, "label", "n", F.when(own, F.col("label")).otherwise(F.lit(b"")).alias("of")).join(parted, [*keys, "of"])
    placed = spread_join(member, deal, [*keys, "label"], "n").withColumn(
        "part", F.pmod(F.when(F.col("of") == F.lit(b""), F.xxhash64("label")).otherwise(F.xxhash64("node")), F.col("parts"))
    )
    return placed.select(*keys, "node", "label", F.struct("of", "part").alias("c")).join(met, [*keys, "c"]).drop("c")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, alpha: float = 0.1, bands: int = 22, rows: int = 4, df_bits: int = 19, size: int = 5
) -> DataFrame:
    """A row for each row of docs: ``id``, ``node`` (MD5 of the text, which names it), ``label`` (the class's smallest node) and ``class_id`` (its smallest id)."""
    spark = docs.sparkSession
    d = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = d.count()
    sampler = spark.sparkContext.broadcast(Sampler(document_frequencies(d, "text", df_bits, size), n, alpha, bands * rows, size))  # 2**df_bits numbers

    def sign(batches):
        factor = np.array([pow(0xA0761D6478BD642F, j + 1, 2**64) for j in range(rows)], np.uint64)
        for b in batches:
            texts = _texts(b.column(1))
            for i, j in by_bytes(texts, 1 << 18):
                at, total, s = sampler.value.signatures(texts[i:j])
                keys = mix64((s.reshape(len(s), bands, rows) * factor).sum(2, dtype=np.uint64)).view(np.int64)
                sig: list = [None] * (j - i)
                weight = np.zeros(j - i)
                for k, x in enumerate(at):
                    sig[x] = keys[k]
                    weight[x] = total[k]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(weight), pa.array(sig, pa.list_(pa.int64()))],
                    ["id", "node", "weight", "bands"]
                )

    id_type = d.schema["id"].dataType.simpleString()
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    signed = cut(d.select("id", "text", node.alias("node")).mapInArrow(sign, f"id {id_type}, node binary, weight double, bands array<long>"))
    texts = cut(signed.where("bands is not null").groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    keyed = texts.select("node", "weight", F.posexplode("bands").alias("band", "key"))
    full = cut(keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), narrow=True)
    member = cut(spread_join(keyed, full, ["band", "key"], "n"), narrow=True)
    first = member.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()

    def bodies(wanted: DataFrame) -> DataFrame:
        """The texts of nodes."""
        # one row of each wanted text: that with the smallest id
        one = signed.groupBy("node").agg(F.min("id").alias("id")).join(wanted, "node")
        own = d.select(node.alias("node"), "id", "text").alias("d").join(one.alias("o"), F.expr("d.node = o.node and d.id <=> o.id"))
        return cut(own.select("d.node", "d.text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), as a table."""
        pairs = cut(pairs, narrow=True)
        body = bodies(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())

        def check(batches):
            for x in batches:
                a, b = _texts(x.column(2)), _texts(x.column(3))
                for i, j in by_bytes([p + q for p, q in zip(a, b, strict=True)]):
                    ok = np.flatnonzero(sampler.value.similarity(a[i:j], b[i:j]) >= threshold - 1e-9) + i
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(ok)), x.column(1).take(pa.array(ok))], ["a", "b"])

        both = salted_join(pairs, body.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(body.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        out = cut(both.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary"))
        remove(spark, pairs, body)
        return out

    def joined(m: DataFrame) -> DataFrame:
        """Links that join the classes within blocks."""
        body = bodies(m.select("node").distinct())

        def join(frame: pd.DataFrame) -> pd.DataFrame:
            node = frame.node.tolist()
            label = np.unique([bytes(x).hex() for x in frame.label], return_inverse=True)[1]
            found = sampler.value.joining([(t or "").encode("utf-8", "replace") for t in frame.text], label, threshold)
            return pd.DataFrame({"a": [node[x] for x, _ in found], "b": [node[y] for _, y in found]})

        return salted_join(m, body, "node").groupBy("band", "key", "i", "j").applyInPandas(join, "a binary, b binary")

    links = verified(first)
    found = cut(components(links), narrow=True)
    classed = member.join(found, "node", "left").withColumn("label", F.coalesce("label", "node")).select("band", "key", "node", "weight", "label", "n")
    more = _bucket_pairs(classed.where(F.col("n") <= BUCKET).drop("n"), threshold).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(more))
    big = cut(classed.where(F.col("n") > BUCKET).drop("n"), narrow=True)
    if big.limit(1).count():
        left = cut(_blocks(big), narrow=True)
        links = links.unionByName(cut(joined(left).distinct()))
    ids = cut(signed.groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), narrow=True)
    found = cut(components(links).join(ids.select("node", "least_id"), "node"), narrow=True)
    classes = found.groupBy("label").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n"))
    found = spread_join(found.select("node", "label"), classes, ["label"], "n").drop("n")
    # a text with no link is a class of its own
    by_node = cut(
        ids.join(found, "node", "left").select(
            "node", F.coalesce("label", "node").alias("label"),
            F.when(F.col("label").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"), "copies"
        ),
        narrow=True
    )
    return spread_join(signed.select("id", "node"), by_node, ["node"], "copies").drop("copies")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, one of each near-duplicate class: that with the smallest id, then the smallest MD5 of the text; of rows equal in both, one."""
    rows = near_classes(docs, id_col, text_col, **options).groupBy("label", "id", "node").agg(F.count("*").alias("copies"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "copies")).alias("best")
    keep = cut(rows.groupBy("label").agg(best).select(F.col("best.id").alias("_nd_id"), F.col("best.node").alias("_nd_node"), F.col("best.copies").alias("_nd_copies")))
    body = docs.withColumn("_nd_own", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    joined = body.join(keep.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_nd_id")) & (F.col("_nd_own") == F.col("_nd_node")))
    out = joined.where("_nd_copies = 1").select(docs.columns)
    if keep.where("_nd_copies > 1").limit(1).count():
        out = out.unionByName(joined.where("_nd_copies > 1").dropDuplicates(["_nd_own", "_nd_id"]).select(docs.columns))
    return out


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_classes(docs)
    return out.select(F.col("id").alias("doc_id"), "class_id")
