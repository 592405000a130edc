"""MinHash near-duplicates with tensored banding.

Two collections of KEYS short minhash keys each are computed. A table's key pairs
one key of the first with one of the second, so KEYS * KEYS tables cost
2 * KEYS * ROWS minhashes instead of KEYS * KEYS * 2 * ROWS.

Equal shingle sets are one class from the start. In each bucket every class meets
the bucket's centre (the member that shares most buckets), and full sets confirm
or refuse the link. Members of a bucket whose components still differ after that
meet through their rarest shingles, with bounds from where these stand, so no link
of a bucket is lost while a group of n near copies costs n pairs, not n * n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Codes, discard, low_words, mixed, shingles, table, trimmed, word_hashes, written

WIDTH = 5  # words in a shingle
PERCENT = 75  # similarity of a link at least
KEYS, ROWS = 16, 3  # keys in each collection, minhashes in a key: at a similarity of 0.75 a pair shares a table with 0.9997
HOT = 10_000  # keys at most that are treated apart because many rows have them, so that they can be broadcast
AGREE = 58  # of the 2 * KEYS * ROWS minhashes, how many a pair to be confirmed shares; at 0.75 fewer have a probability of 5e-4


class Shingler:
    """texts -> sorted distinct shingle hashes; words' hashes are kept between batches until the codes start anew."""

    def __init__(self):
        self.words, self.hashes = Codes(), np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.words.full():
            self.hashes = self.hashes[:0]
        codes = [self.words.of(low_words(t)) for t in texts]
        if new := self.words.take():
            self.hashes = np.concatenate([self.hashes, np.array(word_hashes(new), np.uint64)])
        return [shingles(self.hashes[c], WIDTH) for c in codes]


def minhash_keys(sets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """2 * KEYS keys, each of ROWS minhashes, of a set that isn't empty, and each minhash's lowest byte."""
    least = np.min([((sets[k : k + 1024, None] ^ ~seeds[::-1]) * seeds).min(axis=0) for k in range(0, len(sets), 1024)], axis=0)
    rows = least.reshape(2 * KEYS, ROWS)
    out = np.arange(2 * KEYS, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k], 0x2545F4914F6CDD1D)
    return out.view(np.int64), mixed(least, 17).astype(np.uint8).view(np.int8)


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys, low): the size and two hashes of the whole set, its minhash keys and its
    minhashes' lowest bytes (null without shingles)."""
    seeds = np.random.default_rng(20240229).integers(1, 1 << 63, 2 * KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        shingle = Shingler()
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                sets = shingle(texts[k : k + 256])
                a = [int(mixed(s, 11).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                c = [int(mixed(s, 13).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                made = [minhash_keys(s, seeds) if len(s) else (None, None) for s in sets]
                columns = [ids.slice(k, len(sets)), pa.array(map(len, sets), pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64())]
                columns += [pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "keys", "low"])
        del shingle
        trimmed()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, low array<tinyint>")


def shingle_sets(documents: DataFrame) -> DataFrame:
    """(id, shingles) of whole texts; shingles are sorted and distinct."""

    def run(batches):
        shingle = Shingler()
        for b in batches:
            ids, texts = b.column("id"), b.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                sets = [s.view(np.int64) for s in shingle(texts[k : k + 256])]
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return documents.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def likely() -> Column:
    """Whether two classes' sizes allow a link and enough minhashes agree; columns na, nb, la, lb."""
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    agree = F.aggregate(F.zip_with("la", "lb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= AGREE
    return F.when(sizes, agree).otherwise(F.lit(False))


def crowded(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts), as a table: the keys that more than a bounded number of rows have, and how many tasks such rows fill. No more
    than HOT keys can have so many, so they may be broadcast."""
    bound = max(64, -(-rows.count() // HOT))
    return written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("parts")))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. sets: (id, shingles).

    A centre's pairs may be many: its set goes to as many tasks as they fill, and they are dealt to these by a."""
    hot = F.broadcast(crowded(pairs, "b").withColumnRenamed("b", "hot_b"))
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(hot, pairs["b"] == F.col("hot_b"), "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("salt"))
    as_b = sets.join(hot, sets["id"] == F.col("hot_b"), "left").select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("shingles").alias("sb"))
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(as_b, ["b", "salt"])

    def run(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            va, oa, vb, ob = a.values.to_numpy(), a.offsets.to_numpy(), b.values.to_numpy(), b.offsets.to_numpy()
            keep = []
            for i in range(len(a)):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= PERCENT * max(len(x), len(y)) else 0
                keep.append(shared > 0 and 100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def with_least(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """rows (u, v), n of them, with m: the least v of the same u; and the table of these, to discard later. Each task adds up its own
    rows first; the rows of a u that has many don't come together, but meet its minimum where they are."""
    least = written(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    bound = max(64, -(-n // HOT))
    hot = rows.join(F.broadcast(least.where(F.col("n") > bound).select("u", "m")), "u", "left")
    cold = hot.where(F.col("m").isNull()).drop("m").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return hot.where(F.col("m").isNotNull()).unionByName(cold), least


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in an edge; component is the smallest id reachable.

    Large-star and small-star steps in turn, until each component is a star around its smallest id. Each step is a
    group-by with a minimum and a join back, written in the shared folder before the next reads it."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, n = None, edges.count()
    while True:
        both, least = with_least(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        large = written(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())
        discard(edges, least)
        met, least = with_least(large, n)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct())
        discard(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def grouped(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of documents.

    A null or blank text has no shingles and is linked with nothing. Rows of one doc_id count as one document: their
    links are united. Rows without a doc_id are linked with nothing; their component_id is null and they are kept.
    An empty table gives no rows; columns other than doc_id and text are not read."""
    rows = written(signatures(documents))
    some = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    of_class = (F.any_value(c).alias(c) for c in ("n_shingles", "keys", "low"))
    classes = written(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), *of_class))
    as_a = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("low").alias("la"))
    as_b = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("low").alias("lb"))

    # Only keys that two classes share can make a shared table key; most classes have few.
    single = classes.select("id", F.explode("keys").alias("key"))
    shared = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    of_id = single.join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("shared")).join(classes.select("id", "keys"), "id")
    # Tables: an id and a key for each pair of a key of the first collection and one of the second.
    first, second = (F.array_intersect(F.slice("keys", 1 + k, KEYS), "shared") for k in (0, KEYS))
    paired = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x, y))))
    entries = of_id.select("id", F.explode(paired).alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = written(entries.join(buckets, "key"))
    weight = found.groupBy("id").agg(F.sum("n").alias("weight"))
    members = written(found.select("id", "key").join(weight, "id"))
    centres = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("b"))
    stars = members.join(centres, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    pairs = written(stars.join(as_a, "a").join(as_b, "b").where(likely()).select("a", "b"))
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    sets = written(shingle_sets(texts.join(weight, "id", "left_semi")))
    discard(found)
    links = written(confirmed(pairs, sets))
    done = [members, classes, pairs, sets, links]

    # Rows of one doc_id with different sets are one document, and so are equal sets.
    own = some.select("set_a", "set_b", "doc_id").distinct().join(classes.select("set_a", "set_b", "id"), ["set_a", "set_b"])
    alike = own.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    of = written(components(links))
    done.append(of)

    # Members that aren't in the component of their bucket's centre meet the others that lie in another component.
    home = members.join(of, "id", "left").select("key", "id", "weight", F.coalesce("component", "id").alias("component"))
    mixed_up = home.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("weight", (-F.col("id")).alias("l"), "component")).alias("top"))
    mixed_up = mixed_up.where("low < high").select("key", F.col("top.component").alias("main"))
    loose = home.join(mixed_up, "key").groupBy("id", "component").agg(F.bool_or(F.col("component") != F.col("main")).alias("apart"))
    loose = written(loose)
    done.append(loose)
    if not loose.isEmpty():
        rest = written(overlapping(loose, sets, done).join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
        done.append(rest)
        if not rest.isEmpty():
            links = links.union(confirmed(rest, sets))
    of = written(components(links.union(alike)))
    discard(*done)
    named = rows.join(of, rows["doc_id"] == of["id"], "left").select(rows["doc_id"], "n_shingles", F.coalesce("component", rows["doc_id"]).alias("component_id"))
    return named.select("*", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def overlapping(loose: DataFrame, sets: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of loose ids in different components, one of them apart, that may be similar enough.

    Shingles are put in one order, the rarest first. Two sets that are similar enough share one of their first
    n - ceil(n * PERCENT / 100) + 1 shingles, and where the first shared one stands bounds how many can follow. A passage
    that many documents hold comes late in that order, so documents that share little else don't meet. A shingle that many
    rows have is dealt to as many tasks as those rows fill. Tables to discard later are added to done."""
    of_loose = sets.join(loose.select("id"), "id", "left_semi")
    each = of_loose.select("id", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    common = each.join(often, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("common"))
    # Shingles of one set alone come first; they match nothing, so only their number matters.
    size, own = F.size("shingles"), F.size("shingles") - F.size("common")
    prefix = (size - F.ceil(size * F.lit(PERCENT) / 100) + 1).cast("int")
    rows = of_loose.join(common, "id").select("id", size.alias("n"), own.alias("own"), F.slice("common", F.lit(1), F.greatest(prefix - own, F.lit(0))).alias("head"))
    rows = rows.join(loose, "id").select("id", "component", "apart", "n", "own", F.posexplode("head").alias("at", "x"))
    rows = written(rows.select("id", "component", "apart", "n", (F.col("own") + F.col("at") + 1).alias("at"), F.col("x.s").alias("s")))
    done.append(rows)
    rows = rows.join(F.broadcast(crowded(rows, "s")), "s", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    x = rows.where("apart").select("s", each_part, F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    y = rows.select("s", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("salt"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("apart").alias("both"))
    once = ~F.col("both") | (F.col("a") < F.col("b"))
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    reach = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1) * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT
    met = x.join(y, ["s", "salt"]).where((F.col("ca") != F.col("cb")) & once & sizes & reach)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def without_copies(documents: DataFrame) -> DataFrame:
    """One row of each group, of the smallest doc_id; columns unchanged. Rows without doc_id stay.

    Of rows that repeat a doc_id the one of the smallest text stays, a null text counting as empty."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    lost = written(grouped(documents.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct())
    left = documents.join(lost, "doc_id", "left_anti").select(*columns)
    again = written(left.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id"))
    # Only repeated rows are grouped; the others pass as they are.
    once = left.join(again, "doc_id", "left_anti").select(*columns)
    first = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias("first"))
    return once.union(first.select("first.*"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLES: dict[str, str] = {}
