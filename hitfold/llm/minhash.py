"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

1. One pass makes, per document, its set size, a digest of its set and a SuperMinHash signature of ``BANDS * ROWS`` slots.
   Documents with equal sets are one class from here on, represented by the smallest doc_id.
2. Each band of a signature is a bucket key. Buckets with more than one class are candidates: a pair at the threshold
   of 0.8 shares none of the 32 bands of 4 rows with a probability below 5e-8.
3. Links are first looked for in stars. A bucket is dealt into parts of about ``STAR`` classes; all of a part are compared
   with its best connected member. Linked classes are united, and buckets whose classes have all met are done.
4. Classes of the other buckets may still have links between components. They are gathered into neighbourhoods (classes joined by such
   buckets) and dealt into blocks of about ``BLOCK``; two blocks meet in one task, which counts all their intersections as
   products of sparse rows. Blocks of one component don't meet themselves, nor blocks whose set sizes differ too much. Pairs
   never become rows; a task returns at most one link for each union it makes.
5. A comparison reads full sets. Only classes that are in some comparison have theirs made, in another pass over the texts
   that a bounded filter keeps narrow.

Links, components and signatures never reach the driver, only counts and the filter's bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitfold.llm.common import Membership, column_of, components, documents, mix, seeded, sliced, text_bytes, words, written

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 4
STAR, BLOCK = 512, 256
#: Shared shingles handled at once when two blocks meet.
COLUMNS = 4096
_WEIGHTS = [int(x) | 1 for x in seeded(23, 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row: ``n`` words each, or the whole sequence where it is shorter."""
    hashes, owner = words(data, offsets)
    edges = np.searchsorted(owner, np.arange(len(offsets)))
    whole = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        whole += hashes[k : k + len(whole)] * np.uint64(_WEIGHTS[k])
    whole = mix(whole)
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            short = sum(int(h) * w for h, w in zip(hashes[a:b], _WEIGHTS, strict=False)) + (b - a)
            yield mix(np.array([short & (1 << 64) - 1], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of a set of 64-bit hashes as ``m`` slots of level and fraction in one integer.

    Step j gives each element the j-th place of its own random permutation (Fisher-Yates) and a value in [j, j + 1); a slot keeps the
    least. All elements take a step together. Once every slot is filled, later steps only hold larger values, and the rest is skipped:
    large sets stop after one or two steps.
    """
    slots = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    x, order = elements, None
    for j in range(m):
        draw = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % (m - j)
        value = (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32))
        if j == 0:
            at, before = k, k
        else:
            if order is None:  # the state after step 0, made only for sets that need more steps
                order = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                rows = np.arange(len(x))
                order[rows, before], order[:, 0] = 0, before
            at = order[rows, k]
            order[rows, k] = order[:, j]
            order[:, j] = at
        np.minimum.at(slots, at, value)
        if int(slots.max()) >> 32 <= j:
            break
    return slots


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): digest names the set, bands are the bucket keys; both null for an empty set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, digests, keys = [], [], []
            for found in shingle_sets(*text_bytes(column_of(batch, "text")), shingle):
                sizes.append(len(found))
                if not len(found):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                table = superminhash(found, bands * rows).reshape(bands, rows)
                fold = np.arange(1, bands + 1, dtype=np.uint64)
                for c in range(rows):
                    fold = mix(fold * np.uint64(_WEIGHTS[c]) + table[:, c])
                keys.append(fold.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles): the packed full set of each document in ``wanted`` (doc_id), and perhaps of a few more."""
    held = Membership(wanted.select(F.xxhash64("doc_id").alias("h")), "h")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            batch = batch.filter(pa.array(held.holds(column_of(batch, "h").to_numpy().view(np.uint64))))
            if batch.num_rows:
                packed = [x.tobytes() for x in shingle_sets(*text_bytes(column_of(batch, "text")), shingle)]
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(packed, pa.binary())], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).filter("doc_id IS NOT NULL").mapInArrow(
        scan, "doc_id long, shingles binary"
    )


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Of ``pairs`` (a, b), those with 100 * intersection >= percent * union of the full sets."""
    sets = written(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), shingle).dropDuplicates(["doc_id"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(column_of(batch, "x"), column_of(batch, "y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([column_of(batch, "a"), column_of(batch, "b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(compare, "a long, b long")
    )


def between(docs: DataFrame, rest: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between components of one area: enough to unite all that any link unites.

    ``rest`` has one row a class: (rep, component, area).
    """
    sets = full_sets(docs, rest.select(F.col("rep").alias("doc_id")), shingle).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    sized = written(sets.join(rest, "rep").withColumn("size", F.length("shingles") / 8), "sets")
    # a component with half a block of classes has blocks of its own; the others share blocks; sizes of one block differ by little
    own = sized.groupBy("area", "component").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= BLOCK // 2).select("area", "component", F.lit(True).alias("large"))
    kind = (
        sized.drop("shingles").join(own, ["area", "component"], "left")
        .withColumn("pool", F.when(F.col("large"), F.col("component").cast("string")).otherwise(F.lit("")))
        .withColumn("band", F.floor(F.log(F.col("size")) / F.log(F.lit(1.25))))
    )
    many = kind.groupBy("area", "pool", "band").agg(F.count(F.lit(1)).alias("m"))
    dealt = written(
        kind.join(many, ["area", "pool", "band"])
        .select("rep", "area", "pool", "size", F.struct("pool", "band", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK)).alias("part")).alias("block")),
        "blocks",
    )
    block = dealt.groupBy("area", "pool", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count(F.lit(1)).alias("m"))
    left, right = block.alias("l"), block.alias("r")
    meet = left.join(right, "area").filter(
        (F.col("l.block") < F.col("r.block")) & ((F.col("l.pool") == "") | (F.col("l.pool") != F.col("r.pool"))) | (F.col("l.block") == F.col("r.block")) & (F.col("l.pool") == "") & (F.col("l.m") > 1)
    ).filter(f"100 * l.hi >= {percent} * r.lo AND 100 * r.hi >= {percent} * l.lo")
    meet = meet.select("area", F.xxhash64("area", "l.block", "r.block").alias("meeting"), F.explode(F.array(
        F.struct(F.col("l.block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("r.block").alias("block"), F.lit(1).alias("side"))
    )).alias("x")).select("area", "meeting", "x.block", "x.side")
    rows = dealt.select("rep", "area", "block").join(meet, ["area", "block"]).select("rep", "meeting", "side").join(sized.select("rep", "component", "shingles"), "rep")

    def compare(table):
        rows = table.sort_by([("side", "ascending"), ("rep", "ascending")]).to_pydict()
        sides = [[i for i, s in enumerate(rows["side"]) if s == k] for k in (0, 1)]
        found = linked([rows["shingles"][i] for i in sides[0]], [rows["shingles"][i] for i in sides[1]], percent)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in found:
            i, j = sides[0][i], sides[1][j]
            x, y = find(rows["component"][i]), find(rows["component"][j])
            if x != y:
                root[x] = y
                out.append((rows["rep"][i], rows["rep"][j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.select("meeting", "side", "rep", "component", "shingles").groupBy("meeting").applyInArrow(compare, "a long, b long")


def linked(left: list[bytes], right: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Index pairs of two lists of packed sets that are linked, by products of 0/1 rows over the shared shingles."""
    sets = [[np.frombuffer(x, np.uint64) for x in side] for side in (left, right)]
    flat = [np.concatenate(side) for side in sets]
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in sets]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, own in zip(flat, owner, strict=True):
        at = np.searchsorted(shared, values) if len(shared) else np.zeros(len(values), np.int64)
        hit = shared[np.minimum(at, len(shared) - 1)] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], own[hit][order]))
    for a in range(0, len(shared), COLUMNS):
        tables = []
        for (at, own), n in zip(places, both.shape, strict=True):
            lo, hi = np.searchsorted(at, [a, a + COLUMNS])
            table = np.zeros((n, min(COLUMNS, len(shared) - a)), np.float32)
            table[own[lo:hi], at[lo:hi] - a] = 1
            tables.append(table)
        both += tables[0] @ tables[1].T
    sizes = [np.array([len(x) for x in side], np.int64) for side in sets]
    both = np.rint(both).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return [(int(i), int(j)) for i, j in np.argwhere(100 * both >= percent * union)]


def grouped(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z; a set has the distinct shingles of ``shingle`` words, or the whole shorter sequence as one.
    Texts without words and null texts have an empty set and are alone. Rows that repeat a doc_id are equal as far as
    their texts are; each keeps a row of its own and all get one component. A row without doc_id is never linked: its component is null and it
    is kept. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = written(signatures(docs, shingle, bands, rows), "signatures")
    classes = written(own.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("rep", F.explode("bands").alias("bucket"))
    busy = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = spread.join(busy, "bucket").select("bucket", "rep", "n")
    links = None
    if busy.limit(1).count():
        degree = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
        active = written(buckets.join(degree, "rep").select("bucket", "rep", "n", "degree"), "buckets")
        dealt = active.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / STAR)))
        pivot = dealt.groupBy("bucket", "part").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("p"))
        pairs = dealt.join(pivot, ["bucket", "part"]).filter("rep <> p").select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b"))
        links = written(confirmed(docs, written(pairs.distinct(), "pairs"), percent, shingle), "links")
        met = written(components(links), "components")
        active = active.select("bucket", "rep").join(met.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        apart = active.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("hub")).filter("lo < hi")
        active = written(active.join(apart.select("bucket", "hub"), "bucket"), "buckets")
        if active.limit(1).count():
            near = components(active.select(F.col("hub").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("area"))
            rest = active.select("rep", "component").distinct().join(near, "rep")
            links = links.union(between(docs, written(rest, "areas"), percent, shingle))
    links = None if links is None else written(links, "links")
    members = classes.select("digest", "rep")
    if links is not None:
        members = members.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    else:
        members = members.withColumn("component", F.col("rep"))
    members = members.select("digest", F.coalesce("component", "rep").alias("component"))
    return (
        own.select("doc_id", "n_shingles", "digest").join(members, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id. Columns are unchanged."""
    gone = grouped(docs, percent, shingle).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The component of every document under links of 0.8 or more between shingle sets."""
    return grouped(documents(spark, sf_dir, "doc_id", "text"), shingle=4)
