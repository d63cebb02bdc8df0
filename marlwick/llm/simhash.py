"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits share a variant that is within
one bit of both. So each distinct fingerprint emits itself and all its one-bit
variants; rows are shuffled on the variant and sorted, and neighbours in a
variant's group are linked. A group holds distinct fingerprints of one ball, so
it has bits + 1 members at most, all of them within two bits of each other: a
chain through it keeps every connection that all of its pairs would give.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import attach, frugal, heavy_keys, met, written

#: Shingles that are hashed at once; longer texts come in blocks.
BLOCK = 1 << 15
RADIUS = 2
#: Members of a bucket, or partners of a document, that one task takes together, about.
GROUP = 1024
#: Low bits of every least hash that a sketch keeps, and how many of such values must agree in a pair, in standard
#: deviations below what is expected at the similarity asked for. At six, one true pair in 10^7 or so would go.
PLANES, DEVIATIONS = 4, 6
#: Slots in which shingles are counted to put them in order; their counts are all that the driver gets and broadcasts.
SLOTS = 1 << 18


def shingles(text: str, words: int) -> Iterator[list[bytes]]:
    """Blocks of a text's shingles, repeats included. A-Z is lowered; words are parts between ASCII white space."""
    w = text.encode().lower().split()
    if 0 < len(w) < words:
        yield [b" ".join(w)]
    for a in range(0, len(w) - words + 1, BLOCK):
        part = w[a:a + BLOCK + words - 1]
        yield list(map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)))


def majority(text: str, words: int, digest: Callable[[bytes], bytes], width: int) -> bytes:
    """Bits set in over half the digests of the text's shingles; zero without shingles."""
    ones, n = np.zeros(8 * width, np.int64), 0
    for block in shingles(text, words):
        raw = np.frombuffer(b"".join(map(digest, block)), np.uint8).reshape(-1, width)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
        n += len(block)
    return np.packbits(2 * ones > n).tobytes() if n else bytes(width)


def fingerprints(words: int):
    """(doc_id, fp): 64 bits from XXH64 with seed 42; equal to Spark's xxhash64 of the shingle."""
    import xxhash

    digest = partial(xxhash.xxh64_digest, seed=42)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [int.from_bytes(majority(t.as_py() or "", words, digest, 8), "big", signed=True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return rows


def ball_links(fingerprints: DataFrame, bits: int = 64) -> DataFrame:
    """(a, b): neighbours in the balls of ``fingerprints`` (one column of distinct longs)."""
    points = fingerprints.toDF("fp")
    ball = F.expr(f"explode(concat(array(fp), transform(sequence(0, {bits - 1}), i -> fp ^ shiftleft(1L, i))))")
    order = Window.partitionBy("variant").orderBy("fp")
    met = points.select(ball.alias("variant"), "fp").select(F.lag("fp").over(order).alias("a"), F.col("fp").alias("b"))
    return met.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def simhash_components(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``documents`` (doc_id, text).

    Fingerprints link at two or fewer differing bits; component_id is the
    smallest doc_id that can be reached. A null text counts as empty; texts
    without words have fingerprint zero and are linked like any other. Null
    doc_ids are never the smallest unless a component has no other. Repeated
    rows come out repeated. Other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(rows.mapInArrow(frugal("simhash", fingerprints(words)), "doc_id long, fp long"), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    linked = components(ball_links(points.select("fp"))).join(points.select(F.col("fp").alias("node"), "least"), "node")
    linked = written(linked, "linked")
    roots = written(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held")), "roots")
    named = attach(linked.select("node", "root"), roots, ["root"], "held", ["node"]).select(F.col("node").alias("fp"), "component_id")
    groups = written(
        points.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "groups"
    )
    return attach(prints, groups, ["fp"], "n", ["doc_id"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def sketches(words: int, bands: int, depth: int):
    """(doc_id, text_hash, copy, fp, bands, planes) of (doc_id, text_hash, text): a digest of the text, its fingerprint, ``bands`` keys of ``depth`` least hashes each,
    and the least hashes' low bits, one bit plane after the other.

    A text without words has no bands.
    """
    import xxhash

    digest = partial(xxhash.xxh64_digest, seed=42)
    n_hashes = bands * depth
    odd = np.random.default_rng(42).integers(0, 1 << 63, n_hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    padded = -(-n_hashes // 64) * 64

    def sketch(text: str) -> tuple[int, list[int], list[int]]:
        ones, n = np.zeros(64, np.int64), 0
        least = np.full(n_hashes, (1 << 64) - 1, np.uint64)
        for block in shingles(text, words):
            raw = np.frombuffer(b"".join(map(digest, block)), np.uint8).reshape(-1, 8)
            n += len(block)
            hashes = raw.view(">u8").ravel().astype(np.uint64)
            for a in range(0, len(hashes), 2048):
                ones += np.unpackbits(raw[a:a + 2048], axis=1).sum(0, dtype=np.int64)
                np.minimum(least, np.multiply.outer(odd, hashes[a:a + 2048]).min(axis=1), out=least)
        low = np.zeros((PLANES, padded), np.uint8)
        low[:, :n_hashes] = least >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)
        planes = np.packbits(low).view(np.int64).tolist()
        if not n:
            return 0, [], planes
        fp = int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)
        keys = [xxhash.xxh3_64_digest(row.tobytes(), seed=i) for i, row in enumerate(least.reshape(bands, depth))]
        return fp, [int.from_bytes(k, "big", signed=True) for k in keys], planes

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, fps, keys, planes = [], [], [], []
            for value in batch.column(2):
                text = value.as_py()
                for column, x in zip((fps, keys, planes), sketch(text), strict=True):
                    column.append(x)
                copies.append(hashlib.sha256(text.encode()).digest()[:16])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(copies, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, lists), pa.array(planes, lists)],
                names=["doc_id", "text_hash", "copy", "fp", "bands", "planes"],
            )

    return rows


def alike(a: str, b: str, n_hashes: int, similarity: float) -> Column:
    """Whether so many of the least hashes agree in the arrays ``a`` and ``b`` of planes that the similarity isn't ruled out."""
    size = -(-n_hashes // 64)
    words = [" | ".join(f"({a}[{p * size + i}] ^ {b}[{p * size + i}])" for p in range(PLANES)) for i in range(size)]
    agree = similarity + (1 - similarity) / 2 ** PLANES
    most = n_hashes * (1 - agree) + DEVIATIONS * (n_hashes * agree * (1 - agree)) ** 0.5
    return F.expr(" + ".join(f"bit_count({w})" for w in words)) <= F.lit(most)


def shingle_sets(words: int):
    """(node, grams) of (node, text): the sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    digest = xxhash.xxh3_64_digest

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for t in batch.column(1):
                blocks = [np.unique(np.frombuffer(b"".join(map(digest, b)), np.int64)) for b in shingles(t.as_py(), words)]
                sets.append(np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["node", "grams"])

    return rows


def verified(pairs: DataFrame, points: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, n_hashes: int) -> DataFrame:
    """The ``pairs`` (a, b; no b in many of them) that ``roots`` leaves apart and whose ``sets`` reach the similarity.

    Pairs whose sketches in ``points`` (node, planes) rule it out go first, so
    that few sets are moved. An ``a`` that many pairs share is split by b, and
    its set goes to each part.
    """
    named = points.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "planes", F.coalesce("root", "node").alias("root"))
    heads = written(named.withColumnsRenamed({"node": "a", "planes": "a_planes", "root": "a_root"}).join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a"), "heads")
    known = attach(pairs, heads, ["a"], "n", ["b"]).join(named.withColumnsRenamed({"node": "b", "planes": "b_planes", "root": "b_root"}), "b")
    apart = known.where((F.col("a_root") != F.col("b_root")) & alike("a_planes", "b_planes", n_hashes, similarity))
    apart = written(apart.select("a", "b", F.expr(f"pmod(xxhash64(b), n div {GROUP} + 1)").alias("part")), "apart")
    firsts = written(apart.select("a", "part").distinct(), "firsts")
    first = met(sets.toDF("a", "a_grams"), firsts, ["a"])
    second = met(sets.toDF("b", "b_grams"), apart.select("b"), ["b"], "left_semi")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    return apart.join(first, ["a", "part"]).join(second, "b").where(
        both >= similarity * (F.size("a_grams") + F.size("b_grams") - both)
    ).select("a", "b")


def bucket_members(points: DataFrame) -> DataFrame:
    """(key, n, node, head, before, salt) of the members of buckets of two or more; ``points`` has node and keys, an array.

    One shuffle: rows are dealt by key and sorted. n is the size of a bucket,
    head its least node, before its member's neighbour in an order that differs
    from bucket to bucket (in a bucket of three, the order of nodes, so that
    head and before make all of its pairs). Buckets of over GROUP members are
    found beforehand and cut by salt (from 1; others have 0); head and before
    are then those of the part.
    """
    rows = points.select("node", F.explode("keys").alias("key"))
    heavy = rows.join(F.broadcast(heavy_keys(points.select("keys"))), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n_all"))
    hot = written(heavy.where(F.col("n_all") > GROUP), "hot")  # no more rows than heavy_keys gives
    salted = rows.join(F.broadcast(hot), "key", "left").withColumn(
        "salt", F.when(F.col("n_all").isNull(), F.lit(0).cast("long")).otherwise(F.expr(f"pmod(xxhash64(node), n_all div {GROUP} + 1) + 1"))
    ).drop("n_all")
    mine = Window.partitionBy("key", "salt").orderBy("node")
    whole = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = salted.select("key", "salt", "node", F.first("node").over(mine).alias("head"), F.count(F.lit(1)).over(whole).alias("n")).where("n > 1 OR salt > 0")
    mixed = F.when(F.col("n") <= 3, F.col("node")).otherwise(F.xxhash64("node", "key"))
    chain = Window.partitionBy("key", "salt").orderBy(mixed, "node")
    held = held.withColumn("before", F.lag("node").over(chain))
    return held.join(F.broadcast(hot), "key", "left").select("key", F.coalesce("n_all", "n").alias("n"), "node", "head", "before", "salt")


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the ``members`` of buckets whose nodes ``roots`` leaves in several classes.

    Buckets of up to three members are settled, as all of their pairs were verified.
    """
    large = members.where("n > 3").select("key", "n", "node").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    known = written(large.select("key", "n", "node", F.coalesce("root", "node").alias("root")), "known")
    mixed = known.groupBy("key").agg(F.first("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = written(mixed.where("low <> high").select("key", "n", F.lit(True).alias("mixed")), "mixed")
    return attach(known.select("key", "node", "root"), mixed, ["key"], "n", ["node"]).where("mixed").select("node", "root").distinct()


def gram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of a partition's (grams, ...): how many grams fall on each of SLOTS slots."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column("grams").flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot], pa.int64())], names=["slot", "n"])


def prefixes(shared, similarity: float):
    """(gram, node, root, size, place) of (node, root, grams): the first size - ceil(similarity * size) + 1 grams, from the rarest slots on."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            found, sizes = [], []
            for value in batch.column("grams"):
                grams = value.values.to_numpy() if len(value) else np.zeros(1, np.int64)
                sizes.append(len(grams))
                most = len(grams) - math.ceil(len(grams) * similarity - 1e-9) + 1
                found.append(grams[np.lexsort((grams, counts[grams & (SLOTS - 1)]))[:most]])
            taken = [len(x) for x in found]
            place = np.concatenate([np.arange(1, n + 1) for n in taken] or [np.zeros(0, np.int64)])
            each = lambda x: pa.array(np.repeat(np.asarray(x, np.int64), taken))  # noqa: B023, E731
            grams = pa.array(np.concatenate(found or [np.zeros(0, np.int64)]))
            columns = [grams, each(batch.column("node").to_numpy()), each(batch.column("root").to_numpy()), each(sizes), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "node", "root", "size", "place"])

    return rows


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of ``nodes`` (node, root) with different roots whose ``sets`` can reach the similarity.

    Shingles are put in one order for all sets, in about that from the rarest
    among the nodes to the commonest: by the count of their slot, of which there
    are SLOTS. Two sets that reach the similarity share one of their first
    size - ceil(similarity * size) + 1 shingles, and behind the first that they
    share there must be enough left for the rest; so nothing is lost, whatever
    the order. A shingle that many nodes have early is split on both sides.
    Nodes of its largest class meet the others only, so the rows that come out
    are pairs still apart. Empty sets count as having one shingle, 0.
    """
    own = written(met(sets, nodes, ["node"]).select("node", "root", "grams"), "own")
    slots = own.select("grams").mapInArrow(frugal("sets", gram_counts), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"].to_numpy(np.int64)] = slots["n"]
    shared = nodes.sparkSession.sparkContext.broadcast(counts)
    early = written(own.mapInArrow(frugal("sets", prefixes(shared, similarity)), "gram long, node long, root long, size long, place long"), "early")
    held = early.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("gram").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
    held = written(held.where("n > most"), "held")
    here = attach(early, held, ["gram"], "n", ["node"]).where("n IS NOT NULL")
    here = written(here.withColumns({"lefts": F.expr(f"n div {GROUP} + 1"), "rights": F.expr(f"(n - most) div {GROUP} + 1")}), "here")
    names = ["node", "root", "size", "place"]
    left = here.select("gram", "main", *(F.col(c).alias(f"l_{c}") for c in names), F.expr("pmod(xxhash64(node), lefts)").alias("i"), F.explode(F.expr("sequence(0L, rights - 1)")).alias("j"))
    right = here.where("root <> main").select("gram", *(F.col(c).alias(f"r_{c}") for c in names), F.expr("pmod(xxhash64(node), rights)").alias("j"), F.explode(F.expr("sequence(0L, lefts - 1)")).alias("i"))
    once = (F.col("l_root") == F.col("main")) | (F.col("l_node") < F.col("r_node"))
    most = F.least(F.col("l_size") - F.col("l_place"), F.col("r_size") - F.col("r_place")) + 1
    enough = most * (1 + similarity) >= (F.col("l_size") + F.col("r_size")) * similarity - 1e-9
    keys = (left["gram"] == right["gram"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    facing = left.join(right, keys & (F.col("l_root") != F.col("r_root")) & once & enough)
    pair = F.min(F.struct(F.col("r_node").alias("a"), F.col("l_node").alias("b"))).alias("pair")
    ends = [f(F.col("l_node"), F.col("r_node")).alias(c) for f, c in ((F.least, "low"), (F.greatest, "high"))]
    return facing.groupBy(*ends).agg(pair).select("pair.a", "pair.b")


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, depth: int = 6) -> DataFrame:
    """(doc_id, class_id, text_hash) of every document that isn't the first of its class; class_id is the first one's doc_id.

    One 64-bit ball of radius two meets few pairs at a Jaccard similarity of
    0.8, so texts that share one of ``bands`` keys of ``depth`` least hashes are
    candidates too (a pair at similarity s is met with probability
    1 - (1 - s^depth)^bands: 0.999 at 0.8). A candidate is a link if the shingle
    sets prove the similarity. Members of a bucket are compared with its least
    one and, if that leaves them apart, with neighbours in an order that differs
    from bucket to bucket. The members of larger buckets that are then still in
    several classes go through an exact join on their rarest shingles, so no
    link within a bucket is missed. Equal texts are one point from the start.
    Texts without words are alike. Rows with a null doc_id or text belong to no
    class.
    """
    spark, n_hashes = documents.sparkSession, bands * depth
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    made = written(texts.mapInArrow(frugal("sketches", sketches(words, bands, depth)), "doc_id long, text_hash long, copy binary, fp long, bands array<long>, planes array<long>"), "sketches")
    values = [F.any_value(c).alias(c) for c in ("text_hash", "fp", "bands", "planes")]
    copies = made.groupBy("copy").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *values)
    copies = written(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    prints = written(copies.groupBy("fp").agg(F.min("node").alias("node")), "points")
    ball = ball_links(prints.select("fp"))
    for end in ("a", "b"):
        ball = ball.withColumnRenamed(end, "fp").join(prints.select("fp", F.col("node").alias(end)), "fp").drop("fp")
    ball = written(ball.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "ball")
    # Texts of one fingerprint are a bucket like any other.
    members = written(bucket_members(copies.select("node", F.concat(F.array(F.xxhash64("fp")), "bands").alias("keys"))), "members")

    stars = members.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = members.where("salt > 0").groupBy("key", "salt").agg(F.min("head").alias("b"))
    heads = heads.join(F.broadcast(heads.groupBy("key").agg(F.min("b").alias("a"))), "key").where("a <> b").select("a", "b")  # hot keys alone
    stars = stars.union(heads)
    least = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    chains = members.where("before IS NOT NULL").select(F.col("before").alias("a"), F.col("node").alias("b"))

    needed = written(members.select("node").union(ball.select("a")).union(ball.select("b")).distinct(), "needed")
    points = met(copies.select("node", "least", "text_hash", "planes"), needed, ["node"], "left_semi")
    points = written(points, "sketched")
    owners = written(points.select("node", F.col("least").alias("doc_id"), "text_hash"), "owners")
    sets = met(texts, owners, ["doc_id", "text_hash"]).select("node", "text").mapInArrow(frugal("sets", shingle_sets(words)), "node long, grams array<long>")
    sets = written(sets, "shingles")
    if sets.count() > needed.count():  # repeated rows
        sets = written(sets.groupBy("node").agg(F.any_value("grams").alias("grams")), "shingles")
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    for candidates in (ball.union(least), stars.union(chains)):
        pairs = written(candidates.distinct(), "pairs")
        links = written(links.union(verified(pairs, points, sets, roots, similarity, n_hashes)), "links")
        roots = components(links)
    rest = written(unsettled(members, roots), "unsettled")
    if not rest.isEmpty():
        pairs = written(prefix_pairs(rest, sets, similarity), "pairs")
        links = written(links.union(verified(pairs, points, sets, roots, similarity, n_hashes)), "links")
        roots = components(links)
    linked = written(met(copies.select("node", "least", "copy"), written(roots, "roots"), ["node"]), "linked")
    first = linked.groupBy("root").agg(F.min(F.struct("least", "copy")).alias("first"))
    linked = linked.join(first, "root").select("node", "first.least", F.col("first.copy").alias("first_copy")).withColumnsRenamed({"node": "_node", "least": "class_id"})
    classed = copies.join(linked, F.col("node") == F.col("_node"), "left").select(
        "copy", "n", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("first_copy", "copy").alias("first_copy")
    )
    rows = attach(made.select("copy", "doc_id", "text_hash"), written(classed, "classes"), ["copy"], "n", ["doc_id"])
    return rows.where("doc_id <> class_id OR copy <> first_copy").select("doc_id", "class_id", "text_hash")


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` without those of ``near_duplicates``: the smallest doc_id of each class stays.

    Rows that repeat the document that stays stay too. Different texts with one
    doc_id are different documents; of two in one class the one with the least
    digest stays. Rows with a null doc_id or text stay.
    """
    gone = written(near_duplicates(documents, **options).select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct(), "gone")
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    return met(documents, gone, same, "left_anti").select(*documents.columns)
