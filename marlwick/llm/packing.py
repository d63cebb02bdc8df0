"""Best-fit packing of token pieces by hierarchical residual rounds.

Pieces below the capacity are dealt by hash to nodes, so each node sees the
whole distribution of lengths, and packed there by best fit, longest first.
Full bins are emitted. Others become items of the next round, where a node gets
the bins of FAN nodes, until one node is left; so that every task's input is
bounded, a node hands up the emptiest CARRY at most, and no nearly full ones.
Whatever is then in bins that aren't full, handed up or not, at any level, is
packed anew in one last round over all nodes: best fit needs only the number of
pieces of each length, of which there are fewer than the capacity, so the driver
plans that round on counts, and every piece finds its place by its rank among
those of its length.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, kept, written

END = 2
#: Words whose ids a worker keeps; when full the cache starts anew.
CACHE = 500_000
SPECIAL = "<|endoftext|>"
#: The vocabulary's own way to cut text into words, which byte-pair merges never cross, written out for texts
#: of these letters and signs alone, on which all Unicode versions agree. Other texts go to the library whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
OTHER = re.compile(rf"[^\t\n\r -~{LETTERS}¡¿«»–—‘’“”…€]")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, merged on first use."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = array("I", self.merge(word.encode())).tobytes()
        return ids


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merger(path: str):
    """A fast merge of one word's bytes, if the file's merges stand in the order of their ids; else None.

    Then the lowest rank is the lowest id, and the ids of a word are those that
    the library gives it. Only whole words are merged, so no pattern is needed.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, letters = file["model"], byte_letters()
    plain = file.get("normalizer") is None and not file["pre_tokenizer"].get("add_prefix_space") and file["pre_tokenizer"]["type"] == "ByteLevel"
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if not plain or ids != sorted(set(ids)) or any(model["vocab"].get(c, 256) > 255 for c in letters):
        return None
    made = set(letters) | {a + b for a, b in pairs}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t in made}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """Ids of the library's byte-level BPE as little-endian unsigned 32-bit bytes, with a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = self.library.token_to_id(SPECIAL)
        merge = merger(path)
        self.known = Words(merge) if merge and self.special is not None else None

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.known is None or OTHER.search(text):
            return self.whole(text)
        mark = np.array([self.special], "<u4").tobytes()
        return mark.join(b"".join(map(self.known.__getitem__, WORDS.findall(x))) for x in text.split(SPECIAL))


def cutter(path: str, capacity: int):
    """Partition function: the pieces of each document; a long one's first piece takes what is left over."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = kept(("packing", path), lambda: Encoder(path)), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                total, at, k = len(raw) // 4, 0, 0
                size = total % capacity or capacity
                while at < total:
                    rows.append((doc, k, at, size, zlib.crc32(raw[4 * at:4 * (at + size)])))
                    at, k, size = at + size, k + 1, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return cut


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size in the order given, and the fill of each bin: the fullest bin with room takes it."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    bins, offsets, fills = [], [], []
    for size in sizes:
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, fills


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """``best_fit`` of ``counts[size]`` items of each size, longest first, on counts alone: a table of runs, and the number of bins.

    A run (size, rank, bin, bins, offset) says where the items of a size from
    that rank on go: one into each of ``bins`` bins from ``bin`` on, then again
    one into each, behind the first, until the next run's rank.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: ranges of bins (first, number) that have it
    runs, made = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                room, first, n = capacity, made, max(1, left // (capacity // size))
                made += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            # A bin takes all it has room for before the next one's turn, as it is the fullest then.
            bins = min(n, max(1, left // (room // size)))
            each = min(left, room // size)
            if bins < n:
                rooms.setdefault(room, []).append((first + bins, n - bins))
            if room > each * size:
                rooms.setdefault(room - each * size, []).append((first, bins))
            runs.append((size, rank, first, bins, capacity - room))
            rank, left = rank + bins * each, left - bins * each
    return np.array(runs, np.int64).reshape(-1, 5), made


def packer(level: int, capacity: int, nearly: float, carry: int, last: bool, alone: bool):
    """Group function of a node: pack the items (pieces with the same sequence_id) and say which bins are done, go up or are left over.

    ``nth`` counts a node's left-over pieces of each length. A node that is
    ``alone`` has packed all there is, so all of its bins are done.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(end=rows["offset"] + rows["length"])
        items = rows.groupby("sequence_id", sort=False).agg(size=("end", "max"), length=("length", "max")).reset_index()
        # The order depends on the items alone, not on how they arrived, so a task that runs again packs alike.
        items = items.sort_values(["size", "sequence_id"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(items["size"].tolist(), capacity)
        fill = np.array(fills)
        state = np.where((fill == capacity) | alone, DONE, LEFT)
        if not last:
            waiting = np.flatnonzero(fill < nearly * capacity)
            state[waiting[np.argsort(fill[waiting], kind="stable")][:carry]] = UP
        node = int(rows["node"].iloc[0])
        placed = pd.DataFrame({"sequence_id": items["sequence_id"].to_numpy(), "bin": bins, "base": offsets})
        out = rows.merge(placed, on="sequence_id")
        out["offset"] += out["base"]
        out["sequence_id"] = (level << 56) + (node << 28) + out["bin"]
        out["state"] = state[out["bin"].to_numpy()]
        out["nth"] = out[out["state"] == LEFT].groupby("length").cumcount()
        out["nth"] = out["nth"].fillna(-1).astype(np.int64)
        return out[[x.split()[0] for x in PACKED.split(", ")]]

    return pack


def placer(shared):
    """Partition function: sequence_id and offset of pieces (columns of PIECES, rank) by the runs of ``best_fit_counts``."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, begin, first, bins, offset = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1].T
            row, at = np.divmod(rank - begin, bins)
            columns = [*batch.columns[:-1], pa.array((1 << 61) + first + at), pa.array(offset + row * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def settle(rest: DataFrame, capacity: int) -> DataFrame:
    """``rest`` (PIECES, sequence_id, offset, nth) in as few bins as best fit over all of it gives, or as it is if that saves none."""
    spark, names = rest.sparkSession, [x.split()[0] for x in PIECES.split(", ")]
    rest = rest.withColumn("owner", F.expr("sequence_id >> 28"))  # level and node
    counts = written(rest.groupBy("owner", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer rows than the capacity
    runs, made = best_fit_counts(totals, capacity)
    if made >= rest.where("offset = 0").count():
        return rest.select(*names, "sequence_id", "offset")
    # The runs of a size come in order of rank, so sorting by size puts them in order of both.
    shared = spark.sparkContext.broadcast(runs[np.argsort(runs[:, 0], kind="stable")])
    before = Window.partitionBy("length").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("owner", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rest.join(bases, ["owner", "length"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(frugal("packing", placer(shared)), PIECES + ", sequence_id long, offset long")


#: What becomes of a bin: it is emitted, goes to the next round, or is left for the last one.
DONE, UP, LEFT = range(3)
PACKED = PIECES + ", sequence_id long, offset long, node long, state int, nth long"


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 1024, per_node: int = 100_000, fan: int = 8,
                   nearly: float = 0.995, carry: int = 4096) -> DataFrame:
    """A row per piece of ``documents`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizers file on every machine. A null or
    empty text is the end token alone. Repeated rows are packed each; a null
    doc_id stays null. An empty table gives an empty result. Other columns are
    not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(rows.mapInArrow(frugal("packing", cutter(vocabulary, capacity)), PIECES), "pieces")
    names = [x.split()[0] for x in PIECES.split(", ")]
    full = pieces.where(F.col("length") == capacity).select(
        *names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    waiting = pieces.where(F.col("length") < capacity)
    nodes = max(1, math.ceil(waiting.count() / per_node))
    # At first every row is an item of its own; rows that are equal in all columns still differ in this number.
    waiting = waiting.withColumns({
        "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
        "node": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(nodes)),
    })
    level, parts, rests, alone = 0, [full], [], nodes == 1
    while True:
        packed = written(
            waiting.groupBy("node").applyInPandas(packer(level, capacity, nearly, carry, nodes == 1, alone), PACKED), "packed"
        )
        parts.append(packed.where(F.col("state") == DONE).select(*names, "sequence_id", "offset"))
        rests.append(packed.where(F.col("state") == LEFT).select(*names, "sequence_id", "offset", "nth"))
        if nodes == 1:
            break
        nodes, level = math.ceil(nodes / fan), level + 1
        waiting = packed.where(F.col("state") == UP).drop("state", "nth").withColumn("node", F.expr(f"node div {fan}"))
    if not alone:
        parts.append(settle(reduce(DataFrame.unionByName, rests), capacity))
    return reduce(DataFrame.unionByName, parts)
