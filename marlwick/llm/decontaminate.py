"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be met with ``rate * n`` edits. It is split into
budget + 1 pieces, of which one at least must stand untouched in any such
meeting. One Aho-Corasick automaton holds the pieces of a block of items; each
hit names a window of the text, and windows of an item that overlap are merged
and verified with Myers' bit-parallel distance. Short items are met exactly, as
whole words.

Items are the stated query set and come in blocks of bounded size. A map-only
pass over all documents walks up to PASS_BLOCKS blocks, one automaton after the
other over the texts that a task holds; only a benchmark beyond that takes
another pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, kept

#: Characters of items that one block holds; the automaton of a block takes some hundred bytes for each.
BLOCK_CHARS = 1 << 19
#: Blocks of one pass, each a broadcast of bounded size, and characters of documents that a task walks with each of them in turn.
PASS_BLOCKS, HOLD_CHARS = 64, 1 << 24
#: Items of fewer characters are met as whole words, without an edit.
SHORT = 20

RESULT = "doc_id long, item_id long, distance int, start long, end long"
Items = tuple[tuple[int, str], ...]


def budget(item: str, rate: float) -> int:
    """Edits that a meeting of the item may have."""
    return int(rate * len(item)) if len(item) >= SHORT else 0


def normalise(text: str | None) -> str:
    """Lower case, with runs of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length, with their offsets."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least distance of the pattern to a substring of the text, end of the first such substring).

    Anchored: substrings that begin where the text begins.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    low = int(anchored)
    get = where.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | low
        pv = (mh << 1) & full | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def automaton(items: Items, rate: float):
    """The automaton of all pieces of the items, whose values are lists of (item index, offset in the item, piece length)."""
    import ahocorasick

    held: dict[str, list[tuple[int, int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for at, piece in pieces(item, budget(item, rate)):
            held.setdefault(piece, []).append((k, at, len(piece)))
    built = ahocorasick.Automaton()
    for piece, uses in held.items():
        built.add_word(piece, uses)
    built.make_automaton()
    return built


def whole_word(text: str, at: int) -> bool:
    """Whether no word of letters and digits goes on across this place."""
    return at == 0 or at == len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def windows(text: str, items: Items, rate: float, found) -> Iterator[tuple[int, int, int]]:
    """(item index, from, to): disjoint parts of the text that hold every place where the item can be met."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for last, uses in found.iter(text):
        for k, at, size in uses:
            n = len(items[k][1])
            slack = budget(items[k][1], rate)
            begin = last + 1 - size - at
            if n < SHORT and not (whole_word(text, begin) and whole_word(text, begin + n)):
                continue
            spans.setdefault(k, []).append((max(0, begin - slack), min(len(text), begin + n + slack)))
    for k, parts in spans.items():
        parts.sort()
        a, b = parts[0]
        for c, d in parts[1:]:
            if c < b:
                b = max(b, d)
            else:
                yield k, a, b
                a, b = c, d
        yield k, a, b


def meetings(text: str, items: Items, rate: float, found) -> Iterator[tuple[int, int, int, int]]:
    """(item index, distance, start, end) of the best meeting of each item in the normalised text."""
    best: dict[int, tuple[int, int]] = {}
    for k, a, b in windows(text, items, rate, found):
        item = items[k][1]
        distance, end = myers(item, text[a:b])
        if distance <= budget(item, rate):
            best[k] = min(best.get(k, (len(item) + 1, 0)), (distance, a + end))
    for k, (distance, end) in best.items():
        item = items[k][1]
        back = text[max(0, end - len(item) - distance):end][::-1]
        _, size = myers(item[::-1], back, anchored=True)
        yield k, distance, end - size, end


def in_pass(blocks: list, rate: float, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int, int]]]]]:
    """Each batch, whose texts are in its column ``text``, with the meetings of every text: (item_id, distance, start, end).

    ``blocks`` are broadcast Items. Texts are held up to HOLD_CHARS, so that an automaton is made once for each such
    lot; the automaton of a single block is kept by the worker.
    """
    held: list[tuple[pa.RecordBatch, list[str]]] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            texts = [normalise(t.as_py()) for t in batch.column("text")]
            held.append((batch, texts))
            size += sum(map(len, texts))
        if not held or (batch is not None and len(blocks) > 1 and size < HOLD_CHARS):
            continue
        found: list[list[list]] = [[[] for _ in texts] for _, texts in held]
        for shared in blocks:
            items = shared.value
            make = lambda: automaton(items, rate)  # noqa: B023, E731
            walk = kept(("decontaminate", items, rate), make) if len(blocks) == 1 else make()
            for (_, texts), rows in zip(held, found, strict=True):
                for text, row in zip(texts, rows, strict=True):
                    row += [(items[k][0], *rest) for k, *rest in meetings(text, items, rate, walk)]
        yield from zip((b for b, _ in held), found, strict=True)
        held, size = [], 0


def item_blocks(benchmark: DataFrame, shortest: int, block_chars: int) -> Iterator[Items]:
    """The items in blocks, one at a time on the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        text = normalise(row.text)
        if text and len(text) >= shortest:
            block.append((row.item_id, text))
            size += len(text)
        if size >= block_chars:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def passes(benchmark: DataFrame, shortest: int, block_chars: int) -> Iterator[list]:
    """Broadcast blocks, as many as one pass takes at a time."""
    context = benchmark.sparkSession.sparkContext
    blocks = item_blocks(benchmark, shortest, block_chars)
    while part := [context.broadcast(block) for block in islice(blocks, PASS_BLOCKS)]:
        yield part


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = 0.08, shortest: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a document and a test item met in it: doc_id, item_id, distance, start, end.

    ``documents`` (doc_id, text) and ``benchmark`` (item_id, text) are compared in
    lower case with runs of white space as one space; start and end are places
    in that form of the text, of the first meeting with the least distance.
    Items of under SHORT characters are met without an edit and as whole words;
    those of under ``shortest`` are left out (by default none). Documents without
    a leak have no row. Null or empty texts hold and leak nothing. Repeated rows
    and items are reported each; other columns aren't read.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def matcher(blocks):
        def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in in_pass(blocks, rate, batches):
                rows = [(doc, *x) for doc, own in zip(batch.column("doc_id").to_pylist(), found, strict=True) for x in own]
                columns = list(zip(*rows, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return match

    out = None
    for blocks in passes(benchmark, shortest, block_chars):
        part = texts.mapInArrow(frugal("decontaminate", matcher(blocks)), RESULT)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], RESULT) if out is None else out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = 0.08, shortest: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``documents``, all columns as they were, that hold no test item as ``find_leaks`` meets them.

    A map-only filter. Rows with a null text stay.
    """

    def keeper(blocks):
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in in_pass(blocks, rate, batches):
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        return keep

    out = documents
    for blocks in passes(benchmark, shortest, block_chars):
        out = out.mapInArrow(frugal("decontaminate", keeper(blocks)), documents.schema)
    return out
