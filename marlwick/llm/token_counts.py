"""Token counts of a sentencepiece model, with overlap resynchronisation for huge texts.

A huge text is encoded in overlapping chunks with offsets. Where the end of one
chunk and the encoding that begins inside the overlap both have a token start,
and no piece of the vocabulary holds the two characters around it side by side
(so no merge can ever cross it), the chunks are spliced. If an overlap holds no
such place it is widened, up to the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, kept

CHUNK, OVERLAP = 16_384, 256
SPACE = "▁"


class Counter:
    """Exact counts for one model. Texts of over ``chunk`` characters are spliced."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.pairs: set[str] = set()
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pairs.update(piece[k:k + 2] for k in range(len(piece) - 1))
        #: Splicing needs a model whose normaliser is the identity, with a leading space put before each text.
        self.exact = self.model.encode("a  bＡ ", out_type=str) and self.model.decode(self.model.encode("a  bＡ ")) == "a  bＡ " and self.model.encode(" a", out_type=str)[0].startswith(SPACE) and self.model.encode("a", out_type=str)[0].startswith(SPACE)

    def stable(self, text: str, at: int) -> bool:
        """No piece can hold text[at-1] and text[at], and a chunk that begins at ``at`` can be counted alone."""
        x, y = text[at - 1].replace(" ", SPACE), text[at].replace(" ", SPACE)
        return x + y not in self.pairs and (y == SPACE or SPACE + y not in self.pairs)

    def tail(self, text: str, at: int, to: int) -> tuple[list[int], int]:
        """Token starts of text[at:to] as it is encoded inside the text; ``at`` is 0 or stable."""
        if at and text[at] in (" ", SPACE):
            # The space that the library puts before a text stands for this one.
            starts = self.starts(text[at + 1:to], at + 1) if to > at + 1 else []
            return [at, *starts[1:]] if starts else [at], at
        starts = self.starts(text[at:to], at)
        return (starts[1:] if at else starts), at

    def starts(self, text: str, at: int) -> list[int]:
        """Places of the tokens of a text that stands at ``at``. The library's offsets are in bytes."""
        begins = [p.begin for p in self.model.encode(text, return_type="proto").pieces]
        if text.isascii():
            return [at + b for b in begins]
        bytes_of = np.cumsum([0, *(len(c.encode()) for c in text)])
        return (at + np.searchsorted(bytes_of, begins, "right") - 1).tolist()

    def long(self, text: str) -> int:
        count, at = 0, 0
        while True:
            overlap = self.overlap
            while True:
                to = min(len(text), at + self.chunk + overlap)
                left, _ = self.tail(text, at, to)
                if to == len(text):
                    return count + len(left)
                here = self.join(text, left, at + self.chunk, to)
                if here is not None:
                    break
                overlap *= 2
            count += sum(s < here for s in left)
            at = here

    def join(self, text: str, left: list[int], begin: int, to: int) -> int | None:
        """The first place in the overlap [begin, to) where both encodings start a token and no merge can cross."""
        ours = {s for s in left if begin < s < to}
        first = next((s for s in range(begin, to) if self.stable(text, s)), None)
        if first is None:
            return None
        theirs, _ = self.tail(text, first, to)
        return next((s for s in theirs if s in ours and self.stable(text, s)), None)

    def __call__(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk + self.overlap or not self.exact]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            counts[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            counts[i] = self.long(texts[i])
        return counts


def count_tokens(documents: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``documents`` (doc_id, text).

    ``model`` is the path of a sentencepiece model on every machine. Null texts
    count as empty: no bytes, no tokens. Map only, so repeated rows, null ids and
    other columns (not read) need no care.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(("tokens", model, chunk), lambda: Counter(model, chunk))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal("tokens", rows), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
