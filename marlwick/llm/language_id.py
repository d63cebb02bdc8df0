"""Language ID by prediction by partial matching.

Each language has a context tree over bytes: for every context of up to ORDER
bytes, how often each byte followed. A byte's code length under a language is
taken at the longest context seen there; a byte not yet met in it costs an
escape (method C: as many escapes as distinct successors) and is coded one
order lower, at last uniformly. Statistics are frozen after training, so a
byte's cost depends on it and the ORDER bytes before alone, and a whole text is
scored with a few table lookups for each byte: one row of a table holds the
costs in all languages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, release

ORDER = 4
LEAD = b" " * ORDER
#: Bytes that are scored at once; the arrays of a block take some eighty times as many.
BLOCK = 1 << 18
#: A-Z as a-z, digits as 0, white space as a space; other bytes as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))

MODEL = "lang string, k int, gram long, n long"


def folded(text: str) -> bytes:
    return text.encode().translate(FOLD)


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """For each place from ORDER on: the k bytes before it and its own, as a number."""
    key = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(k + 1):
        key |= data[ORDER - j:len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return key


def count_grams(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of all orders of one language's sampled texts."""
    out = []
    texts = [np.frombuffer(LEAD + folded(t), np.uint8) for t in rows["text"] if t]
    for k in range(ORDER + 1):
        key, n = np.unique(np.concatenate([grams(t, k) for t in texts]), return_counts=True) if texts else ([], [])
        out.append(pd.DataFrame({"lang": rows["lang"].iloc[0], "k": k, "gram": np.asarray(key, np.int64), "n": n}))
    return pd.concat(out)


class Table:
    """A hash table from distinct numbers to rows; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.levels, left, odd = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            slots = np.zeros(1 << self.bits, np.int32)
            at = self._slot(keys[left], odd)
            slots[at] = left
            self.levels.append((odd, slots))
            left = left[slots[at] != left]
            odd = (odd * 0xD1342543DE82EF95 + 0xDA3E39CB94B95BDB | 1) & (1 << 64) - 1

    def _slot(self, keys: np.ndarray, odd: int) -> np.ndarray:
        return (keys * np.uint64(odd)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it was found) of each key. An empty slot names row 0, which the comparison settles."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        (odd, slots), *rest = self.levels
        row = slots[self._slot(keys, odd)]
        found = self.keys[row] == keys
        left = np.flatnonzero(~found)
        for odd, slots in rest:
            if not len(left):
                break
            row[left] = at = slots[self._slot(keys[left], odd)]
            hit = self.keys[at] == keys[left]
            found[left[hit]] = True
            left = left[~hit]
        return row, found


class Model:
    """Frozen statistics of all languages: code lengths in bits."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        width = len(self.languages)
        lower_rows, lower = None, None
        self.costs: list[tuple[Table, np.ndarray]] = []
        self.escapes: list[tuple[Table, np.ndarray]] = []
        for k in range(ORDER + 1):
            of = counts[counts["k"] == k]
            keys = np.unique(of["gram"].to_numpy().astype(np.uint64))
            contexts = np.unique(keys >> np.uint64(8)) if k else np.zeros(min(1, len(keys)), np.uint64)
            # What a byte costs that the context doesn't have: an escape where the context is known, then the lower order.
            escape = np.zeros((len(contexts), width))
            cost = np.zeros((len(keys), width))
            if k:
                row, found = lower_rows.find(keys & np.uint64((1 << 8 * k) - 1))
                below = lower[row]
            else:
                below = np.full((len(keys), width), 8.0)
            where = np.searchsorted(contexts, keys >> np.uint64(8) if k else np.zeros(len(keys), np.uint64))
            for j, lang in enumerate(self.languages):
                own = of[of["lang"] == lang]
                place = np.searchsorted(keys, own["gram"].to_numpy().astype(np.uint64))
                n = own["n"].to_numpy().astype(float)
                total = np.bincount(where[place], n, len(contexts))
                distinct = np.bincount(where[place], minlength=len(contexts)).astype(float)
                known = total > 0
                escape[known, j] = np.log2((total + distinct)[known] / distinct[known])
                cost[:, j] = escape[where, j] + below[:, j]
                cost[place, j] = np.log2((total + distinct)[where[place]] / n)
            lower_rows, lower = Table(keys), cost
            self.costs.append((lower_rows, cost.astype(np.float32)))
            self.escapes.append((Table(contexts), escape.astype(np.float32)))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each folded text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        part: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for a in range(0, len(text), BLOCK):
                piece = (LEAD + text[:BLOCK] if not a else text[a - ORDER:a + BLOCK])
                part.append((i, piece))
                held += len(piece)
                if held > BLOCK:
                    self._add(part, out)
                    part, held = [], 0
        if part:
            self._add(part, out)
        return out

    def _add(self, part: list[tuple[int, bytes]], out: np.ndarray) -> None:
        data = np.frombuffer(b"".join(x for _, x in part), np.uint8)
        ends = np.cumsum([len(x) for _, x in part])
        # Every piece brings ORDER bytes of context, which aren't scored themselves.
        scored = np.ones(len(data), bool)
        for begin in [0, *ends[:-1]]:
            scored[begin:begin + ORDER] = False
        key = grams(data, ORDER)[scored[ORDER:]]
        cost = np.zeros((len(key), len(self.languages)), np.float32)
        left = np.arange(len(key))
        for k in range(ORDER, -1, -1):
            (table, values), (contexts, escape) = self.costs[k], self.escapes[k]
            row, found = table.find(key)
            if k == ORDER:
                cost[found] = values[row[found]]
            else:
                cost[left[found]] += values[row[found]]
            left, key = left[~found], key[~found]
            if not len(left):
                break
            if k:
                row, known = contexts.find(key >> np.uint64(8))
                cost[left[known]] += escape[row[known]]
                key = key & np.uint64((1 << 8 * k) - 1)
            else:
                cost[left] += (escape[0] if len(escape) else 0) + np.float32(8)
        starts = np.concatenate([[0], np.cumsum([len(x) - ORDER for _, x in part])[:-1]])
        sums = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _ in part], sums)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` (text, ...) of about BLOCK bytes of text, or one row where that is longer."""
    at, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for i, size in enumerate(sizes):
        if i > at and held + size > BLOCK:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, place, text) the first row of each place in a partition."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        new = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def training_rows(documents: DataFrame, per_language: int = 200, longest: int = 100_000, languages: int = 64, sample_bytes: int = 8 << 20) -> DataFrame:
    """(lang, text): the bounded sample that a model is trained on, of the rows that aren't held out and have a text and a lang.

    It has the ``languages`` commonest languages (ties by name) at most; of each
    the first ``per_language`` (at most 1000) different documents of up to
    ``longest`` bytes, by a hash of doc_id, as far as the language's even share
    of ``sample_bytes`` goes (the first one always). Which they are is settled
    on ids, lengths and hashes alone, of which each task keeps only its first
    ones. A document is a doc_id with a text; rows that repeat it count once in
    the sample, but may take several of a language's places.
    """
    usable = documents.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    common = [r.lang for r in common.collect()]
    share = sample_bytes // max(1, len(common))
    usable = usable.where(F.col("lang").isin(common) & (F.octet_length("text") <= longest))
    ids = usable.select("doc_id", "lang", F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_hash"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    first = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= min(per_language, 1000))
    chosen: dict[tuple, list] = {}
    for r in first.collect():  # languages * per_language rows of fixed size at most
        chosen.setdefault((r.lang, r.doc_id, r.text_hash), [r.place, r["size"]])
    held: dict[str, int] = {}
    rows = []
    for (lang, doc_id, text_hash), (place, size) in sorted(chosen.items(), key=lambda x: (x[0][0], x[1][0])):
        if lang not in held or held[lang] + size <= share:
            rows.append((lang, doc_id, text_hash, place))
            held[lang] = held.get(lang, 0) + size
    picked = documents.sparkSession.createDataFrame(rows, "_lang string, _doc_id long, _text_hash long, place int")
    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    found = usable.join(F.broadcast(picked), same).select("lang", "place", "text").mapInArrow(frugal("language", once), "lang string, place int, text string")
    # A text that was found by several tasks is still there once for each of them.
    return found.dropDuplicates(["lang", "place"]).select("lang", "text")


def train(documents: DataFrame, **options) -> Model:
    """A model of ``training_rows``. Its statistics, of ``sample_bytes`` of text at most, are all that reaches the driver."""
    counts = training_rows(documents, **options).groupBy("lang").applyInPandas(count_grams, MODEL).toPandas()
    model = Model(counts)
    del counts
    release()
    return model


def identify(documents: DataFrame, model: Model, schema: str = "doc_id long, held_out boolean, lang_pred string, score double") -> DataFrame:
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        model = shared.value
        for batch in (part for whole in batches for part in parts(whole)):
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            texts = [t if t and letter(t) else None for t in batch.column("text").to_pylist()]
            index = [i for i, t in enumerate(texts) if t is not None and model.languages]
            if index:
                bits = model.bits([folded(texts[i]) for i in index])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for i, b, s in zip(index, best, share, strict=True):
                    names[i], scores[i] = model.languages[b], float(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(frugal("language", rows), schema)


def language_id(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents`` (doc_id, text, lang).

    Trained by ``train`` on the rows whose crc32(doc_id) mod 5 isn't 0. score is
    the share of the best language among all, if each were as likely before.
    Texts that are null or have no letter, and all texts where nothing could be
    learned, are ``und`` with score 0. A null doc_id counts as not held out.
    """
    return identify(documents, train(documents, **options))


def drop_unknown(documents: DataFrame, least: float = 0.5, slack: float = 64, **options) -> DataFrame:
    """The rows of ``documents``, columns as they were, in a known language with a score of ``least`` or more.

    A text is in no known language if even its best one codes it in more bits
    than it has as plain bytes, and ``slack`` bits more, so that a few odd words
    don't decide. Texts that are null, empty or have no letter go; so does
    everything where nothing could be learned.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(documents, **options))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        model = shared.value
        for batch in (part for whole in batches for part in parts(whole)):
            kept = [bool(t and letter(t) and model.languages) for t in batch.column("text").to_pylist()]
            index = np.flatnonzero(kept)
            if len(index):
                column = batch.column("text")
                texts = [folded(column[int(i)].as_py()) for i in index]
                bits = model.bits(texts)
                best = bits.min(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - best[:, None], 1000)).sum(axis=1)
                for i, t, b, s in zip(index, texts, best, share, strict=True):
                    kept[i] = bool(s >= least and b <= 8 * len(t) + slack)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(frugal("language", keep), documents.schema)
