"""Full-text search: tokens, boolean queries, BM25 ranks and snippets.

A full-text table has a stored index beside each part: postings in order of term,
so that a search reads the row groups of its terms only, and shuffles nothing but
their postings. Without an index, a query is evaluated on each document's token
array with built-in array functions, in two scans and with no shuffle of documents.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DialectError, quote
from ..plans.syntax import Parser, Select

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}\p{M}\p{Pc}]+"


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # several for a phrase
    prefix: bool = False
    negated: bool = False


def words(text: str) -> tuple[str, ...]:
    import regex

    return tuple(w.casefold() for w in regex.findall(WORD, text))


def parse(query: str) -> list[list[Term]]:
    """Groups joined by OR; the terms of a group must all hold."""
    groups: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', query):
        minus, phrase, word = m[1] == "-", m[2], m[3]
        if word == "OR" and not minus:
            groups.append([])
        elif word == "AND":
            continue
        else:
            prefix = phrase is None and word.endswith("*")
            found = words(phrase if phrase is not None else word)
            if found:
                groups[-1].append(Term(found, prefix, minus))
    return [g for g in groups if any(not t.negated for t in g)]


@cache
def folds() -> tuple[dict[str, str], dict[str, str]]:
    """Of the characters that lower() leaves alone, those that a full case fold changes: into one, and into several."""
    found = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c.lower() == c != c.casefold()}
    return {c: f for c, f in found.items() if len(f) == 1}, {c: f for c, f in found.items() if len(f) > 1}


def ranges(chars: Iterable[str], gap: int = 1) -> str:
    """A regular expression's class of characters; those that lie up to ``gap`` apart are taken together with what is between them."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c - runs[-1][1] <= gap:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def folded(text: Column) -> Column:
    """The full case fold of a text, in the JVM: lower() and then, where a text has any, the characters that need more.

    Every text is matched with a class of a few ranges, as the JVM tries the
    members of a class one by one; only what it finds is looked at more closely.
    Letters newer than the JVM's Unicode stay as they are.
    """
    single, several = folds()
    several = {c: f for c, f in several.items() if c != "ß"}  # the common one, which is replaced first
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))

    def closely(low: Column) -> Column:
        moved = F.translate(low, "".join(single), "".join(single.values()))
        spelt = F.array_join(F.transform(F.split(moved, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.when(low.rlike(ranges(several)), spelt).otherwise(moved)

    # As a lambda's variable the lower case is computed once, however often it is read.
    low = F.array(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))
    return F.transform(low, lambda x: F.when(x.rlike(ranges([*single, *several], 64)), closely(x)).otherwise(x))[0]


def tokens(text: Column) -> Column:
    """Case-folded words of a text."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, term) of every token: an inverted index to write out, clustered by term."""
    return df.select(key, F.posexplode(tokens(F.col(column))).alias("pos", "term"))


def count(term: Term, of: str) -> str:
    """SQL for how often a term stands in the token array ``of``."""
    if term.prefix:
        return f"size(filter({of}, t -> startswith(t, {quote(term.words[0])})))"
    if len(term.words) == 1:
        return f"size(filter({of}, t -> t = {quote(term.words[0])}))"
    phrase = f"array({', '.join(map(quote, term.words))})"
    # Most texts lack a word of it, which is told faster than the places of all.
    some = " AND ".join(f"array_contains({of}, {quote(w)})" for w in dict.fromkeys(term.words))
    return f"CASE WHEN size({of}) >= {len(term.words)} AND {some} THEN size(filter(sequence(1, size({of}) - {len(term.words) - 1}), i -> slice({of}, i, {len(term.words)}) = {phrase})) ELSE 0 END"


def index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows to write for ``df``: a term, the document's key and length, and the term's places, in order of term in each partition.

    A document's places are grouped within its row, so nothing is shuffled, and a
    common term is spread over files as its documents are. A document without
    words has a row with a null term.
    """
    # Generators keep the optimizer from copying an expression to every place that reads it.
    held = df.select(key, F.explode(F.array(tokens(F.concat_ws("\n", *columns)))).alias("_tokens"))
    placed = F.sort_array(F.transform("_tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    placed = held.select(key, F.size("_tokens").alias("len"), F.explode(F.array(placed)).alias("_placed"))
    begins = F.expr("CASE WHEN len > 0 THEN filter(sequence(1, len), i -> i = 1 OR _placed[i - 1].term <> _placed[i - 2].term) ELSE array() END")
    begun = placed.select(key, "len", "_placed", F.explode(F.array(begins)).alias("_begins"))
    groups = F.expr("transform(_begins, (b, k) -> struct(_placed[b - 1].term AS term, slice(_placed, b, coalesce(get(_begins, k + 1), len + 1) - b).pos AS places))")
    grouped = begun.select(key, "len", F.explode_outer(groups).alias("_of"))
    return grouped.select("_of.term", key, "len", F.coalesce("_of.places", F.array().cast("array<int>")).alias("places")).sortWithinPartitions("term", key)


def asked(query: str) -> tuple[list[list[Term]], list[Term]]:
    """A query's groups, and its terms in a fixed order."""
    groups = parse(query)
    return groups, sorted({t for g in groups for t in g}, key=lambda t: (t.words, t.prefix, t.negated))


def ranked(counted: DataFrame, groups: list[list[Term]], terms: list[Term], total) -> DataFrame:
    """Of rows with ``_len`` and a count ``_tf`` for each term, those that a query matches, and their rank.

    ``total`` has n (documents), mean (their length) and df0, df1, ... (documents with each term).
    """
    where = None
    for g in groups:
        part = None
        for t in g:
            has = F.col(f"_tf{terms.index(t)}") > 0
            has = ~has if t.negated else has
            part = has if part is None else part & has
        where = part if where is None else where | part
    rank = F.lit(0.0)
    for i, t in enumerate(terms):
        if not t.negated:
            tf, n = F.col(f"_tf{i}"), total[f"df{i}"]
            idf = F.log(F.lit((total["n"] - n + 0.5) / (n + 0.5) + 1))
            rank = rank + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(float(total["mean"] or 1))))
    return counted.where(where).withColumn("rank", rank)


def search(df: DataFrame, columns: list[str], query: str, keep: list[str]) -> DataFrame:
    """Matching rows with ``keep`` and their BM25 rank over all ``columns``, best for high values; no index is wanted."""
    groups, terms = asked(query)
    text = F.concat_ws("\n", *columns)
    # A generator keeps the optimizer from copying the words' expression to every place that reads them.
    held = df.select(*keep, F.explode(F.array(tokens(text))).alias("_tokens"))
    counted = held.select(
        *keep, F.size("_tokens").alias("_len"), *(F.expr(count(t, "_tokens")).alias(f"_tf{i}") for i, t in enumerate(terms))
    )
    if not groups:
        return counted.where(F.lit(False)).select(*keep, F.lit(0.0).alias("rank"))
    total = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"),
        *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))),
    ).first()
    return ranked(counted, groups, terms, total).select(*keep, "rank")


def search_index(found: DataFrame, key: str, query: str, docs: int, length: int) -> DataFrame:
    """Keys and ranks of the documents that a query matches, from rows of ``index`` over ``docs`` documents of ``length`` words in all."""
    groups, terms = asked(query)
    if not groups:
        return found.where(F.lit(False)).select(key, F.lit(0.0).alias("rank"))
    wanted, counts = F.lit(False), []
    for i, t in enumerate(terms):
        if t.prefix:
            hit = F.col("term").startswith(t.words[0])
            counts.append(F.sum(F.when(hit, F.size("places")).otherwise(0)).alias(f"_tf{i}"))
        elif len(t.words) == 1:
            hit = F.col("term") == t.words[0]
            counts.append(F.sum(F.when(hit, F.size("places")).otherwise(0)).alias(f"_tf{i}"))
        else:
            hit = F.col("term").isin(*t.words)
            # A phrase begins at the places that all its words share, each moved back by its number in the phrase.
            begins = [
                F.coalesce(F.max(F.when(F.col("term") == w, F.expr(f"transform(places, p -> p - {j})"))), F.array().cast("array<int>"))
                for j, w in enumerate(t.words)
            ]
            both = begins[0]
            for b in begins[1:]:
                both = F.array_intersect(both, b)
            counts.append(F.size(both).alias(f"_tf{i}"))
        wanted = wanted | hit
    counted = found.where(wanted).groupBy(key).agg(F.first("len").alias("_len"), *counts)
    total = counted.agg(*(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first().asDict()
    return ranked(counted, groups, terms, total | {"n": docs, "mean": length / docs if docs else 0}).select(key, "rank")


def window(hits: list[tuple[int, str]], sentences: list[int], n: int, size: int) -> int:
    """Where the best n words of a text of ``size`` begin.

    A window scores 1000 for every different wanted word and 1 for every further
    one. Windows begin at a wanted word, and are then moved so that their hits
    stand in the middle, or at the sentence before it, for 120 more if that is
    the first and 100 if not. The first of the best wins.
    """
    def score(begin: int) -> tuple[int, int]:
        seen = [(p, w) for p, w in hits if begin <= p < begin + n]
        kinds = len({w for _, w in seen})
        last = seen[-1][0] + 1 if seen else begin
        return 1000 * kinds + len(seen) - kinds, last

    best, where = 0, 0
    for p, _ in hits:
        points, last = score(p)
        if points > best:
            best, where = points, max(0, min(p - (n - (last - p)) // 2, size - n))
        before = max((s for s in sentences if s <= p), default=p)
        if before < p:
            points = score(before)[0] + (120 if before == 0 else 100)
            if points > best:
                best, where = points, before
    return where


def snippet_of(text: str | None, wanted: tuple[tuple[str, bool], ...], begin: str, end: str, dots: str, n: int) -> str | None:
    """The best n words of a text, with marks around the wanted ones; the first n where there are none."""
    import regex

    if text is None:
        return None
    found = [(m.start(), m.end(), m[0].casefold()) for m in regex.finditer(WORD, text)]
    hit = [next((w for w, prefix in wanted if t == w or prefix and t.startswith(w)), None) for _, _, t in found]
    sentences = [0, *(i for i in range(1, len(found)) if text[found[i - 1][1]:found[i][0]].rstrip().endswith((".", ":")))]
    where = window([(i, h) for i, h in enumerate(hit) if h], sentences, n, len(found))
    last = min(len(found), where + n)
    out, at = [], found[where][0] if where else 0
    for (a, b, _), h in zip(found[where:last], hit[where:last], strict=True):
        out.append(text[at:a] + (f"{begin}{text[a:b]}{end}" if h else text[a:b]))
        at = b
    tail = text[at:] if last == len(found) else dots
    return (dots if where else "") + "".join(out) + tail


def snippet(text: str, query: str, begin: str = "<b>", end: str = "</b>", dots: str = "...", n: int = 10):
    """A column of snippets, vectorised Python on the matching rows only."""
    wanted = tuple((w, t.prefix) for g in parse(query) for t in g if not t.negated for w in t.words)

    @F.pandas_udf("string")
    def made(x: pd.Series) -> pd.Series:
        return x.map(lambda t: snippet_of(t, wanted, begin, end, dots, n))

    return made(text)


def matched(engine, sql: str, params: dict) -> DataFrame | None:
    """The rows of ``SELECT ... FROM t WHERE t MATCH 'query'`` on a full-text table, or None for any other query."""
    q = Parser(sql).query()
    if not isinstance(q, Select) or not q.where or q.where[0] != "match" or not q.source or q.source[0] != "table":
        return None
    name = q.source[1]
    t = engine.store.state.tables.get(name)
    if t is None or not t.fts:
        raise DialectError(f"{name} isn't a full-text table")
    text = params[q.where[2][1]] if q.where[2][0] == "param" else q.where[2][1][1:-1].replace("''", "'")
    found = search_index(engine.store.terms(name), "_rowid", text, *engine.store.words(name))
    out = []
    for node, alias in q.items:
        if node == ("star",):
            out += [F.col(f"`{c}`") for c in t.names()]
        elif node[0] == "col":
            out.append(F.col(f"`{node[2]}`").alias(alias or node[2]))
        elif node[0] == "fn" and node[1] == "SNIPPET":
            args = node[2]
            place = args[1]
            column = t.names()[int(place[1])] if place[0] == "int" else place[2]
            marks = [a[1][1:-1].replace("''", "'") for a in args[2:5]]
            out.append(snippet(column, text, *marks, int(args[5][1])).alias(alias or "snippet"))
        else:
            raise DialectError("a full-text query gives columns, rank and snippets")
    by_rank = not q.order or q.order[0][0] == ("col", None, "rank")
    if by_rank and q.limit is not None:  # only the rows that are given are looked up
        found = found.orderBy(F.desc("rank"), "_rowid").limit(q.limit + (q.offset or 0))
    found = found.join(engine.store.rows(name), "_rowid")
    found = found.orderBy(F.desc("rank") if by_rank else F.col(f"`{q.order[0][0][2]}`"), "_rowid")
    if q.limit is not None:
        found = found.limit(q.limit + (q.offset or 0)).offset(q.offset or 0)
    return found.select(*out)
