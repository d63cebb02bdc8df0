"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive context.

A candidate is a long unbroken string in a line with a sensitive word, in the
line after it, or in the block of a private key. What it adds to the compressed size of the code around it is measured with a compressor
primed by two dictionaries, of code and of identifiers: names, paths and prose
are cheap there, random strings cost nearly their own entropy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base scan. Letters of the first are met in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hex digits is met from its first one, so whole runs of 32 are the long matches of [0-9a-f]+.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "novel")

#: A sensitive word. Its line and the next one are context, whatever identifier the word stands in.
SENSITIVE = re.compile(
    r"passw(?:or)?d|pass[-_ ]?phrase|pwd|secret|token|(?:api|private|access|auth|signing|encryption)[-_ ]?key|credential|bearer"
    r"|authori[sz]ation|signature|session[-_ ]?id", re.ASCII | re.IGNORECASE)
#: A block of a private key is context as a whole.
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----.*?(?:-----END|\Z)", re.DOTALL)
#: An unbroken string of 16 or more: all between two equal quotes, or a run without quotes, brackets, commas and semicolons.
LONG = re.compile(r"([\"'`])((?:(?!\1)\S){16,})\1|[^\s\"'`<>(){}\[\],;]{16,}")
#: The name and the sign before a value, in one run with it or not.
NAMED = re.compile(r"[A-Za-z_][\w.-]*(?:=>|:=|[:=])", re.ASCII)
NAME = re.compile(r"[A-Za-z_][\w.-]*[\"'`]?\s*[:=]", re.ASCII)

CODE = (
    "import os sys json requests def class return self.config = get(\"\") if not None else for in range(len( "
    "const let var function async await export default new require('') process.env. public static void main String "
    "private final int null true false https://www.example.com/api/v1/users?id= http://localhost:8080 /usr/local/bin "
    "SELECT * FROM WHERE INSERT INTO VALUES CREATE TABLE password = \"\" token: '' secret= api_key: Authorization: Bearer "
)
IDENTIFIERS = (
    "access_token_secret_key_client_id_user_name_password_hash_session_id_private_key_public_key_refresh_token "
    "accessTokenSecretKeyClientIdUserNamePasswordHashSessionIdPrivateKeyPublicKeyRefreshToken configuration "
    "connection_string database_url environment_variable authentication_service authorization_header certificate "
    "placeholder_example_changeme_your_token_here_xxxxxxxxxxxxxxxx_0123456789_abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ00000000000000000000000000000000 ................ ---------------- ================ "
)


@cache
def compressor(level: int = 6):
    import zstandard

    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + CODE).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Marginal compressed bytes for each byte of the candidate."""
    size = lambda text: len(compressor().compress(text.encode()))
    return (size(before + candidate + after) - size(before + after)) / len(candidate.encode())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def contexts(text: str) -> list[tuple[int, int]]:
    """Where strings are measured: lines with a sensitive word and those after them, and key blocks; merged, in order."""
    found = [m.span() for m in PEM.finditer(text)]
    at = 0
    while m := SENSITIVE.search(text, at):
        first = text.find("\n", m.end())
        first = len(text) if first < 0 else first
        second = text.find("\n", first + 1)
        found.append((text.rfind("\n", 0, m.start()) + 1, len(text) if second < 0 else second))
        at = first
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def novel_spans(text: str, least: float, around: int = 200) -> list[tuple[int, int, str]]:
    """Long strings in context whose novelty is ``least`` or more, with ``around`` characters of code on either side.

    Of a run with a name before its value, the value is measured first, then the whole run. Names with a sensitive word are
    context themselves and not measured.
    """
    out = []
    for low, high in contexts(text):
        for m in LONG.finditer(text, low, high):
            a, b = m.span(2) if m[1] else m.span()
            if not m[1]:
                b = a + len(text[a:b].rstrip(".:"))
            named, name = NAMED.match(text, a, b), NAME.match(text, a, high)
            context = name and SENSITIVE.search(text, a, min(b, name.end()))
            for start in ([named.end()] if named else []) + ([] if context else [a]):
                if b - start >= 16 and novelty(text[max(0, start - around):start], text[start:b], text[b:b + around]) >= least:
                    out.append((start, b, "novel"))
                    break
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in the fixed order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(least: float):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for i, kind in enumerate(KINDS[:3]):
                    out[i].append(sum(s[2] == kind for s in base))
                out[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[4].append(listed(base + novel_spans(text, least)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return rows


def find_secrets(documents: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``documents`` (doc_id, text).

    A span is the whole match in code points, end exclusive. base_sha256 is of
    the fixed patterns' spans alone; spans holds those of novel strings too.
    Null and empty texts have no spans. Map only: rows are independent, so
    repeated rows, nulls and other columns (not read) need no care.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan(least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
