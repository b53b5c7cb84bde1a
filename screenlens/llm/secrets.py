"""Secret scan: patterns for known kinds, and a token-efficiency test for unknown ones.

Natural text needs few tokens for its characters; random strings need many. Every run of at least
`MIN_RUN` characters of the base64/URL alphabet that is not yet inside a match of a known kind is
encoded with a tiktoken vocabulary; with fewer than `MAX_RATIO` characters a token it is reported as
kind `random`. Digests of standard length, UUIDs, account numbers whose check digits are right, dates and
versions, and identifiers (words joined by `_`, `-`, `/` or case changes, with short numbers) are excluded first.

Kinds in order: assign, access, hex, random. Spans are code points, end exclusive.

Defined results: a null text counts as empty and has no span; repeated rows are scanned each for
itself; a text is scanned whole whatever its length; a run that meets a known kind is that kind alone; spans that begin together
go in the order of kinds; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune

#: The patterns of the known kinds and the least length of what they must catch.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: A text without any of these, in lower case, has no match of `assign`.
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Random strings of 16 characters and more, in any of the usual alphabets, have 1.1 to 2.3 characters a token (hex and base 32 the most).
MIN_RUN, MAX_RATIO = 16, 2.4
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]+)=*")
#: Account numbers with check digits; groups of digits and short words (dates, versions, part numbers).
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
NUMBERS = re.compile(r"[A-Za-z]{0,4}[0-9]{0,8}[A-Za-z]?(?:[-_/+T=][A-Za-z]{0,4}[0-9]{0,8}[A-Za-z]?)+")
#: Parts of an identifier: words by case, and numbers.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Characters a token that words of identifiers have at least, each by itself in lower case.
WORD_RATIO = 2.6
TOKENS = "byte_bpe_50k.tiktoken"
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@functools.lru_cache(4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENS)


def identifier(run: str, path: str) -> bool:
    """Whether a run is words and numbers.

    Without digits its words, parted by case or signs, have four letters on average: random letters change case more often.
    With digits, words of three letters or more make up half of it and are as cheap in tokens as words are.
    """
    parts = PART.findall(run)
    words = [p for p in parts if p.isalpha()]
    if len(words) == len(parts):
        return sum(map(len, words)) >= 4 * len(words)
    words = [w for w in words if len(w) >= 3]
    chars = sum(map(len, words))
    return 2 * chars >= sum(map(len, parts)) and chars >= WORD_RATIO * sum(len(encoder(path).encode_ordinary(" " + w.lower())) for w in words)


def account(run: str) -> bool:
    """Whether an account number's check digits (modulo 97) are right."""
    return ACCOUNT.fullmatch(run) is not None and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def mixed(run: str) -> bool:
    """At least two of: digits, capitals, small letters; and digits or case changes inside."""
    return (any(c.isdigit() for c in run) + any(c.isupper() for c in run) + any(c.islower() for c in run)) >= 2


def random_runs(text: str, taken: list[tuple[int, int]], path: str) -> list[tuple[int, int]]:
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, b in taken):
            continue
        run = m[0].strip("=-_/+")
        if len(run) < MIN_RUN - 2 or not mixed(run) or DIGEST.fullmatch(run) or NUMBERS.fullmatch(run) or account(run) or identifier(run, path):
            continue
        if len(run) < MAX_RATIO * len(encoder(path).encode_ordinary(run)):
            out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place), sorted by start and place."""
    out = []
    low = text.lower()
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign" and not any(c in low for c in CUES) or kind == "access" and "AKIA" not in text:
            continue
        # A run of hex digits is matched whole, so only runs that are long enough need be looked for.
        found = LONG_HEX.finditer(text) if kind == "hex" else pattern.finditer(text)
        out += [(m.start(), m.end(), k) for m in found if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan_text(text: str | None, path: str) -> tuple[int, int, int, str, str, int]:
    text = text or ""
    base = base_spans(text)
    more = random_runs(text, [x[:2] for x in base], path)
    names = [k[0] for k in KINDS] + ["random"]
    write = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, e, k in spans)
    count = [sum(x[2] == k for x in base) for k in range(3)]
    every = sorted(base + [(s, e, 3) for s, e in more], key=lambda x: (x[0], x[2]))
    return (*count, hashlib.sha256(write(base).encode()).hexdigest(), write(every), len(more))


def scan_udf(path: str | None = None):
    """Arrow UDF: text to the struct of SCHEMA; path: the tiktoken ranks."""
    path = path or vocabulary_path()

    @F.arrow_udf(SCHEMA)
    def scan(text: pa.Array) -> pa.Array:
        rows = [scan_text(t, path) for t in text.to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return scan.asNondeterministic()


def scan(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the columns of SCHEMA for every row of docs (doc_id, text)."""
    tune(spark)
    return docs.select("doc_id", scan_udf(path)("text").alias("r")).select("doc_id", "r.*")
