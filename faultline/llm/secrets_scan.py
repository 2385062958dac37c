"""Secrets in texts: fixed patterns, plus random strings found by token efficiency.

A subword vocabulary packs ordinary writing into few tokens (four characters a
token and more) but splits random strings into pieces of one or two
characters.  Long unbroken strings whose characters-per-token ratio is low are
reported, after excluding what is random by nature but no secret: digests of
the usual lengths, UUIDs, numbers, and identifiers whose words are themselves
packed into few tokens.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty
from .spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

#: Below so many characters a token a string counts as random.
RATIO = 2.4
SHORTEST = 20
#: A string may stand after "="; at its end "=" is padding only if nothing follows.
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % SHORTEST)
# Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: snake_case, kebab-case, camelCase and paths of words, each with a number at most.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4})(?:[/_-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}(?![a-z])))*")


def find_plain(text: str) -> list[Span]:
    """Leftmost non-overlapping hits of each pattern; failing hits are dropped."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def excluded(s: str, tokens_of, ratio: float = RATIO) -> bool:
    """Digests, UUIDs, strings without letters, and identifiers of token-efficient words."""
    if ALL_HEX.fullmatch(s) and len(s) in DIGEST_LENGTHS or UUID.fullmatch(s):
        return True
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", s)
    if not words:
        return True
    pieces = len(words) + len(re.findall(r"[0-9]+", s))
    if not IDENTIFIER.fullmatch(s) or len(s) / pieces < 4:
        return False
    return sum(map(len, words)) >= ratio * sum(len(tokens_of(w.lower())) for w in words)


def find_random(text: str, tokens_of, ratio: float = RATIO) -> list[Span]:
    found = []
    for m in LONG.finditer(text):
        s = m.group()
        if len(s) < ratio * len(tokens_of(s)) and not excluded(s, tokens_of, ratio):
            found.append(("random", *m.span()))
    return found


def tokenizer(vocabulary: str):
    """Encoder over a rank file of a public tokenizer."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def find_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 ratio: float = RATIO) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_added): one row
    per row of ``docs``.  Counts and digest are of the pattern hits, ``spans``
    lists all, ``n_added`` counts random strings outside them.  ``vocabulary``
    is the path of a rank file on every executor.  Null and empty texts have
    no spans; repeated rows repeat their result; an empty table gives no rows;
    other columns are ignored; texts are read whole."""
    state: list = []

    def judge(ids, texts):
        if not state:
            state.append(tokenizer(vocabulary))
        rows = []
        for i, text in zip(ids, texts, strict=True):
            plain = find_plain(text)
            more = [s for s in find_random(text, state[0], ratio) if not any(p[1] < s[2] and s[1] < p[2] for p in plain)]
            counts = [sum(s[0] == k for s in plain) for k in KINDS[:3]]
            rows.append((i, *counts, digest(joined(plain, KINDS)), joined(plain + more, KINDS), len(more)))
        return zip(*rows, strict=True)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [F.col(f"`{id_col}`"), text_or_empty(text_col)], judge,
                     f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
