"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last ``WINDOW`` bytes has a fixed
pattern, so shared passages fall into the same chunks whatever stands before
them.  A worker encodes a chunk the first time it meets it and keeps the result
in a bounded store; later documents with that chunk reuse it.  A cut may fall
inside a word, so a chunk's first and last pieces are left open, and each join
is repaired by re-encoding: the span grows over the following chunks until it
ends at white space on both sides, where the tokenizer (its pre-tokenizer
drops white space and never merges across it) agrees exactly with an encoding
of the whole text.

Inside a new chunk, equal words are also encoded once.  Both stores are
bounded; what falls out is encoded again, with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty

WINDOW = 16
CUT_BITS = 9  # a cut every 512 bytes on average
SHORTEST, LONGEST = 64, 8192
CHUNKS_KEPT = 20_000
WORDS_KEPT = 200_000  # of each of two generations
#: A word of one token between unknown words that are encoded together, and how many.
MARK, LINE = "\x01", 256
MARK_BYTES = MARK.encode()
PART_CHARS = 4_000_000  # text encoded at once
#: White space at which the tokenizer surely splits.
SPACES = bytes.maketrans(b"\t\n\r", b"   ")
GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)

Encoded = tuple[int, str, str]  # number of ids, ids and decoded tokens, joined by spaces


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, never inside a character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= SHORTEST:
        return [len(b)] if len(b) else []
    g = GEAR[b]
    h, k = g, 1
    while k < WINDOW:  # the sum over 2k bytes is that over k bytes and, shifted, the one k bytes before
        g, h = h, h.copy()
        h[k:] += g[:-k] << np.uint32(k)
        k *= 2
    whole = np.ones(len(b), bool)
    whole[:-1] = (b[1:] & 0xC0) != 0x80
    # The upper bits have seen the whole window.
    marks = np.flatnonzero(((h >> np.uint32(32 - CUT_BITS)) == 0) & whole) + 1
    out, last = [], 0
    for at in [*marks.tolist(), len(b)]:
        while at - last > LONGEST:
            forced = last + LONGEST
            while not whole[forced - 1]:
                forced -= 1
            out.append(forced)
            last = forced
        if at - last >= SHORTEST:
            out.append(at)
            last = at
    if last < len(b):
        out.append(len(b))
    return out


def joined(parts: list[Encoded]) -> Encoded:
    counts, ids, plain = zip(*parts) if parts else ((), (), ())
    if 0 in counts:
        return joined([e for e in parts if e[0]])
    return sum(counts), " ".join(ids), " ".join(plain)


class Encoder:
    """Encodes byte texts with a tokenizer file; see the module text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks: dict[bytes, tuple[bytes, bytes | None, Encoded]] = {}
        self.known: dict[bytes, Encoded] = {}
        self.before: dict[bytes, Encoded] = {}  # the generation before; what is met again moves on
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # Ids in decimal, and the mark as it stands in lines of ids and of decoded
        # tokens; without a decoder those are the tokens, joined by spaces.
        self.decimal = [str(i) for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.between = f" {self.mark} ", f" {self.tokenizer.decode(mark, skip_special_tokens=False)} "
        self.plain_lines = self.tokenizer.decoder is None

    def learn(self, words: list[bytes]) -> None:
        """Encode and decode words that are not known yet.

        They are laid into lines with a mark between them: the tokenizer splits
        at white space, so each word gets the ids it has alone.  Words that
        hold the mark are encoded alone."""
        new = set(words).difference(self.known)
        if self.before:
            again = new.intersection(self.before)
            self.known.update((w, self.before[w]) for w in again)
            new -= again
        alone = [w for w in new if self.mark is None or MARK_BYTES in w]
        new = list(new.difference(alone) if alone else new)
        for i in range(0, len(new), LINE):
            self.learn_line(new[i:i + LINE])
        ids = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in alone], add_special_tokens=False)]
        self.keep(alone, ids)

    def learn_line(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([(b" " + MARK_BYTES + b" ").join(words).decode()], add_special_tokens=False)[0].ids
        if self.plain_lines and found:
            # A word without ids leaves two marks side by side, or one at an end, and so too few parts.
            tokens = " ".join([self.decimal[i] for i in found]).split(self.between[0])
            plain = self.tokenizer.decode(found, skip_special_tokens=False).split(self.between[1])
            if len(tokens) == len(plain) == len(words):
                self.known.update((w, (t.count(" ") + 1, t, p)) for w, t, p in zip(words, tokens, plain, strict=True))
                return
        ends = [k for k, x in enumerate(found) if x == self.mark]
        self.keep(words, [found[a:b] for a, b in zip([0, *[k + 1 for k in ends]], [*ends, len(found)], strict=True)])

    def keep(self, words: list[bytes], ids: list[list[int]]) -> None:
        plain = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        self.known.update((w, (len(i), " ".join(map(str, i)), p)) for w, i, p in zip(words, ids, plain, strict=True))

    def together(self, words: list[bytes]) -> Encoded:
        return joined(list(map(self.known.__getitem__, words)))

    def encode(self, texts: list[bytes]) -> list[Encoded]:
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks = {}
        if len(self.known) > WORDS_KEPT:
            self.before, self.known = self.known, {}
        split = []
        fresh: dict[bytes, list[bytes]] = {}
        for data in texts:
            ends = cuts(data)
            split.append([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            for c in split[-1]:
                if c not in self.chunks and c not in fresh:
                    fresh[c] = c.translate(SPACES).split(b" ")
        self.learn([w for pieces in fresh.values() for w in pieces[1:-1]])
        for c, pieces in fresh.items():
            tail = pieces[-1] if len(pieces) > 1 else None  # None: no white space in the chunk
            self.chunks[c] = (pieces[0], tail, self.together([w for w in pieces[1:-1] if w]))
        # Joins: the open end of what came before, and the open start of the next chunk.
        joins, plans = [], []
        for parts in split:
            plan: list = []
            open_end = b""
            for c in parts:
                head, tail, body = self.chunks[c]
                open_end += head
                if tail is not None:
                    plan += [open_end, body]
                    open_end = tail
            plan.append(open_end)
            joins += [w for w in plan if isinstance(w, bytes)]
            plans.append(plan)
        self.learn([w for w in joins if w])
        out = []
        for plan in plans:
            out.append(joined([self.known[x] if isinstance(x, bytes) else x for x in plan if x != b""]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder: its stores outlive a task and serve the worker's next ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded), one row per row of ``docs``; with
    ``digests`` instead of ids and decoded text their SHA-256 (ids in decimal,
    joined by one space).  ``path`` is a tokenizer file on every executor.
    Null texts count as empty: no ids, empty decoded text.  Repeated rows
    repeat their result; an empty table gives no rows; other columns are
    ignored; texts are read whole."""
    def work(ids, texts):
        encoder = encoder_for(path)
        out: list[list] = [[], [], []]
        part: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            part.append(t.encode())
            size += len(t)
            if size >= PART_CHARS or i == len(texts) - 1:
                for n, tokens, plain in encoder.encode(part):
                    out[0].append(n)
                    if digests:
                        out[1].append(hashlib.sha256(tokens.encode()).hexdigest())
                        out[2].append(hashlib.sha256(plain.encode()).hexdigest())
                    else:
                        out[1].append([int(x) for x in tokens.split()])
                        out[2].append(plain)
                part, size = [], 0
        return ids, *out

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_texts(docs, [F.col(f"`{id_col}`"), text_or_empty(text_col)], work, f"`{id_col}` {kind}, n_tokens long, {rest}")
