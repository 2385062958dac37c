import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from faultline.llm import bpe

from .conftest import awkward_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(texts, encoder=None):
    tok = library()
    for x, (n, ids, plain) in zip(texts, (encoder or bpe.Encoder(PATH)).encode([t.encode() for t in texts]), strict=True):
        want = tok.encode(x, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want), x[:80]
        assert plain == tok.decode(want, skip_special_tokens=False), x[:80]


def test_equal_to_the_library():
    r = random.Random(1)
    odd = ["", " ", "a", "x" * 5000, "ab " * 4000, "é́́ ́a", "ΑΣ ΟΔΟΣ σς", "hi <|endoftext|>there<|startoftext|> x", "a\x0bb\x0cc\x1cd\x85e f",
           "don't I'll we've 123 4,5", "İstanbul ǅ ﬁ", "日本語テキスト" * 3000, "a b", prose(4, 20000)]
    odd += ["".join(r.choice(["a", "B", " ", "'", "é", "1", "\n", "ń", "日", "🎉", "<|endoftext|>", "\t", "\x0b", " "]) for _ in range(r.randint(1, 2500))) for _ in range(150)]
    check(odd)


def test_chunks_are_reused_and_cuts_follow_content(monkeypatch):
    shared = prose(8, 3000)
    texts = [prose(s, 40) + " " + shared + " " + prose(s + 50, 40) for s in range(6)]
    encoder = bpe.Encoder(PATH)
    check(texts, encoder)
    total = sum(len(bpe.cuts(t.encode())) for t in texts)
    assert len(encoder.chunks) < total / 3
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 5)  # stores that overflow change nothing
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    check(texts + texts, encoder)


class Counting:
    """A tokenizer that counts the texts and the lists of ids given to it."""

    def __init__(self, tokenizer):
        self.of, self.given = tokenizer, 0

    def __getattr__(self, name):
        def call(x, **how):
            self.given += len(x) if "batch" in name else 1
            return getattr(self.of, name)(x, **how)

        return call


def test_new_words_meet_the_tokenizer_by_lines():
    words = [b"w%dx%d" % (i, i * i) for i in range(3 * bpe.LINE)]
    encoder = bpe.Encoder(PATH)
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    encoder.learn(words)
    assert counting.given <= 6
    tok = library()
    for w in words:
        want = tok.encode(w.decode(), add_special_tokens=False).ids
        assert encoder.known[w] == (len(want), " ".join(map(str, want)), tok.decode(want, skip_special_tokens=False))


def test_words_without_ids_share_a_line():
    check(["\u00a0", "\u2003", "a \u00a0 b", " ".join(f"\u00a0 v{i} \u2003 \u00a0" for i in range(900)), "\x01 a\x01 \x01b \u00a0 \x01"])
    for words in ([], ["\u00a0"], ["\u00a0", "a"], ["a", "\u00a0"], ["\u00a0", "\u2003"], ["a", "\u00a0", "\x01", "b"]):
        encoder = bpe.Encoder(PATH)
        encoder.learn([w.encode() for w in words])
        for w in words:
            assert encoder.known[w.encode()][0] == len(library().encode(w, add_special_tokens=False).ids)


def test_the_store_of_a_worker_stays_small():
    encoder = bpe.Encoder(PATH)
    for i in range(600_000):
        encoder.known[b"%d" % i] = (1, "1", "a")
        if i % 1000 == 0:
            assert encoder.encode([]) == []
    assert len(encoder.known) + len(encoder.before) < 450_000 and bpe.CHUNKS_KEPT <= 20_000


def test_cuts_cover_the_text_at_character_ends():
    for t in (prose(1, 4000), "é" * 30000, "日" * 9000, "a" * 20000, "x"):
        data = t.encode()
        ends = bpe.cuts(data)
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()
            assert b - a <= bpe.LONGEST + bpe.SHORTEST


def test_jobs(awkward, nothing):
    tok = library()
    texts = {r[0]: r[1] or "" for r in awkward_rows() if r[0] is not None}
    got = bpe.encode(awkward, PATH).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        if r.doc_id is not None:
            want = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == want and r.n_tokens == len(want) and r.decoded == tok.decode(want, skip_special_tokens=False)
    for r in bpe.encode(awkward, PATH, digests=True).collect():
        if r.doc_id is not None:
            want = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(tok.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(nothing, PATH).count() == 0


def test_whole_query_equals_the_library(spark, sf, small_docs):
    from faultline.llm.queries import QUERIES

    check([d["text"] or "" for d in small_docs])
    tok = library()
    got = {r.doc_id: r.ids_sha256 for r in QUERIES["op8_bpe"](spark, sf).collect()}
    assert got == {d["doc_id"]: hashlib.sha256(" ".join(map(str, tok.encode(d["text"] or "", add_special_tokens=False).ids)).encode()).hexdigest() for d in small_docs}
