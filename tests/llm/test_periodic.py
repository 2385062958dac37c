import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from faultline.llm import periodic, queries

from .conftest import rows_of


def runs_by_force(words):
    """Streaks of word i == word i + q for each q; smallest period by divisors."""
    x, out = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.empty(0, int), []
    for q in range(1, len(x) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, (x[q:] == x[:-q]).astype(int), 0]))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            whole = x[i:j + q]
            if len(whole) >= max(6, 4 * q) and not any((whole[p:] == whole[:-p]).all() for p in range(1, q) if q % p == 0):
                out.append((i, len(whole), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def summed(doc, words):
    runs = runs_by_force(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def split(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_query_equals_brute_force(spark, sf, small_docs):
    got = queries.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", *COLUMNS] and got.count() == len(small_docs)
    want = sorted((summed(d["doc_id"], planted(d["doc_id"], split(d["text"]))) for d in small_docs), key=str)
    assert sum(r[1] > 0 for r in want) > 10
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def texts():
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abc") for _ in range(k))
    out = [["a"] * n for n in (5, 6, 7, 100)] + [["a", "b"] * n for n in (3, 4, 50)] + [["a", "a", "b"] * 30, ["x", *["a", "b", "c"] * 4, "a", "y"]]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            base = [word(1) for _ in range(r.randrange(1, 14))]
            parts += (base * 12)[: r.randrange(1, len(base) * 9 + 2)] + [word(2) for _ in range(r.randrange(4))]
        out.append(parts)
    out += [[r.choice("ab") for _ in range(300)] for _ in range(20)]  # many short runs
    out.append([f"w{i}" for i in range(400)] * 5 + ["end"])
    out.append((["p", "q", "q"] * 7 + ["z"]) * 6)  # runs within a run
    return out


def fragments_of(x, width=periodic.TILE):
    for g, start, tile, marks in periodic.tiles(x, width):
        for q, a, b in periodic.fragments(g, tile.tolist(), marks.tolist()):
            yield q, start + a, start + b


@pytest.mark.parametrize("width", [1, 16, periodic.TILE])
def test_fragments_make_up_all_runs(width):
    for words in texts():
        by_period = {}
        for q, a, b in fragments_of(periodic.numbered(words), width):
            by_period.setdefault(q, set()).update(range(a, b))
        got = []
        for q, hits in by_period.items():
            for s in (i for i in hits if i - 1 not in hits):
                e = s
                while e in hits:
                    e += 1
                if e - s + q >= max(6, 4 * q):
                    got.append((s, e - s + q, q))
        assert sorted(got) == sorted(runs_by_force(words)), words


def test_z_function():
    r = random.Random(1)
    for _ in range(200):
        s = [r.choice("ab") for _ in range(r.randrange(0, 30))]
        z = periodic.z_function(s, 40)
        assert z == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_texts_and_odd_rows(spark, awkward, nothing):
    docs = spark.createDataFrame([(i, " ".join(w), 1, "x") for i, w in enumerate(texts())], "doc_id long, text string, rid int, g string")
    got = sorted((tuple(r) for r in periodic.periodic(docs.repartition(3)).collect()), key=str)
    assert got == sorted((summed(i, w) for i, w in enumerate(texts())), key=str)
    want = Counter(summed(r.doc_id, split(r.text)) for r in awkward.collect())
    assert Counter(tuple(r) for r in periodic.periodic(awkward).collect()) == want
    assert periodic.periodic(nothing).count() == 0


def test_long_text_spreads_over_tiles(spark):
    """100,000 equal words, and a long period: many tiles, few fragments."""
    same = np.zeros(100_000, np.int64)
    pieces = list(fragments_of(same))
    assert {q for q, *_ in pieces} == {1} and len(pieces) < 200
    long = [f"w{i}" for i in range(9000)] * 4 + ["end"]
    docs = spark.createDataFrame([(1, " ".join(["a"] * 100_000)), (2, " ".join(long))], "doc_id long, text string")
    assert rows_of(periodic.periodic(docs), "id", "n_runs", "start", "length", "period", "exponent_milli") == [(1, 1, 0, 100_000, 1, 100_000_000), (2, 1, 0, 36_000, 9000, 4000)]
