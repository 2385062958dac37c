import hashlib
from collections import Counter

from pyspark.sql import functions as F

from faultline.llm import order_minhash as om

from .conftest import awkward_rows, prose


def test_edited_texts_equal_brute_force(awkward):
    got = om.edit_study(awkward)
    want = Counter()
    known = [(r[0], r[1] or "") for r in awkward_rows() if r[0] is not None]
    ids = Counter(i for i, _ in known)
    order = sorted(known, key=lambda x: -x[0])
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        if k + 1 < len(order) and ids[i] == 1 == ids[order[k + 1][0]]:
            want[(i, len(t), hashlib.sha256((t[:len(t) - n] + order[k + 1][1][:n]).encode()).hexdigest())] += 1
    rows = got.collect()
    assert len(rows) == len(awkward_rows())
    have = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    assert all(have[k] == v for k, v in want.items())
    by_text = {}
    for r, t in [(r, dict(known).get(r.doc_id)) for r in rows if r.doc_id is not None]:
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_last_is_followed_by_the_first(spark):
    df = spark.createDataFrame([(i, chr(97 + i) * 9) for i in range(26)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.edited_sha256 for r in om.edit_study(df, bucket_chars=20).collect()}
    assert got == {i: hashlib.sha256((chr(97 + i) * 6 + chr(97 + (i - 1) % 26) * 3).encode()).hexdigest() for i in range(26)}
    one = om.edit_study(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_occurrence_numbers(spark):
    import random

    r = random.Random(3)
    runs = sorted((r.randrange(6) << om.PLACE_BITS) | i for i in range(200))
    df = spark.createDataFrame([(runs,)], "s array<long>")
    got = df.select(F.transform("s", lambda x, i: om._occurrence(F.col("s"), x, i))).first()[0]
    seen, want = Counter(), []
    for x in runs:
        want.append(seen[x >> om.PLACE_BITS])
        seen[x >> om.PLACE_BITS] += 1
    assert got == want


def test_order_and_repeats_change_the_fingerprint(spark):
    a = prose(5, 400).split()
    texts = {"same": " ".join(a), "edit": " ".join(a[:200] + ["new"] + a[200:]), "swapped": " ".join(a[200:] + a[:200]),
             "reversed": " ".join(reversed(a)), "twice": " ".join(a + a), "other": prose(77, 400)}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    fp = {r.name: r.fp for r in om.with_fingerprint(df, "text", "fp").collect()}
    pair = lambda x, y: spark.createDataFrame([(fp[x], fp[y])], "a array<int>, b array<int>").select(om.likeness(F.col("a"), F.col("b"))).first()[0]
    assert pair("same", "edit") > 0.9
    assert pair("same", "swapped") < pair("same", "edit")  # the same k-mers in another order
    assert pair("same", "reversed") < 0.1 and pair("same", "other") < 0.1
    assert pair("same", "twice") < 0.9
    assert len(fp["same"]) <= om.BINS and len({x >> 24 for x in fp["same"]}) == len(fp["same"])


def test_moved_blocks_change_the_fingerprint_of_short_texts(spark):
    rows = []
    for n in (30, 50, 80, 100):
        for seed in range(20):
            a = prose(seed, n).split()
            rows.append((n, " ".join(a), " ".join(a[len(a) // 2:] + a[:len(a) // 2])))
    df = om.with_fingerprint(spark.createDataFrame(rows, "n int, a string, b string"), "a", "fa")
    got = om.with_fingerprint(df, "b", "fb").groupBy("n").agg(F.avg(om.likeness(F.col("fa"), F.col("fb"))).alias("like")).collect()
    print({r.n: round(r.like, 3) for r in got})
    assert len(got) == 4 and all(0.2 < r.like < 0.6 for r in got)


def test_empty(nothing):
    assert om.edit_study(nothing).count() == 0


def brute_fingerprint(text, k=om.K, bins=om.BINS):
    """The signature by dictionaries: Spark's hash is XXH64 with seed 42, each further value seeded by the hash so far."""
    import re
    import struct

    import xxhash

    def h(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed

    long = lambda v: struct.pack("<Q", v % 2**64)
    words = [h(w.encode()) for w in re.findall(om.TOKEN, text)]
    seen, by_bin = Counter(), {}
    for i in range(len(words)):
        v = h(*map(long, words[i:i + k])) % 2**32
        seen[v] += 1
        value = v if seen[v] == 1 else h(long(v), struct.pack("<i", seen[v] - 1)) % 2**32
        by_bin.setdefault(value * bins >> 32, []).append((value, i))
    least = {b: sorted(x)[:2] for b, x in by_bin.items()}
    out, order = [], sorted(least)
    for at, b in enumerate(order):
        pair = [least[b][0], least[b][1] if len(least[b]) > 1 else least[order[(at + 1) % len(order)]][0]]
        chosen = [long(v) for v, _ in sorted(pair, key=lambda p: p[1])]
        out.append(f"{b << 24 | h(*(chosen if len(words) > 1 else chosen[:1])) % 2**24:08x}")
    return "".join(out)


def test_fingerprints_equal_brute_force(awkward, spark, sf):
    want = Counter((r[0], brute_fingerprint(r[1] or "")) for r in awkward_rows())
    assert Counter((r.doc_id, r.fingerprint) for r in om.edit_study(awkward).collect()) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in om.edit_study(docs).collect()}
    bits = lambda f: {f[i:i + 8] for i in range(0, len(f), 8)}

    def like(a, b):
        return len(bits(a) & bits(b)) / len({x[:2] for x in bits(a) | bits(b)}) if a or b else 1.0

    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = r.text or "", after.text or ""
        edited = a[:len(a) - len(a) // 3] + b[:len(a) // 3]
        have = got[r.doc_id]
        assert (have.fingerprint, have.edited_fingerprint) == (brute_fingerprint(a), brute_fingerprint(edited))
        assert abs(have.near_edited - like(have.fingerprint, have.edited_fingerprint)) < 1e-9
        assert abs(have.near_next - like(have.fingerprint, brute_fingerprint(b))) < 1e-9
