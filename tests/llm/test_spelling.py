import random
import re
import zlib
from collections import Counter

from faultline.llm import queries, spelling

from .conftest import rows_of


def counted(docs, change):
    total = Counter()
    for doc, text in docs:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            total[change(doc, run)] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def planted(doc, run):
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    close = {w: [v for m in (-1, 0, 1) for v in by_length.get(len(w) + m, []) if near(w, v)] for w in words}
    form = {}
    for w, around in close.items():
        if around:
            best = min(around, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), words.get(form.get(w))))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_query_equals_brute_force(spark, sf, small_docs):
    want = brute(counted([(d["doc_id"], d["text"]) for d in small_docs], planted))
    got = queries.op11_spelling(spark, sf)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert len(want) > 1000 and rows_of(got, *COLUMNS) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_pairs_at_every_place_and_refined_keys(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(1500)}
    words |= {"common" + "".join(r.choice("xyz") for _ in range(4)) for _ in range(60)} | {w + "tail" for w in ("aaaa", "aaab", "aaba", "aabac")}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) if len(a) > len(b) or len(a) == len(b) and a < b else (b, a) for a in words for b in words if a < b and near(a, b))
    for limit in (spelling.PAIRS, 1):  # one: every key is cut down to single letters
        assert sorted((p.a, p.b) for p in spelling.near_pairs(df, limit).collect()) == want


def test_refined_keys_are_small(spark):
    """Words that share half their letters do not meet as all pairs."""
    r = random.Random(5)
    words = sorted({"prefixhalfo" + "".join(r.choice("abcdefghij") for _ in range(11)) for _ in range(3000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert spelling.near_pairs(df, 100).count() == sum(near(a, b) for a, b in zip(words, words[1:], strict=False) if a[:21] == b[:21]) + sum(
        near(a, b) for i, a in enumerate(words) for b in words[i + 1:] if not a[:21] == b[:21] and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    ) + sum(near(a, b) for i, a in enumerate(words) for b in words[i + 2:] if a[:21] == b[:21])


def test_odd_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = brute(counted(rows, lambda doc, run: run))
    assert want and rows_of(spelling.variants(awkward), *COLUMNS) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert spelling.variants(nothing).count() == 0
    few = spark.createDataFrame([(1, "once only words"), (2, None)], "doc_id long, text string")
    assert spelling.variants(few).count() == 0


def test_forms_ties_and_chains(spark):
    text = " ".join(["house"] * 4 + ["mouse"] * 4 + ["douse"] * 2 * 4 + ["louse"] * 3 + ["lousex"] * 9 + ["lousexy"] * 20 + ["Ärger"] * 3 + ["ärger"] * 3 + ["÷×÷×÷"] * 3)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["house"].form == "douse" and got["house"].n_near == 3 and got["house"].form_n == 8
    assert got["louse"].form == "lousex" and got["louse"].root == "lousexy" and got["lousex"].form == "lousexy"
    assert got["lousexy"].form is None and got["lousexy"].root == "lousexy"
    assert got["Ärger"].form is None and got["Ärger"].n_near == 1  # only A-Z are lower-cased
    assert got["÷×÷×÷"].n_near == 0
