import hashlib
import math
import re
from collections import Counter, defaultdict

from faultline.llm import mixing

from .conftest import awkward_rows


def brute(rows, weight_of, cap=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    weight = {s: weight_of(i) for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in sources:
        own = sorted((hashlib.md5(("-".join(([str(i)] if i is not None else []) + ["42"])).encode()).hexdigest(), -1 if i is None else i, size(t)) for i, t, x in rows if x == s)
        whole = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        want, upto = target[s] - whole * total[s], 0
        for _, i, n in own:
            upto += n
            out.append((None if i < 0 else i, n, total[s], round(target[s], 6), n * (whole + (upto - n / 2 < want))))
    return out


def rounded(df):
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in df.collect())


def test_sizes_equal_brute_force(awkward):
    got = mixing.mix_sizes(awkward)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = [(r[0], r[1], r[3]) for r in awkward_rows()]
    assert rounded(got) == Counter(brute(rows, lambda i: i % 3 + 1))


def test_clamped_sources_reshare_their_excess(spark):
    rows = [(i, "w " * 10, f"s{i % 7}" if i < 30 else "big") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df).collect()
    target = {r.source_size: r.target for r in got}
    assert sum({(r.source_size, r.doc_id % 7 if r.doc_id < 30 else 9): r.target for r in got}.values()) == 2000
    assert all(t <= 3 * n for n, t in target.items())
    taken = defaultdict(int)
    for r in got:
        taken[rows[r.doc_id][2]] += r.taken
    for s, n in taken.items():
        goal = next(r.target for r in got if rows[r.doc_id][2] == s)
        assert abs(n - goal) <= 5, (s, n, goal)  # half a document


def test_mixed_rows_agree_with_sizes(awkward):
    got = mixing.mix(awkward)
    assert got.columns == awkward.columns
    often = Counter(r.doc_id for r in got.collect())
    sizes = mixing.mix_sizes(awkward).collect()
    ids = Counter(r.doc_id for r in sizes)
    for r in sizes:
        if r.size and ids[r.doc_id] == 1:
            assert often[r.doc_id] == r.taken // r.size


def test_empty(nothing):
    assert mixing.mix_sizes(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0


def check_targets(rows, got, each):
    """``got``: (source key, taken words) pairs; every source comes within half a document of its target."""
    want = {}
    for _, n, total, target, _ in brute(rows, lambda i: i % 3 + 1):
        want[total] = (target, n)
    taken = defaultdict(int)
    for total, n in got:
        taken[total] += n
    for total, (target, _) in want.items():
        assert abs(taken[total] - target) <= each / 2 + 1e-6, (total, taken[total], target)


def test_rows_that_share_an_id_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "CHUNK", 100)
    for ids, texts in ((lambda i: 7, lambda i: "w w w w"), (lambda i: None, lambda i: f"w w w w{i}"), (lambda i: i % 2, lambda i: f"w w w w{i % 30}")):
        rows = [(ids(i), texts(i), "a" if i % 3 else "b") for i in range(1200)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        got = mixing.mix_sizes(df).collect()
        assert len(got) == len(rows)
        check_targets(rows, [(r.source_size, r.taken) for r in got], 4)
        assert all(r.taken <= 3 * r.size for r in got)
        mixed = Counter(map(tuple, mixing.mix(df).collect()))
        total = {"a": 3200, "b": 1600}
        check_targets(rows, [(total[r[2]], 4 * n) for r, n in mixed.items()], 4)
        held = Counter(rows)
        assert all(n <= 3 * held[r] for r, n in mixed.items())
        assert mixed == Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))  # reruns agree
