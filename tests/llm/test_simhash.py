import random
import re

import numpy as np
import xxhash

from faultline.llm import simhash
from faultline.llm.components import components

from .conftest import awkward_rows


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    out = {}
    for f in fps:
        if f not in out:
            todo, seen = [f], {f}
            while todo:
                x = todo.pop()
                for y in fps:
                    if y not in seen and (x ^ y).bit_count() <= radius:
                        seen.add(y)
                        todo.append(y)
            out |= dict.fromkeys(seen, frozenset(seen))
    return out


def clustered(seed, groups=30):
    r = random.Random(seed)
    out = {0}
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(r.randrange(1, 60)):
            x = base
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_bit_sliced_kernels_equal_popcounts():
    for seed in range(4):
        fps = clustered(seed)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
        assert (simhash.near_in_block(fps) == near).all()
        group = np.sort(np.random.default_rng(seed).integers(0, 40, len(fps)))
        i, j = simhash.near_in_sweep(fps, group)
        want = {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1))) if group[a] == group[b]}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_radius_is_a_parameter():
    fps = clustered(9)
    for radius in (1, 2, 3, 5):
        assert (simhash.near_in_block(fps, radius) == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_groups_may_reach_over_batches():
    import pyarrow as pa

    fps = clustered(3)
    group = np.sort(np.random.default_rng(0).integers(0, 5, len(fps)))
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(group[a:b]), pa.array(fps[a:b].view(np.int64))], names=["g", "f"])
    links = lambda cuts: {(a, b) for x in simhash.links_of(batch(*c) for c in cuts) for a, b in zip(x[0].to_pylist(), x[1].to_pylist())}
    assert links([(0, len(fps))]) == links([(i, i + 7) for i in range(0, len(fps), 7)])


def test_components_of_long_paths_and_stars(spark):
    r = random.Random(2)
    ids = r.sample(range(10**6), 400)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[200], x) for x in ids[201:]]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(ids) and len({got[x] for x in ids[:200]}) == 1 and len({got[x] for x in ids[200:]}) == 1
    assert got[ids[0]] != got[ids[200]]


def test_links_span_all_components_with_small_blocks(spark):
    fps = clustered(5)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = {frozenset(c) for c in brute_components([int(f) for f in fps]).values() if len(c) > 1}
    for block in (2048, 8):  # 8: hot keys are cut into block pairs
        found = components(simhash.near_links(df, block=block)).collect()
        groups = {}
        for x in found:
            groups.setdefault(x.root, set()).add(x.node % 2**64)
        assert {frozenset(g) for g in groups.values()} == want


def test_groups_equal_brute_force(awkward):
    rows = [(r[0], brute_fingerprint(r[1])) for r in awkward_rows()]
    comp = brute_components([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    got = simhash.near_groups(awkward).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component) for r in got), key=str) == sorted(((i, f, least.get(comp[f])) for i, f in rows), key=str)
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    alone = {None for c in comp.values() if c not in least}  # a group whose ids are all null
    assert {r.doc_id for r in kept.collect()} == set(least.values()) | alone


def test_whole_query_equals_brute_force(spark, sf, small_docs):
    from faultline.llm.queries import QUERIES

    fp = {d["doc_id"]: brute_fingerprint(d["text"]) for d in small_docs}
    comp = brute_components(list(fp.values()))
    least = {}
    for i, f in sorted(fp.items(), reverse=True):
        least[comp[f]] = i
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in fp.items()}


def test_empty(nothing):
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0
