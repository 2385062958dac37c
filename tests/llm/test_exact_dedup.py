import hashlib
from collections import Counter

from faultline.llm import exact_dedup

from .conftest import awkward_rows, rows_of


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            kept = i == keep and first
            first &= not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_groups_equal_brute_force(awkward):
    got = awkward.transform(exact_dedup.group_copies)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute([(r[0], r[1]) for r in awkward_rows()]))


def test_drop_copies_keeps_one_row_a_text_with_all_columns(awkward):
    got = exact_dedup.drop_copies(awkward)
    assert got.columns == awkward.columns
    rows = rows_of(got, "doc_id", "text")
    assert [r[0] for r in rows if r[0] is not None] == sorted({b[1] for b in brute([(r[0], r[1]) for r in awkward_rows()]) if b[1] is not None})
    assert len({t or "" for _, t in rows}) == len(rows)
    assert rows_of(exact_dedup.drop_copies(awkward), "doc_id", "text") == rows


def test_filter_has_no_false_negative(spark):
    x = spark.range(4000).selectExpr("sha2(cast(id % 3500 as string), 256) AS d")
    flagged = exact_dedup.flag_repeats(x, "d", x.selectExpr("d AS _digest"))
    again = {r[0] for r in flagged.filter("_again").select("d").collect()}
    twice = {r[0] for r in x.groupBy("d").count().filter("count > 1").collect()}
    assert twice <= again and len(again) < 700


def test_beyond_the_broadcast_bound(awkward, monkeypatch):
    want = rows_of(exact_dedup.group_copies(awkward), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup, "BROADCAST_BLOCKS", 0)
    assert rows_of(exact_dedup.group_copies(awkward), "doc_id", "keep_id", "group_size", "kept") == want


def test_rows_beyond_the_broadcast_bound_do_not_join_the_filter(awkward, monkeypatch):
    want = rows_of(exact_dedup.drop_copies(awkward), "doc_id", "text")
    monkeypatch.setattr(exact_dedup, "BROADCAST_BLOCKS", -1)
    joined = []
    probe = exact_dedup.flag_repeats
    monkeypatch.setattr(exact_dedup, "flag_repeats", lambda df, *a: joined.append(df.columns) or probe(df, *a))
    got = exact_dedup.drop_copies(awkward)
    assert rows_of(got, "doc_id", "text") == want and got.columns == awkward.columns
    assert joined == [["_digest"]]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" not in plan


def test_empty(nothing):
    assert exact_dedup.group_copies(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0
