"""J-8 by line range against a brute-force version."""

import random
from collections import Counter

from faultline.operators import smells

RELEASES = "project string, name string, release_id int"
METHODS = "project string, release_id int, path string, method_ord long, begin_line int, end_line int"
VIOLATIONS = "project string, release_name string, class string, beginline int"


def test_innermost_method_by_line_range(spark):
    r = random.Random(5)
    methods = [("p", 1, f"a/C{i % 4}.java", i, b, b + r.choice([0, 3, 40, 300])) for i in range(60) for b in [r.randrange(300)]]
    methods += [("p", 1, "b/C0.java", 900, 0, 900), ("p", 1, "a/C1.java", 901, None, None), ("p", 1, "a/C1.java", 902, 9, 4)]
    found = [("p", r.choice(["1.0", "9.9"]), f"C{r.randrange(5)}", r.choice([None, *range(0, 700, 7)])) for _ in range(800)]
    found += [("p", "1.0", "C2", 50)] * 500
    want = Counter()
    for _, release, c, line in found:
        held = [(e - b, -b, o) for _, _, path, o, b, e in methods
                if b is not None and line is not None and path == f"a/{c}.java" and b <= line <= e]
        if release == "1.0" and held:
            want[min(held)[2]] += 1
    rel = spark.createDataFrame([("p", "1.0", 1)], RELEASES)
    m, v = spark.createDataFrame(methods, METHODS), spark.createDataFrame(found, VIOLATIONS)
    for width in (1, 64, 10_000):
        got = smells.range_smell_counts(v, rel, m, width).collect()
        assert {x.method_ord: x.n_smells for x in got} == dict(want) and len(got) == len(want)
    assert smells.range_smell_counts(v.limit(0), rel, m).count() == 0
    assert smells.range_smell_counts(v, rel, m.limit(0)).count() == 0
