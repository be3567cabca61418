"""The similarity join against all pairs, and the subsequence kernel against the table."""

import random
import time

import pytest

from granary.functions import text
from granary.operators import similar, vocab
from granary.plans import notations, registry

SF = "/root/testdata/sf0.001"


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else 1 - (len(a) + len(b) - 2 * table(a, b)) / (len(a) + len(b))


def words(rng, n, letters, most):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize(("letters", "most"), [("ab", 12), ("abcdé😀\0ਕ", 70), ("xyz\U0010ffff", 200), ("ab", 400)])
def test_kernel_equals_the_table(letters, most):
    rng = random.Random(most)
    a, b = words(rng, 60, letters, most), words(rng, 60, letters, most)
    a[:3], b[:3] = ["", "abc", None], ["", "", "x"]
    got = text.indel_many(a, b)
    for x, y, g in zip(a, b, got, strict=True):
        assert (g != g) if x is None or y is None else g == ratio(x, y) == text.indel(x, y)


def test_kernel_is_fast():
    rng = random.Random(1)
    a, b = words(rng, 20_000, "abcdefghij ", 40), words(rng, 20_000, "abcdefghij ", 40)
    t = time.perf_counter()
    text.indel_many(a, b)
    fast = time.perf_counter() - t
    t = time.perf_counter()
    for x, y in zip(a[:1000], b[:1000], strict=True):
        ratio(x, y)
    assert (time.perf_counter() - t) * 20 > 5 * fast


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95, 1.0])
def test_join_loses_no_pair(spark, least):
    rng = random.Random(int(least * 100))
    names = {w for w in words(rng, 60, "abcde ", 14) + words(rng, 30, "ab", 5) + words(rng, 20, "abcdefgh", 40)}
    asked = set(words(rng, 60, "abcde ", 14)) | {"".join(c for c in w if rng.random() > 0.1) + rng.choice(["", "z"]) for w in names} | set(list(names)[:20])
    left = spark.createDataFrame([(w,) for w in [*asked, None, ""]], "x string")
    right = spark.createDataFrame([(w,) for w in [*names, None, ""]], "y string")
    got = {(r.x, r.y): r.ratio for r in similar.alike(left, "x", right, "y", least).collect()}
    want = {(x, y): ratio(x, y) for x in asked for y in names if x and y and ratio(x, y) >= least}
    assert got == want and want


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "x string")
    some = spark.createDataFrame([("abc",)], "y string")
    assert similar.alike(none, "x", some, "y", 0.8).count() == 0 and similar.alike(some, "y", none, "x", 0.8).count() == 0


def test_few_are_compared(spark):
    rng = random.Random(9)
    names, asked = (spark.createDataFrame([(w,) for w in {f"{rng.getrandbits(60):x}" for _ in range(700)}], f"{c} string") for c in "yx")
    assert similar.candidates(asked, "x", names, "y", 0.8).count() < 0.01 * 700 * 700


def test_names_are_found_without_a_nested_loop(spark):
    found = registry.queries()["vocab_lookup"](spark, SF)
    found.count()
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {r.method for r in found.select("method").distinct().collect()} >= {"alias", "skeleton", "fuzzy", "partial", "none"} and vocab.MARGIN and notations.queries()


def test_a_line_that_cannot_be_read_is_a_row(spark):
    from granary.operators import render

    rows = [("a", "S | R"), ("b", "??? not a line ⟨"), ("c", None)]
    got = {r.id: r for r in render.parsed(spark.createDataFrame(rows, "id string, line string"), "id", "line").filter("error IS NOT NULL").collect()}
    bad = []
    for k, x in rows:
        try:
            render.parse_line(x or "")
        except ValueError:
            bad.append(k)
    assert bad and sorted(got) == bad and all(r.error and r.kind is None and r.pos is None for r in got.values())
