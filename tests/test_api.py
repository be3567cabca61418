"""Requests: the order of checks, codes, and that several indexes fuse."""

from granary.operators import lexical, reading
from granary.operators.encode import Encoder
from granary.plans import api
from granary.plans import tables as T

SF = "/root/testdata/sf0.001"


def test_requests(spark):
    rows = T.index(spark, SF)
    ix = {"a": api.Loaded(rows, encoder=Encoder()), "b": api.Loaded(T.index(spark, SF, "c"), ("neighbours",)), "p": api.Loaded(rows, ("text",), ("gurmukhi",), Encoder())}
    known = ["a", "b", "p", "z"]
    codes = lambda f, *xs: [f(ix, known, "a", *x).code for x in xs]
    assert codes(api.similar, ("z", "1"), ("q", "1"), ("p", "1"), (None, "x"), (None, "12")) == [503, 400, 400, 400, 200]
    assert codes(api.text, (None, "x" * 201), (None, ""), ("b", "x"), ("p", "x"), (None, "ਸ"), (None, "some words")) == [400, 200, 400, 400, 400, 200]
    one, many = api.similar(ix, known, "a", None, "12", "5"), api.similar(ix, known, "a", "all", "12", "5")
    assert one.told["score_kind"] == "cosine" and many.told["score_kind"] == "rrf"
    assert [r.id for r in one.rows.collect()] == [r.key for r in many.rows.collect()] and {r.votes for r in many.rows.collect()} == {2}
    corpora = {"x": api.Loaded(rows, encoder=Encoder()), "y": api.Loaded(rows)}
    w = lambda *a, **k: api.writings(corpora, *a, **k).code
    assert [w(" ", "q"), w("no", "q"), w("y", "q"), w("all", "q", work="w"), w("all", ""), w("x", "q")] == [400, 400, 503, 400, 200, 200]
    both = api.writings({"x": api.Loaded(rows, encoder=Encoder()), "y": api.Loaded(rows, encoder=Encoder())}, "all", "words", "4")
    assert [(r.corpus, r.unit) for r in both.rows.collect()][:2] == [(0, both.rows.first().unit), (1, both.rows.first().unit)]


def test_letters_and_groups(spark):
    lines = lexical.encode(T.lines(spark, SF).select("line_id", "letters"))
    tokens = lexical.tokens(lines)
    assert api.first_letters(lines, tokens, "x" * 201).code == 400
    a = api.first_letters(lines, tokens, "t", limit="3")
    assert a.rows.count() == 3 and a.told["total"] == lines.filter("letters LIKE '%t%'").count()
    assert api.first_letters(lines, tokens, "t", "start", "7").told["total"] == 7
    rows = T.index(spark, SF)
    owner = rows.selectExpr("id", "cast(label as long) as group_id")
    got = api.related_groups({"a": (rows, rows, rows)}, 12, [12, 13], owner, 5, 10).collect()
    assert 4 <= len(got) <= 5 and all(r.key != 12 for r in got)
    q = Encoder().query("words")
    assert api.retrieve_groups({"a": (rows, rows, rows)}, {"a": [q, q]}, owner, 5, 10).first().votes >= 2


def test_rows_light_up_and_carry_translations(spark):
    rows = spark.createDataFrame([(1, "koie n jwxY qyrw", "knjq"), (2, "njq ]1]", "n")], "line_id long, line string, letters string")
    lines = lexical.encode(rows)
    texts = spark.createDataFrame([(1, "b", "second"), (1, "a", ""), (2, "a", "x")], "line_id long, source string, text string")
    got = api.first_letters(lines, lexical.tokens(lines), "ਨਜ", text="line", texts=texts, views={"en": ["a", "b"], "pa": ["c"]}, langs="en,xx,pa")
    row = got.rows.first()
    assert got.told["total"] == 1 and (row.highlight.first, row.highlight.last, row.tr_en, row.tr_pa) == (1, 2, "second", None)
    pages = reading.with_lines(spark.createDataFrame([(7, "h")], "g long, head string"), "g", spark.createDataFrame([(7, 1, "b"), (7, 0, "a"), (8, 0, "c")], "g long, p int, t string"), "p", ["t"])
    assert [x.t for x in api.group(pages, "g", "7").rows.first().lines] == ["a", "b"] and api.group(pages, "g", "8").rows.first().head is None
    assert api.group(pages, "g", "9").code == 404 and api.group(pages, "g", "x").code == 400
