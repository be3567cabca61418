"""The catalogue on four items of two books."""

from pyspark.sql import functions as F

from granary.functions.letters import char_codes
from granary.functions.text import fold_native, loose_roman
from granary.operators import catalogue as C

ITEMS = [
    ("gss-1:0168:1", "gss-1", "prin-dyal-singh", 1, 913, 269, "a", "gauri", "bhairavi", None, "dadra", 1),
    ("gss-1:0171:1", "gss-1", "prin-dyal-singh", 2, 4284, 1208, "b", "sarang", "bhairavi", None, "teentaal", 0),
    ("gss-1:0174:1", "gss-1", "prin-dyal-singh", 3, None, None, None, None, "bhairavi", None, "dadra", 0),
    ("rr:0500:1", "rr", "prof-tara-singh", 1, 913, 269, "a", "gauri", "gauri_purbi", "gauri", "dadra", 0),
]
RAAGS = [("bhairavi", "Bhairavi", 0, None, 0), ("gauri", "Gauri", 1, None, 3), ("gauri_purbi", "Gauri Purbi", 1, "gauri", None), ("sarang", "Sarang", 1, None, 27), ("todi", "Todi", 1, None, 9)]


def ids(df):
    return [r.notation_id for r in df.orderBy(*C.item_order()).collect()]


def test_catalogue(spark):
    items = spark.createDataFrame(ITEMS, "notation_id string, book_key string, author_key string, ordinal int, shabad_id long, ang int, first_line string, raag_shabad_key string, raag_used_key string, raag_used_parent_key string, taal_key string, verified int")
    raags = spark.createDataFrame(RAAGS, "key string, english string, in_ggs int, parent_key string, ggs_order int")
    facet = C.raag_facet(items, raags, spark.createDataFrame([], "raag_key string")).orderBy("place").collect()
    assert [r.key for r in facet] == ["gauri", "gauri_purbi", "sarang", "bhairavi"]
    assert {r.key: (r.used, r.prescribed) for r in facet} == {"gauri": (0, 2), "gauri_purbi": (1, 0), "sarang": (0, 1), "bhairavi": (3, 0)}
    assert {(r.facet, r.key): r.n for r in C.facet_counts(items, ["taal_key", "author_key"]).collect()} == {("taal_key", "dadra"): 3, ("taal_key", "teentaal"): 1, ("author_key", "prin-dyal-singh"): 3, ("author_key", "prof-tara-singh"): 1}
    assert ids(C.list_items(items)) == ["gss-1:0168:1", "rr:0500:1", "gss-1:0171:1", "gss-1:0174:1"]
    assert ids(C.list_items(items, raag="gauri")) == ["rr:0500:1"] and len(ids(C.list_items(items, raag="bhairavi"))) == 3
    assert ids(C.list_items(items, verified=True)) == ["gss-1:0168:1"] and ids(C.list_items(items, shabad=913, author="prof-tara-singh")) == ["rr:0500:1"]
    m = spark.createDataFrame([(913, "other"), (4284, "b")], "shabad_id long, matched_line string")
    assert {r.notation_id: r.matched_line for r in C.list_items(items, matched=m).collect()} == {"gss-1:0168:1": "other", "rr:0500:1": "other", "gss-1:0171:1": None}
    named = C.cards(items, {"raag_used_key": (raags.filter("key <> 'bhairavi'"), "key", "english")}).collect()
    assert {r.raag_used_key: r.raag_used_key_name for r in named} == {"bhairavi": "bhairavi", "gauri_purbi": "Gauri Purbi"}
    images = spark.createDataFrame([("gss-1:0168:1", 2, "crop", None, "p2"), ("gss-1:0168:1", 1, "thumb", "u1", "p1")], "notation_id string, n int, kind string, url string, path string")
    one = C.item(items, images, "notation_id", "gss-1:0168:1").first()
    assert [i.n for i in one.images] == [1, 2] and one.others == 1
    assert C.page(C.list_items(items), C.item_order(), 2, 9)[1] == {"total": 4, "pages": 2, "page": 2}


def test_modes(spark):
    lines = spark.createDataFrame([(1, 0, "ਸਾਕਤ ਨਿੰਦਕ", "saakat nindak har", "snh"), (1, 1, "ਗੁਰ", "gur soochaa hovat", "gsh"), (2, 0, "ਮਨ", "man ram", "mr")], "g long, p int, n string, r string, l string")
    lines = lines.withColumns({"f": fold_native(F.col("n")), "r": loose_roman(F.col("r")), "c": char_codes(F.col("l"))})
    find = lambda q: {r.g: r.matched_line for r in C.match_lines(lines, "g", "p", q, shown="n", native="f", loose="r", letters="l", codes="c").collect()}
    assert find("ਸਾਕਤ") == {1: "ਸਾਕਤ ਨਿੰਦਕ"} and find("hovat soochaa") == {} and find("soochaa hovat") == {1: "ਗੁਰ"}
    assert find("gsh") == {1: "ਗੁਰ"} and find("g s h") == {1: "ਗੁਰ"} and find("zzzz") == {} and find("") == {}
    assert find("ਸਨਹ") == find("ਸ਼ਨਹ") == {1: "ਸਾਕਤ ਨਿੰਦਕ"} and find("ਗਸ਼ ਹ") == {} and find("ਗਸਹ") == {1: "ਗੁਰ"} and find("ਮਰ") == {2: "ਮਨ"}
    assert catalogue_images(spark) == {1: "p9", 2: "u", 3: None}


def catalogue_images(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    images = spark.createDataFrame([(1, 1, "full", None, "p9"), (2, 1, "thumb", "u", "p"), (2, 1, "full", "f", "p"), (3, 2, "thumb", "x", "y")], "k long, n int, kind string, url string, path string")
    return {r.k: r.image for r in C.with_images(items, images, "k").select("k", F.col("image")).collect()}
