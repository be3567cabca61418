"""Queries on letters, folds and parameters over whole tables, each with SQL that works its answer out another way.

The tables hold Latin text. Where a function is for another script, the text is first written in it by a fixed spelling,
and the SQL says what the function makes of that spelling, from the Latin text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.letters import LETTERS
from granary.functions import keyboard
from granary.functions import letters as L
from granary.functions import text as X
from granary.functions.numeric import limit_of
from granary.operators import render, vocab
from granary.operators.encode import fingerprint_column
from granary.operators.reading import is_stanza_end
from granary.plans import tables as T

VIEWS = ("HIGH", "LOW", "URGENT")


def _spelled(v: Column) -> Column:
    """Some letters as dotted letters of the script, in one piece or with the dot after them."""
    for a, b in (("s", "ਸ਼"), ("g", "ਗ਼"), ("l", "ਲ਼"), ("d", "ਖ਼"), ("t", "ਕ")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def fl_query_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name, partly in the script and with dotted letters, as a query."""
    p = T.read(spark, sf, "part")
    typed = F.concat(F.lit(" "), _spelled(F.col("p_name")), F.when(F.col("p_size") > 25, "+").otherwise("\t"))
    return p.select("p_partkey", L.query_codes(typed).alias("codes"), L.has_operator(typed).alias("has_operator"), L.strip_dots(typed).alias("bare"))


def fl_prefix_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """How many tokens the range of each Latin letter holds."""
    asked = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "letter string")
    q = asked.select("letter", L.char_codes(F.col("letter")).alias("lo"), L.upper_bound(L.char_codes(F.col("letter"))).alias("hi"))
    t = T.tokens(spark, sf).groupBy(F.substring("token", 1, 8).alias("head")).agg(F.count("*").alias("n"))  # some hundreds of heads
    return t.join(F.broadcast(q), F.col("head").between(F.col("lo"), F.col("hi"))).groupBy("letter").agg(F.sum("n").alias("n"))


def fl_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """Which words of every line to light up for three letters, and which word each letter is from."""
    x = T.lines(spark, sf).select("line_id", "line")
    lit = x.select("line_id", L.highlight_words(F.col("line"), F.lit("ste")).alias("h"), L.word_of_letter(L.letters_of_words(F.col("line"))).alias("w"))
    return lit.select("line_id", T.shown(F.col("h.first")).alias("first"), T.shown(F.col("h.last")).alias("last"), F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


def fl_limits(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise((F.col("value") - 10) * 20)
    return T.read(spark, sf, "events").select("event_id", limit_of(v).cast("long").alias("n"))


def keyboard_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every letter's key, whether a physical key writes it, the letter that its sound writes if one key can, and how often the key is
    struck to type all parts' names and types."""
    own = {letter: key for key, letter in keyboard.physical().items()}
    rows = [(r, p, c, s, k, c in own, keyboard.SOUND_KEYS.get(s)) for r, p, c, s, k in keyboard.keys()]
    keys = spark.createDataFrame(rows, "row long, place long, letter string, sound string, key string, physical boolean, by_sound string")
    struck = T.read(spark, sf, "part").select(F.explode(F.split(F.concat("p_name", "p_type"), "")).alias("key")).groupBy("key").agg(F.count("*").alias("struck"))
    return keys.join(struck, "key", "left").select(*keys.columns, F.coalesce("struck", F.lit(0)).alias("struck"))


def keyboard_typed(spark: SparkSession, sf: str) -> DataFrame:
    """All parts' names as a typist on the physical keys would write them, and what first letters there are among it."""
    typed = keyboard.typed(F.col("p_name"))
    return T.read(spark, sf, "part").select("p_partkey", typed.alias("typed"), keyboard.main_letters(typed).alias("letters"))


def fold_native_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with dotted letters and doubled signs, folded."""
    x = T.lines(spark, sf)
    return x.select("line_id", X.fold_native(X.nfc(F.concat(_spelled(F.col("line")), F.lit(" ੱ  x")))).alias("folded"))


_VOWELS = {"a": "ਾ", "i": "ਿ", "u": "ੁ", "e": "ੇ", "o": "ੋ"}
_CONSONANTS = {"b": "ਬ", "c": "ਚ", "d": "ਡ", "f": "ਫ", "g": "ਗ", "h": "ਹ", "j": "ਜ", "k": "ਕ", "l": "ਲ", "m": "ਮ", "n": "ਣ", "p": "ਪ", "q": "ਕ", "r": "ਰ", "s": "ਸ", "t": "ਟ", "v": "ਵ", "w": "ਵ", "x": "ਕ", "y": "ਯ", "z": "ਜ"}
_SCRIPT = _VOWELS | _CONSONANTS


def _in_script(v: Column | str) -> Column:
    return F.translate(F.lower(v), "".join(_SCRIPT), "".join(_SCRIPT.values()))


def vocab_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds and skeletons of every part's name with its brand, in both scripts; in the script with a dot, a doubling sign, an
    invisible joiner and a stop word."""
    name = F.concat_ws(" ", "p_name", F.lower("p_brand"), F.initcap("p_type"))
    p = T.read(spark, sf, "part").select("p_partkey", name.alias("latin"), F.concat(F.lit("ਰਾਗ "), _in_script(F.concat_ws("‍ ", "p_name", "p_type")), F.lit("਼ ੱ")).alias("native"))
    both = p.select("p_partkey", vocab._fold(False, ["small"])(F.col("latin")).alias("latin"), vocab._fold(True, ["ਰਾਗ"])(F.col("native")).alias("native"))
    return both.select("p_partkey", "latin", vocab.skeleton(F.col("latin"), False).alias("latin_skeleton"), "native", vocab.skeleton(F.col("native"), True).alias("native_skeleton"))


def native_digits(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders")
    shown = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "".join(chr(0xA66 + i) for i in range(10)))
    return o.select("o_orderkey", X.native_digits(F.concat(shown, F.lit("a"))).alias("digits"))


def word_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every turn of a conversation, parts by dandas; counters and the refrain's marker are no words."""
    c = T.read(spark, sf, "conversations").filter("text IS NOT NULL")
    line = F.concat(F.replace(F.col("text"), F.lit("."), F.lit("।")), F.lit("॥੧੨॥ ਰਹਾਉ ਦੂਜਾ ॥"))
    spans = render.word_spans_column(line)
    x = c.select("conv_id", "turn", spans.alias("s"), line.alias("line"))
    words = F.transform("s", lambda s: F.substring(F.col("line"), s["start"] + 1, s["end"] - s["start"]))
    return x.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.sha2(F.array_join(words, " "), 256).alias("words"))


def image_addresses(spark: SparkSession, sf: str) -> DataFrame:
    p = T.read(spark, sf, "pages")
    url, path = F.when(F.col("page_id") % 3 > 0, F.col("url")).when(F.col("page_id") % 2 == 0, ""), F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("p/"), "page_id")).otherwise("")
    at = lambda **kw: X.image_address(url, path, **kw)
    return p.select("page_id", at().alias("plain"), at(published="http://th", mirror="https://mirror/").alias("mirrored"), at(local="/images/").alias("local"))


def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    book = F.when(F.col("p_size") % 2 == 0, F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))).otherwise(F.col("p_brand"))
    made = T.read(spark, sf, "part").select("p_partkey", X.record_id(book, F.col("p_size"), F.col("p_partkey")).alias("id"))
    return made.select("p_partkey", "id", T.shown(X.parse_record_id(F.col("id"))["page"]).alias("page"), X.parse_record_id(F.concat("id", F.lit("x"))).isNull().alias("refused"))


def param_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a line may be a query, what of it a search takes, and whether it is there at all."""
    x = T.lines(spark, sf)
    return x.select("line_id", X.capped(F.col("line")).isNotNull().alias("taken"), F.length(F.substring(X.text_of(F.col("line")), 1, 120)).cast("long").alias("n"), X.absent(F.col("line")).alias("absent"))


def param_langs(spark: SparkSession, sf: str) -> DataFrame:
    """Views asked for by an order's priority; those that nobody knows go."""
    asked = F.concat(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(", ")), F.lit(",LOW,x, HIGH,LOW"))
    return T.read(spark, sf, "orders").select("o_orderkey", F.array_join(X.known_parts(asked, VIEWS), ",").alias("views"))


def roman_of(spark: SparkSession, sf: str) -> DataFrame:
    """The transliteration of every part's name in the script."""
    p = T.read(spark, sf, "part")
    return p.select("p_partkey", render.roman_column(_in_script(F.concat_ws(" ", "p_name", "p_type")), ROMAN).alias("roman"))


def line_romans(spark: SparkSession, sf: str) -> DataFrame:
    """The Latin words under two beats of every part's name in the script, by their spans; none where the words' numbers differ."""
    p = T.read(spark, sf, "part")
    native = F.concat(_in_script("p_name"), F.lit(" ॥੧॥ ਰਹਾਉ ॥ "), _in_script("p_type"))
    roman = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") % 3 == 0, "more"))
    cut = F.instr("p_name", " ") - 1
    spans = F.array(F.array(F.lit(0), cut), F.array(cut + 1, F.length("p_name")), F.array(F.lit(0), F.length("p_name")))
    w = render.spelled_column(spans, native, roman)
    return p.select("p_partkey", w.alias("w")).select("p_partkey", *[F.get("w", i).alias(f"w{i}") for i in range(3)])


ENDS = [" ॥੧॥", " ॥੪॥੬॥੩੯॥ ", " ॥", " ॥੧॥ ਰਹਾਉ ॥", ""]


def stanza_ends(spark: SparkSession, sf: str) -> DataFrame:
    c = T.read(spark, sf, "conversations")
    text = F.concat("text", F.element_at(F.array(*map(F.lit, ENDS)), (F.col("turn") % len(ENDS) + 1).cast("int")))
    return c.select("conv_id", "turn", is_stanza_end(text).alias("ends"))


def encoder_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The session that each part's settings would share."""
    p = T.read(spark, sf, "part")
    found = fingerprint_column(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("wordpiece"), F.when(F.col("p_size") % 3 > 0, "cls"), F.concat(F.col("p_name"), F.lit(': "é" ')))
    return p.select("p_partkey", found.alias("fingerprint"))


ROMAN = render.Roman({c: x for x, c in _CONSONANTS.items() if x not in "qwxz"}, {c: x for x, c in _VOWELS.items()}, {}, {}, {}, "a")


def queries() -> dict:
    found = [fl_query_codes, fl_prefix_bounds, fl_highlight, fl_limits, keyboard_keys, keyboard_typed, fold_native_lines, vocab_folds, native_digits, word_spans, image_addresses, record_ids, param_texts, param_langs, roman_of, line_romans, stanza_ends, encoder_fingerprints]
    return {f.__name__: f for f in found}


_LINES = f"SELECT doc_id * {T.LINES_A_GROUP} + i - 1 AS line_id, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_SINGLE = "[ \\t\\n\\x0B\\f\\r]+"


def _squeezed(x: str, letters: str) -> str:
    """Repeated letters as one; there are no back-references."""
    for c in letters:
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def oracle_sql() -> dict[str, str]:
    typed_from, typed_to = "aAeshkKgG|cCjJ\\tTfFxqQdDnpPbBmXrlvV", LETTERS
    codes = "array_to_string(list_transform(regexp_extract_all(k, '.'), lambda c: CASE WHEN c = '+' THEN c ELSE ',' || CASE WHEN ord(c) < 100 THEN '0' ELSE '' END || ord(c) END), '')"
    native = "translate(lower(n), '" + "".join(_SCRIPT) + "', '" + "".join(_SCRIPT.values()) + "')"
    latin = "lower(p_name || ' ' || p_brand || ' ' || p_type)"
    letters_only = f"array_to_string(list_filter(regexp_split_to_array({latin}, '[^a-z]+'), lambda w: w NOT IN ('', 'small')), ' ')"
    skeleton = _squeezed("regexp_replace(translate(replace(latin, ' ', ''), 'wz', 'vj'), '[aeiou]', '', 'g')", "bcdfghjklmnpqrstvxy")
    native_skeleton = _squeezed("regexp_replace(translate(replace(native, ' ', ''), 'ਟਡਣਵਯ', 'ਤਦਨਬਜ'), '[ਾਿੁੇੋ]', '', 'g')", "ਬਚਦਫਗਹਜਕਲਮਨਪਰਸਤ")
    # A consonant without a vowel after it takes "a", but at the end of the text; single final i and u are not heard.
    roman = "translate(lower(p_name || ' ' || p_type), 'qwxz', 'kvkj')"
    keys = [(i, letter) for i, letter in enumerate("ੳ ਅ ੲ ਸ ਹ ਕ ਖ ਗ ਘ ਙ ਚ ਛ ਜ ਝ ਞ ਟ ਠ ਡ ਢ ਣ ਤ ਥ ਦ ਧ ਨ ਪ ਫ ਬ ਭ ਮ ਯ ਰ ਲ ਵ ੜ ਸ਼ ਖ਼ ਗ਼ ਜ਼ ਫ਼ ਲ਼".split())]
    return {
        "fl_query_codes": f"""SELECT p_partkey, {codes} AS codes, p_size > 25 AS has_operator, ' ' || replace(replace(replace(replace(replace(p_name, 's', 'ਸ'), 'g', 'ਗ'), 'l', 'ਲ'), 'd', 'ਖ'), 't', 'ਕ') || CASE WHEN p_size > 25 THEN '+' ELSE chr(9) END AS bare
          FROM (SELECT *, translate(replace(p_name, ' ', ''), 'sgldt', 'sglKk') || CASE WHEN p_size > 25 THEN '+' ELSE '' END AS k FROM part)""",
        "fl_prefix_bounds": f"SELECT letter, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(string_split_regex(lower(line), '[^a-z]+'), lambda w: w <> ''), lambda w: w[1])) AS letter FROM ({_LINES})) GROUP BY letter",
        "fl_highlight": f"""WITH w AS (SELECT line_id, list_filter(regexp_split_to_array(line, '{_SINGLE}'), lambda x: x <> '') AS ws FROM ({_LINES})),
          l AS (SELECT line_id, list_transform(ws, lambda x: CASE WHEN x = 'rhwau' OR regexp_matches(x, '^i*$') OR regexp_matches(x, '^i*[\\]0-9\\[]') THEN '' ELSE regexp_extract(x, '^i*([\\s\\S])', 1) END) AS ls FROM w),
          m AS (SELECT line_id, list_filter(range(0, len(ls)), lambda i: ls[i + 1] <> '') AS place, array_to_string(ls, '') AS letters FROM l),
          a AS (SELECT *, CASE WHEN contains(letters, 'ste') THEN instr(letters, 'ste') ELSE nullif(instr(translate(letters, 'S', 's'), 'ste'), 0) END AS spot FROM m)
          SELECT line_id, coalesce(place[spot], -1) AS first, coalesce(place[spot + 2], -1) AS last, len(place) AS n, coalesce(list_sum(place), 0)::BIGINT AS places FROM a""",
        "fl_limits": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN 20 ELSE greatest(0, least(1000, floor((value - 10) * 20))) END::BIGINT AS n FROM events",
        "keyboard_keys": "SELECT least(7, i // 5)::BIGINT AS row, CASE WHEN i < 35 THEN i % 5 ELSE i - 35 END::BIGINT AS place, letter, sound, key, i < 35 AS physical, CASE WHEN sound IN ('ng', 'ny', 'sh', 'L') OR length(sound) > 1 THEN NULL WHEN sound = 'f' THEN 'ਫ਼' WHEN sound = 'z' THEN 'ਜ਼' ELSE letter END AS by_sound, coalesce((SELECT count(*) FROM (SELECT unnest(string_split(p_name || p_type, '')) AS c FROM part) WHERE c = key), 0)::BIGINT AS struck FROM (SELECT i, letter, string_split('u a i s h k kh g gh ng ch chh j jh ny T Th D Dh N t th d dh n p ph b bh m y r l v R sh khh ghh z f L', ' ')[i + 1] AS sound, 'aAeshkKgG|cCjJ\\tTfFxqQdDnpPbBmXrlvVsKgjPl'[i + 1] AS key FROM (VALUES "
        + ", ".join(f"({i}, '{c}')" for i, c in keys)
        + ") v(i, letter))",
        "keyboard_typed": f"SELECT p_partkey, typed, regexp_replace(typed, '[^{LETTERS}]', '', 'g') AS letters FROM (SELECT p_partkey, translate(p_name, '{typed_from}', '{typed_to}') AS typed FROM part)",
        "fold_native_lines": f"SELECT line_id, trim(regexp_replace(translate(line, 'sgldt', 'ਸਗਲਖਕ') || '   x', '{_SINGLE}', ' ', 'g')) AS folded FROM ({_LINES})",
        "vocab_folds": f"""WITH f AS (SELECT p_partkey, {letters_only} AS latin, array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda n: regexp_replace({native}, '[ੁਿ]$', '')), ' ') AS native FROM part)
          SELECT p_partkey, latin, {skeleton} AS latin_skeleton, native, {native_skeleton} AS native_skeleton FROM f""",
        "native_digits": "SELECT o_orderkey, o_orderkey || 'a' AS digits FROM orders",
        "word_spans": f"SELECT conv_id, turn, len(w) AS n, sha256(array_to_string(w, ' ')) AS words FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(replace(text, '.', ' '), '{_SINGLE}'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL)",
        "image_addresses": """SELECT page_id, u AS plain, CASE WHEN starts_with(u, 'http://th') THEN 'https://mirror/' || substr(u, 10) ELSE u END AS mirrored, coalesce(u, '/images/' || p) AS local
          FROM (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS u, CASE WHEN page_id % 4 > 0 THEN 'p/' || page_id END AS p FROM pages)""",
        "record_ids": "SELECT p_partkey, id, CASE WHEN id IS NOT NULL THEN p_size ELSE -1 END::BIGINT AS page, true AS refused FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN format('{}:{:04d}:{}', replace(lower(p_brand), '#', '-'), p_size, p_partkey) END AS id FROM part)",
        "param_texts": f"SELECT line_id, coalesce(length(line), 0) <= 200 AS taken, least(coalesce(length(line), 0), 120)::BIGINT AS n, line = '' AS absent FROM ({_LINES})",
        "line_romans": "SELECT p_partkey, CASE WHEN same THEN string_split(p_name, ' ')[1] END AS w0, CASE WHEN same THEN string_split(p_name, ' ')[2] END AS w1, NULL::VARCHAR AS w2 FROM (SELECT *, p_size % 3 > 0 AS same FROM part)",
        "stanza_ends": "SELECT conv_id, turn, turn % 5 < 2 AS ends FROM conversations",
        "encoder_fingerprints": """SELECT p_partkey, sha256('["' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'bge-small-en-v1.5' END || '","wordpiece",' || CASE WHEN p_size % 3 > 0 THEN '"cls"' ELSE 'null' END || ',"' || p_name || ': \\"é\\" "]')[1:12] AS fingerprint FROM part""",
        "param_langs": "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'HIGH') THEN 'HIGH,LOW' WHEN contains(o_orderpriority, 'URGENT') THEN 'URGENT,LOW,HIGH' ELSE 'LOW,HIGH' END AS views FROM orders",
        "roman_of": f"""SELECT p_partkey, regexp_replace(r, '([^aeiou])[iu]$', '\\1') AS roman
          FROM (SELECT p_partkey, regexp_replace(regexp_replace({roman}, '([bcdfghjklmnpqrstvy])([ bcdfghjklmnpqrstvy])', '\\1a\\2', 'g'), '([bcdfghjklmnpqrstvy])([ bcdfghjklmnpqrstvy])', '\\1a\\2', 'g') AS x, replace(x, ' ', '') AS r FROM part)""",
    }
