"""Queries that put together what a page shows: groups with all that goes with them, corpora, a catalogue and its facets.

The catalogue is made of orders: books are priorities, groups are documents. The SQL beside each works it out from the tables.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import catalogue, reading, scan, vectors
from granary.plans import api, catalog, records
from granary.plans import tables as T
from granary.sources import packs, qindex
from granary.sources.store import folder

VIEWS = {"early": ("1-URGENT", "2-HIGH"), "late": ("3-MEDIUM", "5-LOW"), "none": ("6-NEVER",)}
ITEM, RAAG, NOBODY = 1200, "r1", "qqqq zzzz xxxx"
FOLDS = {"native": "native", "loose": "loose", "letters": "letters", "codes": "codes"}


def _items(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders")
    group = F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderkey") % 1000)
    used = F.col("o_custkey") % 9
    return o.select(
        F.col("o_orderkey").alias("notation_id"), F.col("o_orderpriority").alias("book_key"), F.concat(F.lit("a"), F.col("o_custkey") % 11).alias("author_key"), F.col("o_orderkey").alias("ordinal"),
        group.alias("shabad_id"), (group % 143).alias("ang"), F.lit(None).cast("string").alias("first_line"), F.concat(F.lit("r"), F.col("o_orderkey") % 9).alias("raag_shabad_key"),
        F.concat(F.lit("r"), used).alias("raag_used_key"), F.when(used >= 5, F.concat(F.lit("r"), used - 5)).alias("raag_used_parent_key"), F.concat(F.lit("t"), F.col("o_orderkey") % 4).alias("taal_key"),
        (F.col("o_orderstatus") == "F").cast("int").alias("verified"),
    )


def _raags(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(10).select(F.concat(F.lit("r"), i).alias("key"), F.concat(F.lit("Raag "), 9 - i).alias("english"), (i % 2).cast("int").alias("in_ggs"), F.when((i >= 5) & (i < 9), F.concat(F.lit("r"), i - 5)).alias("parent_key"), F.when(i % 3 > 0, (i * 7 % 10).cast("int")).alias("ggs_order"))


def _books(spark: SparkSession, sf: str) -> DataFrame:
    """A book for each priority, and one that nothing is in."""
    o = T.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("book_key")).agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("verified"), F.min("o_custkey").alias("c"))
    rows = o.select("book_key", F.concat(F.lit("a"), F.col("c") % 2).alias("author_key"), F.concat(F.lit("Book of "), F.lower("book_key")).alias("title"), F.when(F.length("book_key") % 2 == 0, 1).alias("part"), F.when(F.col("book_key") != "5-LOW", F.col("verified")).alias("verified"))
    return rows.unionByName(spark.createDataFrame([("none", "a0", "Empty", 2, None)], rows.schema))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "orders").filter("o_orderkey % 50 = 0").select(F.concat(F.lit("r"), F.col("o_custkey") % 10).alias("raag_key"), F.col("o_orderpriority").alias("book_key"), F.col("o_orderkey").alias("n"))


# ---- groups and corpora


def views_available(spark: SparkSession, sf: str) -> DataFrame:
    return reading.views_available(T.read(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", VIEWS)


def groups_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as a page: its turns in order with their refrain flags, its first lines, its context, its count."""
    c = T.read(spark, sf, "conversations")
    t = c.select("conv_id", "turn", F.when(F.col("role") == "assistant", "rahao").when(F.col("role") == "user", "line").otherwise("heading").alias("kind"), "text")
    flagged = reading.stanza_flags(t, "conv_id", "turn", "kind", reading.is_stanza_end(F.col("text")))
    first = reading.first_of(t, "conv_id", "text", "turn", name="first_line")
    units = c.select("conv_id", F.col("turn").alias("ord"), F.when(F.col("role") == "system", "bhav").alias("kind"), "text", F.col("turn").alias("stanza"), F.lit("1").alias("en_covers"))
    topics = c.select("conv_id", F.col("role").alias("code"), F.col("role").alias("topic")).distinct()
    page = reading.with_lines(first, "conv_id", flagged, "turn", ["in_stanza", "kind"])
    page = page.join(reading.group_context(units, topics, "conv_id"), "conv_id", "left")
    counted = reading.attach_counts(page, "conv_id", T.read(spark, sf, "orders").select((F.col("o_orderkey") % 300).alias("conv_id")))
    flags = F.array_join(F.transform("lines", lambda x: F.when(x["in_stanza"], "T").otherwise("F")), "")
    return counted.select("conv_id", "first_line", flags.alias("flags"), F.size("lines").cast("long").alias("lines"), F.size("topics").cast("long").alias("topics"), "bhav", "n")


def corpus_load(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as passages of works (their sources), in the order that labels ask for, with what they cite."""
    d = T.read(spark, sf, "documents").select(F.col("doc_id").alias("unit_row"), F.col("source").alias("work_id"), "lang")
    works = T.read(spark, sf, "documents").select(F.col("source").alias("work_id"), F.upper("source").alias("title")).distinct()
    wanted = T.read(spark, sf, "labels").select((F.lit(1_000_000) - F.col("doc_id")).alias("ord"), F.col("doc_id").alias("unit_row"))
    unknown = spark.createDataFrame([(7, -5)], "ord long, unit_row long")
    cites = T.read(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("unit_row"), F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("shabad_id"))
    got = reading.load_units(d, works, cites, wanted.unionByName(unknown), cited=["shabad_id"])
    return got.select("ord", "unit_row", "title", "lang", "section", F.array_join(F.transform("cites", lambda c: c["shabad_id"].cast("string")), ",").alias("cites"))


def corpus_roster(spark: SparkSession, sf: str) -> DataFrame:
    d = T.read(spark, sf, "documents")
    works = d.select(F.col("source").alias("work_id")).distinct().unionByName(spark.createDataFrame([("unwritten",)], "work_id string"))
    return reading.corpus_roster(d.select(F.col("source").alias("work_id"), "lang"), "work_id", "lang", works)


def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Registered indexes, of which some have vectors of the table: as many as a label's."""
    e = T.read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"))
    names = F.when(F.col("label") == 1, "en").when(F.col("label") == 2, "pa")
    counts = e.select(names.alias("name"), "vectors").filter("name IS NOT NULL")
    s = catalog.summarize(records.manifests(spark), counts)
    return s.select("name", "folder", F.col("order").cast("long").alias("ord"), F.array_join("roles", ",").alias("roles"), F.array_join("query_scripts", ",").alias("scripts"), "loaded", T.shown(F.col("vectors")).alias("vectors"))


def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    n = T.read(spark, sf, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region"))
    return catalog.json_rows(n)


def packs_required(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as packs that need those of half and a third of their number: what every fiftieth of them needs."""
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("pack")).filter("pack > 0")
    needs = p.select("pack", F.floor(F.col("pack") / 2).alias("needs")).unionByName(p.filter("pack % 3 = 0").select("pack", F.floor(F.col("pack") / 3).alias("needs"))).filter("needs > 0")
    return packs.required(p.filter("pack % 50 = 0"), needs)


def table_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Whether tables are there, by name, and how many rows each has."""
    T.read(spark, sf, "orders").createOrReplaceTempView("granary_probe")
    there = catalog.table_exists(spark, ["granary_probe", "granary_absent"])
    found = [spark.table(n).agg(F.count("*").alias("rows")) if yes else spark.range(1).select(F.lit(-1).cast("long").alias("rows")) for n, yes in sorted(there.items())]
    shown = [x.select(F.lit(n).alias("name"), F.lit(yes).alias("there"), "rows") for x, (n, yes) in zip(found, sorted(there.items()), strict=True)]
    return shown[0].unionByName(shown[1])


# ---- vectors by level, groups of lines


def _levels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines; groups, a label each, with the vector of its first line; refrains, which odd labels have; lines' owners."""
    i = T.index(spark, sf)
    firsts = i.groupBy("label").agg(F.min("id").alias("id"))
    groups = i.join(firsts, ["label", "id"]).select(F.col("label").cast("long").alias("row"), F.col("label").cast("long").alias("id"), "codes", "scale", F.lit(True).alias("mask"))
    return i, groups, groups.filter("id % 2 = 1"), i.select("id", F.col("label").cast("long").alias("group_id")).filter("id % 10 > 0")


def index_files(spark: SparkSession, sf: str) -> DataFrame:
    """A whole index written as the files of its format, in ranges of its rows by tasks, and read again."""
    at = f"{folder(spark)}/granary-files/{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    kept = T.index(spark, sf).select("id", "codes", "scale", "mask", F.lit(0).alias("all"))
    numbered = scan.running(scan.hold(scan.in_ranges(kept, T.files(spark), "all", ["id"])), "all", rank="row")
    qindex.write(numbered, at, manifest={"index_dim": 64})
    qindex.register(spark)
    back = spark.read.format("qindex").load(at)
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda n, c: n + c)
    return back.select("row", "id", total.alias("code_sum"), F.array_max("codes").cast("long").alias("code_max"), "mask")


def vec_predicate(spark: SparkSession, sf: str) -> DataFrame:
    from granary.plans.retrieval import _Q

    return vectors.search(T.index(spark, sf), _Q, 10, where=(F.col("id") % 7 == 3)).select("id", "score")


def vec_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of ids, and ids of rows; unknown ones have none."""
    i = T.index(spark, sf)
    asked = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return vectors.rows_of(i, asked).select("id", T.shown(F.col("row")).alias("row"))


def vec_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The three best of each level for one query; and what is like group 3 and group 4 by its refrain, of which 4 has none."""
    from granary.plans.retrieval import _Q

    lines, groups, refrains, _ = _levels(spark, sf)
    levels = {"lines": lines, "groups": groups, "refrains": refrains}
    parts = [vectors.search_level(levels, x, _Q, 3).select(F.lit(x).alias("level"), "id", "score") for x in levels]
    parts += [vectors.similar_to(refrains, g, 3).select(F.lit(f"like {g}").alias("level"), "id", "score") for g in (3, 4)]
    parts.append(vectors.similar_to(groups, 3, 3).select(F.lit("group 3").alias("level"), "id", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrieve_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by two queries over three levels: six lists."""
    from granary.plans.retrieval import _Q, _Q2

    lines, groups, refrains, owner = _levels(spark, sf)
    got = api.retrieve_groups({"x": (lines, groups, refrains)}, {"x": [_Q, _Q2]}, owner, 5, 12)
    return got.select(F.col("key").alias("group_id"), "score", "votes")


def related_groups(spark: SparkSession, sf: str) -> DataFrame:
    lines, groups, refrains, owner = _levels(spark, sf)
    got = api.related_groups({"x": (lines, groups, refrains)}, 3, [13, 17], owner, 5, 12)
    return got.select(F.col("key").alias("group_id"), "score", "votes")


# ---- the catalogue


def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.summary(_items(spark, sf), _books(spark, sf))


def catalog_raags(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.raag_facet(_items(spark, sf), _raags(spark), _notes(spark, sf))


def catalog_taals(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.taal_facet(_items(spark, sf), spark.createDataFrame([("t1", "Teen"), ("t2", "Dadra")], "key string, english string"))


def catalog_authors(spark: SparkSession, sf: str) -> DataFrame:
    authors = spark.range(10).select(F.concat(F.lit("a"), "id").alias("author_key"), F.concat(F.lit("Name "), F.col("id") * 7 % 10).alias("name"))
    return catalogue.author_facet(_items(spark, sf), authors)


def catalog_books(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.book_facet(_items(spark, sf), _books(spark, sf))


def catalog_matched(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of what has a raag or its children, isn't verified, and is of a text that is searched for."""
    rows, told = catalogue.listed(_items(spark, sf), T.lines(spark, sf), q=" of the ", folds=FOLDS, k=7, number=2, raag=RAAG, verified=False)
    return rows.select("notation_id", "matched_line", *[F.lit(told[c]).cast("long").alias(c) for c in ("total", "pages", "page")])


def catalog_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """What an answer tells if the text is met nowhere."""
    rows, told = catalogue.listed(_items(spark, sf), T.lines(spark, sf), q=NOBODY, folds=FOLDS)
    return spark.createDataFrame(sorted(told.items()), "what string, n long").withColumn("rows", F.lit(rows.count()).cast("long"))


def catalog_native(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with two letters in a row, asked for in the script: a dotted one, a whole vowel and its carrier."""
    found = catalogue.match_lines(T.lines(spark, sf), "group_id", "pos", "ਜ਼ਊ", shown="line", native="native", codes="codes")
    return found


def catalog_cards(spark: SparkSession, sf: str) -> DataFrame:
    i = _items(spark, sf)
    names = {"book_key": (_books(spark, sf), "book_key", "title"), "raag_used_key": (_raags(spark).filter("key <> 'r2'"), "key", "english")}
    return catalogue.cards(i, names).select("notation_id", "book_key_name", "raag_used_key_name")


def catalog_item(spark: SparkSession, sf: str) -> DataFrame:
    li = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("notation_id"), F.col("l_linenumber").alias("n"), F.lit("crop").alias("kind"), F.concat(F.lit("u"), "l_partkey").alias("url"), F.lit(None).cast("string").alias("path"))
    one = catalogue.item(_items(spark, sf), li, "notation_id", ITEM + 1)
    return one.select("notation_id", "others", F.array_join(F.transform("images", lambda x: x["url"]), ",").alias("images"))


def raag_notes(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.raag_notes(_notes(spark, sf), RAAG).select("book_key", "n", "place")


def raag_keys_known(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of raags as a corpus writes them: exact, else by an alias, else none."""
    r = _raags(spark)
    asked = T.read(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "r").otherwise("Raag "), F.col("p_size") % 12).alias("text"))
    return catalogue.known_key(asked, "text", r.select("key", F.col("english").alias("alias"))).select("p_partkey", "key")


def group_heads(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.group_heads(T.lines(spark, sf), "group_id", "pos", "line", "letters")


def rate_limit_exempt(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are never counted and always let through; requests without a client share one window."""
    from granary.plans.browsing import DAY_US, LIMIT
    from granary.streaming import limits

    e = T.read(spark, sf, "events").select(F.when(F.col("user_id") % 40 > 0, F.col("user_id")).alias("user_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    r = limits.fixed_window(e, "user_id", "us", "event_id", LIMIT, DAY_US, exempt=F.col("event_type") == "error")
    return r.select(F.col("ord").alias("event_id"), "allowed", T.shown(F.col("remaining")).alias("remaining"))


def p95_by_type(spark: SparkSession, sf: str) -> DataFrame:
    from granary.functions.numeric import at_share

    return at_share(T.read(spark, sf, "events"), "event_type", "value", 0.95)


def masked_means(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as eight states of eight numbers, of which a mask leaves some, to their mean."""
    from granary.functions.numeric import masked_mean, round6

    e = T.read(spark, sf, "embeddings")
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 3 > 0, 1).otherwise(0))
    mask = F.when(F.col("vec_id") % 11 == 0, F.array_repeat(F.lit(0), 8)).otherwise(mask)
    m = masked_mean(states, mask, 8)
    return e.select("vec_id", F.posexplode(m).alias("c", "x")).select("vec_id", F.col("c").cast("long").alias("c"), round6(F.col("x")).alias("x"))


def queries() -> dict:
    found = [index_files, views_available, groups_whole, corpus_load, corpus_roster, index_summary, json_bodies, packs_required, table_probe, vec_predicate, vec_rows, vec_levels, retrieve_groups, related_groups, catalog_summary, catalog_raags, catalog_taals, catalog_authors, catalog_books, catalog_matched, catalog_unmatched, catalog_native, catalog_cards, catalog_item, raag_notes, raag_keys_known, group_heads, rate_limit_exempt, p95_by_type, masked_means]
    return {f.__name__: f for f in found}


_ITEMS = """SELECT o_orderkey AS notation_id, o_orderpriority AS book_key, 'a' || (o_custkey % 11) AS author_key, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 1000 END AS shabad_id,
  CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 1000 % 143 END AS ang, 'r' || (o_orderkey % 9) AS prescribed, o_custkey % 9 AS used, 't' || (o_orderkey % 4) AS taal_key, o_orderstatus = 'F' AS verified FROM orders"""
_LINES = f"""SELECT doc_id AS group_id, i - 1 AS pos, ls[i] AS line, array_to_string(list_transform(list_filter(string_split_regex(lower(ls[i]), '[^a-z]+'), lambda w: w <> ''), lambda w: w[1]), '') AS letters
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"""
_BOOKS = """SELECT book_key, 'a' || (c % 2) AS author_key, 'Book of ' || lower(book_key) AS title, CASE WHEN length(book_key) % 2 = 0 THEN 1 END AS part, CASE WHEN book_key <> '5-LOW' THEN v END AS verified
  FROM (SELECT o_orderpriority AS book_key, count(*) FILTER (WHERE o_orderstatus = 'F') AS v, min(o_custkey) AS c FROM orders GROUP BY 1) UNION ALL SELECT 'none', 'a0', 'Empty', 2, NULL"""


def oracle_sql() -> dict[str, str]:
    from granary.plans.browsing import DAY_US, LIMIT, _loose_sql
    from granary.plans.retrieval import _DOT, _Q2F, _QF, R6, _deq, _index_sql, _search_sql, _sql_list

    index = _index_sql("c")
    levels = f"""i AS MATERIALIZED ({index}), groups AS (SELECT label::BIGINT AS id, codes, scale FROM i WHERE id IN (SELECT min(id) FROM i GROUP BY label)), refrains AS (SELECT * FROM groups WHERE id % 2 = 1),
      owner AS (SELECT id, label::BIGINT AS group_id FROM i WHERE id % 10 > 0)"""
    score = lambda q: R6.format(_DOT.format(a="codes", b=q) + " * scale::DOUBLE")
    top = lambda src, q, k, where="true": f"(SELECT id, {score(q)} AS score FROM {src} WHERE {where} ORDER BY score DESC, id LIMIT {k})"
    own = lambda src, g: f"(SELECT {_deq()} FROM {src} WHERE id = {g}{' AND mask' if src == 'i' else ''})"
    ranked = lambda rows, key: f"SELECT {key} AS k, row_number() OVER (ORDER BY score DESC, h.id) AS rank FROM {rows} h"
    by_line = lambda rows: f"SELECT group_id AS k, rank FROM (SELECT h.id, row_number() OVER (ORDER BY score DESC, h.id) AS rank FROM {rows} h) JOIN owner USING (id)"

    def fused(lists: list[str], k: int, drop: str = "true") -> str:
        each = " UNION ALL ".join(f"SELECT {n} AS l, k, min(rank) AS rank FROM ({x}) GROUP BY k" for n, x in enumerate(lists))
        return f"WITH {levels} SELECT k AS group_id, score, votes FROM (SELECT k, {R6.format('sum(1::DOUBLE / (60 + rank))')} AS score, count(*) AS votes FROM ({each}) GROUP BY k ORDER BY score DESC, k LIMIT {k}) WHERE {drop}"

    q1, q2 = _sql_list(_QF), _sql_list(_Q2F)
    three = lambda q: [by_line(top("i", q, 12, "mask")), ranked(top("groups", q, 12), "h.id"), ranked(top("refrains", q, 12), "h.id")]
    like = lambda src, g, k, where="true": top(src, own(src, g), k, f"id <> {g} AND {where}")
    english = "'Raag ' || (9 - i)"
    raags = f"SELECT i, 'r' || i AS key, {english} AS english, i % 2 AS in_ggs, CASE WHEN i BETWEEN 5 AND 8 THEN i - 5 END AS parent, CASE WHEN i % 3 > 0 THEN i * 7 % 10 END AS own FROM range(10) t(i)"
    found = f"SELECT group_id, arg_min(line, pos) AS matched_line FROM ({_LINES}) WHERE contains(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 'of the') OR contains({_loose_sql('line')}, {_loose_sql(chr(39) + 'of the' + chr(39))}) GROUP BY group_id"
    return {
        "index_files": f"SELECT row_number() OVER (ORDER BY id) - 1 AS row, id, list_sum(codes)::BIGINT AS code_sum, list_max(codes)::BIGINT AS code_max, mask FROM ({index})",
        "views_available": "SELECT * FROM (VALUES ('early', (SELECT count(*) > 0 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))), ('late', (SELECT count(*) > 0 FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '5-LOW'))), ('none', false)) v(view, available)",
        "groups_whole": """WITH k AS (SELECT *, role = 'user' AS plain, first_value(CASE WHEN role <> 'user' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM conversations)
          SELECT conv_id, arg_min(text, turn) AS first_line, string_agg(CASE WHEN role = 'assistant' OR (plain AND coalesce(nxt = 'assistant', false)) THEN 'T' ELSE 'F' END, '' ORDER BY turn) AS flags, count(*) AS lines, count(DISTINCT role) AS topics,
            arg_min(text, turn) FILTER (WHERE role = 'system') AS bhav, any_value(o.n) AS n FROM k LEFT JOIN (SELECT o_orderkey % 300 AS c, count(*) AS n FROM orders GROUP BY 1) o ON o.c = conv_id GROUP BY conv_id""",
        "corpus_load": "SELECT 1000000 - d.doc_id AS ord, d.doc_id AS unit_row, upper(source) AS title, lang, NULL::VARCHAR AS section, coalesce(c.cites, '') AS cites FROM labels l JOIN documents d USING (doc_id) LEFT JOIN (SELECT o_orderkey % 500 AS u, string_agg(o_custkey, ',' ORDER BY o_orderkey) AS cites FROM orders GROUP BY 1) c ON c.u = d.doc_id",
        "corpus_roster": """SELECT source AS work_id, sum(n)::BIGINT AS units, '[' || string_agg('{"part":"' || lang || '","units":' || n || '}', ',' ORDER BY lang) || ']' AS parts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source UNION ALL SELECT 'unwritten', 0, NULL""",
        "index_summary": """SELECT name, folder, ord, roles, scripts, loaded, CASE WHEN loaded THEN coalesce((SELECT count(*) FROM embeddings WHERE label = l), 0) ELSE -1 END AS vectors FROM (VALUES
          ('en', 'root', 100, 'neighbours,text,ask', 'latin', true, 1), ('pa', 'a', 20, 'neighbours,text,ask', 'gurmukhi,latin', true, 2), ('en', 'b', 5, 'text', 'latin', false, 1), ('en', 'd', 5, '', 'latin', false, 1), ('lab', 'e', 7, 'neighbours', 'gurmukhi', true, -1)) v(name, folder, ord, roles, scripts, loaded, l)""",
        "json_bodies": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"' || CASE WHEN n_regionkey > 1 THEN ',"region":' || n_regionkey ELSE '' END || '}' AS body FROM nation""",
        "packs_required": "WITH RECURSIVE r AS (SELECT p_partkey AS pack FROM part WHERE p_partkey % 50 = 0 AND p_partkey > 0 UNION SELECT n FROM (SELECT unnest([pack // 2, CASE WHEN pack % 3 = 0 THEN pack // 3 ELSE 0 END]) AS n FROM r) WHERE n > 0) SELECT pack FROM r",
        "table_probe": "SELECT 'granary_absent' AS name, false AS there, -1::BIGINT AS rows UNION ALL SELECT 'granary_probe', true, count(*) FROM orders",
        "vec_predicate": f"SELECT id, score FROM ({_search_sql('mask AND id % 7 = 3')})",
        "vec_rows": "SELECT p_partkey AS id, coalesce(vec_id, -1) AS row FROM part LEFT JOIN embeddings ON vec_id = p_partkey",
        "vec_levels": f"""WITH {levels} SELECT 'lines' AS level, * FROM {top("i", q1, 3, "mask")} UNION ALL SELECT 'groups', * FROM {top("groups", q1, 3)} UNION ALL SELECT 'refrains', * FROM {top("refrains", q1, 3)}
          UNION ALL SELECT 'like 3', * FROM {like("refrains", 3, 3)} UNION ALL SELECT 'group 3', * FROM {like("groups", 3, 3)}""",
        "retrieve_groups": fused([*three(q1), *three(q2)], 5),
        "related_groups": fused([*(by_line(like("i", x, 12, f"mask AND (SELECT mask FROM i WHERE id = {x})")) for x in (13, 17)), ranked(like("groups", 3, 12), "h.id"), ranked(like("refrains", 3, 12), "h.id")], 5, "k <> 3"),
        "catalog_summary": f"SELECT (SELECT count(*) FROM orders) AS items, (SELECT count(DISTINCT shabad_id) FROM ({_ITEMS})) AS groups, count(*) AS books, sum(verified)::BIGINT AS verified FROM ({_BOOKS})",
        "catalog_raags": f"""WITH r AS ({raags}), n AS (SELECT r.key, r.english, (SELECT count(*) FROM orders WHERE o_custkey % 9 = r.i) AS used, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = r.i) AS prescribed,
            (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey % 10 = r.i) AS noted, r.in_ggs, r.parent, coalesce(nullif(r.own, 0), nullif(p.own, 0), 99) AS granth FROM r LEFT JOIN r p ON p.i = r.parent)
          SELECT key, english, used, prescribed, noted, row_number() OVER (ORDER BY in_ggs DESC, granth, parent IS NOT NULL, english) AS place FROM n WHERE used + prescribed + noted > 0""",
        "catalog_taals": f"SELECT taal_key AS key, CASE taal_key WHEN 't1' THEN 'Teen' WHEN 't2' THEN 'Dadra' ELSE taal_key END AS english, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, taal_key) AS place FROM ({_ITEMS}) GROUP BY taal_key",
        "catalog_authors": f"SELECT key, name, n, row_number() OVER (ORDER BY name, key) AS place FROM (SELECT author_key AS key, CASE WHEN author_key = 'a10' THEN 'a10' ELSE 'Name ' || (author_key[2:]::INT * 7 % 10) END AS name, count(*) AS n FROM ({_ITEMS}) GROUP BY author_key)",
        "catalog_books": f"SELECT book_key AS key, title, (SELECT count(*) FROM orders WHERE o_orderpriority = book_key) AS n, row_number() OVER (ORDER BY author_key, coalesce(part, 0), title) AS place FROM ({_BOOKS})",
        "catalog_matched": f"""WITH m AS ({found}), x AS (SELECT notation_id, matched_line, row_number() OVER (ORDER BY ang NULLS LAST, book_key, notation_id) AS r, count(*) OVER () AS total FROM ({_ITEMS}) JOIN m ON group_id = shabad_id WHERE used IN (1, 6) AND NOT verified)
          SELECT notation_id, matched_line, total, ceil(total / 7)::BIGINT AS pages, least(2, ceil(total / 7))::BIGINT AS page FROM x WHERE r > (least(2, ceil(total / 7)) - 1) * 7 AND r <= least(2, ceil(total / 7)) * 7""",
        "catalog_unmatched": "SELECT * FROM (VALUES ('page', 1::BIGINT, 0::BIGINT), ('total', 0, 0)) v(what, n, rows)",
        "catalog_native": f"SELECT group_id, arg_min(line, pos) AS matched_line FROM ({_LINES}) WHERE regexp_matches(letters, 'ja|za') GROUP BY group_id",
        "catalog_cards": f"SELECT notation_id, 'Book of ' || lower(book_key) AS book_key_name, CASE WHEN used = 2 THEN 'r2' ELSE 'Raag ' || (9 - used) END AS raag_used_key_name FROM ({_ITEMS})",
        "catalog_item": f"SELECT {ITEM + 1} AS notation_id, (SELECT count(*) - 1 FROM ({_ITEMS}) WHERE shabad_id = {(ITEM + 1) % 1000}) AS others, (SELECT string_agg('u' || l_partkey, ',' ORDER BY l_linenumber, 'u' || l_partkey) FROM lineitem WHERE l_orderkey = {ITEM + 1}) AS images",
        "raag_notes": "SELECT o_orderpriority AS book_key, o_orderkey AS n, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey % 10 = 1",
        "raag_keys_known": "SELECT p_partkey, CASE WHEN p_size % 12 > 9 THEN NULL WHEN p_size % 2 = 0 THEN 'r' || (p_size % 12) ELSE 'r' || (9 - p_size % 12) END AS key FROM part",
        "group_heads": f"SELECT group_id, arg_min(line, pos) AS first_line, arg_min(letters, pos) AS letters FROM ({_LINES}) GROUP BY group_id",
        "rate_limit_exempt": f"""WITH RECURSIVE e AS (SELECT CASE WHEN user_id % 40 > 0 THEN user_id ELSE -1 END AS c, event_id, event_type, epoch_us(ts) AS us FROM events),
          r AS (SELECT c, event_id, us, row_number() OVER (PARTITION BY c ORDER BY us, event_id) AS k FROM e WHERE event_type <> 'error'),
          s AS (SELECT c, event_id, k, true AS allowed, 1 AS n, us AS start FROM r WHERE k = 1 UNION ALL
            SELECT r.c, r.event_id, r.k, r.us - start >= {DAY_US} OR n < {LIMIT}, CASE WHEN r.us - start >= {DAY_US} THEN 1 WHEN n < {LIMIT} THEN n + 1 ELSE n END, CASE WHEN r.us - start >= {DAY_US} THEN r.us ELSE start END FROM s JOIN r ON r.c = s.c AND r.k = s.k + 1)
          SELECT event_id, allowed, ({LIMIT} - n)::BIGINT AS remaining FROM s UNION ALL SELECT event_id, true, -1 FROM e WHERE event_type = 'error'""",
        "p95_by_type": "SELECT event_type, list_sort(list(value))[floor(count(*) * 0.95)::BIGINT + 1] AS value FROM events GROUP BY event_type",
        "masked_means": """SELECT vec_id, c, CASE WHEN m = 0 THEN 0 ELSE floor(s / m * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE END AS x FROM (SELECT vec_id, c, coalesce(sum(embedding[i * 8 + c + 1]::DOUBLE) FILTER (WHERE used), 0) AS s, count(*) FILTER (WHERE used) AS m
          FROM (SELECT vec_id, embedding, c, i, vec_id % 11 > 0 AND (vec_id + i) % 3 > 0 AS used FROM embeddings, range(8) a(i), range(8) b(c)) GROUP BY vec_id, c)""",
    }
