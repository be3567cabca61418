"""Queries on registries and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import render, scan, vectors
from granary.operators.encode import Encoder
from granary.plans import catalog
from granary.plans import tables as T
from granary.plans.retrieval import _search_sql

MANIFESTS = [
    ("root", 0, None, "en", "translations", None, None, None, None, "false"),
    ("a", 1, None, "pa", "gurmukhi_uni", None, None, 2.0, 20, "true"),
    ("b", 2, None, "en", "steek", ["latin"], ["text", "magic"], None, 5, "gloss"),
    ("c", 3, "documents", "books", None, None, None, None, None, None),
    ("d", 4, None, None, None, None, [], None, 5, None),
    ("e", 5, None, "lab", None, ["gurmukhi"], ["neighbours"], 0.5, 7, None),
]
TAALS = {"teen": render.Taal(16, (4, 4, 4, 4), ("x", "2", "0", "3")), "dadra": render.Taal(6, (3, 3), ("x", "0"))}
RECORD = {
    "schema_version": 1, "notation_id": "book:0042:3", "book_key": "book", "page": 42, "seq": 3, "kind": "notation", "script": "latin", "pages": [42], "flags": [],
    "heading": {"raag": {"key": "sarang"}, "taal": {"key": "dadra"}}, "shabad": {"shabad_id": 7, "source": "G", "method": "stream"},
    "sections": [{"kind": "sthai", "n": 1, "lines": [{"kind": "avartan", "line_id": 5, "beats": [{"m": i + 1, "notes": [{"s": s}], "bol": {"g": g, "h": 0}} for i, (s, g) in enumerate(zip("SRGMPD", ["a", "b", "", "d", "e", "f"], strict=True))]}]}],
}


def manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFESTS, catalog.MANIFEST)


def manifests_of(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of every part: what it leaves out, and whose name it shares, follow from its numbers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None)
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return T.read(spark, sf, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("folder"),
        k.cast("int").alias("ord"),
        F.when(k % 7 == 3, "documents").otherwise(none).alias("kind"),
        F.when(k % 5 > 0, F.concat(F.lit("i"), k % 97)).otherwise(none).alias("index"),
        F.when(k % 4 == 0, "translations").when(k % 4 == 1, "gurmukhi_uni").when(k % 4 == 2, F.col("p_brand")).otherwise(none).alias("text_source"),
        F.when(size % 3 == 0, strings("latin")).when(size % 3 == 1, strings("gurmukhi")).otherwise(none).alias("query_scripts"),
        F.when(size % 5 == 0, strings("text", "magic")).when(size % 5 == 1, strings()).when(size % 5 == 2, strings("neighbours")).otherwise(none).alias("roles"),
        F.when(size % 4 == 0, size / 10).otherwise(none).cast("double").alias("ask_weight"),
        F.when(size % 2 == 0, size).otherwise(none).cast("int").alias("order"),
        F.when(k % 6 == 0, "TRUE").when(k % 6 == 1, "false").when(k % 6 == 2, "gloss").otherwise(none).alias("enriched"),
    )


def registry_normalize(spark: SparkSession, sf: str) -> DataFrame:
    n = catalog.normalize_manifests(manifests_of(spark, sf))
    return n.select(F.col("ord").cast("long").alias("p_partkey"), "folder", "name", "text_source", "text_lang", F.array_join("query_scripts", ",").alias("scripts"), F.array_join("roles", ",").alias("roles"), "ask_weight", F.col("order").cast("long").alias("place"), "enriched")


def registry_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_by_name(catalog.normalize_manifests(manifests_of(spark, sf))).select(F.col("ord").cast("long").alias("p_partkey"), "folder", "name", "loaded")


def registry_order(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that can answer texts, with their place among all of them."""
    n = catalog.with_role(catalog.first_by_name(catalog.normalize_manifests(manifests_of(spark, sf))).filter("loaded"), "text")
    able = n.select("name", "order", F.lit(0).alias("all"))
    held = scan.hold(scan.in_ranges(able, T.files(spark), "all", ["order", "name"]))
    return scan.running(held, "all", rank="before").select("name", (F.col("before") + 1).alias("place"))


def param_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Values of events as texts, read as bounded integers."""
    v = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise(F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(" ")))
    return T.read(spark, sf, "events").select("event_id", X.bounded_int(v, 1, 50, 10).alias("k"), X.non_negative_int(F.floor("value").cast("string")).alias("id"))


def script_capability(spark: SparkSession, sf: str) -> DataFrame:
    d = T.read(spark, sf, "documents").select("doc_id", F.concat("text", F.when(F.col("lang") == "de", "ਸ").otherwise("")).alias("t"))
    s = F.array(F.lit("latin"))
    return d.select("doc_id", catalog.can_read(s, F.col("t")).alias("latin"), catalog.can_read(F.array(F.lit("gurmukhi"), F.lit("latin")), F.col("t")).alias("both"))


CHECKED = {"documents": ("doc_id", ["text", "lang", "tags"]), "embeddings": ("vec_id", ["embedding"]), "orders": ("o_custkey", ["o_orderkey"]), "events": ("event_id", ["ts", "value"]), "conversations": ("conv_id", ["turn", "speaker"])}


def table_health(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, keys and columns of the tables; two of them lack a column that is asked for, and in two keys repeat."""
    return catalog.health(spark, {t: (T.read(spark, sf, t), key, columns) for t, (key, columns) in CHECKED.items()})


ASKED = "the first words"


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text to vector to the ten best rows, with the hashing model, whose rankings mean nothing."""
    return vectors.search(T.index(spark, sf), Encoder(pooling="mean").query(ASKED), 10).select("id", "score")


def queries() -> dict:
    found = [registry_normalize, registry_dedupe, registry_order, param_bounds, script_capability, table_health, text_search]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    m = """(SELECT replace(p_name, ' ', '-') AS folder, p_partkey AS ord, CASE WHEN p_partkey % 7 = 3 THEN 'documents' END AS kind, CASE WHEN p_partkey % 5 > 0 THEN 'i' || (p_partkey % 97) END AS idx,
        CASE p_partkey % 4 WHEN 0 THEN 'translations' WHEN 1 THEN 'gurmukhi_uni' WHEN 2 THEN p_brand END AS src, CASE p_size % 3 WHEN 0 THEN ['latin'] WHEN 1 THEN ['gurmukhi'] END AS scripts,
        CASE p_size % 5 WHEN 0 THEN ['text', 'magic'] WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['neighbours'] END AS roles, CASE WHEN p_size % 4 = 0 THEN p_size::DOUBLE / 10 END AS weight, CASE WHEN p_size % 2 = 0 THEN p_size END AS pos,
        CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'gloss' END AS enriched FROM part) m"""
    every = "['neighbours', 'text', 'ask']"
    n = f"""SELECT folder, ord, kind, coalesce(idx, 'en') AS name, coalesce(CASE src WHEN 'translations' THEN 'ssk,bdb,ms' ELSE src END, 'unknown') AS text_source,
        CASE WHEN src = 'gurmukhi_uni' THEN 'pa' ELSE 'en' END AS text_lang, coalesce(scripts, CASE WHEN src = 'gurmukhi_uni' THEN ['gurmukhi', 'latin'] ELSE ['latin'] END) AS scripts,
        coalesce(list_filter(roles, lambda r: list_contains({every}, r)), {every}) AS roles, coalesce(weight, 1)::DOUBLE AS ask_weight, coalesce(pos, 100)::BIGINT AS pos,
        CASE WHEN enriched = 'true' THEN 'kosh' WHEN enriched IS NULL OR enriched = 'false' THEN 'none' ELSE enriched END AS enriched FROM {m}"""
    loaded = f"SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) = 1 AS loaded FROM ({n}) WHERE kind IS DISTINCT FROM 'documents'"
    # Letters are tokens: after four special ones, each by itself, then, 36 further on, each as the rest of a word.
    ids = [2, *(4 + ord(c) - ord("a") + 36 * (k > 0) for w in ASKED.split() for k, c in enumerate(w)), 3]
    byte = "(instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1"
    states = f"SELECT j, avg(({byte})::DOUBLE / 127.5::DOUBLE - 1) AS x FROM (SELECT j, substr(sha256(t || ':' || (j // 32)), j % 32 * 2 + 1, 2) AS h FROM (SELECT unnest({ids}) AS t), range(64) r(j)) GROUP BY j"
    asked = f"(SELECT list((x / n)::FLOAT ORDER BY j) FROM (SELECT j, x, sqrt(sum(x * x) OVER ()) AS n FROM ({states})))"
    return {
        "text_search": _search_sql(q=asked).replace("SELECT id, label,", "SELECT id,"),
        "registry_normalize": f"SELECT ord AS p_partkey, folder, name, text_source, text_lang, array_to_string(scripts, ',') AS scripts, array_to_string(roles, ',') AS roles, ask_weight, pos AS place, enriched FROM ({n})",
        "registry_dedupe": f"SELECT ord AS p_partkey, folder, name, loaded FROM ({loaded})",
        "registry_order": f"SELECT name, row_number() OVER (ORDER BY pos, name) AS place FROM ({loaded}) WHERE loaded AND list_contains(roles, 'text')",
        "param_bounds": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 10 ELSE greatest(1, least(50, floor(value)::BIGINT)) END::BIGINT AS k, CASE WHEN floor(value) >= 0 THEN floor(value)::BIGINT END AS id FROM events",
        "script_capability": "SELECT doc_id, lang IS DISTINCT FROM 'de' AS latin, true AS both FROM documents",
        "table_health": " UNION ALL ".join(
            f"SELECT '{t}' AS name, count(*) AS rows, count(*) FILTER (WHERE {k} IS NULL) AS keyless, count({k}) - count(DISTINCT {k}) AS repeated, coalesce(min({k}), -1)::BIGINT AS least, coalesce(max({k}), -1)::BIGINT AS most, '{ {'documents': 'tags', 'conversations': 'speaker'}.get(t, '') }' AS missing FROM {t}"
            for t, (k, _) in CHECKED.items()
        ),
    }
