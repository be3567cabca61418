"""Registered indexes: discovery, defaults, order, roles; tables with fixed or optional columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import has_native
from granary.sources.qindex import Folder

#: Roles an index can have, and the sources that an old name of a source stands for.
ROLES = ("neighbours", "text", "ask")
SOURCE_NAMES = {"translations": "ssk,bdb,ms"}
MANIFEST = "folder string, ord int, kind string, index string, text_source string, query_scripts array<string>, roles array<string>, ask_weight double, `order` int, enriched string"


def assert_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order, or an error."""
    if df.columns != list(expected):
        raise ValueError(f"columns are {df.columns}, not {list(expected)}")
    return df


def with_optional(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns that older tables lack, as nulls."""
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def normalize_manifests(m: DataFrame) -> DataFrame:
    """Defaults for all that a manifest leaves out. Roles that nobody knows go; an empty list of roles stays empty."""
    named = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    source = F.coalesce(named[F.col("text_source")], F.col("text_source"), F.lit("unknown"))
    native = F.coalesce(F.col("text_source") == "gurmukhi_uni", F.lit(False))
    scripts = F.when(native, F.array(F.lit("gurmukhi"), F.lit("latin"))).otherwise(F.array(F.lit("latin")))
    every = F.array(*map(F.lit, ROLES))
    return m.select(
        "folder",
        "ord",
        "kind",
        F.coalesce("index", F.lit("en")).alias("name"),
        source.alias("text_source"),
        F.when(native, "pa").otherwise("en").alias("text_lang"),
        F.coalesce("query_scripts", scripts).alias("query_scripts"),
        F.coalesce(F.filter("roles", lambda r: r.isin(*ROLES)), every).alias("roles"),
        F.coalesce("ask_weight", F.lit(1.0)).alias("ask_weight"),
        F.coalesce("order", F.lit(100)).alias("order"),
        F.when(F.lower("enriched") == "true", "kosh").when(F.col("enriched").isNull() | (F.lower("enriched") == "false"), "none").otherwise(F.col("enriched")).alias("enriched"),
    )


def first_by_name(m: DataFrame) -> DataFrame:
    """``loaded``: whether an entry is the first of its name; collections of documents are no indexes."""
    own = m.filter(F.coalesce(F.col("kind") != "documents", F.lit(True)))
    return own.withColumn("loaded", F.row_number().over(Window.partitionBy("name").orderBy("ord")) == 1)


def ordered(m: DataFrame) -> DataFrame:
    return m.orderBy("order", "name")


def with_role(m: DataFrame, role: str) -> DataFrame:
    return m.filter(F.array_contains("roles", role))


def can_read(scripts: Column, text: Column) -> Column:
    """A text with letters of the script needs an index that reads them; others need Latin."""
    return F.array_contains(scripts, F.when(has_native(text), "gurmukhi").otherwise("latin"))


@dataclass(frozen=True)
class Refusal(Exception):
    code: int
    reason: str


def pick(known: Sequence[str], loaded: dict[str, Sequence[str]], asked: str | None, role: str, default: str) -> list[str]:
    """The indexes that a request names: one, several, or all, of those loaded (in display order) that have the role."""
    able = [n for n, roles in loaded.items() if role in roles]
    if asked == "all":
        if not able:
            raise Refusal(503, f"no index has the role {role}")
        return able
    names = list(dict.fromkeys(x.strip() for x in (asked or default).split(",") if x.strip()))
    missing = [n for n in names if n not in loaded]
    if missing:
        raise Refusal(503 if all(n in known for n in missing) else 400, f"not loaded: {', '.join(missing)}")
    found = [n for n in able if n in names]
    if not found:
        raise Refusal(400, f"no such index has the role {role}")
    return found


def summarize(m: DataFrame, counts: DataFrame) -> DataFrame:
    """What an index says of itself: its name, order, roles and scripts, whether it is loaded, and how many vectors it has."""
    own = first_by_name(normalize_manifests(m))
    return own.join(counts, "name", "left").select("name", "folder", "order", "roles", "query_scripts", "loaded", F.when(F.col("loaded"), F.coalesce("vectors", F.lit(0))).alias("vectors"))


def table_exists(spark: SparkSession, names: Sequence[str]) -> dict[str, bool]:
    return {n: spark.catalog.tableExists(n) for n in names}


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as the bodies of answers: one JSON object each, without what is null."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("body"))


def health(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """(name, rows, keyless, repeated, least, most, missing) of every table, in one plan. ``tables`` has each with its key and the columns that it should have:
    rows without a key, rows whose key another one has, the key's bounds (-1 where there is none), and the columns that aren't there."""
    out = None
    for name, (df, key, columns) in tables.items():
        lacking = ",".join(c for c in columns if c not in df.columns)
        k = F.col(key) if key in df.columns else F.lit(None).cast("long")
        counts = df.groupBy(k.alias("k")).agg(F.count("*").alias("n"))  # combined before the shuffle, whatever the keys
        bound = lambda x: F.coalesce(x.cast("long"), F.lit(-1).cast("long"))
        whole = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
            F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated"),
            bound(F.min("k")).alias("least"),
            bound(F.max("k")).alias("most"),
        )
        own = whole.select(F.lit(name).alias("name"), "rows", "keyless", "repeated", "least", "most", F.lit(lacking).alias("missing"))
        out = own if out is None else out.unionByName(own)
    return out


def discover(path: str) -> list[tuple[str, dict | None, str | None]]:
    """(folder, manifest, warning) of an index folder and its subfolders by name. Unreadable ones are told, not hidden."""
    found, seen = [], set()
    for name in ["", *Folder(path).folders()]:
        d = Folder(f"{path.rstrip('/')}/{name}".rstrip("/"))
        if d.size("manifest.json") is None:
            continue
        try:
            m = d.manifest()
        except ValueError:
            found.append((d.path, None, "the manifest can't be read"))
            continue
        if m.get("kind") == "documents":
            continue
        own = m.get("index") or name or path.rstrip("/").rpartition("/")[2]
        found.append((d.path, m if own not in seen else None, None if own not in seen else f"a second index named {own}"))
        seen.add(own)
    return found
