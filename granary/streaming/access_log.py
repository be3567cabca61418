"""Access-log lines without what was searched for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.functions.text import safe_query


def log_lines(requests: DataFrame, url: Column, *, keep_q: bool = False) -> DataFrame:
    """``path`` and ``query`` of each request's address; the same on a batch and on a stream."""
    path = F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return requests.withColumn("path", F.when(path == "", "/").otherwise(path)).withColumn("query", safe_query(query, keep_q))


def log_sink(requests: DataFrame, url: Column, path: str, checkpoint: str, *, form: str = "json", keep_q: bool = False, **fields: Column) -> StreamingQuery:
    """Start writing a stream of requests as an access log: a line of JSON, or of text, for each request, in files below ``path``.

    Each line is there once, also when the query is stopped or fails and starts again from its checkpoint. A text line holds the fields
    in their order, with a dash for each that is null.
    """
    if form not in ("json", "text"):
        raise ValueError(f"{form} is neither json nor text")
    told = log_lines(requests, url, keep_q=keep_q)
    shown = told.select(*[c.alias(k) for k, c in fields.items()], "path", "query")
    if form == "text":
        shown = shown.select(F.concat_ws(" ", *[F.coalesce(F.nullif(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", " "), F.lit("")), F.lit("-")) for c in shown.columns]).alias("value"))
    return shown.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
