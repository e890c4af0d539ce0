"""URL filters: a temporal list join, in DataFrame functions only.

Dated list entries (``add`` or ``remove`` of a domain) become validity intervals.
An as-of join evaluates every capture against the entries that were active at
its fetch time; of several, the most specific domain decides, and of equal ones
a block.

Hosts are made distinct before they meet the list, so a host with a third of all
captures meets it once; captures then join their host's intervals, at most one
row each.  The intervals of a host are bounded by the list's history of its
domains, not by the captures.

Defined results: a null or malformed url has the host '' and meets no entry; a host
that ends in dots meets the entries of the name before them; a host in brackets is
an address and meets entries of the whole of it; a null fetch time is outside all
intervals; captures that meet no active entry are kept; of entries of one list,
domain and time, ``remove`` comes last, and the same entry twice counts once;
repeated captures, and captures without an id, get results of their own; an id or
time column that is named like a result is given as ``id`` or ``time``; other
columns of any name may stand beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/:?#]+)"
#: What a result has besides its capture's id and time.
RESULTS = ("host", "domain", "verdict", "kept")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, domain, action, at)`` to ``(list, domain, valid_from,
    valid_to)``, half open; ``valid_to`` is null while an entry stands."""
    turn = Window.partitionBy("list", "domain").orderBy("at", "action")  # 'add' < 'remove'
    spans = entries.withColumn("domain", F.lower("domain")).withColumn("valid_to", F.lead("at").over(turn))
    return spans.where("action = 'add' and (valid_to is null or valid_to > at)").select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, host, time, domain, verdict, kept) of every capture."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(time_col).alias("time"), host(F.col(url_col)).alias("host")).withColumn("name", F.rtrim("host", F.lit(".")))
    labels = F.when(F.col("name").startswith("["), F.array("name")).otherwise(F.split("name", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    hosts = rows.where("name <> ''").select("name").distinct().withColumn("labels", labels).select("name", F.explode(suffixes).alias("domain"))
    item = F.struct(F.length("domain").alias("n"), F.when(F.col("list") == "block", 1).otherwise(0).alias("block"), "domain", "list", "valid_from", "valid_to")
    listed = hosts.join(validity_intervals(entries), "domain").groupBy("name").agg(F.collect_set(item).alias("spans"))
    listed = materialize(listed, "listed-hosts")  # its size is then known, and captures of one host can be split over tasks
    joined = rows.join(listed, "name", "left")
    active = F.filter("spans", lambda s: (s["valid_from"] <= F.col("time")) & (s["valid_to"].isNull() | (F.col("time") < s["valid_to"])))
    own = lambda column, other: other if column in RESULTS else column
    best = joined.select("id", "host", "time", F.array_max(active).alias("best"))
    return best.select(
        F.col("id").alias(own(id_col, "id")), "host", F.col("time").alias(own(time_col, "time")), F.col("best.domain").alias("domain"), F.col("best.list").alias("verdict"),
        (F.coalesce(F.col("best.block"), F.lit(0)) == 0).alias("kept"),
    )
