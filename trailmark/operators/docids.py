"""Constrained generation of document ids: the prefix trie as a table, and decoding along
it as joins of what each beam has written with the trie.

A scorer takes options (query_id, text, beam, generated, token) and gives them with
``gain`` (double), the score of writing the token next; a model plugs in there.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Marks the end of an id among the next tokens.
TERMINAL = -1


def prefix_table(ids: DataFrame) -> DataFrame:
    """``ids(doc_id, tokens)`` to (prefix, next): what may follow each prefix; an id's
    own end is followed by ``TERMINAL``.  Ids without tokens are left out."""
    n = F.size("tokens")
    steps = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.slice("tokens", F.lit(1), i).alias("prefix"), F.coalesce(F.get("tokens", i), F.lit(TERMINAL)).alias("next")))
    return ids.where(n > 0).select(F.inline(steps)).distinct()


def allowed_next(trie: DataFrame, states: DataFrame, separator: int, end: int) -> DataFrame:
    """``states(state_id, generated)`` to (state_id, allowed): after the last separator
    the trie's tokens; at an id's end also separator and end; off the trie the end."""
    parts = F.array_position(F.reverse("generated"), F.lit(separator)).cast("int")
    n = F.size("generated")
    current = F.when(parts > 0, F.slice("generated", n - parts + 2, parts - 1)).otherwise(F.col("generated"))
    asked = states.select("state_id", current.alias("prefix"))
    found = asked.join(trie, "prefix", "left")
    options = F.when(F.col("next") == TERMINAL, F.array(F.lit(separator), F.lit(end))).when(F.col("next").isNull(), F.array(F.lit(end))).otherwise(F.array("next"))
    return found.select("state_id", F.explode(options).alias("t")).groupBy("state_id").agg(F.array_sort(F.collect_set("t")).alias("allowed"))


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def resolve_ids(generated: DataFrame, ids: DataFrame) -> DataFrame:
    """``generated(query_id, pos, candidate)``: candidates equal to an id but for white
    space and case, first occurrence; the score counts down from the number found."""
    known = ids.groupBy(squeezed(F.col("doc_id")).alias("key")).agg(F.max("doc_id").alias("doc_id"))
    hits = generated.withColumn("key", squeezed(F.col("candidate"))).join(known.hint("merge"), "key").groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("query_id").orderBy("pos")
    n = F.count("*").over(Window.partitionBy("query_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("n", n)
    return ranked.select("query_id", "doc_id", "rank", (F.col("n") - F.col("rank") + 1).cast("double").alias("score"))


# -------------------------------------------------------------------- decoding

Scorer = Callable[[DataFrame], DataFrame]


def trie_edges(ids: DataFrame) -> DataFrame:
    """``ids(doc_id, tokens)`` as a trie without forced steps: (depth, prefix, run, options).
    From a prefix where there is a choice, ``run`` is the token to choose and those that
    must follow it; a whole id's end has the run ``[TERMINAL]``; ``options`` counts a
    prefix's tokens, an end as two (separator and end)."""
    n = F.size("tokens")
    known = ids.where(n > 0).select("tokens").distinct()
    places = known.select("tokens", F.posexplode(F.sequence(F.lit(0), n)).alias("i", "_")).select("tokens", "i", F.slice("tokens", F.lit(1), F.col("i")).alias("prefix"), F.coalesce(F.get("tokens", F.col("i")), F.lit(TERMINAL)).alias("next"))
    degree = places.select("prefix", "next").distinct().groupBy("prefix").agg((F.count("*") + F.count_if(F.col("next") == TERMINAL)).cast("int").alias("options"))
    marked = places.join(degree.hint("merge"), "prefix").groupBy("tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "options"))), lambda x: x["options"]).alias("options"))  # one id's length
    places_of = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (F.get("options", i) > 1))
    stops = marked.select("tokens", "options", places_of.alias("at")).select("tokens", "options", F.posexplode("at").alias("k", "i"), F.col("at"))
    until = F.get("at", F.col("k") + 1)
    run = F.when(F.col("i") == n, F.array(F.lit(TERMINAL))).otherwise(F.slice("tokens", F.col("i") + 1, until - F.col("i")))
    return stops.select(F.col("i").alias("depth"), F.slice("tokens", F.lit(1), F.col("i")).alias("prefix"), run.alias("run"), F.get("options", F.col("i")).alias("options")).distinct()


def decode(queries: DataFrame, edges: DataFrame, score: Scorer, separator: int, end: int, beams: int = 1, steps: int | None = 256, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, beam, generated, total): the ``beams`` best token sequences for each of
    ``queries(query_id, text)``, which hold ids of ``trie_edges`` only, separated, with
    ``end`` last; one beam is greedy decoding.

    A step writes one chosen token and those it forces: what the beams have written of
    their id joins the trie, the scorer is asked where there is a choice, and a query's
    best sequences so far stay, finished or not; ties go to the smaller tokens.  What is
    not finished after ``steps`` choices is given as it is; None goes on until all are
    finished, for a scorer that comes to prefer the end.  The only loop on the driver is over
    steps, each of which ``keep`` makes durable: by default it is written."""
    keep = keep or durable(queries.sparkSession)
    edges = keep(edges)
    none = F.array().cast("array<int>")
    state = queries.select("query_id", "text", F.lit(1).alias("beam"), none.alias("generated"), none.alias("prefix"), F.lit(0.0).alias("total"), F.lit(False).alias("done"))
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "generated")
    for _ in count() if steps is None else range(steps):
        going = state.where("not done")
        if going.isEmpty():
            break
        going = going.withColumn("depth", F.size("prefix"))
        near = edges.join(going.select("depth", "prefix").distinct(), ["depth", "prefix"], "left_semi")  # the trie itself is not sent about
        met = going.join(near, ["depth", "prefix"], "left")
        at_end = F.get("run", F.lit(0)) == TERMINAL
        runs = F.when(F.col("run").isNull(), F.array(F.array(F.lit(end)))).when(at_end, F.array(F.array(F.lit(separator)), F.array(F.lit(end)))).otherwise(F.array("run"))
        open_ = met.select("query_id", "text", "beam", "generated", "prefix", "total", F.coalesce("options", F.lit(1)).alias("options"), F.explode(runs).alias("run")).withColumn("token", F.get("run", F.lit(0)))
        asked = score(open_.where("options > 1")).withColumn("total", F.col("total") + F.col("gain")).drop("gain")
        moved = asked.unionByName(open_.where("options = 1"))
        prefix = F.when(F.col("token").isin(separator, end), none).otherwise(F.concat("prefix", "run"))
        written = moved.select("query_id", "text", F.concat("generated", "run").alias("generated"), prefix.alias("prefix"), "total", (F.col("token") == end).alias("done"))
        pool = written.unionByName(state.where("done").select(*written.columns))
        state = keep(pool.withColumn("beam", F.row_number().over(best)).where(F.col("beam") <= beams))
    return state.select("query_id", "beam", "generated", "total")


def decoded_ids(sequences: DataFrame, ids: DataFrame, separator: int, end: int) -> DataFrame:
    """(query_id, pos, candidate): the ids in sequences (query_id, generated), in order; what
    stands after ``end``, and a part that is no whole id, is left out."""
    stop = F.array_position("generated", F.lit(end)).cast("int")
    body = F.when(stop > 0, F.slice("generated", F.lit(1), stop - 1)).otherwise(F.col("generated"))
    text = F.concat(F.lit(","), F.array_join(F.transform(body, lambda t: t.cast("string")), ","), F.lit(","))
    parts = sequences.select("query_id", F.posexplode(F.split(text, f",{separator},")).alias("pos", "part")).select("query_id", "pos", F.trim("part", F.lit(",")).alias("part"))
    known = ids.where(F.size("tokens") > 0).groupBy(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("part")).agg(F.max("doc_id").alias("candidate"))
    return parts.join(known.hint("merge"), "part").select("query_id", "pos", F.col("candidate").cast("string").alias("candidate"))


def byte_tokens(id_col: Column | str) -> Column:
    """The bytes of an id as tokens, 3 to 258; a stand-in for a tokenizer.  0 to 2 are free."""
    digits = F.split(F.regexp_replace(F.hex(F.encode(F.col(id_col) if isinstance(id_col, str) else id_col, "UTF-8")), "(..)(?=.)", "$1,"), ",")
    return F.transform(F.filter(digits, lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int") + 3)


def spelled(hits: DataFrame, ids: DataFrame, separator: int, end: int) -> Scorer:
    """A scorer that spells out the ids of a ranking (query_id, doc_id, rank without gaps),
    as many as it has.  A stand-in for a generator, never to be reported as one."""
    targets = hits.join(ids, "doc_id").select("query_id", F.col("rank").cast("int").alias("turn"), "tokens")
    count = targets.groupBy("query_id").agg(F.max("turn").alias("turns"))

    def score(options: DataFrame) -> DataFrame:
        turn = F.size(F.filter("generated", lambda t: t == separator)) + 1
        place = F.array_position(F.reverse("generated"), F.lit(separator)).cast("int")
        written = F.when(place > 0, place - 1).otherwise(F.size("generated"))  # of the id at hand
        joined = options.withColumn("turn", turn).withColumn("written", written).join(targets, ["query_id", "turn"], "left").join(count, "query_id", "left")
        over = F.col("turn") >= F.coalesce("turns", F.lit(0))
        wanted = F.coalesce(F.get("tokens", F.col("written")), F.when(over, F.lit(end)).otherwise(F.lit(separator)))
        return joined.withColumn("gain", F.when(F.col("token") == wanted, F.lit(0.0)).otherwise(F.lit(-1.0))).select(*options.columns, "gain")

    return score
