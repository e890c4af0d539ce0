"""QA examples: enrichment, prompts, passages, weak span labels, training rows."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import best

#: What joins the parts of training texts and the ids to generate.
SO_FAR, POSTERIOR, DOC_MARK = "\nEvidence so far: ", "\nPosterior evidence: ", " <DOC> "
#: Methods whose training queries carry the facts of earlier hops.
HISTORY_METHODS = ("mdr", "m3", "baleen", "mopo")
#: The instruction of each prompt method.
INSTRUCTIONS = {
    "ask_to_understand": "Answer the legal question by asking yourself focused sub-questions about each passage before producing the final answer.",
    "generative_context_pair_selection": "Select the compatible legal passages that jointly answer the question and synthesize one answer from them.",
    "msg": "Select the relevant legal facts from the passages and write a concise, complete answer to the question.",
    "pointer_generator": "Answer using the legal passages. Preserve exact legal terms, article numbers, conditions, and enumerations when they are relevant.",
    "pathfid": "Follow the legal reasoning path across the passages in order and then generate the final answer.",
}

# ------------------------------------------------------------------------- joins


def enrich_contexts(examples: DataFrame, corpus: DataFrame) -> DataFrame:
    """``examples(query_id, candidate_doc_ids, positive_doc_ids)`` with ``contexts``:
    ordered (hop_index, doc_id, title, text, is_positive); a missing document fails."""
    rows = examples.select("query_id", "positive_doc_ids", F.posexplode("candidate_doc_ids").alias("hop_index", "doc_id"))
    joined = rows.join(corpus.select("doc_id", "title", "text"), "doc_id", "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("document missing from the corpus: "), F.col("doc_id").cast("string")))).otherwise(F.col("text"))
    item = F.struct("hop_index", "doc_id", "title", text.alias("text"), F.array_contains("positive_doc_ids", F.col("doc_id")).alias("is_positive"))
    return examples.join(joined.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("contexts")), "query_id", "left")


def downstream_examples(queries: DataFrame, rankings: DataFrame, corpus: DataFrame, answers: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, question, answer, contexts) from the first ``k`` of each ranking.  A
    ranked document that the corpus lacks, or a query without an answer, fails."""
    top = rankings.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    needed = corpus.join(top.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "title", "text", F.lit(True).alias("held"))
    rows = top.join(needed, "doc_id", "left").withColumn("rank", _or_fail("held", "rank", "document missing from the corpus: ", "doc_id"))
    contexts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "text"))).alias("contexts"))
    asked = queries.select("query_id", F.col("text").alias("question")).join(answers.select("query_id", "answer"), "query_id", "left")
    return asked.withColumn("answer", _or_fail("answer", "answer", "no answer for query ", "query_id")).join(contexts, "query_id", "left")


def _or_fail(test: str, value: str, message: str, name: str) -> Column:
    """``value`` where ``test`` is not null, else an error that names the row."""
    return F.when(F.col(test).isNull(), F.raise_error(F.concat(F.lit(message), F.col(name).cast("string")))).otherwise(F.col(value))


# ----------------------------------------------------------------------- prompts


def build_source(question: Column, contexts: Column, method: str, most: int | None = None) -> Column:
    """The prompt of a method over ``contexts`` (array of struct doc_id, title, text)."""
    if method not in INSTRUCTIONS:
        raise ValueError(f"unknown method {method!r}")
    used = contexts if most is None else F.slice(contexts, 1, most)

    def block(c: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        title = F.coalesce(F.nullif(c["title"], F.lit("")), F.nullif(c["doc_id"].cast("string"), F.lit("")), F.concat(F.lit("passage-"), n))
        label, text = F.concat(F.lit("[PASSAGE_"), n, F.lit("] "), title), F.trim(T.text_or_empty(c["text"]))
        if method == "pathfid":
            return F.concat(F.lit("<title-"), n, F.lit("> "), label, F.lit("\n<context-"), n, F.lit("> "), text)
        mark = {"generative_context_pair_selection": "candidate", "msg": "source"}.get(method)
        before = F.concat(F.lit(f"<{mark}-"), n, F.lit("> ")) if mark else F.lit("")
        return F.concat(before, label, F.lit("\n"), text)

    head = F.array(F.lit(f"instruction: {INSTRUCTIONS[method]}"), F.concat(F.lit("question: "), F.trim(T.text_or_empty(question))))
    return F.array_join(F.concat(head, F.transform(used, block)), "\n\n")


def build_target(answer: Column) -> Column:
    """The trimmed answer; an empty one fails."""
    text = F.trim(T.text_or_empty(answer))
    return F.when(text == "", F.raise_error(F.lit("an answer is empty"))).otherwise(text)


def passage_budget(k: int, max_source: int = 2048, max_passage: int = 256) -> int:
    """Tokens that each of ``k`` passages may have in a prompt of ``max_source``."""
    return min(max_passage, max(1, (max_source - 256) // k - 32))


def cut_contexts(contexts: Column, budget: int) -> Column:
    """Contexts (array of struct with text) whose texts end after ``budget`` tokens, which
    are words between white space; a shorter text stays as it is."""

    def cut(text: Column) -> Column:
        return T.let(F.filter(F.split(T.text_or_empty(text), r"\s+", -1), lambda w: w != ""), lambda w: F.when(F.size(w) > budget, F.array_join(F.slice(w, 1, budget), " ")).otherwise(text))

    return F.transform(contexts, lambda c: c.withField("text", cut(c["text"])))


# ---------------------------------------------------------------------- passages


def build_passages(contexts: DataFrame, most: int = 6, size: int = 256) -> DataFrame:
    """``contexts(query_id, ctx, doc_id, text)`` to passages of ``size`` tokens, taken
    round robin over the contexts until ``most``: (query_id, ctx, doc_id, chunk_index,
    global_start, global_end, tokens)."""
    tokens = F.slice(T.word_mark_tokens(F.col("text")), 1, most * size)
    cut = contexts.select("query_id", "ctx", "doc_id", tokens.alias("t"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size("t") / size).cast("int") - 1), lambda i: F.struct(i.alias("chunk_index"), F.slice("t", i * size + 1, size).alias("tokens")))
    rows = cut.where(F.size("t") > 0).select("query_id", "ctx", "doc_id", F.inline(pieces))
    turn = Window.partitionBy("query_id").orderBy("chunk_index", "ctx")
    chosen = rows.withColumn("p", F.row_number().over(turn)).where(F.col("p") <= most)
    end = F.sum(F.size("tokens")).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    placed = chosen.withColumn("global_end", end - 1)
    return placed.select("query_id", "ctx", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), (F.col("global_end") - F.size("tokens") + 1).cast("long").alias("global_start"), F.col("global_end").cast("long").alias("global_end"), "tokens")


def answer_passages(passages: DataFrame, spans: DataFrame) -> DataFrame:
    """Passages that a labelled span (query_id, start, end, score) touches."""
    joined = passages.join(spans, "query_id", "left")
    touches = (F.col("global_start") <= F.col("end")) & (F.col("global_end") >= F.col("start")) & (F.col("score") > 0)
    return joined.select("query_id", "ctx", "chunk_index", "global_start", "global_end", F.coalesce(touches, F.lit(False)).alias("is_answer_passage"))


# ------------------------------------------------------------------- span labels


def exact_spans(passages: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, start, end, method) of the first passage that holds, in this order of
    preference, the whole answer, its longest fragment, or its words alone."""
    rows = passages.join(answers.select("query_id", "answer"), "query_id")
    whole = T.word_mark_tokens(F.col("answer"))
    is_word = lambda t: t.rlike(r"^[\p{L}\p{N}_]")
    rows = rows.select("query_id", "global_start", "tokens", whole.alias("a"), T.answer_fragments(F.col("answer")).alias("fragments"))
    rows = rows.withColumn("words", F.filter("a", is_word)).withColumn(
        "word_at", F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: is_word(F.get("tokens", i)))
    )
    rows = rows.withColumn("context_words", F.transform("word_at", lambda i: F.get("tokens", i)))
    rows = rows.withColumn("exact", T.subsequence_at(F.col("tokens"), F.col("a")))
    hits = F.filter(F.transform("fragments", lambda f, i: F.struct(i.alias("order"), T.subsequence_at(F.col("tokens"), f).alias("at"), F.size(f).alias("n"))), lambda x: x["at"].isNotNull())
    rows = rows.withColumn("fragment", F.get(hits, F.lit(0))).withColumn("word", T.subsequence_at(F.col("context_words"), F.col("words")))
    g = F.col("global_start")
    word_start = F.get("word_at", F.col("word"))
    word_end = F.get("word_at", F.col("word") + F.size("words") - 1)
    options = F.array(
        F.when(F.col("exact").isNotNull(), F.struct(F.lit(0).alias("tier"), F.lit(0).alias("order"), g.alias("g"), (g + F.col("exact")).alias("s"), (g + F.col("exact") + F.size("a") - 1).alias("e"))),
        F.when(F.col("fragment").isNotNull(), F.struct(F.lit(1).alias("tier"), F.col("fragment.order").alias("order"), g.alias("g"), (g + F.col("fragment.at")).alias("s"), (g + F.col("fragment.at") + F.col("fragment.n") - 1).alias("e"))),
        F.when(F.col("word").isNotNull(), F.struct(F.lit(2).alias("tier"), F.lit(0).alias("order"), g.alias("g"), (g + word_start).alias("s"), (g + word_end).alias("e"))),
    )
    best_ = rows.select("query_id", F.array_min(F.filter(options, lambda o: o.isNotNull())).alias("o")).groupBy("query_id").agg(F.min("o").alias("o")).where("o is not null")
    method = F.element_at(F.array(F.lit("exact"), F.lit("fragment"), F.lit("subsequence")), F.col("o.tier") + 1)
    return best_.select("query_id", F.col("o.s").cast("long").alias("start"), F.col("o.e").cast("long").alias("end"), method.alias("method"))


#: The longest window, and how much shorter or longer than the answer two are.
LONGEST, NEAR = 1536, 16


def overlap_window(answer: list[str], context: list[str]) -> tuple[int, int, float]:
    """The window of a few lengths around the answer's with the highest token F1;
    shorter, then earlier windows win ties."""
    n, m = len(answer), len(context)
    if not n or not m:
        return 0, 0, 0.0
    longest = min(m, max(1, min(LONGEST, 2 * n)))
    widths = sorted(w for w in {max(1, n // 2), max(1, n - NEAR), n, min(longest, n + NEAR), longest} if w <= m)
    need = Counter(answer)
    top: tuple[float, int, int] = (-1.0, 0, 0)
    for width in widths:
        spare = dict(need)  # how many of each token the window still lacks
        shared = 0
        for end, token in enumerate(context):
            left = spare.get(token)
            if left is not None:
                spare[token] = left - 1
                shared += left > 0
            start = end - width + 1
            if start < 0:
                continue
            score = 2.0 * shared / (n + width)
            if (score, -width, -start) > top:
                top = (score, -width, -start)
            gone = context[start]
            left = spare.get(gone)
            if left is not None:
                spare[gone] = left + 1
                shared -= left >= 0
    score, width, start = top
    return -start, -start - width - 1, max(0.0, score)


def overlap_spans(passages: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, start, end, overlap_score): the best window inside any one passage."""
    rows = passages.join(answers.select("query_id", T.word_mark_tokens(F.col("answer")).alias("a")), "query_id")

    @F.pandas_udf("struct<s:long,e:long,score:double>")
    def window(a: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([overlap_window(list(x), list(y)) for x, y in zip(a, t)], columns=["s", "e", "score"])

    found = rows.select("query_id", "global_start", window("a", "tokens").alias("w"))
    found = found.select("query_id", (F.col("global_start") + F.col("w.s")).alias("start"), (F.col("global_start") + F.col("w.e")).alias("end"), F.round("w.score", 6).alias("overlap_score"))
    width = F.col("end") - F.col("start")
    return best(found, "query_id", [F.desc("overlap_score"), width, F.col("start")])


# ----------------------------------------------------------------- training rows


def hop_training_rows(positives: DataFrame, corpus: DataFrame, epoch: int, method: str = "mdr") -> DataFrame:
    """``positives(query_id, question, doc_ids)``: one row per query for an epoch.  The
    target hop rotates over the positives that the corpus holds; the methods of
    ``HISTORY_METHODS`` add the facts of earlier hops."""
    rows = positives.select("query_id", "question", F.posexplode("doc_ids").alias("pos", "doc_id"))
    held = rows.join(corpus.select("doc_id"), "doc_id", "left_semi")
    kept = held.groupBy("query_id", "question").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    hop = F.lit(epoch) % F.size("doc_ids")
    base = kept.select("query_id", "question", "doc_ids", hop.alias("hop"))
    target = F.get("doc_ids", F.col("hop")).alias("positive_id")
    if method == "dense":
        return base.select("query_id", F.col("question").alias("query"), F.col("question").alias("posterior_query"), target, F.col("hop").cast("long").alias("hop"))
    used = base.select("query_id", "question", "hop", F.posexplode(F.slice("doc_ids", F.lit(1), F.col("hop") + 1)).alias("pos", "doc_id"))
    facts = used.join(corpus.select("doc_id", F.col("text").alias("body")), "doc_id").select("query_id", "pos", "hop", T.concise_fact(F.col("body"), F.col("question")).alias("fact"))
    grouped = facts.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") < F.col("hop"), F.struct("pos", "fact")))), lambda x: x["fact"]), " ").alias("before"),
        F.max(F.when(F.col("pos") == F.col("hop"), F.col("fact"))).alias("target"),
    )
    carried = F.when(F.col("hop") > 0, F.concat("question", F.lit(SO_FAR), "before")).otherwise(F.col("question")) if method in HISTORY_METHODS else F.col("question")
    joined = base.join(grouped, "query_id").withColumn("query", carried)
    return joined.select("query_id", "query", F.concat("query", F.lit(POSTERIOR), "target").alias("posterior_query"), target, F.col("hop").cast("long").alias("hop"))


def contrastive_loss(scores: DataFrame, temperature: float = 0.05) -> DataFrame:
    """``scores(query_id, doc_id, score, positive)``: log-sum-exp of all minus that of
    the positives, shifted by the maximum; and its mean is the loss."""
    z = F.col("score") / temperature
    top = scores.groupBy("query_id").agg(F.max(z).alias("top"))
    shifted = scores.join(top, "query_id")
    e = F.exp(z - F.col("top"))
    return shifted.groupBy("query_id").agg((F.log(F.sum(e)) - F.log(F.sum(F.when(F.col("positive"), e).otherwise(0.0)))).alias("loss"))


def relevance_bce(scores: DataFrame, weight: float = 0.25) -> DataFrame:
    """Weighted binary cross entropy of scores as logits, by query."""
    x, y = F.col("score"), F.col("positive").cast("double")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return scores.groupBy("query_id").agg((F.avg(loss) * weight).alias("bce"))


def distillation_kl(scores: DataFrame, weight: float = 0.1) -> DataFrame:
    """``scores(query_id, doc_id, student, teacher)``: weighted KL of the teacher's
    distribution from the student's, by query."""
    top = scores.groupBy("query_id").agg(F.max("student").alias("ms"), F.max("teacher").alias("mt"))
    sums = scores.join(top, "query_id").groupBy("query_id", "ms", "mt").agg(F.log(F.sum(F.exp(F.col("student") - F.col("ms")))).alias("ls"), F.log(F.sum(F.exp(F.col("teacher") - F.col("mt")))).alias("lt"))
    rows = scores.join(sums, "query_id")
    lt, ls = F.col("teacher") - F.col("mt") - F.col("lt"), F.col("student") - F.col("ms") - F.col("ls")
    return rows.groupBy("query_id").agg((F.sum(F.exp(lt) * (lt - ls)) * weight).alias("kl"))


def span_passage_loss(logits: DataFrame, labels: DataFrame, passages: DataFrame, weight: float = 0.25) -> DataFrame:
    """``logits(batch, id, position, start_logit, end_logit)``, ``labels(batch, id, start,
    end)`` and ``passages(batch, id, logit, label)`` of the passages in use: by batch the
    mean cross entropy of start and end, halved together, the mean binary cross entropy
    of all passages, and their weighted sum: (batch, loss, span_loss, passage_loss)."""
    top = logits.groupBy("batch", "id").agg(F.max("start_logit").alias("ms"), F.max("end_logit").alias("me"))
    joined = logits.join(top, ["batch", "id"]).join(labels.select("batch", "id", "start", "end"), ["batch", "id"])
    side = lambda logit, peak, at: F.log(F.sum(F.exp(F.col(logit) - F.col(peak)))) + F.max(peak) - F.max(F.when(F.col("position") == F.col(at), F.col(logit)))
    spans = joined.groupBy("batch", "id").agg(((side("start_logit", "ms", "start") + side("end_logit", "me", "end")) / 2).alias("ce"))
    x, y = F.col("logit"), F.col("label").cast("double")
    flags = passages.groupBy("batch").agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("passage_loss"))
    both = spans.groupBy("batch").agg(F.avg("ce").alias("span_loss")).join(flags, "batch")
    return both.select("batch", (F.col("span_loss") + weight * F.col("passage_loss")).alias("loss"), "span_loss", "passage_loss")


def moving_average(teacher: Column, student: Column, momentum: float = 0.999) -> Column:
    return teacher * momentum + student * (1 - momentum)


def joined_targets(positives: DataFrame) -> DataFrame:
    """``positives(query_id, doc_ids)``: the ids that a generator is to write."""
    return positives.select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), DOC_MARK).alias("target"))


def epoch_order(rows: DataFrame, id_col: str, seed: int, epoch: int) -> DataFrame:
    """A seeded permutation per epoch, as ``position`` from 1: the order of a hash of seed,
    epoch and id.  The hash's first bits cut it into ranges of like size; a range's rows
    are numbered on their own, after as many rows as the ranges before it hold."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")
    marked = rows.withColumn("__h", digits).withColumn("__range", F.shiftright("__h", 48))
    counts = marked.groupBy("__range").agg(F.count("*").alias("n"))  # 4,096 rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__range", before.alias("__before")))
    number = F.row_number().over(Window.partitionBy("__range").orderBy("__h", id_col))
    return marked.join(offsets, "__range").withColumn("position", F.col("__before") + number).drop("__h", "__range", "__before")
