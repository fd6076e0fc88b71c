"""Answer assembly (K): contexts, chat history, prompts, refusals, explanations,
citations, final answers and source lists, all as per-query DataFrame work.

Every per-query group is a bounded hit list (top 10) or one reply text, so the
ordered ``collect_list`` aggregations here never gather an unbounded group.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(literal, field) pairs of a ``str.format`` template, parsed once on the driver."""
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(template)]


def fill(template: str, **fields) -> Column:
    """Fill ``{name}`` fields in one pass (substituted text is never re-expanded)."""
    parts = []
    for lit, field in template_parts(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            v = fields[field]
            parts.append(F.col(v) if isinstance(v, str) else v)
    return F.concat(*parts) if parts else F.lit("")


def fill_sql(template: str, **fields: str) -> str:
    parts = []
    for lit, field in template_parts(template):
        if lit:
            parts.append(T._lit_sql(lit))
        if field is not None:
            parts.append(fields[field])
    return "(" + " || ".join(parts) + ")" if parts else "''"


def _ordered_join(order_col: str, value, sep: str) -> Column:
    """Values of a bounded group, ordered by ``order_col``, joined by ``sep``."""
    v = F.col(value) if isinstance(value, str) else value
    arr = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), v.alias("v"))))
    return F.array_join(F.transform(arr, lambda x: x["v"]), sep)


def context_string(hits: DataFrame, order_col: str = "rerank", questions: DataFrame | None = None) -> DataFrame:
    """K2: ``"\\nExtracted documents:\\n"`` + ``"Document {i}\\n" + content`` per hit, i from 0, and the
    number of hits. With ``questions`` those without hits have a row too: the header alone, 0 hits."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("content").alias("v"))))
    items = F.transform(arr, lambda x, i: F.concat(F.lit("Document "), i.cast("string"), F.lit("\n"), x["v"]))
    found = hits.groupBy("query_id").agg(F.concat(F.lit(C.CONTEXT_HEADER), F.array_join(items, "")).alias("context"),
                                         F.count(F.lit(1)).alias("n_hits"))
    if questions is None:
        return found
    return questions.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(C.CONTEXT_HEADER)).alias("context"),
        F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"))


def chat_history(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """K3: ``user: ...`` / ``assistant: ...`` lines in turn order (every non-user role
    prints as assistant); ``No previous conversation.`` for an empty history."""
    line = F.concat(F.when(F.col("role") == "user", F.lit("user: ")).otherwise(F.lit("assistant: ")), F.col("text"))
    g = messages.groupBy(key).agg(_ordered_join("turn", line, "\n").alias("h"))
    return g.select(key, F.when(F.col("h") == "", F.lit(C.NO_HISTORY)).otherwise(F.col("h")).alias("chat_history"))


def history_append(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """K4: memory rows written after an answer: the question as ``user`` at turn+1 and
    ``answer + blank line + context`` as ``assistant`` at turn+2.

    ``turns``: key, turn (last turn so far), question, answer, context.
    """
    user = turns.select(key, (F.col("turn") + 1).alias("turn"), F.lit("user").alias("role"),
                        F.col("question").alias("text"))
    bot = turns.select(key, (F.col("turn") + 2).alias("turn"), F.lit("assistant").alias("role"),
                       F.concat(F.col("answer"), F.lit("\n\n"), F.coalesce(F.col("context"), F.lit(""))).alias("text"))
    return user.unionByName(bot)


def generate(prompts: DataFrame, generator: Callable[[list[str], list[str]], list[str]]) -> DataFrame:
    """Answers ``(query_id, answer)`` of a prompt table, by a batch function of (system prompts,
    user prompts) -> answers that gets Arrow batches; to be joined back by ``query_id``."""

    @F.pandas_udf("string")
    def answer(system: pd.Series, user: pd.Series) -> pd.Series:
        return pd.Series(generator(system.tolist(), user.tolist()), dtype=object)

    return prompts.select("query_id", answer("system_prompt", "user_prompt").alias("answer"))


def repeat_question(system: list[str], user: list[str]) -> list[str]:
    """A generator for tests: what follows the last ``Question: `` of each prompt."""
    return [u.rpartition("Question: ")[2] for u in user]


def prompt_table(questions: DataFrame, contexts: DataFrame, history: DataFrame | None = None,
                 variant: str = "chat") -> DataFrame:
    """K5 + B15: per question the routed template (with context when it has hits) as
    ``(query_id, template, system_prompt, user_prompt)``. ``history`` has the chat histories
    (query_id, chat_history) of questions that continue a conversation."""
    if variant == "chat":
        sys_c, usr_c, sys_n, usr_n = (C.CHAT_SYSTEM_WITH_CONTEXT, C.CHAT_USER_WITH_CONTEXT,
                                      C.CHAT_SYSTEM_NO_CONTEXT, C.CHAT_USER_NO_CONTEXT)
    else:
        sys_c, usr_c, sys_n, usr_n = (C.EVAL_SYSTEM_WITH_CONTEXT, C.EVAL_USER_WITH_CONTEXT,
                                      C.EVAL_SYSTEM_NO_CONTEXT, C.EVAL_USER_NO_CONTEXT)
    j = questions.join(contexts, "query_id", "left")
    hist = F.lit(C.NO_HISTORY)
    if history is not None:
        j = j.join(history.select("query_id", "chat_history"), "query_id", "left")
        hist = F.coalesce("chat_history", hist)
    ctx = F.coalesce(F.col("context"), F.lit(""))
    fields = dict(context=ctx, chat_history=hist, question=F.col("query_text"))
    has = F.coalesce(F.col("n_hits") > 0, F.lit(False))
    return j.select(
        "query_id",
        F.when(has, F.lit("context")).otherwise(F.lit("no_context")).alias("template"),
        F.when(has, fill(sys_c, **fields)).otherwise(fill(sys_n, **fields)).alias("system_prompt"),
        F.when(has, fill(usr_c, **fields)).otherwise(fill(usr_n, **fields)).alias("user_prompt"),
    )


def refusal_flag(answers: DataFrame) -> DataFrame:
    """K6: the answer equals the fixed no-documents text after normalisation."""
    return answers.select("query_id", (T.normalize("answer") == T.normalize(F.lit(C.NO_DOCS_TEMPLATE))).alias("refusal"))


def explain_prompt(hits: DataFrame, questions: DataFrame, order_col: str = "rerank") -> DataFrame:
    """K7: explanation request per query: sources in order of their first hit, each
    with its first three contents (hit order) joined by newline."""
    w = Window.partitionBy("query_id", "source").orderBy(order_col)
    h = hits.withColumn("k", F.row_number().over(w))
    per_src = h.groupBy("query_id", "source").agg(
        F.min(order_col).alias("first"),
        _ordered_join(order_col, F.when(F.col("k") <= C.EXPLAIN_CHUNKS_PER_SOURCE, F.col("content")), "\n")
        .alias("contents"))
    item = fill(C.EXPLAIN_USER_ITEM, source=F.col("source"), contents=F.col("contents"))
    items = per_src.groupBy("query_id").agg(_ordered_join("first", item, "").alias("items"))
    q = questions.join(items, "query_id")
    return q.select("query_id", F.lit(C.EXPLAIN_SYSTEM).alias("system_prompt"),
                    F.concat(fill(C.EXPLAIN_USER_HEAD, query=F.col("query_text")), F.col("items")).alias("user_prompt"))


# A line naming a document, and the label that may open an explanation line.
DOC_LINE = r"[Dd]ocument[:\-–]?" + T.WS + r"*([^\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]+?\.pdf)"
EXPLANATION_LABEL = r"(?i)^Explanation:" + T.WS + "*"


def parse_explanations(replies: DataFrame) -> DataFrame:
    """K8: ``(query_id, doc, explanation)`` from free-text replies.

    A line naming ``<name>.pdf`` opens (or restarts) that document's section; the
    following lines, label removed and stripped, are appended with a trailing space;
    lines before the first document are dropped; leading non-letters are removed.
    """
    lines = replies.select("query_id", F.posexplode(F.split("reply", "\n", -1)).alias("ln", "line"))
    is_doc = F.col("line").rlike(DOC_LINE)
    lines = lines.withColumn("doc", F.when(is_doc, F.regexp_extract("line", DOC_LINE, 1)))
    w = Window.partitionBy("query_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(is_doc.cast("int")).over(w)).where(F.col("section") > 0)
    body = F.when(~is_doc, F.concat(T.py_strip(F.regexp_replace("line", EXPLANATION_LABEL, "")), F.lit(" ")))
    sec = lines.groupBy("query_id", "section").agg(
        F.max("doc").alias("doc"),
        _ordered_join("ln", F.coalesce(body, F.lit("")), "").alias("text"))
    wl = Window.partitionBy("query_id", "doc").orderBy(F.col("section").desc())
    last = sec.withColumn("r", F.row_number().over(wl)).where("r = 1")
    return last.select("query_id", "doc", F.regexp_replace("text", "^[^a-zA-Z]*", "").alias("explanation"))


def citation_block(hits: DataFrame, explanations: DataFrame, base_url: str = C.VIEWER_BASE_URL,
                   order_col: str = "rerank") -> DataFrame:
    """K9 + K10: per query, one two-line entry per source (sources in first-hit order):
    title, page links with highlight snippets, and the explanation or the default text."""
    snippet = T.clean_snippet(F.left("content", F.lit(C.CHUNK_SIZE)))
    pages = hits.select("query_id", "source", order_col, F.col("page_number").alias("page"), snippet.alias("snippet"))
    link = F.concat(F.lit("[pag."), F.col("page").cast("string"), F.lit("]("), F.lit(base_url), F.lit("?file="),
                    T.url_quote("source", keep_slash=True), F.lit("&page="), F.col("page").cast("string"),
                    F.lit("&highlight="), T.double_url_encode("snippet"), F.lit(")"))
    distinct_pages = pages.groupBy("query_id", "source", "page", "snippet").agg(F.min(order_col).alias("o"))
    per_src = distinct_pages.withColumn("link", link).groupBy("query_id", "source").agg(
        F.min("o").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "snippet", "link"))),
                                 lambda x: x["link"]), ", ").alias("links"))
    ex = explanations.select("query_id", F.col("doc").alias("source"), "explanation")
    per_src = per_src.join(ex, ["query_id", "source"], "left")
    expl = F.regexp_replace(F.coalesce("explanation", F.lit(C.NO_EXPLANATION)), "^[^a-zA-Z]*", "")
    entry = F.concat(F.lit(C.SOURCE_LINE_PREFIX), T.short_title("source"), F.lit(": "), F.col("links"), F.lit("\n"),
                     F.lit(C.EXPLANATION_LINE_PREFIX), expl, F.lit("\n\n"))
    return per_src.groupBy("query_id").agg(_ordered_join("first", entry, "").alias("citations"))


def final_answer(answers: DataFrame, citations: DataFrame, refusals: DataFrame) -> DataFrame:
    """Answer + blank line + citations, unless there were no hits or it is a refusal."""
    j = answers.join(citations, "query_id", "left").join(refusals, "query_id", "left")
    cite = F.col("citations").isNotNull() & ~F.coalesce(F.col("refusal"), F.lit(False))
    return j.select("query_id", F.when(cite, F.concat("answer", F.lit("\n\n"), "citations"))
                    .otherwise(F.col("answer")).alias("final_answer"))


def source_list(questions: DataFrame, hits: DataFrame, order_col: str = "rerank") -> DataFrame:
    """``[source, Pagina page]`` lines in hit order, or ``null`` without hits."""
    line = F.concat(F.lit("["), F.col("source"), F.lit(f", {C.SOURCE_PAGE_LABEL} "),
                    F.col("page_number").cast("string"), F.lit("]"))
    s = hits.groupBy("query_id").agg(_ordered_join(order_col, line, "\n").alias("sources"))
    return questions.select("query_id").join(s, "query_id", "left").select(
        "query_id", F.coalesce("sources", F.lit(C.NO_SOURCES)).alias("sources"))
