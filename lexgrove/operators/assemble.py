"""Text blocks for a table of questions: contexts, histories, prompts.

Every list gathered here is bounded: the hits of one query, or the last N
messages of one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.text import blank_to_null, fill, head
from lexgrove.operators.sequences import last_n


def _or_missing(c: str) -> Column:
    return F.coalesce(blank_to_null(F.col(c)), F.lit(fv.MISSING))


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def joined_in_order(df: DataFrame, key: str, order: str, text: Column, sep: str, name: str) -> DataFrame:
    """One text per key from its few rows, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias(name))


def _with_context() -> Column:
    """Content between the texts of its neighbours."""
    before = F.when(
        _present("context_before"),
        F.concat(F.lit(fv.CONTEXT_BEFORE_HEAD), F.col("context_before")),
    )
    after = F.when(
        _present("context_after"), F.concat(F.lit(fv.CONTEXT_AFTER_HEAD), F.col("context_after"))
    )
    return F.concat_ws("\n", before, F.col("content"), after)


def legal_block() -> Column:
    return fill(
        fv.STATUTE_BLOCK,
        index=F.col("rank"),
        doc_name=_or_missing("doc_name"),
        doc_number=_or_missing("doc_number"),
        doc_type=_or_missing("doc_type"),
        dieu=_or_missing("dieu"),
        dieu_title=F.col("dieu_title"),
        effective_date=_or_missing("effective_date"),
        content=_with_context(),
    )


def verdict_block() -> Column:
    label = F.col("section_type")
    for value, text in fv.SECTION_LABELS:
        label = F.when(F.col("section_type") == value, F.lit(text)).otherwise(label)
    detail = F.coalesce(
        *[F.when(_present(c), F.concat(F.lit(text), F.col(c))) for c, text in fv.SECTION_DETAILS],
        F.lit(""),
    )
    return fill(
        fv.VERDICT_BLOCK,
        index=F.col("rank"),
        case_number=_or_missing("case_number"),
        court_name=_or_missing("court_name"),
        judgment_date=_or_missing("judgment_date"),
        trial_level=_or_missing("trial_level"),
        ip_types=F.array_join("ip_types", ", "),
        plaintiff=_or_missing("plaintiff"),
        defendant=_or_missing("defendant"),
        section_label=label,
        section_detail=detail,
        content=_with_context(),
    )


def trademark_block() -> Column:
    labels = {k: F.lit(v) for k, v in fv.TRADEMARK_LABELS.items()}

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    def optional(label: str, c: str) -> Column:
        return F.when(_present(c), F.concat(labels[label], F.col(c)))

    classes = F.when(
        F.size(F.coalesce("classes", F.array().cast("array<string>"))) > 0,
        F.array_join("classes", ", "),
    ).otherwise(fv.MISSING)
    kind = F.coalesce(blank_to_null(F.col("ipr_type")), blank_to_null(F.col("feature")), F.lit(fv.MISSING))
    country = F.coalesce(
        blank_to_null(F.col("country_of_filing")), blank_to_null(F.col("ip_office")), F.lit(fv.MISSING)
    )
    percent = F.bround(F.col("score") * 100).cast("int").cast("string")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), labels["name"], text("name")),
        F.concat(labels["owner"], text("owner_name"), F.lit(" ("), text("owner_country"), F.lit(")")),
        F.concat(labels["registration"], text("registration_number")),
        optional("application", "application_number"),
        optional("st13", "st13"),
        F.concat(labels["classes"], classes),
        F.concat(labels["kind"], kind),
        F.concat(labels["country"], country),
        F.concat(labels["status"], text("status")),
        optional("applied", "application_date"),
        optional("registered", "registration_date"),
        optional("expires", "expiry_date"),
        F.concat(labels["score"], percent, F.lit("% ("), F.col("match_type"), F.lit(")")),
    )


def contexts(hits: DataFrame, block: Column, separator: str = "\n") -> DataFrame:
    """``(query_id, context)`` from ranked hits."""
    return joined_in_order(hits, "query_id", "rank", block, separator, "context")


def case_lists(hits: DataFrame, case: str = "case_number") -> DataFrame:
    """``(query_id, case_list)``: distinct cases in order of their first hit."""
    first = (
        hits.where(F.coalesce(F.col(case).cast("string"), F.lit("")) != "")
        .groupBy("query_id", case)
        .agg(F.min("rank").alias("_first"))
    )
    return joined_in_order(first, "query_id", "_first", F.col(case).cast("string"), ", ", "case_list")


# ---------------------------------------------------------------- conversations
def history_line(role: Column, content: Column) -> Column:
    """``User: …`` or ``Assistant: …``, long assistant texts cut."""
    is_user = role == "user"
    limit = fv.HISTORY_ASSISTANT_CHARS
    cut = F.when(
        ~is_user & (F.length(content) > limit), F.concat(head(content, limit), F.lit("..."))
    ).otherwise(content)
    return F.concat(F.when(is_user, "User: ").otherwise("Assistant: "), cut)


def histories(
    messages: DataFrame,
    session: str,
    order: str,
    role: str,
    content: str,
    n: int = fv.HISTORY_MESSAGES,
) -> DataFrame:
    """``(session, history)``: the last ``n`` messages, oldest first, as one block."""
    recent = last_n(messages.select(session, order, role, content), session, [F.col(order)], n)
    line = history_line(F.col(role), F.col(content))
    text = joined_in_order(recent, session, order, line, "\n", "history")
    return text.withColumn("history", fill(fv.HISTORY_BLOCK, history=F.col("history")))


def session_titles(
    messages: DataFrame, session: str, order: str, role: str, content: str
) -> DataFrame:
    """``(session, title)`` from the first user message; the default title without one."""
    limit = fv.SESSION_TITLE_CHARS
    # one character more than the title tells whether the message is longer
    opening = head(F.col(content), limit + 1)
    first = F.min_by(opening, F.when(F.col(role) == "user", F.col(order)))
    titled = messages.groupBy(session).agg(first.alias("_first"))
    title = F.when(
        F.length("_first") > limit, F.concat(head(F.col("_first"), limit), F.lit("..."))
    ).otherwise(F.coalesce("_first", F.lit(fv.DEFAULT_SESSION_TITLE)))
    return titled.select(session, title.alias("title"))


# --------------------------------------------------------------------- prompts
def _joined(queries: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        queries = queries.join(part, "query_id", "left")
    return queries


def prompts(
    queries: DataFrame,
    contexts_: DataFrame,
    template: str,
    nothing_found: str,
    histories_: DataFrame | None = None,
    case_lists_: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, prompt)``: history, question and context of every query.

    Queries without any hit get the fixed text instead of a prompt.
    """
    parts = [contexts_] + [p for p in (histories_, case_lists_) if p is not None]
    rows = _joined(queries.select("query_id", F.col("text").alias("_query")), *parts)
    history = F.col("history") if histories_ is not None else F.lit("")
    cases = F.col("case_list") if case_lists_ is not None else F.lit(None).cast("string")
    body = fill(
        template,
        query=F.col("_query"),
        context=F.col("context"),
        case_list=F.coalesce(cases, F.lit(fv.NO_CASES)),
        history=history,
    )
    with_history = F.concat(F.coalesce(history, F.lit("")), F.lit("\n"), body)
    return rows.select(
        "query_id",
        F.when(F.col("context").isNull(), F.lit(nothing_found))
        .otherwise(body if "{history}" in template else with_history)
        .alias("prompt"),
    )


def trademark_prompts(
    queries: DataFrame, contexts_: DataFrame, histories_: DataFrame | None = None
) -> DataFrame:
    """As ``prompts``; a search without hits says so inside the prompt."""
    full = _joined(queries.select("query_id"), contexts_).select(
        "query_id", F.coalesce("context", F.lit(fv.NO_TRADEMARK)).alias("context")
    )
    return prompts(queries, full, fv.TRADEMARK_PROMPT, fv.NO_TRADEMARK, histories_)


def combined_contexts(legal: DataFrame, verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    """``(query_id, context)`` with a headed block per source that has hits."""
    both = (
        legal.withColumnRenamed("context", "_legal")
        .join(verdicts.withColumnRenamed("context", "_verdict"), "query_id", "full_outer")
        .join(cases, "query_id", "left")
    )
    heading = fill(
        fv.COMBINED_VERDICT_HEAD, case_list=F.coalesce("case_list", F.lit(fv.NO_CASES))
    )
    return both.select(
        "query_id",
        F.concat_ws(
            "\n",
            F.when(
                F.col("_legal").isNotNull(), F.concat(F.lit(fv.COMBINED_STATUTE_HEAD), "_legal")
            ),
            F.when(F.col("_verdict").isNotNull(), F.concat(heading, "_verdict")),
        ).alias("context"),
    )
