"""What a service around the corpus keeps: permissions, feedback, uploads, guided steps, notes on files, rendered answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each permission, and the column of a user that grants it.
PERMISSIONS = {
    "view_responses": "is_user",
    "submit_queries": "is_user",
    "upload_documents": "can_upload",
    "view_audit_logs": "is_admin",
    "manage_users": "is_admin",
    "admin_access": "is_admin",
}

#: What a file is by the end of its name, and what it holds by the type of its source.
FILE_KINDS = {
    "pdf": "PDF document that may contain financial reports, standards, or regulatory information",
    "docx": "Word document likely containing policies, procedures, or analysis",
    "doc": "Word document likely containing policies, procedures, or analysis",
    "xlsx": "Excel spreadsheet potentially containing financial data, calculations, or models",
    "xls": "Excel spreadsheet potentially containing financial data, calculations, or models",
    "csv": "Data file containing structured information suitable for analysis",
    "txt": "Text document with raw content",
    "pptx": "Presentation document with slides and visual content",
    "ppt": "Presentation document with slides and visual content",
}
SOURCE_KINDS = {
    "US_GAAP": "Contains US GAAP accounting standards and guidance",
    "IFRS": "Contains International Financial Reporting Standards",
    "COMPANY": "Company-specific document for internal use",
    "ACTUARIAL": "Actuarial analysis, models, or calculations",
    "REGULATORY": "Regulatory guidance or compliance documentation",
}


def granted(users: DataFrame) -> DataFrame:
    """(user_id, permission, allowed): each user with each permission; a column that is null grants nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("permission"), F.coalesce(v, F.lit(False)).alias("allowed")) for k, v in PERMISSIONS.items()]))
    return users.select("user_id", each.alias("p")).select("user_id", "p.permission", "p.allowed")


def file_notes(name: Column, size: Column, source_type: Column) -> dict[str, Column]:
    """What can be said of a file without reading it."""
    end = F.when(F.contains(name, F.lit(".")), F.element_at(F.split(F.lower(name), r"\."), -1)).otherwise("unknown")
    looked_up = lambda table, key, other: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(other))
    kilobytes = F.format_string("%.1f", F.bround(size / 1024, 1))
    return {
        "kind": F.concat(F.upper(end), F.lit(" ("), looked_up(FILE_KINDS, end, "Document file"), F.lit(")")),
        "category": looked_up(SOURCE_KINDS, source_type, "Business document"),
        "size": F.concat(F.format_number(size, 0), F.lit(" bytes ("), kilobytes, F.lit(" KB)")),
    }


def upload_jobs(uploads: DataFrame) -> DataFrame:
    """(job_id, status, duplicate_of, uploads) of uploads in the order of job_id, with ``digest`` and ``refused``.

    The first upload of a content that the store takes is queued; later ones are completed at once as duplicates of it,
    whether the store would take them or not. Before it, refused ones fail and leave their digest free. ``uploads``
    counts the original and its duplicates. Totals of a digest are pre-aggregated, so copies of one text meet nowhere.
    """
    first = uploads.groupBy("digest").agg(F.min(F.when(~F.col("refused"), F.col("job_id"))).alias("first"))
    own = uploads.join(first, "digest", "left")
    later = own.filter("job_id >= first").groupBy("digest").agg(F.count("*").alias("n"))
    status = F.when(F.col("first").isNull() | (F.col("job_id") < F.col("first")), "failed").when(F.col("job_id") == F.col("first"), "queued").otherwise("completed")
    taken = own.withColumn("status", status).join(later, "digest", "left")
    kept = F.col("status") != "failed"
    return taken.select("job_id", "status", F.when(F.col("status") == "completed", F.col("first")).alias("duplicate_of"), F.when(kept, F.col("n")).alias("uploads"))


def with_related(q: Column, lexicon: list[tuple], most: int = 3) -> Column:
    """A question and the first related terms, sorted, of the lexicon's keys that occur in it.

    Rows of ``lexicon`` are (key, related terms, aliases, confidence); aliases count from a confidence over 0.8. Terms
    that are words of the question already are left out.
    """
    low = F.lower(q)
    parts = [F.when(F.contains(low, F.lit(key)), F.lit(related + (aliases if sure > 0.8 else []))).otherwise(F.array().cast("array<string>")) for key, related, aliases, sure in lexicon]
    new = F.array_sort(F.array_except(F.flatten(F.array(*parts)), F.split(low, r"[ \t\n\r\f]+")))
    return F.when(F.size(new) > 0, F.concat(q, F.lit(" "), F.array_join(F.slice(new, 1, most), " "))).otherwise(q)


def guided(responses: DataFrame, steps: list[dict]) -> DataFrame:
    """(session, step, n_done, n_rejected, message, progress, status) after the responses of each session, in order.

    A step is a dict of ``id``, ``required``, ``next`` and, if it has them, ``choices``, ``least`` (a number) and
    ``branches`` (response to next step). A response that a step rejects leaves it open; ``message`` is the last
    rejection. Responses after the end change nothing. A session is what one person typed: it is folded in one row.
    """

    def rejection(step: dict, x: Column) -> Column:
        out = [F.when(F.lit(step["required"]) & (F.trim(x) == ""), "This field is required")]
        if "choices" in step:
            out.append(F.when((x != "") & ~x.isin(step["choices"]), "Please select one of: " + ", ".join(step["choices"])))
        if "least" in step:
            number = x.try_cast("double")
            out += [F.when(number.isNull(), "Please enter a valid number"), F.when(number < step["least"], f"Value must be at least {step['least']}")]
        return F.coalesce(*out)

    def following(step: dict, x: Column) -> Column:
        return F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in step.get("branches", {}).items()], F.lit(step["next"]).cast("string"), F.lit("end"))

    def of_step(now: Column, f) -> Column:
        return F.coalesce(*[F.when(now == s["id"], f(s)) for s in steps])

    def move(acc: Column, row: Column) -> Column:
        x, now = F.coalesce(row["response"], F.lit("")), acc["step"]
        bad, open_ = of_step(now, lambda s: rejection(s, x)), now != "end"
        good = open_ & bad.isNull()
        return F.struct(
            F.when(good, of_step(now, lambda s: following(s, x))).otherwise(now).alias("step"),
            (acc["done"] + good.cast("long")).alias("done"),
            (acc["rejected"] + (open_ & bad.isNotNull()).cast("long")).alias("rejected"),
            F.when(open_ & bad.isNotNull(), bad).otherwise(acc["message"]).alias("message"),
        )

    start = F.struct(F.lit(steps[0]["id"]).alias("step"), F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("rejected"), F.lit(None).cast("string").alias("message"))
    own = responses.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", "response"))).alias("r"))
    own = own.select("session", F.aggregate("r", start, move).alias("a"))
    ended = F.col("a.step") == "end"
    progress = F.when(~ended, F.round((F.col("a.done") + 1) / len(steps) * 100, 1))
    return own.select("session", F.when(~ended, F.col("a.step")).alias("step"), F.col("a.done").alias("n_done"), F.col("a.rejected").alias("n_rejected"), F.col("a.message").alias("message"), progress.alias("progress"), F.when(ended, "completed").otherwise("continue").alias("status"))


#: The shape of a structured answer.
ANSWER = """struct<summary: string, key_values: map<string, array<string>>, sections: array<struct<title: string, content: string,
    formulas: array<struct<name: string, readable: string, components: map<string, string>>>, numbered_items: array<string>>>>"""


def answer_of(json: Column) -> Column:
    return F.from_json(json, ANSWER)


def complete(answer: Column) -> Column:
    """Whether an answer has a summary and sections, and each section a title and content."""
    whole = F.forall(answer["sections"], lambda s: s["title"].isNotNull() & s["content"].isNotNull())
    return F.coalesce(answer["summary"].isNotNull() & answer["sections"].isNotNull() & whole, F.lit(False))


def rendered(answer: Column) -> Column:
    """A structured answer as marked-up text; parts that are missing or null leave nothing."""

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def optional(c: Column, out: Column) -> Column:
        return F.when(c.isNotNull(), out).otherwise("")

    def each(items: Column, f) -> Column:
        return F.array_join(F.transform(F.coalesce(items, F.array()), f), "")

    def formula(x: Column) -> Column:
        where = each(F.map_entries(x["components"]), lambda e: text("  - ", e["key"], " = ", e["value"], "\n"))
        return text("\n• ", x["name"], ":\n  ", x["readable"], "\n", optional(x["components"], text("  Where:\n", where)))

    def section(s: Column) -> Column:
        return text(
            "\n**", F.coalesce(s["title"], F.lit("")), "**\n",
            optional(s["content"], text(s["content"], "\n")),
            optional(s["formulas"], text("\n**Key Formulas:**\n", each(s["formulas"], formula))),
            optional(s["numbered_items"], text("\n", each(s["numbered_items"], lambda x, i: text("**", (i + 1).cast("string"), ".** ", x, "\n\n")))),
        )

    values = each(F.map_values(answer["key_values"]), lambda v: each(v, lambda x: text("• ", x, "\n")))
    return text(
        optional(answer["summary"], text(answer["summary"], "\n")),
        each(answer["sections"], section),
        optional(answer["key_values"], text("\n**Important Values:**\n", values)),
    )


def covering_groups(text: Column, n: Column) -> Column:
    """Groups of document numbers named line by line; one group of all if they name less than 0.7 of ``n`` documents."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("Group")) & F.contains(x, F.lit(":")))
    groups = F.transform(lines, lambda x: _numbers(F.regexp_extract_all(x, F.lit("Doc ([0-9]+)"), F.lit(1)), n))
    groups = F.filter(groups, lambda g: F.size(g) > 0)
    return F.when(F.size(F.flatten(groups)) < n * 0.7, F.array(_range(F.lit(1), n))).otherwise(groups)


def topped_groups(text: Column, n: Column, shown: int = 15) -> Column:
    """Groups of the first ``shown`` documents, two halves if fewer than two are named; each later document joins the
    smallest group.
    """
    first = F.least(n, F.lit(shown))
    named = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, "Group [0-9]+:.*?Doc ([0-9]+(?:, Doc [0-9]+)*)", 1))
    groups = F.filter(F.transform(named, lambda x: _numbers(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), first)), lambda g: F.size(g) > 0)
    half = F.floor(first / 2).cast("int")
    groups = F.when(F.size(groups) < 2, F.array(_range(F.lit(1), half), _range(half + 1, first))).otherwise(groups)

    def join(gs: Column, d: Column) -> Column:
        sizes = F.transform(gs, F.size)
        at = F.array_position(sizes, F.array_min(sizes)) - 1
        return F.transform(gs, lambda g, i: F.when(i == at, F.concat(g, F.array(d))).otherwise(g))

    return F.aggregate(_range(F.lit(shown + 1), n), groups, join)


def _numbers(found: Column, n: Column) -> Column:
    return F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda k: k.between(1, n))


def _range(a: Column, b: Column) -> Column:
    """The numbers from a to b, none if b is less."""
    a, b = a.cast("int"), b.cast("int")
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
