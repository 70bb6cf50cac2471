"""Message texts, button payloads and the referral note, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.html import trim_space

# Fixed value: the note sent after an accepted posting
REFERRAL_TEMPLATE = (
    "I came across a recent posting for <<TITLE>> role at <<Company>>. I’ve already applied "
    "and wanted to check if you’d be open to referring me. I’ve attached my resume for "
    "context.\n\nJob ID: <<JOB-ID>>"
)


def _or_unknown(text: Column) -> Column:
    return F.coalesce(text, F.lit("Unknown"))


def _apply_line(link: Column) -> Column:
    return F.when(
        F.coalesce(link, F.lit("")) != "",
        F.concat(F.lit('\U0001f517 <a href="'), link, F.lit('">Apply</a>')),
    )


def job_message(
    company: Column,
    title: Column,
    location: Column,
    keywords: Column,
    link: Column,
    source: Column | None = None,
    index: Column | None = None,
    total: Column | None = None,
) -> Column:
    """The announcement of one posting, with a `Source | i of n` header when numbered."""
    words = F.coalesce(F.array_join(keywords, ", "), F.lit(""))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("\U0001f3e2 <b>"), _or_unknown(company), F.lit("</b>")),
        F.concat(F.lit("\U0001f4cc "), _or_unknown(title)),
        F.concat(F.lit("\U0001f4cd "), _or_unknown(location)),
        F.concat(
            F.lit("\U0001f3f7 "),
            F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, words).otherwise("none"),
        ),
        _apply_line(link),
    )
    if source is None or total is None:
        return body
    name = F.concat(
        F.upper(F.left(source, F.lit(1))),
        F.lower(F.right(source, F.length(source) - 1)),
    )
    header = F.concat(
        F.lit("\U0001f50e <b>"), name, F.lit("</b> | "),
        index.cast("string"), F.lit(" of "), total.cast("string"), F.lit("\n\n"),
    )
    shown = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(total, F.lit(0)) > 0)
    return F.concat(F.when(shown, header).otherwise(""), body)


def decided_message(
    company: Column,
    title: Column,
    location: Column,
    link: Column,
    decision: Column,
    referral_url: Column,
) -> Column:
    """The announcement as it reads once decided; links only if applied."""
    applied = decision == "applied"
    status = F.when(applied, F.lit("✅ APPLIED")).otherwise(F.lit("❌ REJECTED"))
    referral = F.concat(
        F.lit('\U0001f50d <a href="'), referral_url, F.lit('">Find referrers at '),
        _or_unknown(company), F.lit(" on LinkedIn</a>"),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<b>"), status, F.lit("</b>\n")),
        F.concat(F.lit("\U0001f3e2 <b>"), _or_unknown(company), F.lit("</b>")),
        F.concat(F.lit("\U0001f4cc "), _or_unknown(title)),
        F.concat(F.lit("\U0001f4cd "), _or_unknown(location)),
        F.when(applied, _apply_line(link)),
        F.when(applied & (F.coalesce(referral_url, F.lit("")) != ""), referral),
    )


# The answer to a callback, by verdict
ANSWERS = {
    "applied": "Applied ✅",
    "rejected": "Rejected ❌",
    "already_applied": "Already marked as applied",
    "already_rejected": "Already marked as rejected",
    "job_not_found": "Job not found",
    "invalid_request": "Invalid request",
    "unknown_action": "Unknown action",
    "invalid_id": "Invalid job ID",
}


def callback_answer(verdict: Column) -> Column:
    """What the sender of a callback is told; null for an event that is ignored."""
    texts = F.create_map(*(F.lit(x) for pair in ANSWERS.items() for x in pair))
    return F.try_element_at(texts, verdict)


def keyboard(job_id: Column) -> Column:
    """The two decision buttons, as JSON."""

    def button(text: str, verb: str) -> Column:
        data = F.concat(F.lit(f"{verb}:"), job_id.cast("string"))
        return F.struct(F.lit(text).alias("text"), data.alias("callback_data"))

    row = F.array(button("✅ Apply", "apply"), button("❌ Reject", "reject"))
    return F.to_json(F.struct(F.array(row).alias("inline_keyboard")))


def fill_template(
    title: Column, company: Column, job_id: Column, template: str = REFERRAL_TEMPLATE
) -> Column:
    """Placeholders filled in order, parts between `---` trimmed, empty parts dropped."""
    filled = F.lit(template)
    for mark, value in (("<<TITLE>>", title), ("<<Company>>", company), ("<<JOB-ID>>", job_id)):
        filled = F.replace(filled, F.lit(mark), value)
    parts = F.filter(F.transform(F.split(filled, "---"), trim_space), lambda p: p != "")
    return F.array_join(parts, "\n\n")
