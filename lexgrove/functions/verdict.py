"""Court verdicts: OCR repair and document metadata as columns ('' if absent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.text import (
    any_contains,
    collapse_blanks,
    first_group,
    first_rule,
    head,
    iso_date,
    let,
    null_to_blank,
    rstrip,
    rx,
    strip,
)


def repair_ocr(text: Column) -> Column:
    def repaired(pattern: str, replacement: str):
        return lambda t: F.when(t.rlike(rx(pattern)), F.regexp_replace(t, rx(pattern), replacement)).otherwise(t)

    for pattern, replacement in fv.OCR_REPAIRS:
        text = let(text, repaired(pattern, replacement))
    return text


def case_number(text: Column, filename: Column) -> Column:
    """From the text, else ``n/yyyy`` from the file name, else the file name."""
    named = rx(fv.CASE_FILE_NAME)
    from_file = F.concat(
        F.nullif(F.regexp_extract(filename, named, 1), F.lit("")),
        F.lit("/"),
        F.regexp_extract(filename, named, 2),
    )
    return F.coalesce(
        strip(first_group(text, fv.CASE_NUMBER_PATTERNS, ignore_case=True)), from_file, filename
    )


def court_name(text: Column) -> Column:
    return collapse_blanks(first_group(text, fv.COURT_PATTERNS))


def judgment_date(text: Column) -> Column:
    return null_to_blank(F.coalesce(*[iso_date(text, p) for p in fv.JUDGMENT_DATE_PATTERNS]))


def dispute_type(text: Column) -> Column:
    found = first_group(head(text, fv.DISPUTE_CHARS), fv.DISPUTE_PATTERNS, ignore_case=True)
    return null_to_blank(rstrip(strip(found), "."))


def trial_level(text: Column, number: Column) -> Column:
    upper = F.upper(number)
    rules = [(upper.contains(mark), F.lit(level)) for mark, level in fv.TRIAL_BY_NUMBER]
    by_text = let(
        F.lower(head(text, fv.TRIAL_CHARS)),
        lambda lower: first_rule([(lower.contains(word), F.lit(word)) for word in fv.TRIAL_BY_TEXT], F.lit("")),
    )
    return first_rule(rules, by_text)


def parties(text: Column) -> dict[str, Column]:
    top = head(text, fv.PARTY_CHARS)
    return {
        name: null_to_blank(rstrip(strip(first_group(top, [p], ignore_case=True)), ";"))
        for name, p in fv.PARTY_FIELDS
    }


def judges(text: Column) -> Column:
    top = head(text, fv.JUDGE_CHARS)
    presiding = strip(first_group(top, [fv.PRESIDING_JUDGE], ignore_case=True))
    block = strip(first_group(top, [fv.OTHER_JUDGES], ignore_case=True))
    names = F.transform(
        F.regexp_extract_all(block, F.lit(rx(fv.JUDGE_NAME)), F.lit(1)),
        lambda n: rstrip(strip(n), "."),
    )
    return F.concat_ws("; ", presiding, names)


def right_types(text: Column) -> Column:
    def named(lower: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(any_contains(lower, [w.lower() for w in words]), F.lit(name))
                    for name, words in fv.RIGHT_TYPES
                ]
            )
        )

    default = F.array(F.lit(fv.DEFAULT_RIGHT_TYPE))
    return let(let(F.lower(text), named), lambda found: F.when(F.size(found) == 0, default).otherwise(found))


def law_references(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rx(fv.LAW_REFERENCE, ignore_case=True)), F.lit(0))
    tidy = F.array_sort(F.array_distinct(F.transform(found, strip)))
    # a letter that every reference has, in either case, is found much faster than the pattern is tried
    named = any_contains(text, fv.LAW_REFERENCE_LETTERS)
    return F.when(~named, F.array().cast("array<string>")).otherwise(F.slice(tidy, 1, fv.LAW_REFERENCES_KEPT))


def summary(meta: dict[str, Column]) -> Column:
    """Present parts joined by ', '; the parties only if both are known."""
    words = {k: F.lit(v) for k, v in fv.SUMMARY_PARTS.items()}

    def present(c: Column) -> Column:
        return c != ""

    return F.concat_ws(
        ", ",
        F.when(present(meta["case_number"]), F.concat(words["case"], meta["case_number"])),
        F.when(present(meta["dispute_type"]), meta["dispute_type"]),
        F.when(
            present(meta["plaintiff"]) & present(meta["defendant"]),
            F.concat(words["between"], meta["plaintiff"], words["and"], meta["defendant"]),
        ),
        F.when(present(meta["trial_level"]), F.concat(words["level"], meta["trial_level"])),
        F.when(present(meta["court_name"]), F.concat(words["court"], meta["court_name"])),
    )


def metadata(text: Column, filename: Column) -> dict[str, Column]:
    """All document-level fields except the summary, which builds on them."""
    number = case_number(text, filename)
    return {
        "case_number": number,
        "court_name": court_name(text),
        "judgment_date": judgment_date(text),
        "dispute_type": dispute_type(text),
        "trial_level": trial_level(text, number),
        **parties(text),
        "ip_types": right_types(text),
        "judges": judges(text),
        "law_references": law_references(text),
    }
