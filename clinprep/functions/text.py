"""Report text, image paths and prompt text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions.exprs import contains_any, first_match, let, lookup

# blanks of a text strip or a whitespace collapse: the first set is cheap to match, the
# second is rare and only looked for where it occurs
BLANKS = "[ \\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F\\x85\\xA0]+"
RARE_BLANKS = [chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
TRIM_SET = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + "".join(RARE_BLANKS)
SECTION_MIN_CHARS = 10


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_SET))


def collapse_blanks(text: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    def collapse(t):
        ascii_only = F.octet_length(t) == F.length(t)
        every = BLANKS[:-2] + "".join(RARE_BLANKS) + "]+"
        return F.when(ascii_only | ~contains_any(t, RARE_BLANKS), F.regexp_replace(t, BLANKS, " ")).otherwise(
            F.regexp_replace(t, every, " "))

    return F.trim(let(text, collapse))


def _drop(text: Column, marker: str | None, pattern: str) -> Column:
    """Remove a pattern; texts without its marker are not searched."""
    if marker is None:
        return F.regexp_replace(text, pattern, "")
    return let(text, lambda t: F.when(t.contains(marker), F.regexp_replace(t, pattern, "")).otherwise(t))


def clean_text(text: Column, is_upper: bool = False) -> Column:
    """Drop de-identification marks, dictation, signature and date lines; collapse blanks.

    For text known to be upper-case a plain substring test decides whether a pattern can
    match at all.
    """
    out = _drop(text, "[**", r"(?d)\[\*\*.*?\*\*\]")
    for lead in ("Dictated by", "Electronically signed by", "Date:"):
        out = _drop(out, lead.upper() if is_upper else None, rf"(?id){lead}.*?\.")
    return collapse_blanks(out)


def section(upper_text: Column, heading: str) -> Column:
    """Body of a report section: three readings of the heading, first long enough wins."""
    bodies = [
        rf"(?s){heading}:(.*?)(?:\n[A-Z ]+:|\z)",
        rf"(?s){heading}(.*?)(?:\n[A-Z ]+:|\z)",
        rf"(?s){heading}:(.*?)(?:\n[A-Z]{{2,}}|\z)",
    ]
    return F.coalesce(*[
        let(strip(F.regexp_extract(upper_text, b, 1)),
            lambda found: F.when(F.length(found) > SECTION_MIN_CHARS, found))
        for b in bodies
    ])


def extract_impression(report: Column) -> Column:
    """Cleaned impression, or the findings when there is none; null when both are too short."""
    body = let(F.upper(report), lambda t: F.coalesce(section(t, "IMPRESSION"), section(t, "FINDINGS")))
    return clean_text(body, is_upper=True)


def redaction_marks(text: Column) -> Column:
    out = F.replace(text, F.lit("___"), F.lit("[REDACTED]"))
    return F.regexp_replace(out, r"\[REDACTED\]+", "[REDACTED]")


def strip_path_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "^(files/){1,2}", "")


def jpg_path(path: Column) -> Column:
    return F.replace(path, F.lit(".dcm"), F.lit(".jpg"))


def image_id(path: Column) -> Column:
    """File stem of an image path."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def study_of_path(path: Column) -> Column:
    """First path segment that is ``s`` and digits, wherever the prefix left it."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(s\d+)(?:/|$)", 1), F.lit(""))


def view_of_path(path: Column) -> Column:
    low = F.lower(path)
    return first_match(
        [(contains_any(low, words), F.lit(view)) for view, words in vocab.VIEW_FRAGMENTS],
        F.lit(vocab.DEFAULT_VIEW),
    )


# --- prompt and target text ---------------------------------------------------

def _json_object(labels: Column, names) -> Column:
    """``{"name": v, ...}`` in vocabulary order, absent labels as 0."""
    parts = [
        F.concat(F.lit(f'"{n}": '), F.coalesce(F.try_element_at(labels, F.lit(n)), F.lit(0)).cast("string"))
        for n in names
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def stage_a_target(impression: Column, labels: Column) -> Column:
    return F.concat(F.lit("1) IMPRESSION: "), impression, F.lit("\n\n2) CheXpert: "),
                    _json_object(labels, vocab.FINDINGS))


def stage_b_target(impression: Column, labels: Column, icd: Column) -> Column:
    return F.concat(stage_a_target(impression, labels), F.lit("\n\n3) ICD: "),
                    _json_object(icd, vocab.ICD_CLASSES))


def prompt(stage: Column, ehr_json: Column) -> Column:
    return F.when(stage == "A", F.lit(vocab.PROMPT_A)).otherwise(
        F.concat(F.lit(vocab.PROMPT_B_HEAD), ehr_json, F.lit(vocab.PROMPT_B_TAIL))
    )


def short_vital_name(name: Column) -> Column:
    return lookup(vocab.VITAL_SHORT, F.lower(name))
