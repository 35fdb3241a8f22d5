"""Reading structured model output: sections, JSON blocks, repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinprep.functions.exprs import let
from clinprep.functions.text import strip

JSON_MAP = "map<string,string>"

# header variants (fixed values): body of each block in one generated text
IMPRESSION_BLOCK = {
    "plain": r"(?is)Impression:\s*(.*?)(?:\n\n|\nCheXpert:|\z)",
    "numbered": r"(?s)1\) IMPRESSION:\s*(.+?)(?=\n\n|\n2\)|\z)",
}
FINDING_BLOCK = {
    "plain": r"(?is)CheXpert:\s*(\{.*?\})",
    "numbered": r"(?s)2\) CheXpert:\s*(\{.*?\})",
    "strict": r"(?s)2\) CheXpert: (\{.*?\})",
    "header": r"(?s)CheXpert:([^}]*\})",
}
ICD_BLOCK = {
    "plain": r"(?is)ICD:\s*(\{.*?\})",
    "numbered": r"(?s)3\) ICD:\s*(\{.*?\})",
    "strict": r"(?s)3\) ICD: (\{.*?\})",
    "header": r"(?s)ICD:([^}]*\})",
}


def block(text: Column, pattern: str) -> Column:
    """First capture of the pattern, or null when the text has none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def json_map(body: Column) -> Column:
    """The JSON object as a map of text values; null when it is not valid JSON. Of repeated keys the last counts."""
    return F.when(is_json_object(body), last_of_key(F.from_json(body, JSON_MAP)))


def typed_map(body: Column) -> Column:
    """A JSON object as a map of variant values, which keep their JSON types."""
    return last_of_key(F.from_json(body, "map<string,variant>"))


def last_of_key(parsed: Column) -> Column:
    """A parsed object in which repeated keys keep their last value."""
    def unique(m: Column) -> Column:
        entries = F.map_entries(m)
        later = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(F.map_keys(m), i + 2, F.size(m)), e["key"]))
        return F.when(F.size(F.array_distinct(F.map_keys(m))) < F.size(m), F.map_from_entries(later)).otherwise(m)

    return let(parsed, unique)


def is_json(text: Column) -> Column:
    """Exactly one valid JSON value; as in common parsers keys may repeat and numbers may be NaN or infinite.

    Inside an array and as a member of an object, trailing text cannot be overlooked.
    """
    plain = F.regexp_replace(text, r"([:\[,]\s*)(?:NaN|-?Infinity)(?=\s*[,}\]])", "$1 0")
    one = F.json_array_length(F.concat(F.lit("["), plain, F.lit("]"))) == 1
    member = F.from_json(F.concat(F.lit('{"v":'), plain, F.lit("}")), JSON_MAP, {"allowSingleQuotes": "false"}).isNotNull()
    return F.coalesce(one & member, F.lit(False))


def is_json_object(body: Column) -> Column:
    return F.coalesce(F.ltrim(body).startswith("{") & is_json(body), F.lit(False))


def impression_of(text: Column, variant: str = "plain") -> Column:
    """Impression text; the plain variant falls back to the whole text."""
    body = strip(block(text, IMPRESSION_BLOCK[variant]))
    if variant == "plain":
        found = text.rlike(r"(?i)Impression:")
        return F.when(found, F.coalesce(body, F.lit(""))).otherwise(strip(text))
    return F.coalesce(body, F.lit(""))


def brace_pieces(text: Column) -> Column:
    """The text from its first ``{`` on, cut after every brace."""
    return F.when(F.contains(text, F.lit("{")),
                  F.split(F.substr(text, F.locate("{", text)), r"(?<=[{}])"))


def pieces_to_close(pieces: Column) -> Column:
    """How many pieces it takes until the depth is back at zero; null if it never is."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("closed"))

    def step(acc, piece):
        change = F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(F.struct(
            (acc["depth"] + change).alias("depth"), (acc["taken"] + 1).alias("taken"),
            ((change == -1) & (acc["depth"] == 1)).alias("closed")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["closed"], acc["taken"]))


def repaired(text: Column, repair: Column) -> Column:
    """Blocks of ``text`` replaced by the blocks of ``repair`` where those are valid and not empty.

    An invalid finding block in the repair also keeps its ICD block from being used.
    """
    finding, icd = (block(repair, p["strict"]) for p in (FINDING_BLOCK, ICD_BLOCK))

    def swap(source, head, pattern, body, allowed):
        usable = F.coalesce(allowed & is_json_object(body) & (F.size(F.from_json(body, JSON_MAP)) > 0), F.lit(False))
        literal = F.regexp_replace(F.concat(F.lit(head), body), r"([\\$])", r"\\$1")
        return F.when(usable, F.regexp_replace(source, F.lit(pattern), literal)).otherwise(source)

    out = swap(text, "2) CheXpert: ", r"(?s)2\) CheXpert: \{.*?\}", finding, F.lit(True))
    return swap(out, "3) ICD: ", r"(?s)3\) ICD: \{.*?\}", icd, finding.isNull() | is_json_object(finding))
