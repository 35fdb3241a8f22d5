"""Label values and label maps as column expressions.

A label map is ``map<string,int>`` next to the report text of the same record, so every
rule here is row-local: no shuffle, and usable on nested records as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions.exprs import Phrases, any_of, first_match, lookup


def label_value(raw: Column) -> Column:
    """Normalize a label cell (number or word, as text) to -1, 0, 1 or 2."""
    word = F.lower(F.trim(raw))
    number = word.try_cast("double")
    return first_match(
        [
            (raw.isNull() | F.isnan(F.coalesce(number, F.lit(0.0))), F.lit(-1)),
            (number < 0, F.lit(-1)),
            (number == 0, F.lit(0)),
            (number <= 1, F.lit(1)),
            (number.isNotNull(), F.lit(2)),
        ],
        lookup(vocab.LABEL_WORDS, word, F.lit(-1)),
    )


def vote_value(raw: Column, allow_negative: bool = True) -> Column:
    """Sign of a vote: 1, -1 (when allowed) or 0. Only numbers and booleans vote; text is 0."""
    number = F.when(~F.typeof(raw).isin("string", "varchar", "char"), raw.cast("string").try_cast("double"))
    truth = F.when(F.typeof(raw) == "boolean", raw.cast("string").try_cast("boolean").cast("double"))
    return _sign(F.coalesce(truth, number), allow_negative)


def variant_vote(raw: Column, allow_negative: bool = True) -> Column:
    """The same for a JSON value that has kept its type; "1", "yes" and NaN are 0."""
    is_number = F.schema_of_variant(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    return _sign(F.when(is_number, F.try_variant_get(raw, "$", "double")), allow_negative)


def _sign(number: Column, allow_negative: bool) -> Column:
    negative = F.lit(-1) if allow_negative else F.lit(0)
    return F.when(F.isnan(number), 0).when(number > 0, 1).when(number < 0, negative).otherwise(0)


def _get(labels: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(0))


#: All phrases that the reconciliation of labels, the denials and the keywords look for.
RECONCILING = Phrases(*vocab.CLEAR_NEGATIVES.values(), *vocab.CLEAR_POSITIVES.values(), vocab.FRACTURE_DENIALS, vocab.DEVICE_WORDS,
                      vocab.FINDING_PRESENT_WORDS)
DENYING = Phrases(*vocab.NEGATION_PATTERNS.values())
KEYWORDS = Phrases([word for word, _ in vocab.KEYWORD_FINDINGS], [word for word, _ in vocab.KEYWORD_ICD])


def negation_conflicts(labels: Column, holds) -> Column:
    """A positive label that the text clearly denies becomes 0; ``holds(words)`` tests the lower-cased text."""
    def step(k, v):
        denied = first_match(
            [(k == name, holds(words)) for name, words in vocab.NEGATION_PATTERNS.items()],
            F.lit(False),
        )
        return F.when((v == 1) & denied, F.lit(0)).otherwise(v)

    return F.transform_values(labels, step)


def uncertain_to_negative(labels: Column) -> Column:
    return F.transform_values(labels, lambda _, v: F.when(v == -1, 0).otherwise(v))


def in_domain(value: Column) -> Column:
    return F.when(value.isin(-1, 0, 1), value).otherwise(-1)


def reconciled_values(labels: Column, holds, negative_value: int = 0) -> dict[str, Column]:
    """New value of every label that the text can change (null where the label is absent).

    ``holds(words)`` tests the lower-cased text. A clear negative wins over a clear positive unless the label was uncertain.
    """
    def current(name):
        return F.try_element_at(labels, F.lit(name))

    out = {}
    for name, denials in vocab.CLEAR_NEGATIVES.items():
        v = current(name)
        out[name] = (
            F.when(v.isin(0, 1) & holds(denials), F.lit(negative_value))
            .when(v.isin(-1, 0) & holds(vocab.CLEAR_POSITIVES[name]), F.lit(1))
            .otherwise(v)
        )
    v = current("Fracture")
    out["Fracture"] = F.when((v == 1) & holds(vocab.FRACTURE_DENIALS), 0).otherwise(v)
    v = current("Support Devices")
    out["Support Devices"] = F.when((v == -1) & holds(vocab.DEVICE_WORDS), 1).otherwise(v)
    return out


def reconciled_no_finding(labels: Column, holds, others: Column) -> Column:
    """No Finding after all other labels (``others``, a map) are settled."""
    given = F.try_element_at(labels, F.lit("No Finding"))
    was_positive = F.exists(F.map_entries(labels),
                            lambda e: (e["key"] != "No Finding") & (e["value"] == 1))
    positive = F.exists(F.map_values(others), lambda v: v == 1)
    clean = F.forall(F.map_values(others), lambda v: v.isin(0, -1))
    return (
        F.when(positive, F.lit(0))
        .when(clean, F.lit(1))
        .when((given == 1) & was_positive, F.lit(0))
        .when((given == -1) & holds(vocab.FINDING_PRESENT_WORDS), F.lit(0))
        .otherwise(given)
    )


def dense_vector(labels: Column, names=None) -> Column:
    """``array<struct(label, value, mask)>`` in vocabulary order; uncertain is masked out."""
    names = names or vocab.FINDINGS
    cells = []
    for name in names:
        raw = _get(labels, name)
        cells.append(F.struct(
            F.lit(name).alias("label"),
            F.when(raw == 1, 1.0).otherwise(0.0).alias("value"),
            F.when(raw == -1, 0.0).otherwise(1.0).alias("mask"),
        ))
    return F.array(*cells)


def icd_map_from_codes(codes: Column) -> Column:
    """Class map (all classes, 0/1) from ``array<struct(code, ...)>``."""
    from clinprep.functions.measure import icd_class

    found = F.transform(codes, lambda c: icd_class(c["code"]))
    cells = []
    for name in vocab.ICD_CLASSES:
        cells += [F.lit(name), F.coalesce(F.array_contains(found, name), F.lit(False)).cast("int")]
    return F.create_map(*cells)


def icd_codes(conditions: Column, labels: Column) -> Column:
    """Code list from chronic conditions, then from positive findings."""
    from_conditions = F.transform(
        F.filter(F.coalesce(conditions, F.array().cast("array<string>")),
                 lambda c: c.isin(list(vocab.CONDITION_CODE))),
        lambda c: F.struct(lookup(vocab.CONDITION_CODE, c).alias("code"), c.alias("description"),
                           F.lit(vocab.CONDITION_CONFIDENCE).alias("confidence")),
    )
    from_findings = F.filter(
        F.array(*[
            F.when(_get(labels, finding) == 1,
                   F.struct(F.lit(code).alias("code"), F.lit(text).alias("description"),
                            F.lit(conf).alias("confidence")))
            for finding, code, text, conf in vocab.FINDING_CODE
        ]),
        lambda e: e.isNotNull(),
    )
    return F.concat(from_conditions, from_findings)


def keyword_findings(holds) -> dict[str, Column]:
    """Finding and whether any of its keywords is in the lower-cased impression (no negation)."""
    out: dict[str, list[str]] = {}
    for word, label in vocab.KEYWORD_FINDINGS:
        out.setdefault(label, []).append(word)
    return {label: holds(words) for label, words in out.items()}


def keyword_icd(holds) -> dict[str, Column]:
    return {label: holds([word]) for word, label in vocab.KEYWORD_ICD}


def apply_keywords(findings: Column, icd: Column, low: Column, holds, stage: Column,
                   bnp: Column, crp: Column, admission_type: Column, device: Column,
                   bnp_limit: float = vocab.BNP_EDEMA,
                   crp_limit: float = vocab.CRP_PNEUMONIA) -> Column:
    """``struct(findings, icd)`` after keyword and patient-data rules; empty text changes nothing."""
    is_b = stage == "B"
    false = F.lit(False)
    fluid = F.coalesce(is_b & (bnp != 0) & (bnp >= bnp_limit)
                       & F.lower(admission_type).contains("elective"), false)
    infected = F.coalesce(is_b & (crp != 0) & (crp >= crp_limit) & holds(["pneumonia"]), false)
    named_device = F.lower(F.coalesce(device, F.lit("")))
    on_device = is_b & ~named_device.isin("", "unknown", "room air", "none")

    set_finding = dict(keyword_findings(holds))
    for name, test in (("Edema", fluid), ("Pleural Effusion", fluid), ("Support Devices", on_device)):
        set_finding[name] = any_of([set_finding[name], test])
    set_icd = {name: is_b & test for name, test in keyword_icd(holds).items()}
    for name, test in (("Pulmonary_Edema", fluid), ("Pleural_Effusion", fluid), ("Pneumonia", infected)):
        set_icd[name] = any_of([set_icd[name], test])

    def cells(labels, names, tests):
        out = []
        for n in names:
            v = _get(labels, n)
            out += [F.lit(n), F.when(tests[n], 1).otherwise(v) if n in tests else v]
        return F.create_map(*out)

    others = [n for n in vocab.FINDINGS if n != "No Finding"]
    new_findings = cells(findings, others, set_finding)
    any_other = F.exists(F.map_values(new_findings), lambda v: v != 0)
    new_findings = F.map_concat(new_findings, F.create_map(F.lit("No Finding"), F.when(any_other, 0).otherwise(1)))
    kept = cells(findings, vocab.FINDINGS, {})
    blank = low == ""
    return F.struct(
        F.when(blank, kept).otherwise(new_findings).alias("findings"),
        F.when(blank, cells(icd, vocab.ICD_CLASSES, {}))
        .otherwise(cells(icd, vocab.ICD_CLASSES, set_icd)).alias("icd"),
    )
