"""Severity of a vulnerability document: four places to look, first one that answers wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens.fixed_values import HIGH_SEVERITY_FROM, MALWARE_ID_PREFIX, SEVERITY_SCORES
from hazardlens.functions.numbers import lenient_decimal
from hazardlens.functions.text import or_default

_SCORE_AND_TYPE = "struct<score:double,type:string>"
_NUMBER_KINDS = ("BIGINT", "DOUBLE", "FLOAT")


def label_score(label: Column) -> Column:
    """Score of a severity word in any letter case, NULL for other words."""
    pairs = [F.lit(part) for pair in SEVERITY_SCORES.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.upper(label))


def is_high(score: Column) -> Column:
    return F.coalesce(score >= HIGH_SEVERITY_FROM, F.lit(False))


def _answer(score: Column, kind: Column) -> Column:
    """A (score, type) pair, or NULL when there is no score."""
    return F.when(score.isNotNull(), F.struct(score.alias("score"), kind.alias("type")).cast(_SCORE_AND_TYPE))


def from_cvss_field(score: Column) -> Column:
    """A number, or text starting with one, in the document's own CVSS field."""
    return _answer(lenient_decimal(F.try_variant_get(score, "$", "string")), F.lit("CVSS_V3"))


def from_severity_list(entries: Column) -> Column:
    """First entry whose score is a JSON number; vector texts are passed over."""
    def is_number(entry: Column) -> Column:
        kind = F.schema_of_variant(entry["score"])
        return kind.isin(*_NUMBER_KINDS) | kind.startswith("DECIMAL")

    numeric = F.filter(entries, is_number)
    first = F.get(numeric, F.lit(0))
    return _answer(F.try_variant_get(first["score"], "$", "double"), or_default(first["type"], "CVSS"))


def from_label(label: Column) -> Column:
    return _answer(label_score(label), F.upper(label))


def from_malware_marks(osv_id: Column, origins: Column) -> Column:
    """Known malicious packages carry an id prefix or a list of origins."""
    listed = origins.isNotNull() & ~F.coalesce(
        F.to_json(origins).isin("null", "false", "0", '""'), F.lit(False))
    marked = F.coalesce(osv_id.startswith(MALWARE_ID_PREFIX), F.lit(False)) | listed
    return F.when(marked, F.struct(F.lit(SEVERITY_SCORES["MALWARE"]).alias("score"),
                                   F.lit("MALWARE").alias("type")).cast(_SCORE_AND_TYPE))


def severity_of(osv_id: Column, entries: Column, own: Column) -> Column:
    """(score, type) of a document; the type is UNKNOWN and the score NULL when nothing answers."""
    nothing = F.struct(F.lit(None).cast("double").alias("score"), F.lit("UNKNOWN").alias("type"))
    return F.coalesce(
        from_cvss_field(own["cvss"]["score"]),
        from_severity_list(entries),
        from_label(own["severity"]),
        from_malware_marks(osv_id, own["malicious_packages_origins"]),
        nothing.cast(_SCORE_AND_TYPE),
    )
