"""The flagship plan: texts and forms in, verdicts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import all_fields, extract_fields, extract_from_tokens
from ..operators.match import MATCH_FROM, match_documents, match_rows, sides_of_fields, sides_of_texts, submitted_array
from ..operators.verdict import merged_arrays, verdicts_of_arrays
from ..operators.views import audits
from ..schemas import ALIASES, FIELDS

#: What a record says of the applicant, and the submitted names that it is taken from, in order.
_WHO = {"applicant_name": ("name", "full_name"), "dob": ("dob", "date_of_birth"), "gender": ("gender", "sex"), "document_id": ("document_id", "id_number"), "address": ("address",)}
_VERDICT = ("doc_id", "overall_score", "tier", "critical_flag", "manual_review_priority", "review_reason")


@dataclass(frozen=True)
class Verification:
    """One run, all lazy: ``documents`` has a row for each form, (doc_id, who, has_back, matches); the relations are read off it.

    ``scored`` is the same with only what verdicts are made of, without the
    Python pass that finds differences.
    """

    documents: DataFrame
    scored: DataFrame
    fields: DataFrame
    forms: DataFrame
    weights: dict[str, float] | None = None

    @property
    def matches(self) -> DataFrame:
        """A row for each submitted field and side."""
        return match_rows(self.documents)

    @property
    def merged(self) -> DataFrame:
        """A row for each submitted field, from the side with the better evidence."""
        return match_rows(self._merged(self.documents).withColumnRenamed("fields", "matches"))

    @property
    def verdicts(self) -> DataFrame:
        return self._judged(self.scored).select(*_VERDICT)

    def _merged(self, documents: DataFrame) -> DataFrame:
        return documents.withColumn("fields", merged_arrays(F.col("matches"))).drop("matches")

    def _judged(self, documents: DataFrame) -> DataFrame:
        return verdicts_of_arrays(self._merged(documents), self.weights)

    def audits(self, extended: bool = True) -> DataFrame:
        """(doc_id, audit_json) of every document."""
        return audits(self._judged(self.documents), extended).select("doc_id", "audit_json")

    def records(self) -> DataFrame:
        """Rows for ``RecordStore.save``."""
        d = audits(self._judged(self.documents))
        return d.select("who.*", "overall_score", "tier", "critical_flag", "manual_review_priority", F.col("has_back").alias("has_back_document"), "audit_json")


def form_rows(forms: DataFrame) -> DataFrame:
    """(doc_id, submitted, who): the submitted fields as an array, and what a record says of the applicant."""
    have = lambda *names: F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in forms.columns], F.lit(""))
    return forms.select("doc_id", submitted_array(forms).alias("submitted"), F.struct(*[have(*names).alias(c) for c, names in _WHO.items()]).alias("who"))


def verify(forms: DataFrame, texts: DataFrame | None = None, tokens: DataFrame | None = None, weights: dict[str, float] | None = None, only: tuple[str, ...] | None = None) -> Verification:
    """Verify forms (doc_id and submitted columns) against documents.

    Documents come as ``texts`` (doc_id, side, full_text) or as OCR ``tokens``;
    only tokens give boxes and confidences. A text's fields are found in its row;
    then sides and form of a document meet by doc_id, each shuffled once, and
    matching, merging, judging and writing the audit happen in that row. With
    ``only`` no other fields are looked for and compared.
    """
    wanted = only or FIELDS
    forms = forms.drop(*[n for f in FIELDS if f not in wanted for n in ALIASES[f]])
    if tokens is not None:
        fields = extract_from_tokens(tokens)
        found = sides_of_fields(fields, tokens.select("doc_id", "side"))
    else:
        fields = extract_fields(texts)
        found = sides_of_texts(texts, all_fields(F.col("full_text"), wanted))
    rows, fuzzy = form_rows(forms), any(f in MATCH_FROM for f in wanted)
    return Verification(match_documents(rows, found, fuzzy=fuzzy), match_documents(rows, found, with_diffs=False, fuzzy=fuzzy), fields, forms, weights)
