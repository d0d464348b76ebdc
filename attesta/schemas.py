"""Schemas of the relations."""

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


BBOX = T.ArrayType(_I)
SUBMITTED = _struct(doc_id=_S, name=_S, dob=_S, document_id=_S, gender=_S, address=_S)
#: Submitted keys that stand for a field, in order of preference.
ALIASES = {"name": ("name", "full_name"), "dob": ("dob", "date_of_birth"), "document_id": ("document_id", "id_number"), "gender": ("gender", "sex"), "address": ("address",)}
FIELDS = tuple(ALIASES)
MANIFEST = T.StructType([T.StructField("document_path", _S), T.StructField("back_document_path", _S), T.StructField("submitted", T.MapType(_S, _S))])
TOKENS = _struct(doc_id=_S, side=_S, tok_id=_I, text=_S, bbox=BBOX, confidence=_D, line_num=_I, block_num=_I)
OCR_LINES = _struct(doc_id=_S, side=_S, line_idx=_I, poly=T.ArrayType(T.ArrayType(_D)), text=_S, conf=_D)
EXTRACTED = _struct(doc_id=_S, side=_S, field_name=_S, raw_text=_S, normalized_text=_S, matched_pattern=_S, span_start=_I, span_end=_I, bbox=BBOX, confidence=_D)
MATCHES = _struct(doc_id=_S, side=_S, field_name=_S, submitted=_S, ocr_text=_S, score=_D, status=_S, bbox=BBOX, diff=_S, is_critical=_B, ocr_confidence=_D, doc_side=_S)
RECORDS = T.StructType(
    [T.StructField("id", _S, False), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, _S) for c in ("applicant_name", "dob", "gender", "document_id", "address")]
    + [T.StructField("overall_score", _D), T.StructField("tier", _S), T.StructField("critical_flag", _B), T.StructField("manual_review_priority", _B), T.StructField("has_back_document", _B)]
    + [T.StructField(c, _S) for c in ("front_filename", "back_filename", "front_file_path", "back_file_path", "annotated_front_path", "annotated_back_path", "crops_dir", "audit_json")]
)
