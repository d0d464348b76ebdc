"""Field extraction from document text.

Every extractor gives a struct (raw_text, normalized_text, matched_pattern,
span_start, span_end) or null; spans are half-open character offsets into the
text. Spark's regular expressions give no offsets and can't step on to the next
match, so texts go through compiled patterns in Arrow batches, all wanted fields
in one pass; what needs neither (dates, genders) is normalised by built-in
functions afterwards.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import gender_of_text, normalize_date

FOUND = "struct<raw_text: string, normalized_text: string, matched_pattern: string, span_start: int, span_end: int>"
_ARROW = pa.struct([("raw_text", pa.string()), ("normalized_text", pa.string()), ("matched_pattern", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())])

# Labels, patterns and word lists of the document formats.
NAME_LABEL = r"(?i:full\s*name|citizen\s*name|applicant\s*name|holder\s*name|name\s*of\s*holder|name)\s*[:\-.]\s*"
NAME_VALUE = r"[^\n\r,;|]+"
HONORIFIC = r"(?i)^(?:shri|smt|dr|mr|mrs|ms)\.?\s*"
NAME_CHARS = r"[^A-Za-z\s.'\-]"
BIRTH_OR_GENDER = r"(?i)(?:year\s*of\s*birth|yearof\s*birth|yob|dob|gender|male|female)"
CARE_OF = r"(?i)\b[dswc]/o\b"
BIRTH_YEAR_LABEL = r"(?i:year\s*of\s*birth|yearof\s*birth|yearofbirth|birth\s*year|yob)[\s:\-./]*"
BIRTH_YEAR_VALUE = r"[12][0-9]{3}"
DOB_LABEL = r"(?i:dob|d0b|d\.o\.b|date\s*of\s*birth|birth\s*date)[\s:\-./]*"
NUMERIC_DATE = r"[0-3]?[0-9][/\-.][0-1]?[0-9][/\-.][12][0-9]{3}"
DOB_VALUE = NUMERIC_DATE + r"|[12][0-9]{3}[/\-.][0-1]?[0-9][/\-.][0-3]?[0-9]|[0-3]?[0-9]\s+[A-Za-z]{3,9}\s+[12][0-9]{3}"
NOT_A_BIRTH = ("enrollment", "enrolment", "issued", "valid")
NOT_AN_ID = ("enrollment", "enrolment", "phone", "mobile", "help")
ID_PATTERNS = (
    ("aadhaar_spaced", r"\b", r"\d{4}[-\s]\d{4}[-\s]\d{4}", r"\b"), ("aadhaar_compact", r"\b", r"\d{12}", r"\b"), ("pan_card", r"\b", r"[A-Z]{5}[0-9]{4}[A-Z]", r"\b"), ("voter_id", r"\b", r"[A-Z]{3}[0-9]{7}", r"\b"),
    ("passport", r"\b", r"[A-PR-WYa-pr-wy]\s?[0-9]{7,8}", r"\b"), ("driving_license", r"\b", r"[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4,11}", r"\b"),
    ("generic_id", r"(?i:id\s*number|id\s*no|doc\s*id|document\s*id|identity\s*no|card\s*no|aadhaar\s*no)\s*[:\-.]*\s*", r"[A-Za-z0-9][A-Za-z0-9\-/ ]{3,24}", ""),
)
GENDER_PATTERNS = (
    (r"(?i:gender|sex)[\s:\-./]*\b", r"(?i:female|male|transgender)", r"\b"), (r"\b(?i:gender|sex)\b[\s:\-./]*", r"[FMTfmt]", r"\b"), (r"/\s*", r"(?i:female|male|transgender)", r"\b"),
    (r"\b", r"Female|FEMALE", r"\b"), (r"(?i:birth|year|yob|dob|y/o)[\s\S]{1,40}?\b", r"(?i:Male)", r"\b"), (r"\b", r"Male|MALE", r"\b"),
)
ADDRESS_START = r"(?i)[dswc]/o|\bcare\s*of\b|\b(?:hno|h\.no|house\s*no|flat\s*no|door\s*no|plot\s*no)\b|\baddress\b"
PIN = r"\b[1-9][0-9]{2}[\s\-]?[0-9]{3}\b"
BLOCK_NOISE = r"(?i)verified|portal|signature|government|aadhaar\s*no"
LINE_NOISE = r"(?i)verified|portal|signature|government|credential|authority"
ADDRESS_LABEL = r"(?i:address|perm\s*address|residential\s*address|res\.\s*address)\s*[:\-.]"
ADDRESS_END = r"(?=(?i:\n\s*(?:DOB|Date|Phone|Mobile|PIN|Pin\s*Code|ID|Doc\s*ID|Gender)\b)|\n\s*\n|$)"
ADDRESS_WORDS = (
    "road", "rd", "street", "st", "lane", "nagar", "colony", "sector", "plot", "apt", "apartment", "flat", "floor", "cross", "main", "district", "post", "near", "opposite", "mandalam", "mandal", "taluk", "village",
)


Hit = dict[str, object]


def _hit(raw: str, normalized: str, tag: str, start: int, end: int) -> Hit:
    return {"raw_text": raw, "normalized_text": normalized, "matched_pattern": tag, "span_start": start, "span_end": end}


class Hinted:
    """A pattern and words of which every match holds one: ASCII texts without any of them aren't searched.

    Beyond ASCII more letters fold to those of a word; there the pattern runs in any case.
    """

    def __init__(self, pattern: str, *hints: str):
        self.pattern, self.hints = re.compile(pattern), hints

    def search(self, text: str) -> re.Match | None:
        if not text.isascii():
            return self.pattern.search(text)
        low = text.lower()
        for hint in self.hints:
            if hint in low:
                return self.pattern.search(text)
        return None


@dataclass(frozen=True)
class Rule:
    """A value between a label and a tail; a match with one of ``not_after`` in the ``reach`` characters before it, or shorter
    than ``least`` without spaces and hyphens, is passed over for the next one. Every match begins with one of ``begins``, in
    lower case or, if ``shaped``, in the text's shape; none are known if it is empty."""

    tag: str
    label: str
    value: str
    tail: str = ""
    not_after: tuple[str, ...] = ()
    reach: int = 0
    least: int = 0
    begins: tuple[str, ...] = ()
    shaped: bool = False
    pattern: re.Pattern = field(init=False)
    excluded: re.Pattern | None = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "pattern", re.compile(f"{self.label}({self.value}){self.tail}"))
        object.__setattr__(self, "excluded", re.compile("|".join(self.not_after), re.IGNORECASE) if self.not_after else None)

    def first(self, reading: Reading) -> Hit | None:
        text = reading.text
        start = reading.place_of(self.begins, self.shaped) if self.begins else 0
        if start is None:
            return None
        for m in self.pattern.finditer(text, start):
            if self.excluded and self.excluded.search(text, max(0, m.start() - self.reach), m.start()):
                continue
            raw = m[1].strip()
            bare = _BARE.sub("", raw)
            if len(bare) >= self.least:
                return _hit(raw, bare.upper(), self.tag, m.start(1), m.end(1))
        return None


_BARE = re.compile(r"[\s\-]")
_DOB_RULES = (
    Rule("year_of_birth", BIRTH_YEAR_LABEL, BIRTH_YEAR_VALUE, r"\b", begins=("year", "birth", "yob")), Rule("labeled_dob", DOB_LABEL, DOB_VALUE, begins=("dob", "d0b", "d.o.b", "date", "birth")),
    Rule("standalone_date", r"\b", NUMERIC_DATE, r"\b", NOT_A_BIRTH, 30),
)
#: What a number of each kind begins with, in the text's shape; a generic one with its label.
_ID_BEGINS = {
    "aadhaar_spaced": ("0000 0000 0000",), "aadhaar_compact": ("0" * 12,), "pan_card": ("AAAAA0000A",), "voter_id": ("AAA0000000",), "passport": ("A0000000", "a0000000", "A 0000000", "a 0000000"),
    "driving_license": ("AA000000", "AA 000000", "AA00 0000", "AA 00 0000"), "generic_id": ("id", "doc", "card", "aadhaar"),
}
_ID_RULES = tuple(Rule(tag, label, value, tail, NOT_AN_ID, 25, 5, _ID_BEGINS[tag], tag != "generic_id") for tag, label, value, tail in ID_PATTERNS)
_GENDER_BEGINS = (("gender", "sex"), ("gender", "sex"), ("/",), ("female",), ("birth", "year", "yob", "dob", "y/o"), ("male",))
_GENDER_RULES = tuple(Rule(f"gender:{i + 1}", *parts, begins=begins) for i, (parts, begins) in enumerate(zip(GENDER_PATTERNS, _GENDER_BEGINS, strict=True)))

_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f -"  # what \s and the hyphen are within ASCII
_SHAPES = str.maketrans(string.ascii_uppercase + string.ascii_lowercase + string.digits + _SPACES, "A" * 26 + "a" * 26 + "0" * 10 + " " * len(_SPACES))

_FUSED = re.compile("([a-z])([A-Z])")
_FUSED_MARKS = (Hinted(r"(?i)\b([dswc]/o)([a-zA-Z])", "/o"), Hinted(r"(?i)\b(hno|h\.no|house\s*no)([0-9])", "hno", "h.no", "house"))


def _spaced(line: str) -> str:
    """``text.clean_spacing`` of one line."""
    line = _FUSED.sub(r"\1 \2", line)
    for mark in _FUSED_MARKS:
        if mark.search(line):
            line = mark.pattern.sub(r"\1 \2", line)
    return " ".join(line.split())


_NAME, _HONORIFIC, _NO_NAME_CHARS = re.compile(f"{NAME_LABEL}({NAME_VALUE})"), re.compile(HONORIFIC), re.compile(NAME_CHARS)
_NO_NAME = Hinted("(?i)government|india|department", "government", "india", "department")
_OFFICES = ("government", "india", "authority")
#: Names by layout: the tag, what marks a line, how far from it the name is, and what is no name.
_NAME_LINES = (
    ("aadhaar_to_name", Hinted(r"(?i)^to\b", "to"), 1, Hinted("(?i)government|india|authority|enrollment", *_OFFICES, "enrollment")),
    ("aadhaar_pre_dob_name", Hinted(BIRTH_OR_GENDER, "birth", "yob", "dob", "gender", "male"), -1, Hinted("(?i)government|india|authority|enrollment|republic", *_OFFICES, "enrollment", "republic")),
    ("aadhaar_pre_careof_name", Hinted(CARE_OF, "/o"), -1, Hinted(r"(?i)government|india|authority|to\b", *_OFFICES, "to")),
)
_START = Hinted(ADDRESS_START, "/o", "care", "hno", "h.no", "house", "flat", "door", "plot", "address")
_BLOCK_NOISE = Hinted(BLOCK_NOISE, "verified", "portal", "signature", "government", "aadhaar")
_LINE_NOISE = Hinted(LINE_NOISE, "verified", "portal", "signature", "government", "credential", "authority")
_PIN, _LABELLED_ADDRESS = re.compile(PIN), re.compile(rf"{ADDRESS_LABEL}([\s\S]+?){ADDRESS_END}")


def _lines(text: str) -> list[str]:
    """Lines without white space at their ends; blank ones go."""
    return [x for x in map(str.strip, text.splitlines()) if x]


class Reading:
    """One text, and what is found in it.

    Most patterns match in few texts and a search that finds nothing goes through
    all of a text, so that is left out where the text, if it is ASCII, lacks what
    every match begins with or holds.
    """

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()

    @cached_property
    def low(self) -> str:
        return self.text.lower()

    @cached_property
    def shape(self) -> str:
        """The text with A, a and 0 for letters and digits, white space and hyphens as spaces; as long as the text."""
        return self.text.translate(_SHAPES)

    def place_of(self, words: tuple[str, ...], shaped: bool = False) -> int | None:
        """The first place from which a match that begins with one of ``words`` can be found; None if there is none."""
        if not self.ascii:
            return 0
        within, first = self.shape if shaped else self.low, None
        for w in words:
            at = within.find(w)
            if at >= 0 and (first is None or at < first):
                first = at
        return first

    @cached_property
    def may_have_pin(self) -> bool:
        return not self.ascii or "000000" in self.shape or "000 000" in self.shape

    @cached_property
    def lines(self) -> list[str]:
        return _lines(self.text)

    def _by(self, rules: tuple[Rule, ...]) -> Hit | None:
        return next((hit for hit in (r.first(self) for r in rules) if hit), None)

    def dob(self) -> Hit | None:
        return self._by(_DOB_RULES)

    def document_id(self) -> Hit | None:
        """By kind of number first, then by place; the tag names the kind."""
        return self._by(_ID_RULES)

    def gender(self) -> Hit | None:
        return self._by(_GENDER_RULES)

    def name(self) -> Hit | None:
        """Labelled; else, line by line, after 'to', before a birth or gender line, before a care-of line."""
        # from the first 'name' on: the value doesn't depend on what of the label is before it
        at = self.place_of(("name",))
        if at is not None and (m := _NAME.search(self.text, at)):
            clean = _NO_NAME_CHARS.sub("", _HONORIFIC.sub("", m[1].strip())).strip()
            if len(clean) >= 2 and not _NO_NAME.search(clean):
                return _hit(m[1].strip(), _spaced(clean), "labeled_name", *m.span(1))
        there = [x for x in _NAME_LINES if self.place_of(x[1].hints) is not None]
        marked = ((i + step, tag, reject) for i, line in enumerate(self.lines if there else ()) for tag, mark, step, reject in there if mark.search(line))
        for at, tag, reject in marked:
            if 0 <= at < len(self.lines):
                clean = _NO_NAME_CHARS.sub("", _spaced(self.lines[at])).strip()
                if len(clean) >= 3 and not reject.search(clean):
                    return _hit(self.lines[at], clean, tag, *self._span(self.lines[at : at + 1]))
        return None

    def address(self) -> Hit | None:
        """A block from a start mark to the first line with a PIN; else the labelled address; else lines that look like one."""
        return self._address_block() or self._labelled_address() or self._address_lines()

    def _span(self, lines: list[str], origin: int = 0) -> tuple[int, int]:
        """From where the first line first occurs to where the last one, from there on, ends."""
        start = self.text.find(lines[0], origin)
        return start, self.text.find(lines[-1], max(start, 0)) + len(lines[-1])

    def _address_block(self) -> Hit | None:
        if not self.may_have_pin or self.place_of(_START.hints) is None:
            return None
        start = next((i for i, x in enumerate(self.lines) if _START.search(x)), len(self.lines))
        end = next((i for i in range(start, len(self.lines)) if _PIN.search(self.lines[i])), None)
        if end is None:
            return None
        block = self.lines[start : end + 1]
        raw = ", ".join(_spaced(x) for x in block if not _BLOCK_NOISE.search(x))
        return _hit(raw, " ".join(raw.split()), "aadhaar_address_block", *self._span(block)) if raw else None

    def _labelled_address(self) -> Hit | None:
        at = self.place_of(("address",))
        m = _LABELLED_ADDRESS.search(self.text, at) if at is not None else None
        lines = _lines(m[1]) if m else []
        noise = next((i for i, x in enumerate(lines) if _LINE_NOISE.search(x)), len(lines))
        kept = [_spaced(x) for x in lines[:noise]]
        clean = " ".join(kept)
        return _hit(", ".join(kept), clean, "labeled_address", *self._span(lines, m.start(1))) if len(clean) > 5 else None

    def _address_lines(self) -> Hit | None:
        words = [w for w in ADDRESS_WORDS if w in self.low] if self.ascii else ADDRESS_WORDS
        if not words and not self.may_have_pin:
            return None
        looks = [x for x in self.lines if (any(w in x.lower() for w in words) or (self.may_have_pin and _PIN.search(x))) and not _LINE_NOISE.search(x)]
        if not looks:
            return None
        raw, places = ", ".join(map(_spaced, looks)), [self.text.find(x) for x in looks]
        return _hit(raw, " ".join(raw.split()), "heuristic_address", min(places), max(p + len(x) for p, x in zip(places, looks, strict=True)))


FIELD_NAMES = ("name", "dob", "document_id", "gender", "address")


def _normal(name: str, f: Column) -> Column:
    """What built-in functions normalise."""
    raw = f["raw_text"]
    if name == "dob":
        return f.withField("normalized_text", F.when(f["matched_pattern"] == "year_of_birth", raw).otherwise(normalize_date(raw)))
    return f.withField("normalized_text", gender_of_text(raw)) if name == "gender" else f


def extracted(text: Column, *names: str) -> Column:
    """A struct with the fields that are found in ``text``, by name; null where one isn't found."""
    kind = pa.struct([(n, _ARROW) for n in names])

    def read(texts: pa.Array) -> pa.Array:
        readings = [None if t is None else Reading(t) for t in texts.to_pylist()]
        return pa.array([{n: r and getattr(r, n)() for n in names} for r in readings], kind)

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "struct<" + ", ".join(f"{n}: {FOUND}" for n in names) + ">")(text)


def _extractor(name: str) -> Callable[[Column], Column]:
    return lambda text: _normal(name, extracted(text, name)[name])


EXTRACTORS = {name: _extractor(name) for name in FIELD_NAMES}


def extract_all(text: Column, names: tuple[str, ...] = FIELD_NAMES) -> Iterator[tuple[str, Column]]:
    """(field name, its struct) of all fields, or those named, from one pass over the texts."""
    found = extracted(text, *names)
    for name in names:
        yield name, _normal(name, found[name])
