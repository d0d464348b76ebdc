"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import glyphs, tables
from ..functions import text as T
from ..functions.fields import ADDRESS_WORDS, EXTRACTORS
from ..functions.similarity import native_ratio, similarity
from ..operators import layout, views
from ..operators.match import address_score, name_score
from ..operators.verdict import tier_counts, tier_of
from ..session import scratch
from ..sources import records as R
from ..sources import statistics
from . import cards as C
from .verification import verify

Query = Callable[[SparkSession, str], DataFrame]

# --- the relations that the queries share -----------------------------------


def _run(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None):
    """Verification of every card: all five fields, or those named, front and back."""
    return _verified(C.cards(spark, sf_dir), only)


def _verified(card: DataFrame, only: tuple[str, ...] | None = None):
    return verify(C.submitted(card).drop("k"), texts=C.sides(card), only=only)


def _records(spark: SparkSession, sf_dir: str, search: str | None = None) -> DataFrame:
    """A record per card, made of its verdict; with a search term of the cards that are like it, as name and numbers don't depend on the verdict."""
    day = F.expr("timestampadd(MINUTE, cast((k * 7919) % 500000 as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    card = C.cards(spark, sf_dir).withColumns({"id": F.concat(F.lit("VERIF-"), F.lpad("doc_id", 8, "0")), "timestamp": day, "applicant_name": F.col("name")})
    card = R.filtered(card, search=search)
    v = _verified(card).verdicts.select("doc_id", "overall_score", "tier", "critical_flag", "manual_review_priority")
    return card.select("doc_id", "id", "timestamp", "applicant_name", "document_id").join(v, "doc_id").drop("doc_id")


# --- DuckDB: the same relations ---------------------------------------------

_M = lambda m: f"chr(CAST(65 + (k * {m}) % 26 AS INT))"
_CARDS = f"""
cards AS (SELECT k, CAST(k AS VARCHAR) AS doc_id, upper(p_name || ' ' || c_mktsegment) AS name,
  strftime(DATE '1950-01-01' + CAST((k * 37) % 18000 AS INT), '%d/%m/%Y') AS dob,
  {_M(1)} || {_M(3)} || {_M(5)} || {_M(7)} || {_M(11)} || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || {_M(17)} AS document_id,
  CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(k % 997 + 1 AS VARCHAR) || ' Main Road, Apt ' || CAST(k % 50 AS VARCHAR) || 'B, ' || n_name || ' City ' || CAST(100000 + k % 800000 AS VARCHAR) AS address
  FROM (SELECT c_custkey AS k, * FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = k % 200),
forms AS (SELECT k, doc_id,
  CASE k % 8 WHEN 2 THEN array_to_string(list_reverse(string_split(name, ' ')), ' ') WHEN 3 THEN substr(name, 1, 1) || substr(name, 3) ELSE name END AS name,
  CASE k % 8 WHEN 4 THEN strftime(CAST(strptime(dob, '%d/%m/%Y') AS DATE) + 1, '%d/%m/%Y') WHEN 6 THEN substr(dob, 7, 4) ELSE dob END AS dob,
  CASE k % 8 WHEN 5 THEN substr(document_id, 1, 9) || '0' ELSE document_id END AS document_id, gender,
  CASE k % 8 WHEN 1 THEN replace(address, 'Road', 'Rd') ELSE address END AS address FROM cards),
sides AS (
  SELECT k, doc_id, 'front' AS side, concat_ws(chr(10), 'GOVERNMENT CITIZEN IDENTITY CARD', '[PHOTO]', 'Name: ' || name, 'DOB: ' || dob, 'Gender: ' || gender, CASE WHEN k % 8 <> 7 THEN 'Doc ID: ' || document_id END, CASE WHEN k % 3 <> 0 THEN 'Address: ' || address END, 'VERIFIED CITIZEN CREDENTIAL - PORTAL') || chr(10) AS full_text FROM cards
  UNION ALL SELECT k, doc_id, 'back', concat_ws(chr(10), 'Address: ' || address, CASE WHEN k % 8 <> 7 THEN 'Doc ID: ' || document_id END) || chr(10) FROM cards WHERE k % 3 = 0)
"""
_DATE = lambda c: f"coalesce(strftime(coalesce(try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%Y-%m-%d')), '%Y-%m-%d'), {c})"
_NORM = lambda c: f"trim(regexp_replace(lower(regexp_replace({c}, '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+', ' ', 'g'))"
#: Longest common subsequence by folding rows of the dynamic programme.
_RATIO = lambda a, b: (
    f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * list_last(list_reduce(list_prepend([0 FOR i IN range(length({b}) + 1)], [[ord(c)] FOR c IN string_split({a}, '')]), lambda r, c: "
    f"list_reduce(list_prepend([0], [[ord(x), i] FOR x, i IN string_split({b}, '')]), lambda done, x: list_append(done, CASE WHEN x[1] = c[1] THEN r[x[2]] + 1 ELSE greatest(r[x[2] + 1], list_last(done)) END)))) / (length({a}) + length({b})) END)"
)
_SORTED = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
_ADDR = lambda c: f"regexp_replace(regexp_replace({_NORM(c)}, '\\brd\\b', 'road', 'g'), '\\bapt\\b', 'apartment', 'g')"
_NAME_SCORE = lambda same, ts, lev, jw: f"(CASE WHEN {same} THEN 100.0 WHEN {ts} >= 60 THEN greatest({ts}, {lev}, 0.5 * {ts} + 0.5 * {jw}) ELSE least({ts}, {lev}) END)"
#: The parts of an address' score: every card's address holds all words of the form's in their order, so the word sets and the best window agree fully; anything else shows as null.
_TSET = lambda a, b: f"(CASE WHEN list_has_all(string_split({b}, ' '), string_split({a}, ' ')) THEN 100.0::DOUBLE END)"
_PART = lambda a, b: f"(CASE WHEN contains({b}, {a}) THEN 100.0::DOUBLE END)"
_ADDRESS_SCORE = lambda same, tset, ts, part: f"(CASE WHEN {same} THEN 100.0 WHEN {tset} >= 70 THEN CASE WHEN {part} IS NOT NULL THEN greatest(0.5 * {tset} + 0.3 * {part} + 0.2 * {ts}, 0.6 * {tset} + 0.4 * {ts}) END END)"
#: Fields read from the texts of both sides, compared with the forms, scored and sorted into tiers.
_CORE = f"""
found AS (SELECT doc_id, max(regexp_extract(full_text, 'Name: ([^\\n]+)', 1)) AS xn, max(regexp_extract(full_text, 'DOB: ([0-9/]+)', 1)) AS xd, max(regexp_extract(full_text, '\\b([A-Z]{{5}}[0-9]{{4}}[A-Z])\\b', 1)) AS xi,
  max(regexp_extract(full_text, 'Gender: ([A-Za-z]+)', 1)) AS xg, max(regexp_extract(full_text, '(Address: [^\\n]+)', 1)) AS xa FROM sides GROUP BY doc_id),
core AS (SELECT f.*, xn, xd, xi, xg, xa, {_NORM("f.name")} AS na, {_NORM("xn")} AS nb, {_ADDR("f.address")} AS aa, {_ADDR("xa")} AS ab FROM forms f JOIN found USING (doc_id)),
statuses AS (SELECT *, CASE WHEN xd = '' THEN 'missing' WHEN {_DATE("dob")} = {_DATE("xd")} OR (length(dob) = 4 AND dob = substr({_DATE("xd")}, 1, 4)) THEN 'match' ELSE 'mismatch' END AS ds,
  CASE WHEN xi = '' THEN 'missing' WHEN xi = document_id THEN 'match' ELSE 'mismatch' END AS ids, CASE WHEN xg = '' THEN 'missing' WHEN lower(xg) = lower(gender) THEN 'match' ELSE 'mismatch' END AS gs,
  {_SORTED("na")} AS nsa, {_SORTED("nb")} AS nsb, {_SORTED("aa")} AS asa, {_SORTED("ab")} AS asb FROM core),
parts AS (SELECT *, {_RATIO("na", "nb")} AS n_lev, {_RATIO("nsa", "nsb")} AS n_ts, 100 * jaro_winkler_similarity(na, nb) AS n_jw, {_RATIO("asa", "asb")} AS a_ts, {_TSET("aa", "ab")} AS a_tset, {_PART("aa", "ab")} AS a_part FROM statuses),
scores AS (SELECT *, (CASE WHEN ds = 'match' THEN 100.0 ELSE 0.0 END) AS d, (CASE WHEN ids = 'match' THEN 100.0 ELSE 0.0 END) AS i, (CASE WHEN gs = 'match' THEN 100.0 ELSE 0.0 END) AS g,
  {_NAME_SCORE("na = nb", "n_ts", "n_lev", "n_jw")} AS n, {_ADDRESS_SCORE("aa = ab", "a_tset", "a_ts", "a_part")} AS a, ds = 'mismatch' OR ids = 'mismatch' AS critical_flag FROM parts),
v AS (SELECT k, doc_id, (n * 0.30::DOUBLE + d * 0.20::DOUBLE + i * 0.20::DOUBLE + g * 0.15::DOUBLE + a * 0.15::DOUBLE) / (0.30::DOUBLE + 0.20::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE) AS overall_score, critical_flag FROM scores),
verdict AS (SELECT *, CASE WHEN critical_flag THEN 'CRITICAL_MISMATCH' WHEN overall_score >= 95 THEN 'HIGH' WHEN overall_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM v),
records AS (SELECT 'VERIF-' || lpad(c.doc_id, 8, '0') AS id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((c.k * 7919) % 500000 AS INT)) AS timestamp, c.name AS applicant_name, c.document_id, overall_score, tier, critical_flag, tier IN ('CRITICAL_MISMATCH', 'LOW') AS manual_review_priority FROM cards c JOIN verdict USING (doc_id))
"""
_WITH_CARDS, _WITH_RECORDS = f"WITH {_CARDS} ", f"WITH {_CARDS}, {_CORE} "

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.removesuffix("_query")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- verdicts and aggregates -------------------------------------------------


@query(_WITH_RECORDS + "SELECT tier, count(*) AS n FROM verdict GROUP BY tier")
def tier_breakdown(spark, sf_dir):
    """Flagship: texts of both sides to five fields, to matches, to verdicts, to counts."""
    return tier_counts(_run(spark, sf_dir).verdicts)


@query(_WITH_RECORDS + "SELECT tier, count(*) AS n, round(min(overall_score), 6) AS least, round(max(overall_score), 6) AS most FROM verdict GROUP BY tier")
def tier_breakdown_full(spark, sf_dir):
    """Tiers with the range of their scores."""
    score = F.col("overall_score")
    return _run(spark, sf_dir).verdicts.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(score), 6).alias("least"), F.round(F.max(score), 6).alias("most"))


@query(_WITH_RECORDS + "SELECT doc_id, round(overall_score, 6) AS overall_score, critical_flag FROM verdict")
def weighted_score(spark, sf_dir):
    return _run(spark, sf_dir).verdicts.select("doc_id", F.round("overall_score", 6).alias("overall_score"), "critical_flag")


@query(_WITH_RECORDS + "SELECT doc_id, critical_flag FROM verdict WHERE critical_flag")
def critical_flag(spark, sf_dir):
    return _run(spark, sf_dir).verdicts.where("critical_flag").select("doc_id", "critical_flag")


@query(
    _WITH_RECORDS + """SELECT doc_id, tier, tier IN ('CRITICAL_MISMATCH', 'LOW') AS manual_review_priority, CASE tier WHEN 'CRITICAL_MISMATCH' THEN 'Critical mismatch in identity numbers or date of birth'
    WHEN 'MEDIUM' THEN 'Moderate confidence match; minor formatting or OCR variations' WHEN 'LOW' THEN 'Technical clarity/scan uncertainty requires manual priority officer verification; not an automated rejection.' END AS review_reason FROM verdict"""
)
def review_routing(spark, sf_dir):
    return _run(spark, sf_dir).verdicts.select("doc_id", "tier", "manual_review_priority", "review_reason")


@query("SELECT s AS score, c AS critical, CASE WHEN c THEN 'CRITICAL_MISMATCH' WHEN s >= 95 THEN 'HIGH' WHEN s >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM (SELECT l_quantity * 2 AS s, l_linenumber = 7 AS c FROM lineitem)")
def tier_rules(spark, sf_dir):
    """Tier limits over many scores."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") * 2).alias("score"), (F.col("l_linenumber") == 7).alias("critical"))
    return d.select("score", "critical", tier_of(F.col("score"), F.col("critical")).alias("tier"))


# --- records -----------------------------------------------------------------


@query(_WITH_RECORDS + "SELECT count(*) AS total_records FROM records")
def records_total(spark, sf_dir):
    return _records(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_records"))


@query(_WITH_RECORDS + "SELECT tier, count(*) AS n, 0 AS is_total FROM records GROUP BY tier UNION ALL SELECT NULL, count(*), 1 FROM records")
def stats_rollup(spark, sf_dir):
    return _records(spark, sf_dir).rollup("tier").agg(F.count(F.lit(1)).alias("n"), F.grouping("tier").cast("int").alias("is_total"))


@query(_WITH_RECORDS + """, n AS (SELECT tier, count(*) AS n FROM records GROUP BY tier) SELECT sum(n)::BIGINT AS total_records, '{' || string_agg('"' || tier || '":' || n, ',' ORDER BY tier) || '}' AS tier_breakdown FROM n""")
def stats_map(spark, sf_dir):
    """The service's statistics; the map of tiers as JSON."""
    return R.stats(_records(spark, sf_dir)).withColumn("tier_breakdown", F.to_json("tier_breakdown"))


@query(_WITH_RECORDS + "SELECT id, applicant_name, tier FROM records WHERE tier = 'HIGH' AND (applicant_name ILIKE '%wid_et%' OR document_id ILIKE '%wid_et%' OR id ILIKE '%wid_et%')")
def records_filter_search(spark, sf_dir):
    """A tier and a search term whose underscore stays a wildcard."""
    return R.filtered(_records(spark, sf_dir, " wid_et "), "high", " wid_et ").select("id", "applicant_name", "tier")


@query(_WITH_RECORDS + "SELECT id, timestamp, tier FROM records ORDER BY timestamp DESC, id LIMIT 50 OFFSET 25")
def records_page(spark, sf_dir):
    return R.checked_page(_records(spark, sf_dir), 50, 25).select("id", "timestamp", "tier")


@query(_WITH_RECORDS + "SELECT id, applicant_name, document_id, tier FROM records WHERE id = 'VERIF-00000042'")
def record_by_id(spark, sf_dir):
    return _records(spark, sf_dir).where(F.col("id") == "VERIF-00000042").limit(1).select("id", "applicant_name", "document_id", "tier")


@query(_WITH_RECORDS + "SELECT id, tier FROM records r WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 10 = 0 AND 'VERIF-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') = r.id)")
def records_after_delete(spark, sf_dir):
    """Tombstones left out by an anti-join."""
    gone = _every_tenth(spark, sf_dir)
    return _records(spark, sf_dir).join(gone, "id", "left_anti").select("id", "tier")


# --- records that are stored: written as a batch, indexed, read by the index


def _stored(spark: SparkSession, sf_dir: str) -> R.RecordStore:
    store = R.RecordStore(spark, scratch(spark, "records")).create()
    store.save(_records(spark, sf_dir))
    return store


#: Search terms: with each wildcard, with a run too short for a trigram, of digits alone, in another case, and one that nothing is like.
TERMS = ("wid_et", "e%anvil aut", "_0000004", "rt", "BLUE", "no such")
_TERMS = ", ".join(f"('{t}')" for t in TERMS)


@query(_WITH_RECORDS + f", terms(term) AS (VALUES {_TERMS}) SELECT term, id, applicant_name FROM records, terms WHERE applicant_name ILIKE '%' || term || '%' OR document_id ILIKE '%' || term || '%' OR id ILIKE '%' || term || '%'")
def stored_search(spark, sf_dir):
    """Searches of a stored table: candidates by trigrams, then the term itself."""
    store = _stored(spark, sf_dir)
    found = [store.search(t).select(F.lit(t).alias("term"), "id", "applicant_name") for t in TERMS]
    return reduce(DataFrame.unionByName, found)


_DELETED = "id NOT IN (SELECT 'VERIF-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer WHERE c_custkey % 10 = 0)"


def _every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 = 0").select(F.concat(F.lit("VERIF-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id"))


@query(_WITH_RECORDS + f"SELECT id, timestamp, tier, 'before' AS read FROM (SELECT * FROM records WHERE tier = 'HIGH' ORDER BY timestamp DESC, id LIMIT 50 OFFSET 25) UNION ALL SELECT id, timestamp, tier, 'after' FROM (SELECT * FROM records WHERE {_DELETED} ORDER BY timestamp DESC, id LIMIT 50 OFFSET 25)")
def stored_pages(spark, sf_dir):
    """A page of one tier, and one of all after deleting every tenth record and compacting in place."""
    store = _stored(spark, sf_dir)
    columns = ("id", "timestamp", "tier")
    before = store.list("high", limit=50, offset=25).select(*columns, F.lit("before").alias("read"))
    store.delete_all(_every_tenth(spark, sf_dir))
    after = store.compact().list(limit=50, offset=25).select(*columns, F.lit("after").alias("read"))
    return before.unionByName(after)


@query(_WITH_RECORDS + "SELECT id, applicant_name, document_id, tier, round(overall_score, 1) AS overall_score FROM records WHERE id IN ('VERIF-00000042', 'VERIF-00000149')")
def stored_lookup(spark, sf_dir):
    """Two records by id, and one that isn't there."""
    store = _stored(spark, sf_dir)
    found = [store.get(f"VERIF-{i}").select("id", "applicant_name", "document_id", "tier", F.round("overall_score", 1).alias("overall_score")) for i in ("00000042", "00000149", "99999999")]
    return reduce(DataFrame.unionByName, found)


_FIELDS = """m AS (SELECT doc_id, bool_or(side = 'back' AND contains(full_text, 'Address: ')) AS on_back FROM sides GROUP BY doc_id),
said AS (SELECT s.*, on_back, CASE WHEN n >= 85 THEN 'match' WHEN n >= 50 THEN 'partial_match' ELSE 'mismatch' END AS ns, CASE WHEN a >= 80 THEN 'match' WHEN a >= 50 THEN 'partial_match' ELSE 'mismatch' END AS ast FROM scores s JOIN m USING (doc_id)),
fields AS (SELECT doc_id, u.* FROM (SELECT doc_id, unnest([{'field_name': 'name', 'submitted': name, 'ocr_text': xn, 'status': ns, 'doc_side': 'front'}, {'field_name': 'dob', 'submitted': dob, 'ocr_text': xd, 'status': ds, 'doc_side': 'front'},
{'field_name': 'document_id', 'submitted': document_id, 'ocr_text': xi, 'status': ids, 'doc_side': 'front'}, {'field_name': 'gender', 'submitted': gender, 'ocr_text': xg, 'status': gs, 'doc_side': 'front'},
{'field_name': 'address', 'submitted': address, 'ocr_text': xa, 'status': ast, 'doc_side': CASE WHEN on_back THEN 'back' ELSE 'front' END}]) AS u FROM said))"""


@query(
    _WITH_RECORDS + f""", {_FIELDS} SELECT 'VERIF-' || lpad(doc_id, 8, '0') AS id, field_name, submitted, ocr_text, status, doc_side, NULL AS audit_text FROM fields WHERE CAST(doc_id AS BIGINT) % 7 <> 0
    UNION ALL SELECT 'VERIF-' || lpad(doc_id, 8, '0'), NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'not json ' || doc_id ELSE '{{}}' END FROM cards WHERE k % 7 = 0"""
)
def stored_audit_fields(spark, sf_dir):
    """Stored audits, some of them broken or empty, taken apart into a row for each field."""
    number = F.col("doc_id").cast("long")
    broken = F.when(number % 7 == 0, F.when(number % 2 == 0, F.concat(F.lit("not json "), "doc_id")).otherwise(F.lit("{}")))
    store = R.RecordStore(spark, scratch(spark, "records")).create()
    audits = _run(spark, sf_dir).audits()
    store.save(audits.select(F.concat(F.lit("VERIF-"), F.lpad("doc_id", 8, "0")).alias("id"), F.coalesce(broken, "audit_json").alias("audit_json")))
    return R.audit_fields(store.records()).select("id", "field_name", "submitted", "ocr_text", "status", "doc_side", "audit_text")


@query(_WITH_RECORDS + f"SELECT CAST(timestamp AS DATE) AS day, tier, count(*) AS n FROM records WHERE {_DELETED} GROUP BY ALL")
def stored_counts(spark, sf_dir):
    """Counts by day and tier, merged from partial ones, with tombstones taken off."""
    store = _stored(spark, sf_dir)
    store.delete_all(_every_tenth(spark, sf_dir))
    return store.statistics(["day", "tier"]).select("day", "tier", "n")


@query(_WITH_RECORDS + "SELECT tier, count(*) AS n, true AS quantiles_hold, true AS distinct_holds FROM records GROUP BY tier")
def stored_sketches(spark, sf_dir):
    """Quantiles and distinct numbers by merged sketches of two batches, held against exact ones and their stated bounds."""
    written = scratch(spark, "verified")  # both batches are parts of it: verified once
    _records(spark, sf_dir).write.parquet(written)
    records = spark.read.parquet(written)
    store = R.RecordStore(spark, scratch(spark, "records")).create()
    for part in (0, 1):
        store.save(records.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part))
    levels = (0.1, 0.5, 0.9)
    merged = store.statistics(quantiles=levels)
    # rows below each value and up to it are counted, not gathered; there are four tiers
    at, score = [F.get("quantiles", F.lit(i)) for i in range(3)], F.col("overall_score")
    counted = [F.count_if(test).alias(f"{name}_{i}") for i in range(3) for name, test in (("below", score < at[i]), ("upto", score <= at[i]))]
    exact = store.records().join(F.broadcast(merged.select("tier", "quantiles")), "tier").groupBy("tier").agg(F.count_distinct("document_id").alias("numbers"), *counted)
    both = merged.join(exact, "tier")

    def holds(i: int) -> Column:
        # rows below the value and up to it have the level between them
        slack = F.lit(2 * statistics.RANK_ERROR) * F.col("n") + 1
        return (F.col(f"below_{i}") - slack <= levels[i] * F.col("n")) & (F.col(f"upto_{i}") + slack >= levels[i] * F.col("n"))

    near = F.abs(F.col("distinct_numbers") - F.col("numbers")) <= 3 * statistics.DISTINCT_ERROR * F.col("numbers") + 1
    return both.select("tier", "n", (holds(0) & holds(1) & holds(2)).alias("quantiles_hold"), near.alias("distinct_holds"))


@query(_WITH_RECORDS + "SELECT count(*) FILTER (tier IN ('CRITICAL_MISMATCH', 'LOW')) AS needs_attention FROM records")
def kpi_needs_attention(spark, sf_dir):
    return R.needs_attention(_records(spark, sf_dir))


@query(_WITH_RECORDS + """SELECT id, upper(substr(applicant_name, 1, 1) || substr(split_part(applicant_name, ' ', 2), 1, 1)) AS initials FROM records""")
def ui_initials(spark, sf_dir):
    return _records(spark, sf_dir).select("id", views.initials(F.col("applicant_name")).alias("initials"))


@query(
    _WITH_RECORDS + """SELECT id, CASE tier WHEN 'MEDIUM' THEN 'Mostly Match' WHEN 'LOW' THEN 'Needs Review' WHEN 'CRITICAL_MISMATCH' THEN 'Difference Found' ELSE 'High Match' END AS chip,
    CASE WHEN overall_score >= 95 THEN 'high' WHEN overall_score >= 50 THEN 'medium' ELSE 'low' END AS band, round(314 * (1 - least(100, greatest(0, overall_score)) / 100), 6) AS gauge, strftime(timestamp, '%b') || ' ' || day(timestamp) || ', ' || year(timestamp) AS shown FROM records"""
)
def ui_chips(spark, sf_dir):
    s = F.col("overall_score")
    return _records(spark, sf_dir).select("id", views.chip(F.col("tier")).alias("chip"), views.score_band(s).alias("band"), F.round(views.gauge_offset(s), 6).alias("gauge"), F.date_format("timestamp", "MMM d, yyyy").alias("shown"))


# --- normalisers -------------------------------------------------------------


@query(_WITH_CARDS + f"SELECT doc_id, {_NORM('address')} AS v FROM forms")
def normalize_string(spark, sf_dir):
    return C.submitted(C.cards(spark, sf_dir)).select("doc_id", T.normalize_string(F.col("address")).alias("v"))


@query(_WITH_CARDS + f"""SELECT doc_id, regexp_replace(regexp_replace({_NORM('address')}, '\\brd\\b', 'road', 'g'), '\\bapt\\b', 'apartment', 'g') AS v FROM forms""")
def normalize_address(spark, sf_dir):
    return C.submitted(C.cards(spark, sf_dir)).select("doc_id", T.normalize_address(F.col("address")).alias("v"))


@query(_WITH_CARDS + "SELECT doc_id, trim(regexp_replace(regexp_replace('hno' || doc_id || 'MrDoe  ' || name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')).replace('hno', 'hno ') AS v FROM cards")
def clean_spacing(spark, sf_dir):
    fused = F.concat(F.lit("hno"), F.col("doc_id"), F.lit("MrDoe  "), F.col("name"))
    return C.cards(spark, sf_dir).select("doc_id", T.clean_spacing(fused).alias("v"))


@query(_WITH_CARDS + f"SELECT doc_id, {_DATE('dob')} AS v FROM forms")
def normalize_date(spark, sf_dir):
    return C.submitted(C.cards(spark, sf_dir)).select("doc_id", T.normalize_date(F.col("dob")).alias("v"))


@query(
    _WITH_CARDS + """, said AS (SELECT doc_id, CASE k % 3 WHEN 0 THEN upper(gender) WHEN 1 THEN substr(gender, 1, 1) ELSE gender END AS g FROM cards)
    SELECT doc_id, CASE WHEN regexp_matches(lower(g), 'female|^f$') THEN 'Female' WHEN regexp_matches(lower(g), 'male|^m$') THEN 'Male' ELSE g END AS by_text, CASE WHEN lower(g) IN ('f', 'female') THEN 'Female' WHEN lower(g) IN ('m', 'male') THEN 'Male' ELSE g END AS by_form FROM said"""
)
def normalize_gender(spark, sf_dir):
    shout = F.when(F.col("k") % 3 == 0, F.upper("gender")).when(F.col("k") % 3 == 1, F.substring("gender", 1, 1)).otherwise(F.col("gender"))
    return C.cards(spark, sf_dir).select("doc_id", T.gender_of_text(shout).alias("by_text"), T.gender_of_form(shout).alias("by_form"))


# --- similarities ------------------------------------------------------------

_NAMES = f"names AS (SELECT f.doc_id, {_NORM('f.name')} AS a, {_NORM('c.name')} AS b FROM forms f JOIN cards c USING (doc_id))"


def _names(spark, sf_dir):
    card = C.cards(spark, sf_dir)
    return C.submitted(card).select("doc_id", T.normalize_string(F.col("name")).alias("a")).join(card.select("doc_id", T.normalize_string(F.col("name")).alias("b")), "doc_id")


@query(_WITH_CARDS + f", {_NAMES} SELECT doc_id, round({_RATIO('a', 'b')}, 6) AS v FROM names")
def name_ratio(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.round(similarity("ratio", F.col("a"), F.col("b")), 6).alias("v"))


@query(_WITH_CARDS + f", {_NAMES} SELECT doc_id, round({_RATIO('a', 'b')}, 6) AS v FROM names")
def name_ratio_native(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.round(native_ratio(F.col("a"), F.col("b")), 6).alias("v"))


@query(_WITH_CARDS + f", {_NAMES}, s AS (SELECT doc_id, {_SORTED('a')} AS a, {_SORTED('b')} AS b FROM names) SELECT doc_id, round({_RATIO('a', 'b')}, 6) AS v FROM s")
def name_token_sort(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.round(similarity("token_sort_ratio", F.col("a"), F.col("b")), 6).alias("v"))


#: Words that both names have and those that one has alone, and the ratios of the three texts they make.
_WORDS = f"""words AS (SELECT doc_id, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM names),
halves AS (SELECT doc_id, len(list_intersect(x, y)) AS n, length(array_to_string(list_intersect(x, y), ' ')) AS c, array_to_string(list_sort([w FOR w IN x IF NOT list_contains(y, w)]), ' ') AS p, array_to_string(list_sort([w FOR w IN y IF NOT list_contains(x, w)]), ' ') AS q FROM words),
sizes AS (SELECT *, c + (CASE WHEN c > 0 THEN 1 ELSE 0 END) + length(p) AS l, c + (CASE WHEN c > 0 THEN 1 ELSE 0 END) + length(q) AS r, {_RATIO("p", "q")} * (length(p) + length(q)) / 200 AS common FROM halves)"""


@query(
    _WITH_CARDS + f""", {_NAMES}, {_WORDS} SELECT doc_id, round(CASE WHEN n > 0 AND (p = '' OR q = '') THEN 100.0 ELSE greatest(100 * (1 - (length(p) + length(q) - 2 * common) / (l + r)), CASE WHEN c > 0 THEN 100 * (1 - (1 + length(p)) / (c + l)::DOUBLE) END,
    CASE WHEN c > 0 THEN 100 * (1 - (1 + length(q)) / (c + r)::DOUBLE) END) END, 6) AS v FROM sizes"""
)
def name_token_set(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.round(similarity("token_set_ratio", F.col("a"), F.col("b")), 6).alias("v"))


#: Every window of the longer name as long as the shorter one, cut at the ends or not; of equal lengths both names are slid.
_WINDOWS = """pairs AS (SELECT doc_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM names UNION SELECT doc_id, b, a FROM names WHERE length(a) = length(b)),
windows AS (SELECT DISTINCT doc_id, s, substr(l, greatest(0, i) + 1, i + length(s) - greatest(0, i)) AS w FROM pairs, LATERAL (SELECT unnest(range(1 - length(s), length(l))) AS i) WHERE NOT contains(l, s)),
slid AS (SELECT doc_id, s, l FROM pairs WHERE contains(l, s))"""


@query(_WITH_CARDS + f", {_NAMES}, {_WINDOWS} SELECT doc_id, round(max(v), 6) AS v FROM (SELECT doc_id, {_RATIO('s', 'w')} AS v FROM windows UNION ALL SELECT doc_id, 100.0 FROM slid) GROUP BY doc_id")
def name_partial(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.round(similarity("partial_ratio", F.col("a"), F.col("b")), 6).alias("v"))


@query(_WITH_CARDS + f", {_NAMES} SELECT doc_id, round(jaro_winkler_similarity(a, b), 6) AS v FROM names")
def name_jaro_winkler(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.round(similarity("jaro_winkler", F.col("a"), F.col("b")), 6).alias("v"))


_SCORED = f"s AS (SELECT doc_id, a = b AS same, {_RATIO('a', 'b')} AS lev, {_RATIO('sa', 'sb')} AS ts, 100 * jaro_winkler_similarity(a, b) AS jw FROM (SELECT *, {_SORTED('a')} AS sa, {_SORTED('b')} AS sb FROM names))"


@query(_WITH_CARDS + f", {_NAMES}, {_SCORED} SELECT doc_id, round(CASE WHEN same THEN 100.0 WHEN ts >= 60 THEN greatest(ts, lev, 0.5 * ts + 0.5 * jw) ELSE least(ts, lev) END, 6) AS score FROM s")
def name_score_query(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    s = name_score(a == b, similarity("token_sort_ratio", a, b), similarity("ratio", a, b), 100.0 * similarity("jaro_winkler", a, b))
    return _names(spark, sf_dir).select("doc_id", F.round(s, 6).alias("score"))


_ADDRESSES = f"addresses AS (SELECT f.doc_id, {_ADDR('f.address')} AS a, {_ADDR("('Address: ' || c.address)")} AS b FROM forms f JOIN cards c USING (doc_id))"


@query(_WITH_CARDS + f", {_ADDRESSES}, w AS (SELECT *, {_SORTED('a')} AS sa, {_SORTED('b')} AS sb FROM addresses), s AS (SELECT doc_id, a = b AS same, {_RATIO('sa', 'sb')} AS ts, {_TSET('a', 'b')} AS tset, {_PART('a', 'b')} AS part FROM w) SELECT doc_id, round({_ADDRESS_SCORE('same', 'tset', 'ts', 'part')}, 6) AS score FROM s")
def address_score_query(spark, sf_dir):
    card = C.cards(spark, sf_dir)
    d = C.submitted(card).select("doc_id", T.normalize_address(F.col("address")).alias("a")).join(card.select("doc_id", T.normalize_address(F.concat(F.lit("Address: "), F.col("address"))).alias("b")), "doc_id")
    a, b = F.col("a"), F.col("b")
    s = address_score(a == b, similarity("token_set_ratio", a, b), similarity("token_sort_ratio", a, b), similarity("partial_ratio", a, b), similarity("ratio", a, b))
    return d.select("doc_id", F.round(s, 6).alias("score"))


#: An address as a form may have it: the same, with words missing, in another order, of another town, misread, or hardly like it.
_WORN = """CASE k % 8 WHEN 6 THEN 'Address: ' || address WHEN 7 THEN CAST(k % 90 AS STRING) || ' Mine Rode, Flat ' || CAST(k % 50 AS STRING) || ', Cites ' || CAST(200000 + k AS STRING) WHEN 0 THEN regexp_replace(address, '^[0-9]+ ', '') WHEN 1 THEN substr(address, 12) WHEN 2 THEN replace(address, 'City', 'Town') || ' rear' WHEN 3 THEN regexp_replace(address, '^(.*), (.*)$', '\\2 \\1') WHEN 4 THEN 'Hill Lane ' || doc_id ELSE 'St ' || CAST(k % 97 AS STRING) || ' Quay' END"""
_WORN_SCORE = f"""worn AS (SELECT doc_id, {_NORM("w")} AS a0, {_ADDR("('Address: ' || address)")} AS b FROM (SELECT *, {_WORN} AS w FROM cards)),
names AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(a0, '\\brd\\b', 'road', 'g'), '\\bapt\\b', 'apartment', 'g'), '\\bst\\b', 'street', 'g') AS a, b FROM worn),
{_WORDS}, tsets AS (SELECT doc_id, CASE WHEN n > 0 AND (p = '' OR q = '') THEN 100.0 ELSE greatest(100 * (1 - (length(p) + length(q) - 2 * common) / (l + r)), CASE WHEN c > 0 THEN 100 * (1 - (1 + length(p)) / (c + l)::DOUBLE) END, CASE WHEN c > 0 THEN 100 * (1 - (1 + length(q)) / (c + r)::DOUBLE) END) END AS tset FROM sizes),
wide_names AS (SELECT doc_id, a, b FROM names JOIN tsets USING (doc_id) WHERE tset >= 70), {_WINDOWS.replace("FROM names", "FROM wide_names")}, wins AS (SELECT doc_id, max(v) AS part FROM (SELECT doc_id, {_RATIO('s', 'w')} AS v FROM windows UNION ALL SELECT doc_id, 100.0 FROM slid) GROUP BY doc_id),
sorted AS (SELECT doc_id, a, b, {_SORTED('a')} AS sa, {_SORTED('b')} AS sb FROM names),
lcs AS (SELECT doc_id, a = b AS same, {_RATIO('a', 'b')} AS lev, {_RATIO('sa', 'sb')} AS ts FROM sorted)"""


@query(
    _WITH_CARDS + f""", {_WORN_SCORE} SELECT doc_id, round(tset, 6) AS tset, round(part, 6) AS part, round(CASE WHEN same THEN 100.0 WHEN tset >= 70 THEN greatest(0.5 * tset + 0.3 * part + 0.2 * ts, 0.6 * tset + 0.4 * ts) WHEN ts >= 40 THEN 0.5 * tset + 0.3 * ts + 0.2 * lev ELSE least(ts, lev) END, 6) AS score,
    CASE WHEN same THEN 'same' WHEN tset >= 70 THEN 'words' WHEN ts >= 40 THEN 'order' ELSE 'least' END AS branch FROM lcs JOIN tsets USING (doc_id) LEFT JOIN wins USING (doc_id)"""
)
def address_branches(spark, sf_dir):
    """Scores of worn addresses: word sets, windows and every branch of the rule."""
    card = C.cards(spark, sf_dir).withColumn("w", F.expr(_WORN.replace("\\2 \\1", "$2 $1")))
    d = card.select("doc_id", T.normalize_address(F.col("w")).alias("a"), T.normalize_address(F.concat(F.lit("Address: "), F.col("address"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    d = d.withColumns({"tset": similarity("token_set_ratio", a, b), "ts": similarity("token_sort_ratio", a, b), "part": similarity("partial_ratio", a, b), "lev": similarity("ratio", a, b)})
    branch = F.when(a == b, "same").when(F.col("tset") >= 70, "words").when(F.col("ts") >= 40, "order").otherwise("least")
    score = address_score(a == b, F.col("tset"), F.col("ts"), F.col("part"), F.col("lev"))
    return d.select("doc_id", F.round("tset", 6).alias("tset"), F.when(F.col("tset") >= 70, F.round("part", 6)).alias("part"), F.round(score, 6).alias("score"), branch.alias("branch"))


# --- exact matches -----------------------------------------------------------


def _matched(spark, sf_dir, field):
    return _run(spark, sf_dir, (field,)).merged.where(F.col("field_name") == field).select("doc_id", "status", "score", "diff")


@query(_WITH_RECORDS + "SELECT doc_id, ds AS status, d AS score, CASE ds WHEN 'missing' THEN 'DOB not detected on credential' WHEN 'mismatch' THEN 'Submitted ''' || dob || ''' != document ''' || xd || '''' END AS diff FROM scores")
def dob_match(spark, sf_dir):
    return _matched(spark, sf_dir, "dob")


@query(_WITH_RECORDS + "SELECT doc_id, ids AS status, i AS score, CASE ids WHEN 'missing' THEN 'Document ID not found on credential' WHEN 'mismatch' THEN 'ID mismatch: submitted ''' || document_id || ''' != document ''' || xi || '''' END AS diff FROM scores")
def docid_match(spark, sf_dir):
    return _matched(spark, sf_dir, "document_id")


@query(_WITH_RECORDS + "SELECT doc_id, gs AS status, g AS score, CASE gs WHEN 'missing' THEN 'Gender not detected on credential' WHEN 'mismatch' THEN 'Submitted ''' || gender || ''' != document ''' || xg || '''' END AS diff FROM scores")
def gender_match(spark, sf_dir):
    return _matched(spark, sf_dir, "gender")


# --- extraction --------------------------------------------------------------


def _extract(spark, sf_dir, field):
    texts = C.sides(C.cards(spark, sf_dir))
    return texts.select("doc_id", "side", EXTRACTORS[field](F.col("full_text")).alias("f")).where("f IS NOT NULL").select("doc_id", "side", "f.raw_text", "f.normalized_text", "f.matched_pattern", "f.span_start", "f.span_end")


def _span(value: str, prefix: str) -> str:
    return f"CAST(strpos(full_text, {prefix} || {value}) - 1 + length({prefix}) AS INT) AS span_start, CAST(strpos(full_text, {prefix} || {value}) - 1 + length({prefix}) + length({value}) AS INT) AS span_end"


def _read(pattern: str, prefix: str, tag: str, norm: str = "v") -> str:
    """SQL of a field read from the texts by a pattern with one group, where there is one."""
    return _WITH_CARDS + f""", hits AS (SELECT doc_id, side, full_text, regexp_extract(full_text, '{pattern}', 1) AS v FROM sides) SELECT doc_id, side, v AS raw_text, {norm} AS normalized_text, '{tag}' AS matched_pattern, {_span('v', f"'{prefix}'")} FROM hits WHERE v <> ''"""


@query(_read("\\b([A-Z]{5}[0-9]{4}[A-Z])\\b", "Doc ID: ", "pan_card"))
def extract_docid(spark, sf_dir):
    return _extract(spark, sf_dir, "document_id")


@query(_read("DOB: ([0-9/]+)", "DOB: ", "labeled_dob", _DATE("v")))
def extract_dob(spark, sf_dir):
    return _extract(spark, sf_dir, "dob")


@query(_read("Name: ([^\\n]+)", "Name: ", "labeled_name"))
def extract_name(spark, sf_dir):
    return _extract(spark, sf_dir, "name")


@query(_read("Gender: ([A-Za-z]+)", "Gender: ", "gender:1"))
def extract_gender(spark, sf_dir):
    return _extract(spark, sf_dir, "gender")


_LOOKS = f"""looks AS (SELECT doc_id, side, full_text, [x FOR x IN string_split(rtrim(full_text, chr(10)), chr(10)) IF NOT regexp_matches(lower(x), 'verified|portal|signature|government|credential|authority') AND regexp_matches(lower(x), '{"|".join(ADDRESS_WORDS)}')] AS l FROM sides WHERE NOT contains(full_text, 'Address: '))"""


@query(
    _WITH_CARDS + f""", {_LOOKS} SELECT s.doc_id, side, 'Address: ' || address AS raw_text, 'Address: ' || address AS normalized_text, 'aadhaar_address_block' AS matched_pattern, {_span(chr(39) + 'Address: ' + chr(39) + ' || address', chr(39) * 2)} FROM sides s JOIN cards c USING (doc_id) WHERE contains(full_text, 'Address: ')
    UNION ALL SELECT doc_id, side, array_to_string(l, ', '), array_to_string(l, ', '), 'heuristic_address', CAST(strpos(full_text, l[1]) - 1 AS INT), CAST(strpos(full_text, l[-1]) - 1 + length(l[-1]) AS INT) FROM looks WHERE len(l) > 0"""
)
def extract_address(spark, sf_dir):
    return _extract(spark, sf_dir, "address")


# --- layout ------------------------------------------------------------------

_TOKENS = """
lines AS (SELECT doc_id, side, u.i - 1 AS line_num, u.line FROM (SELECT doc_id, side, unnest([{'i': i, 'line': x} FOR x, i IN string_split(rtrim(full_text, chr(10)), chr(10))]) AS u FROM sides)),
toks AS (SELECT doc_id, side, line_num, line, u.i - 1 AS w, u.t AS text FROM (SELECT doc_id, side, line_num, line, unnest([{'i': i, 't': x} FOR x, i IN string_split(line, ' ')]) AS u FROM lines)),
tokens AS (SELECT doc_id, side, line_num * 100 + w AS tok_id, text, line_num, 60.0 + length(text) AS confidence,
  coalesce(10 * (sum(length(text) + 1) OVER (PARTITION BY doc_id, side, line_num ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS x, line_num * 20 AS y, length(text) * 10 AS wd FROM toks),
spans AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, side ORDER BY line_num, x, tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS span_start FROM tokens)
"""
_WITH_TOKENS = _WITH_CARDS + ", " + _TOKENS


@query(_WITH_TOKENS + "SELECT doc_id, side, CAST(tok_id AS INT) AS tok_id, text, span_start, CAST(span_start + length(text) AS INT) AS span_end FROM spans")
def token_offsets(spark, sf_dir):
    return layout.token_spans(C.tokens(C.cards(spark, sf_dir))).select("doc_id", "side", "tok_id", "text", "span_start", "span_end")


@query(_WITH_TOKENS + "SELECT doc_id, side, full_text, CAST((SELECT count(*) FROM tokens t WHERE t.doc_id = s.doc_id AND t.side = s.side) AS INT) AS token_count FROM sides s")
def full_text_layout(spark, sf_dir):
    return layout.full_text(C.tokens(C.cards(spark, sf_dir)))


def _tilted(card: DataFrame) -> DataFrame:
    """Tokens of cards that were scanned at a slope of their own, in the engine's order, without line numbers."""
    t = C.tokens(card)
    slope = (F.pmod(F.col("doc_id").cast("long"), F.lit(13)) - 6) / 100.0  # up to 60 pixels over a line: three lines' height
    y = (F.get("bbox", F.lit(1)) + slope * F.get("bbox", F.lit(0))).cast("int")
    return t.withColumn("bbox", F.array(F.get("bbox", F.lit(0)), y, F.get("bbox", F.lit(2)), F.get("bbox", F.lit(3)))).drop("line_num")


@query(
    _WITH_TOKENS + """, tilted AS (SELECT doc_id, side, CAST(tok_id AS INT) AS tok_id, x, CAST(trunc(y + ((CAST(doc_id AS BIGINT) % 13) - 6) / 100.0::DOUBLE * x) AS INT) AS y, 16.0::DOUBLE AS h FROM tokens),
    steps AS (SELECT *, lead(x) OVER o - x AS run, lead(y) OVER o - y AS rise FROM tilted WINDOW o AS (PARTITION BY doc_id, side ORDER BY tok_id)),
    level AS (SELECT *, y - coalesce(median(CASE WHEN run > 0 AND abs(rise) < h THEN rise / run::DOUBLE END) OVER (PARTITION BY doc_id, side), 0) * x + h / 4 AS top FROM steps),
    edges AS (SELECT *, max(top + h / 2) OVER (PARTITION BY doc_id, side ORDER BY top, tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM level)
    SELECT e.doc_id, e.side, e.tok_id, CAST(sum(CASE WHEN top >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id, e.side ORDER BY top, e.tok_id ROWS UNBOUNDED PRECEDING) AS INT) AS line_num,
    CAST(dense_rank() OVER (PARTITION BY e.doc_id, e.side ORDER BY t.line_num) - 1 AS INT) AS printed FROM edges e JOIN tokens t ON t.doc_id = e.doc_id AND t.side = e.side AND t.tok_id = e.tok_id"""
)
def lines_by_place(spark, sf_dir):
    """Lines of tilted tokens by gaps and islands, beside the lines that were printed."""
    card = C.cards(spark, sf_dir)
    printed = C.tokens(card).select("doc_id", "side", "tok_id", F.col("line_num").alias("printed"))
    return layout.lines_by_place(_tilted(card)).select("doc_id", "side", "tok_id", "line_num").join(printed, ["doc_id", "side", "tok_id"])


_DOB_SPAN = "hit AS (SELECT s.doc_id, s.side, CAST(strpos(full_text, 'DOB: ') + 4 AS INT) AS a, CAST(strpos(full_text, 'DOB: ') + 14 AS INT) AS b FROM sides s WHERE side = 'front')"


@query(_WITH_TOKENS + f", {_DOB_SPAN} SELECT h.doc_id, t.text, t.span_start FROM hit h JOIN spans t ON t.doc_id = h.doc_id AND t.side = h.side AND greatest(a, span_start) < least(b, span_start + length(text))")
def span_overlap_join(spark, sf_dir):
    """Tokens under the extracted date of birth: equi-join on the document with an overlap condition."""
    card = C.cards(spark, sf_dir)
    found = _extract(spark, sf_dir, "dob").select("doc_id", "side", F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    t = layout.token_spans(C.tokens(card)).select("doc_id", "side", "text", "span_start", "span_end")
    return found.join(t, ["doc_id", "side"]).where(F.greatest("a", "span_start") < F.least("b", "span_end")).select("doc_id", "text", "span_start")


@query(_WITH_TOKENS + f", {_DOB_SPAN} SELECT h.doc_id, min(x) AS x, min(y) AS y, max(x + wd) - min(x) AS w, 16 AS h, round(avg(confidence), 6) AS confidence FROM hit h JOIN spans t ON t.doc_id = h.doc_id AND t.side = h.side AND greatest(a, span_start) < least(b, span_start + length(text)) GROUP BY h.doc_id")
def field_bbox(spark, sf_dir):
    card = C.cards(spark, sf_dir)
    found = _extract(spark, sf_dir, "dob").withColumn("field_name", F.lit("dob"))
    d = layout.locate(found, layout.token_spans(C.tokens(card)))
    box = [F.col("bbox")[i].cast("long").alias(n) for i, n in enumerate("xyw")]
    return d.select("doc_id", *box, F.col("bbox")[3].alias("h"), F.round("confidence", 6).alias("confidence"))


@query(
    _WITH_TOKENS + """, n AS (SELECT doc_id, side, line_num, line, length(replace(line, ' ', '')) AS chars, len(line) * 9 AS wide FROM lines), ws AS (SELECT n.*, t.w, t.text, CASE WHEN contains(n.line, ' ') THEN greatest(1, CAST(floor(wide * (length(t.text) / chars::DOUBLE)) AS INT)) ELSE wide END AS ww FROM n JOIN toks t USING (doc_id, side, line_num))
    SELECT doc_id, side, text, CAST(line_num AS INT) AS line_num, CAST(coalesce(sum(ww + CAST(floor(wide * 0.02::DOUBLE) AS INT)) OVER (PARTITION BY doc_id, side, line_num ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 AS INT) AS x, CAST(ww AS INT) AS w FROM ws"""
)
def word_boxes(spark, sf_dir):
    """Lines with polygons to words with boxes."""
    lines = C.sides(C.cards(spark, sf_dir)).select("doc_id", "side", F.posexplode(F.split(F.regexp_replace("full_text", r"\n$", ""), "\n")).alias("line_idx", "text"))
    n, y = (F.char_length("text") * 9 + 5).cast("double"), (F.col("line_idx") * 20).cast("double")
    point = lambda a, b: F.array(a, b)
    poly = F.array(point(F.lit(5.4), y), point(n + 0.9, y), point(n + 0.9, y + 16), point(F.lit(5.4), y + 16))
    t = layout.ocr_words(lines.withColumn("poly", poly).withColumn("conf", F.lit(0.9)))
    return t.select("doc_id", "side", "text", "line_num", F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w"))


# --- images: printed from the cards' texts, read back by table functions --------


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): each card as a file with a page for each side."""
    kind = pa.schema([("doc_id", pa.string()), ("content", pa.binary())])
    netpbm = lambda page: b"P5 %d %d 255\n" % page.shape[::-1] + page.tobytes()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, front, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield doc_id, b"".join(netpbm(glyphs.printed(t.rstrip("\n"))) for t in (front, back) if t is not None)

    of = lambda side: F.max(F.when(F.col("side") == side, F.col("full_text")))
    both = C.sides(C.cards(spark, sf_dir)).groupBy("doc_id").agg(of("front").alias("front"), of("back").alias("back"))
    return both.mapInArrow(lambda batches: tables.in_batches(printed(batches), kind), "doc_id string, content binary")


def _scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, side, png) of the pages of all files."""
    side = F.when(F.col("page") == 0, "front").otherwise("back").alias("side")
    return tables.file_pages(_scans(spark, sf_dir)).select("doc_id", side, "png")


@query(
    _WITH_TOKENS + """, n AS (SELECT doc_id, side, line_num, line, length(replace(line, ' ', '')) AS chars, length(line) * 6 AS wide FROM lines),
    ws AS (SELECT n.*, t.w, t.text, CASE WHEN contains(n.line, ' ') THEN greatest(1, CAST(floor(wide * (length(t.text) / chars::DOUBLE)) AS INT)) ELSE wide END AS ww FROM n JOIN toks t USING (doc_id, side, line_num))
    SELECT doc_id, side, text, CAST(line_num * 12 AS INT) AS y, CAST(coalesce(sum(ww + CAST(floor(wide * 0.02::DOUBLE) AS INT)) OVER (PARTITION BY doc_id, side, line_num ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS x, CAST(ww AS INT) AS w, 100.0::DOUBLE AS confidence FROM ws"""
)
def scanned_lines(spark, sf_dir):
    """Files to pages to lines by an engine that finds lines, then words with boxes."""
    lines = tables.page_lines(_scanned_pages(spark, sf_dir))
    return layout.ocr_words(lines).select("doc_id", "side", "text", F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w"), "confidence")


@query(_WITH_TOKENS + "SELECT doc_id, side, text, CAST(x * 6 / 10 AS INT) AS x, CAST(line_num * 12 AS INT) AS y, CAST(length(text) * 6 AS INT) AS w, CAST(line_num AS INT) AS line_num, 100.0::DOUBLE AS confidence FROM tokens")
def scanned_tokens(spark, sf_dir):
    """Files to pages to words by an engine that finds words."""
    t = tables.page_tokens(_scanned_pages(spark, sf_dir))
    return t.select("doc_id", "side", "text", F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), F.col("bbox")[2].alias("w"), "line_num", "confidence")


@query(_WITH_RECORDS + "SELECT tier, count(*) AS n FROM verdict GROUP BY tier")
def scanned_tiers(spark, sf_dir):
    """From images to tiers: pages, words, fields with boxes, matches, verdicts."""
    words = scratch(spark, "words")  # texts, places and sides are read off the words: without a table they would be printed and read for each
    tables.page_tokens(_scanned_pages(spark, sf_dir)).write.parquet(words)
    t = spark.read.schema("doc_id string, side string, " + tables.TOKENS).parquet(words)
    return tier_counts(verify(C.submitted(C.cards(spark, sf_dir)).drop("k"), tokens=t).verdicts)


# --- merge, audit, boxes -----------------------------------------------------


@query(
    _WITH_CARDS + """, m AS (SELECT doc_id, side, strpos(full_text, 'Address: ') > 0 AS has_address, strpos(full_text, 'Doc ID: ') > 0 AS has_id FROM sides),
    p AS (SELECT doc_id, bool_or(has_address AND side = 'back') AS ab, bool_or(has_id) AS i FROM m GROUP BY doc_id)
    SELECT doc_id, f AS field_name, CASE WHEN f = 'address' AND ab THEN 'back' ELSE 'front' END AS doc_side, CASE WHEN f = 'document_id' AND NOT i THEN 'missing' ELSE 'there' END AS evidence FROM p, (SELECT unnest(['name', 'dob', 'document_id', 'gender', 'address']) AS f)"""
)
def front_back_merge(spark, sf_dir):
    """Which side each field's evidence comes from."""
    m = _run(spark, sf_dir).merged
    return m.select("doc_id", "field_name", "doc_side", F.when(F.col("status") == "missing", "missing").otherwise("there").alias("evidence"))


@query()
def audit_json(spark, sf_dir):
    return _run(spark, sf_dir).audits()


#: Differences in SQL: runs of equal words on a diagonal, the longest one of a region (the first of equal ones), then the regions before and after it.
_DIFFS = """pairs AS (SELECT f.doc_id, 'name' AS kind, f.name AS sub, c.name AS doc FROM forms f JOIN cards c USING (doc_id) UNION ALL SELECT f.doc_id, 'address', f.address, c.address FROM forms f JOIN cards c USING (doc_id)),
lists AS MATERIALIZED (SELECT doc_id, kind, x, y, [lower(w) FOR w IN x] AS a, [lower(w) FOR w IN y] AS b FROM (SELECT doc_id, kind, [w FOR w IN [trim(v, '.,;:()') FOR v IN string_split(doc, ' ')] IF w <> ''] AS x, [w FOR w IN [trim(v, '.,;:()') FOR v IN string_split(sub, ' ')] IF w <> ''] AS y FROM pairs)),
hits AS (SELECT doc_id, kind, i, j, i - row_number() OVER (PARTITION BY doc_id, kind, i - j ORDER BY i) AS island FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM lists)) WHERE a[i] = b[j]),
runs AS MATERIALIZED (SELECT doc_id, kind, i, j, max(i) OVER (PARTITION BY doc_id, kind, i - j, island) - i + 1 AS k FROM hits),
regions AS (SELECT doc_id, kind, 1::BIGINT AS alo, len(a) + 1 AS ahi, 1::BIGINT AS blo, len(b) + 1 AS bhi FROM lists
  UNION ALL SELECT doc_id, kind, CASE side WHEN 0 THEN alo ELSE i + n END, CASE side WHEN 0 THEN i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE j + n END, CASE side WHEN 0 THEN j ELSE bhi END
  FROM (SELECT r.doc_id, r.kind, alo, ahi, blo, bhi, i, j, least(k, ahi - i, bhi - j) AS n FROM regions r JOIN runs m ON m.doc_id = r.doc_id AND m.kind = r.kind AND i >= alo AND i < ahi AND j >= blo AND j < bhi
    QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.kind, alo, ahi, blo, bhi ORDER BY least(k, ahi - i, bhi - j) DESC, i, j) = 1), (SELECT unnest([0, 1]) AS side)
  WHERE CASE side WHEN 0 THEN alo < i AND blo < j ELSE i + n < ahi AND j + n < bhi END),
blocks AS (SELECT r.doc_id, r.kind, i, j, least(k, ahi - i, bhi - j) AS n FROM regions r JOIN runs m ON m.doc_id = r.doc_id AND m.kind = r.kind AND i >= alo AND i < ahi AND j >= blo AND j < bhi
    QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.kind, alo, ahi, blo, bhi ORDER BY least(k, ahi - i, bhi - j) DESC, i, j) = 1 UNION ALL SELECT doc_id, kind, len(a) + 1, len(b) + 1, 0 FROM lists),
gaps AS (SELECT doc_id, kind, i, j, coalesce(lag(i + n) OVER o, 1) AS i0, coalesce(lag(j + n) OVER o, 1) AS j0 FROM blocks WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i, j)),
edits AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i, j) AS place, array_to_string(x[i0:i - 1], ' ') AS p, array_to_string(y[j0:j - 1], ' ') AS q FROM gaps JOIN lists USING (doc_id, kind) WHERE i0 < i OR j0 < j),
said AS (SELECT doc_id, kind, string_agg(CASE WHEN q = '' THEN 'Extra in OCR: ''' || p || '''' WHEN p = '' THEN 'Missing in OCR: ''' || q || '''' ELSE p || ' vs ' || q END, ', ' ORDER BY place) AS d FROM edits WHERE place <= 2 GROUP BY ALL)"""


@query(
    _WITH_CARDS.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_DIFFS} SELECT c.doc_id, n.d AS name_diff, a.d AS address_diff FROM cards c LEFT JOIN said n ON n.doc_id = c.doc_id AND n.kind = 'name' LEFT JOIN said a ON a.doc_id = c.doc_id AND a.kind = 'address'"
)
def token_diff(spark, sf_dir):
    """Differences of names and addresses, word by word."""
    card = C.cards(spark, sf_dir)
    d = C.submitted(card).select("doc_id", "name", "address").join(card.select("doc_id", F.col("name").alias("n"), F.col("address").alias("a")), "doc_id")
    return d.select("doc_id", similarity("token_diff", F.col("name"), F.col("n")).alias("name_diff"), similarity("token_diff", F.col("address"), F.col("a")).alias("address_diff"))


_BOX = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity * 7 AS INT) % 300 AS x, CAST(l_extendedprice AS INT) % 200 AS y, CAST(l_quantity AS INT) AS w, CAST(l_tax * 1000 AS INT) % 40 AS h FROM lineitem"


def _boxes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lambda c: F.col(c).cast("int")
    return d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_quantity") * 7).cast("int") % 300).alias("x"), (F.floor("l_extendedprice").cast("int") % 200).alias("y"), n("l_quantity").alias("w"), (F.round(F.col("l_tax") * 1000).cast("int") % 40).alias("h"))


@query(
    f"SELECT id, greatest(0, x - 8) AS x1, greatest(0, y - 8) AS y1, least(320, x + w + 8) AS x2, least(200, y + h + 8) AS y2 FROM ({_BOX.replace('CAST(l_extendedprice AS INT)', 'CAST(floor(l_extendedprice) AS INT)').replace('CAST(l_tax * 1000 AS INT)', 'CAST(round(l_tax * 1000) AS INT)')}) WHERE w > 0 AND h > 0 AND least(320, x + w + 8) > greatest(0, x - 8) AND least(200, y + h + 8) > greatest(0, y - 8)"
)
def crop_clamp(spark, sf_dir):
    d = _boxes(spark, sf_dir).select("id", views.crop_box(F.array("x", "y", "w", "h"), F.lit(320), F.lit(200), 8).alias("b")).where("b IS NOT NULL")
    return d.select("id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(
    "SELECT id, CASE WHEN abs(g) < 0.2 OR abs(g) > 45 THEN 0.0 ELSE g END AS turn FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN a < -45 THEN -(a + 90) WHEN a > 45 THEN 90 - a ELSE -a END AS g FROM (SELECT *, l_quantity * 3 - 75 AS a FROM lineitem))"
)
def skew_fold(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), views.fold_skew(F.col("l_quantity") * 3 - 75).alias("turn"))


@query(
    "SELECT id, CAST(trunc(500 * s + 800 * c) AS INT) AS w, CAST(trunc(500 * c + 800 * s) AS INT) AS h FROM (SELECT l_orderkey * 10 + l_linenumber AS id, abs(sin(radians(l_quantity / 2))) AS s, abs(cos(radians(l_quantity / 2))) AS c FROM lineitem)"
)
def deskew_canvas(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = views.rotated_size(F.lit(800), F.lit(500), F.col("l_quantity") / 2)
    return d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), size.alias("s")).select("id", F.col("s")[0].alias("w"), F.col("s")[1].alias("h"))


@query(_WITH_CARDS + "SELECT doc_id, 'DOCUMENT ID (' || CAST(k % 101 AS VARCHAR) || '%)' AS label, replace(replace('<' || name || '>', '<', '&lt;'), '>', '&gt;') AS html FROM cards")
def labels_and_html(spark, sf_dir):
    d = C.cards(spark, sf_dir)
    return d.select("doc_id", views.label_text(F.lit("document_id"), (F.col("k") % 101).cast("double")).alias("label"), views.escape_html(F.concat(F.lit("<"), F.col("name"), F.lit(">"))).alias("html"))


@query(_WITH_RECORDS + "SELECT tier, date_trunc('day', timestamp) AS day, count(*) AS n FROM records GROUP BY ALL")
def tier_counts_by_day(spark, sf_dir):
    """The streaming extension's windowed counts, over the whole table."""
    d = _records(spark, sf_dir)
    return d.groupBy("tier", F.window("timestamp", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("tier", F.col("w.start").alias("day"), "n")
