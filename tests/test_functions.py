import pytest
from pyspark.sql import functions as F

from attesta.functions import fields, text as T


def values(spark, f, inputs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r.v for r in d.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_normalizers(spark):
    assert values(spark, T.normalize_string, ["  Jo-hn  DOE! ", None, "", "É_1"]) == ["jo hn doe", "", "", "é_1"]
    assert values(spark, T.normalize_address, ["12 Main Rd., Apt 4B", "No 5 St. Ave", ""]) == ["12 main road apartment 4b", "number 5 street avenue", ""]
    assert values(spark, T.clean_spacing, ["BokamHaritha", "D/OBokam", "HNO12  x", None]) == ["Bokam Haritha", "D/O Bokam", "HNO 12 x", ""]
    again = values(spark, lambda c: T.normalize_address(T.normalize_address(c)), ["12 Main Rd., Apt 4B"])
    assert again == ["12 main road apartment 4b"]


def test_dates(spark):
    given = ["15/05/1990", "1990-05-15", "05/25/1990", "5 May 1990", "15-MAY-1990", "15 August 1990", "1998", "31/02/2020", "(12.04.1995),", "soon", None, "99999-1-1"]
    want = ["1990-05-15", "1990-05-15", "1990-05-25", "1990-05-05", "1990-05-15", "1990-08-15", "1998", "31-02-2020", "1995-04-12", "soon", "", "99999-1-1"]
    assert values(spark, T.normalize_date, given) == want


def test_genders(spark):
    assert values(spark, T.gender_of_text, ["FEMALE", "m", "T", "transman", "other"]) == ["Female", "Male", "Transgender", "Transgender", "Other"]
    assert values(spark, T.gender_of_form, ["a female person", "shemale", "f", "Transgender", "oTHER"]) == ["Female", "Shemale", "Female", "Transgender", "Other"]


def found(spark, field, *texts):
    return [None if v is None else (v.raw_text, v.normalized_text, v.matched_pattern, v.span_start, v.span_end) for v in values(spark, fields.EXTRACTORS[field], texts)]


def test_dob(spark):
    got = found(spark, "dob", "x\nYearofBirth: 2003\nDOB: 01/01/1990", "DOB: 15/05/1990\n", "Date of Birth 5 May 1990", "Enrollment No 12/04/1995 and 13/04/1995", "valid till 1/1/2030", "", None)
    assert got[0] == ("2003", "2003", "year_of_birth", 15, 19) and got[1] == ("15/05/1990", "1990-05-15", "labeled_dob", 5, 15) and got[2][1] == "1990-05-05"
    assert got[3] is None and got[4:] == [None, None, None]
    far = found(spark, "dob", "Enrollment " + "x" * 40 + " 13/04/1995")
    assert far[0][1:3] == ("1995-04-13", "standalone_date")


def test_document_id(spark):
    got = found(spark, "document_id", "PAN ABCDE1234F then 1234 5678 9012", "phone 123456789012", "Doc ID: AB-12 34\n", "Mobile: 9876543210987 help", "ABC1234567", "id no: x1", None)
    assert got[0] == ("1234 5678 9012", "123456789012", "aadhaar_spaced", 20, 34)
    assert got[1] is None and got[2][:3] == ("AB-12 34", "AB1234", "generic_id") and got[3] is None and got[4][2] == "voter_id" and got[5] is None and got[6] is None


def test_document_id_goes_on_to_the_next_match(spark):
    got = found(spark, "document_id", "Doc ID: A-12\nCard No: ABC12345", "phone 123456789012 and afterwards 210987654321", "Passport J 1234567", "DL: KA-01 20190001", "ID No. x-1")
    assert [g and g[1:3] for g in got] == [("ABC12345", "generic_id"), ("210987654321", "aadhaar_compact"), ("J1234567", "passport"), ("KA0120190001", "driving_license"), None]


def test_gender(spark):
    got = found(spark, "gender", "Sex: F", "x / MALE", "a Female b", "YOB 1990 Male", "MALE", "male", None)
    assert [g and g[1] for g in got] == ["Female", "Male", "Female", "Male", "Male", None, None]


def test_name(spark):
    got = found(spark, "name", "Name: Mr. JONATHAN DOE, x", "To\nBokamHaritha\nD/O Bokam", "GOVERNMENT OF INDIA\nPRIYA SHARMA\nDOB: 1990", "Jane Roe\nS/O Richard", "Name: Government of x\nAnn Lee\nMale", "12\n34", None)
    assert got[0][:3] == ("Mr. JONATHAN DOE", "JONATHAN DOE", "labeled_name") and got[0][3:] == (6, 22)
    assert got[1] == ("BokamHaritha", "Bokam Haritha", "aadhaar_to_name", 3, 15)
    assert got[2][1:3] == ("PRIYA SHARMA", "aadhaar_pre_dob_name") and got[3][1:3] == ("Jane Roe", "aadhaar_pre_careof_name") and got[4][1:3] == ("Ann Lee", "aadhaar_pre_dob_name")
    assert got[5:] == [None, None]


def test_address(spark):
    block = "x\nC/O Sharma\nVERIFIED copy\nHNO42 Park Street\nKolkata - 700016\nend"
    got = found(spark, "address", block, "Address: 5 Hill View\nNorth Town\n\nPhone 1", "5 Hill Street\nfoo\n12 Lake Rd\n", "Address: x\nverified", "zzz", None)
    assert got[0][:3] == ("C/O Sharma, HNO 42 Park Street, Kolkata - 700016", "C/O Sharma, HNO 42 Park Street, Kolkata - 700016", "aadhaar_address_block") and got[0][3:] == (2, block.index("\nend"))
    assert got[1][1:3] == ("5 Hill View North Town", "labeled_address")
    assert got[2] == ("5 Hill Street, 12 Lake Rd", "5 Hill Street, 12 Lake Rd", "heuristic_address", 0, 28)
    assert got[4:] == [None, None]


@pytest.mark.parametrize("field", sorted(fields.EXTRACTORS))
def test_long_text(spark, field):
    assert found(spark, field, "q\n" * 20000) == [None]
