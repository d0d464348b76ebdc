"""Identity cards and forms derived from the driver's tables, one per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a card is issued.
HEADER = "GOVERNMENT CITIZEN IDENTITY CARD\\n[PHOTO]"
FOOTER = "VERIFIED CITIZEN CREDENTIAL - PORTAL"


def _k(m: int) -> str:
    return f"char(cast(65 + (k * {m}) % 26 as int))"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_id, name, dob, document_id, gender, address) of every customer, dealt over the session's shuffle partitions.

    The customers' file is small, one task; what is done with a card's texts isn't.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c = read("customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    c = c.join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = read("part").where("p_partkey < 200").select("p_partkey", "p_name")
    c = c.join(F.broadcast(p), F.col("k") % 200 == F.col("p_partkey"))  # 200 rows at any scale
    return c.select(
        "k", F.col("k").cast("string").alias("doc_id"), F.expr("upper(concat(p_name, ' ', c_mktsegment))").alias("name"),
        F.expr("date_format(date_add(DATE'1950-01-01', cast((k * 37) % 18000 as int)), 'dd/MM/yyyy')").alias("dob"),
        F.expr(f"concat({_k(1)}, {_k(3)}, {_k(5)}, {_k(7)}, {_k(11)}, lpad(cast(k % 10000 as string), 4, '0'), {_k(17)})").alias("document_id"),
        F.expr("case when k % 2 = 0 then 'Male' else 'Female' end").alias("gender"),
        F.expr("concat(cast(k % 997 + 1 as string), ' Main Road, Apt ', cast(k % 50 as string), 'B, ', n_name, ' City ', cast(100000 + k % 800000 as string))").alias("address"),
    )


def submitted(card: DataFrame) -> DataFrame:
    """What was submitted for each card: one of eight perturbations, by k % 8."""
    p = F.col("k") % 8
    name = F.when(p == 2, F.expr("concat_ws(' ', reverse(split(name, ' ')))")).when(p == 3, F.expr("concat(substr(name, 1, 1), substr(name, 3))")).otherwise(F.col("name"))
    dob = F.when(p == 4, F.expr("date_format(date_add(to_date(dob, 'dd/MM/yyyy'), 1), 'dd/MM/yyyy')")).when(p == 6, F.expr("substr(dob, 7, 4)")).otherwise(F.col("dob"))
    ident = F.when(p == 5, F.expr("concat(substr(document_id, 1, 9), '0')")).otherwise(F.col("document_id"))
    address = F.when(p == 1, F.expr("replace(address, 'Road', 'Rd')")).otherwise(F.col("address"))
    return card.select("k", "doc_id", name.alias("name"), dob.alias("dob"), ident.alias("document_id"), "gender", address.alias("address"))


def sides(card: DataFrame) -> DataFrame:
    """(doc_id, side, full_text): the card's text; every third card has its address on the back, every eighth no id."""
    ident = F.when(F.col("k") % 8 != 7, F.concat(F.lit("Doc ID: "), F.col("document_id")))
    line = F.concat(F.lit("Address: "), F.col("address"))
    two = F.col("k") % 3 == 0
    head = [F.expr(f"'{HEADER}'"), F.concat(F.lit("Name: "), F.col("name")), F.concat(F.lit("DOB: "), F.col("dob")), F.concat(F.lit("Gender: "), F.col("gender")), ident]
    front = F.concat(F.concat_ws("\n", *head, F.when(~two, line), F.lit(FOOTER)), F.lit("\n"))
    back = F.when(two, F.concat(F.concat_ws("\n", line, ident), F.lit("\n")))
    both = F.array(F.struct(F.lit("front").alias("side"), front.alias("full_text")), F.struct(F.lit("back").alias("side"), back.alias("full_text")))
    return card.select("k", "doc_id", F.explode(both).alias("s")).where("s.full_text IS NOT NULL").select("k", "doc_id", "s.side", "s.full_text")


def tokens(card: DataFrame) -> DataFrame:
    """OCR tokens of the cards: a grid of ten by twenty pixels a character, confidence by the word's length."""
    lines = sides(card).select("doc_id", "side", F.posexplode(F.split(F.regexp_replace("full_text", r"\n$", ""), "\n")).alias("line_num", "line"))
    t = lines.select("doc_id", "side", "line_num", "line", F.posexplode(F.split("line", " ")).alias("w", "text"))
    x = F.expr("10 * coalesce(length(array_join(slice(split(line, ' '), 1, w), ' ')) + case when w > 0 then 1 else 0 end, 0)").cast("int")
    y = (F.col("line_num") * 20).cast("int")
    box = F.array(x, y, (F.char_length("text") * 10).cast("int"), F.lit(16))
    number = (F.col("line_num") * 100 + F.col("w")).cast("int")
    return t.select("doc_id", "side", number.alias("tok_id"), "text", box.alias("bbox"), (F.lit(60.0) + F.char_length("text")).alias("confidence"), F.col("line_num").cast("int").alias("line_num"), F.lit(0).alias("block_num"))
