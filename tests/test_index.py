"""The record store's indexes: the same rows as the scan, from few files."""

import datetime

import pytest
from pyspark.sql import functions as F

from attesta.sources import index
from attesta.sources import records as R

NAMES = ["Ann O'Neil", "anna%b", "Ada_L", "ÉMILE Zola", "émile zola", "Bob", "", None, "Al", "日本語名前", "Ann Ann Ann", "back\\slash"]
TERMS = ["ann", "ANN", "n o'n", "na%b", "a_l", "émile", "ile%zol", "al", "_", "%", "bob", "本語名", "zzz", "verif-0000", "k\\s", "ann%ann", " ann "]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = R.RecordStore(spark, str(tmp_path_factory.mktemp("store")), file_rows=40).create()
    start = datetime.datetime(2024, 1, 1)
    for part in range(2):
        rows = [(f"VERIF-{i:08d}", start + datetime.timedelta(hours=i), NAMES[i % len(NAMES)], f"DOC{i * 37 % 1000:05d}", ["HIGH", "LOW", "MEDIUM"][i % 3]) for i in range(part * 150, part * 150 + 150)]
        s.save(spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, applicant_name string, document_id string, tier string"))
    # a batch without an index, as a writer leaves it that ends early
    s.write_batch(s.records().where("id = 'VERIF-00000000'").withColumn("id", F.lit("VERIF-x")), "b-late")
    s._remove("files/batch=b-late")
    return s


def ids(d):
    return sorted(r["id"] for r in d.select("id").collect())


@pytest.mark.parametrize("term", TERMS)
def test_search_is_the_scan(store, term):
    assert ids(store.search(term.strip())) == ids(R.filtered(store.records(), search=term))


def test_rare_terms_read_postings(store, monkeypatch):
    monkeypatch.setattr(index, "SCAN_SHARE", 1.0)
    done, rest = store.indexed(store.batches())
    assert len(done) == 2 and rest == ["b-0", "b-late"]
    near = store.index.candidates("00000042", done)
    assert near.count() == 1 and "postings" in near.inputFiles()[0]
    found = store.search("00000042")
    assert ids(found) == ["VERIF-00000042"]
    records = [f for f in found.inputFiles() if "/records/" in f and "b-late" not in f]
    assert len(records) == 1  # of some twenty files
    assert store.index.candidates("no such name", done).count() == 0  # a trigram that no record holds
    assert store.index.candidates("ab", done) is None and store.index.candidates("%a_", done) is None
    for term in TERMS:  # all of them by postings, however common
        assert ids(store.search(term.strip())) == ids(R.filtered(store.records(), search=term))


def test_pages_and_lookups_open_few_files(store):
    everything = {f for f in store.records().inputFiles()}
    assert len(everything) > 8
    for tier in (None, "HIGH"):
        for limit, offset in ((5, 0), (20, 10), (200, 90), (200, 400)):
            want = [r["id"] for r in R.page(R.filtered(store.records(), tier), limit, offset).collect()]
            assert [r["id"] for r in store.list(tier, limit=limit, offset=offset).collect()] == want
    assert len([f for f in store.list("LOW", limit=5).inputFiles() if "b-late" not in f]) <= 2
    assert len([f for f in store.get("VERIF-00000077").inputFiles() if "b-late" not in f]) <= 4
    assert ids(store.get("VERIF-00000077")) == ["VERIF-00000077"] and store.get("VERIF-9").isEmpty() and ids(store.get("VERIF-x")) == ["VERIF-x"]


def test_bloom_filters_are_written(store):
    import pyarrow.parquet as pq

    path = next(f for f in store.records().inputFiles() if "b-late" not in f).removeprefix("file://").removeprefix("file:")
    whole = open(path, "rb").read()
    times = [x for x in pq.read_table(path, columns=["timestamp"])["timestamp"].to_pylist()]
    assert times == sorted(times, reverse=True)
    import struct

    offsets = pq.ParquetFile(path).metadata.row_group(0).column(0)
    assert offsets.path_in_schema == "id"
    # the filter lies between the last page and the footer
    body = max(pq.ParquetFile(path).metadata.row_group(0).column(i).data_page_offset + pq.ParquetFile(path).metadata.row_group(0).column(i).total_compressed_size for i in range(19))
    footer = len(whole) - 8 - struct.unpack("<I", whole[-8:-4])[0]
    assert footer - body > 32


def test_compaction_in_place(spark, tmp_path):
    s = R.RecordStore(spark, str(tmp_path), file_rows=10).create()
    row = lambda *x: spark.createDataFrame([(i, "n" + i, "HIGH") for i in x], "id string, applicant_name string, tier string")
    s.save(row("a", "b", "c"))
    s.save(row("d"))
    assert s.delete("b")
    s.delete_all(row("c", "gone"))
    before = s.batches()
    assert s.compact() is s and ids(s.records()) == ["a", "d"]
    assert len(s.batches()) == 1 and not set(before) & set(s.batches())
    s.save(row("e"))
    assert ids(s.records()) == ["a", "d", "e"] and ids(s.search("nd")) == ["d"] and s.stats()["total_records"] == 3
    # what a compaction wrote that never committed doesn't count
    s.write_batch(s.records(), "c-unfinished")
    assert ids(s.records()) == ["a", "d", "e"]
    assert sorted(s.vacuum()) == sorted(before) and ids(s.records()) == ["a", "d", "e"] and ids(s.compact().records()) == ["a", "d", "e"]


def test_times_and_ties(spark, tmp_path):
    s = R.RecordStore(spark, str(tmp_path), file_rows=2).create()
    t = datetime.datetime(2024, 1, 1)
    s.write_batch(spark.createDataFrame([(str(i), t if i < 5 else None) for i in range(8)], "id string, timestamp timestamp_ntz").selectExpr("id", "timestamp", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in R.RECORDS if f.name not in ("id", "timestamp", "tier")], "'LOW' as tier").select(*R.RECORDS.fieldNames()), "b-1")
    for limit in (1, 3, 6, 8):
        assert [r["id"] for r in s.list(limit=limit).collect()] == [str(i) for i in range(limit)]
    assert [r["id"] for r in s.list(limit=2, offset=6).collect()] == ["6", "7"]


def test_statistics_are_merged(spark, tmp_path):
    s = R.RecordStore(spark, str(tmp_path)).create()
    assert s.stats()["total_records"] == 0 and s.needs_attention() == 0
    day = lambda n: datetime.datetime(2024, 1, n, 5)
    rows = [(f"{i}", day(1 + i % 3), ["HIGH", "LOW"][i % 2], float(i % 100), f"D{i % 40}") for i in range(600)]
    make = lambda x: spark.createDataFrame(x, "id string, timestamp timestamp, tier string, overall_score double, document_id string")
    s.save(make(rows[:250]))
    s.save(make(rows[250:]))
    s.write_batch(s.records().limit(0), "b-late")  # no rows, no index
    for i in ("0", "1", "7"):
        assert s.delete(i)
    s.delete_all(spark.createDataFrame([("7",), ("8",), ("none",)], "id string"))  # 7 is gone already
    gone = {"0", "1", "7", "8"}

    def counts():
        return {(r.day.day, r.tier): r.n for r in s.statistics(["day", "tier"]).collect()}

    want = {}
    for i, t, tier, *_ in rows:
        if i not in gone:
            want[t.day, tier] = want.get((t.day, tier), 0) + 1
    assert counts() == want and s.stats()["total_records"] == 596 and s.needs_attention() == 298
    whole = s.statistics([]).first()
    assert whole.n == 596 and abs(whole.distinct_numbers - 40) <= 2 and all(abs(q - e) <= 4 for q, e in zip(whole.quantiles, (10, 50, 90), strict=True))
    s._remove("files/" + next(x for x in s._children("files")))  # a batch that isn't indexed is counted record by record
    assert counts() == want
    s.compact()
    assert counts() == want and s.stats()["tier_breakdown"] == {"HIGH": 298, "LOW": 298}  # tombstones of the old batches count no more
    assert s.delete("9") and s.stats()["total_records"] == 595
    with pytest.raises(ValueError):
        s.statistics(["id"])


def test_postings_are_lists_that_stay_with_their_batch(store):
    done, _ = store.indexed(store.batches())
    base = f"{store.root}/postings"
    lists = store.spark.read.schema(index.POSTINGS + ", batch string").option("basePath", base).parquet(*[f"{base}/batch={b}" for b in done])
    # 300 records hold this trigram of the id; a row each would be 300
    of = lists.where("field = 'id' AND gram = 'ver'")
    assert of.agg(F.sum(F.size("rows"))).first()[0] == 300 and of.count() <= len({r.file for r in store.index.files(done).collect()})
    assert not store._children("lists") or all(not store._children(f"lists/{x}") for x in store._children("lists"))
    seen = lists.select("field", "gram", "file", F.explode("rows").alias("row"))
    assert seen.count() == seen.distinct().count()
    held = store.index._table("grams", done, index.GRAMS)
    assert held.agg(F.sum("n")).first()[0] == seen.count()
