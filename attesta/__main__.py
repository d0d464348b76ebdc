"""Verification from the command line: ``python -m attesta verify --forms … --texts … --out …``.

Forms, and texts or tokens, are Parquet tables or files of JSON lines, by their
names' endings. ``--out`` gets ``audits`` (JSON lines, one document a line) and
``verdicts`` (Parquet); with ``--store`` the records are appended to a record
store as well.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.verification import verify
from .session import attach
from .sources.records import RecordStore


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="attesta")
    verb = parser.add_subparsers(dest="verb", required=True).add_parser("verify", help="verify forms against documents")
    verb.add_argument("--forms", required=True, help="doc_id and what was submitted")
    documents = verb.add_mutually_exclusive_group(required=True)
    documents.add_argument("--texts", help="doc_id, side, full_text")
    documents.add_argument("--tokens", help="OCR tokens with boxes")
    verb.add_argument("--out", required=True, help="a folder that doesn't exist yet")
    verb.add_argument("--store", help="root of a record store")
    verb.add_argument("--short", action="store_true", help="audits without review and policy")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments(argv)
    spark = attach(spark or SparkSession.builder.appName("attesta").getOrCreate())
    documents = {name: _read(spark, getattr(args, name)) for name in ("texts", "tokens") if getattr(args, name)}
    run = verify(_read(spark, args.forms).withColumn("doc_id", F.col("doc_id").cast("string")), **{n: d.withColumn("doc_id", F.col("doc_id").cast("string")) for n, d in documents.items()})
    run.audits(extended=not args.short).select("audit_json").write.text(f"{args.out}/audits")
    run.verdicts.write.parquet(f"{args.out}/verdicts")
    if args.store:
        RecordStore(spark, args.store).create().save(run.records())


if __name__ == "__main__":
    main()
