"""The engine's operations as one object: verify, list, look up, delete, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import images
from .operators.extract import extract_from_tokens
from .operators.layout import ocr_words
from .plans.verification import Verification, verify
from .sources import documents as docs
from .sources import files as files_source
from .sources import records as R

HEALTH = {"status": "ok"}


class VerificationService:
    """``engine`` makes the OCR function of a task (see ``sources.documents.ocr_lines``); without one, texts or tokens are passed in.

    ``reads`` says what the engine gets: the file as it came (``raw``), the level
    image in colour (``color``, for engines trained on photographs) or the level
    image in black and white (``binary``, for classic ones). A file that can't be
    made level goes to the engine as it came.
    """

    def __init__(self, spark: SparkSession, root: str, engine=None, weights: dict[str, float] | None = None, reads: str = "raw", decoder: images.Decoder = images.decode):
        if reads not in ("raw", "color", "binary"):
            raise ValueError("reads must be raw, color or binary")
        self.spark, self.engine, self.weights, self.reads, self.decoder = spark, engine, weights, reads, decoder
        self.store = R.RecordStore(spark, root).create()

    def health(self) -> dict:
        return dict(HEALTH)

    def tokens(self, files: DataFrame) -> DataFrame:
        """OCR tokens of files (doc_id, side, content)."""
        if self.engine is None:
            raise RuntimeError("no OCR engine was given")
        return ocr_words(docs.ocr_lines(self.level(files), self.engine))

    def level(self, files: DataFrame) -> DataFrame:
        """(doc_id, side, content) as the engine gets it."""
        if self.reads == "raw":
            return files
        # the file travels with its image through one pass, so nothing is joined back
        png = "color_png" if self.reads == "color" else "png"
        return images.preprocess(files, self.decoder, keep=True).select("doc_id", "side", F.coalesce(png, "content").alias("content"))

    def artefacts(self, run: Verification, level: DataFrame) -> DataFrame:
        """Annotated images and crops of a run: ``level`` (doc_id, side, content) are the images that OCR read."""
        return images.artefacts(level.withColumnRenamed("content", "png"), run.merged, self.decoder)

    def extract(self, files: DataFrame) -> DataFrame:
        return extract_from_tokens(self.tokens(files))

    def verify(self, forms: DataFrame, files: DataFrame | None = None, texts: DataFrame | None = None, tokens: DataFrame | None = None, save: bool = True) -> Verification:
        """Verify and, if asked to, append the records."""
        run = verify(forms, texts=texts, tokens=self.tokens(files) if files is not None else tokens, weights=self.weights)
        if save:
            self.store.save(run.records())
        return run

    def verify_batch(self, manifest: str, save: bool = True) -> Verification:
        """Documents of a manifest; entries whose front isn't there are left out, backs that are named must be.

        Tasks read the manifest and open what it names (``sources.files``): no
        path comes to the driver, and nothing is joined to the listing.
        """
        files_source.register(self.spark)
        read = self.spark.read.format("attesta_documents").option("manifest", manifest)
        names = ("name", "full_name", "dob", "date_of_birth", "document_id", "id_number", "gender", "sex", "address")
        there = read.option("content", "false").load().where(F.col("side") == "front")
        forms = there.select("doc_id", *[F.try_element_at("submitted", F.lit(n)).alias(n) for n in names])
        return self.verify(forms, files=read.option("content", "true").load().select("doc_id", "side", "content"), save=save)

    def list_records(self, tier: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> dict:
        R.checked(limit, offset)
        return R.envelope(self.store.list(tier, search, limit, offset))

    def get_record(self, record: str) -> dict | None:
        row = self.store.get(record).first()
        return row.asDict() if row else None

    def delete_record(self, record: str) -> bool:
        return self.store.delete(record)

    def stats(self) -> dict:
        return self.store.stats()
