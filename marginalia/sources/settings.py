"""Settings: limits of the engine, and KEY=VALUE files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: Names of the settings in the environment.
NAMES = {"max_pdf_mb": "MAX_PDF_MB", "max_pages": "MAX_PDF_PAGES", "chunk_chars": "CHUNK_CHARS", "single_pass_chars": "SINGLE_PASS_CHARS", "notes_budget_chars": "NOTES_BUDGET_CHARS", "max_ocr_pages": "MAX_OCR_PAGES", "skip_references": "SKIP_REFERENCES"}


@dataclass(frozen=True)
class Limits:
    max_pdf_mb: int = 25
    max_pages: int = 300
    chunk_chars: int = 30_000
    single_pass_chars: int = 100_000
    notes_budget_chars: int = 45_000
    max_ocr_pages: int = 60
    skip_references: bool = True


def limits_of(settings: Mapping[str, str]) -> Limits:
    """Limits with what the settings change; a value that can't be read changes nothing."""
    found = {}
    for f in fields(Limits):
        value = settings.get(NAMES[f.name], "").strip()
        if isinstance(f.default, bool):
            found[f.name] = value.lower() not in ("0", "false", "no")
        elif value.lstrip("+-").isdigit():
            found[f.name] = int(value)
    return replace(Limits(), **found)


def settings_of(lines: DataFrame) -> DataFrame:
    """key, value of lines (line_no, line) of KEY=VALUE files: comments and lines without `=` are left out, quotes around values too; the first of a key holds."""
    line = T.stripped(F.regexp_replace("line", "^\ufeff", ""))
    rows = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("=")))
    key, value = T.stripped(F.regexp_extract("line", "^([^=]*)=", 1)), T.stripped(F.regexp_extract("line", "^[^=]*=(.*)$", 1))
    bare = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    return rows.select("line_no", key.alias("key"), bare.alias("value")).filter("key != ''").groupBy("key").agg(F.min_by("value", "line_no").alias("value"))
