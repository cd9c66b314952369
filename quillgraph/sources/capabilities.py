"""What extraction builds of each language, slot by slot: a slot that isn't built is never read as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scanners

SLOTS = ("exports", "imports", "scopes", "references")
#: Slots that a language's scanner fills; declarations and nesting it always fills.
BUILT = {"TypeScript": SLOTS, "Kotlin": (), "Rust": ()}
#: Languages that the engine knows by name, in the order in which the axis tells them.
LANGUAGES = ("Kotlin", "TypeScript", "Rust", "Java", "JavaScript")


def table(spark: SparkSession) -> DataFrame:
    """(language, slot, built): the slots of every language; without a scanner none is built."""
    rows = [F.struct(F.lit(lang).alias("language"), F.lit(slot).alias("slot"), F.lit(slot in BUILT.get(lang, ())).alias("built")) for lang in LANGUAGES for slot in SLOTS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def axis() -> str:
    """All of it as one text, part of the cache's key: entries of a build that could do less or more have other keys."""
    tell = lambda lang: "|".join(f"{slot}={'built' if slot in BUILT[lang] else 'not-built'}" for slot in SLOTS)
    return ";".join(f"{lang}|{tell(lang)}" if lang in BUILT else f"{lang}|no-extractor" for lang in LANGUAGES)


def version() -> str:
    return f"scanners-{scanners.VERSION}"


def value_of(slot: str, language: Column, value: Column) -> Column:
    """(value, not_built): a slot's value where its language builds it, else the slot's name in place of a value."""
    built = language.isin([lang for lang, slots in BUILT.items() if slot in slots])
    return F.struct(F.when(built, value).alias("value"), F.when(~F.coalesce(built, F.lit(False)), F.lit(slot)).alias("not_built"))


def restored(rows: DataFrame) -> DataFrame:
    """Cached rows (language, refs, ...) as they were stored; one that holds what its language doesn't build is an error."""
    bad = ~F.col("language").isin([lang for lang, slots in BUILT.items() if "references" in slots]) & (F.size("refs") > 0)
    wrong = F.raise_error(F.concat(F.lit("cached references of a language that builds none: "), F.col("language"))).cast("string")
    return rows.withColumn("language", F.when(bad, wrong).otherwise(F.col("language")))


def symbols_of_file(spark: SparkSession, path: str, language: str, text: str) -> DataFrame | None:
    """What one file declares, in byte order; None where nothing extracts its language."""
    if language not in BUILT:
        return None
    one = spark.range(1).select(F.lit(path).alias("path"), F.lit(language).alias("language"), F.lit(text).alias("text"))
    return scanners.extract(one).select("path", F.inline("symbols")).orderBy("byte_start", "ix")
