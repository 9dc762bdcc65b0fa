"""Community source files: strict validation of small JSON files, every failure with its check and path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk import config as C
from newsdesk.functions import variants

#: The fields of a file, all of them wanted and no others: kind, the one value it may have if it is fixed.
FIELDS: dict[str, tuple[str, str | int | None]] = {
    "schema_version": ("number", 1), "platform": ("string", "x"), "identifier": ("string", None), "topic": ("string", None), "language": ("string", None), "submitted_by": ("string", None), "first_seen": ("string", None),
}


def _reserved(v: Column) -> Column:
    return F.lower(v).isin(*C.RESERVED_ROUTES) | F.lower(v).rlike("^[a-z]{2}$")


def _topic(v: Column) -> Column:
    # Lengths count UTF-16 units.
    units = F.length(v) + F.regexp_count(v, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return units.between(3, 80) & v.rlike(C.TOPIC_CHARACTERS) & ~v.rlike(C.UNSAFE_TOPIC) & ~F.contains(v, F.lit("://")) & ~v.rlike(r"[\n\r]")


def _day(v: Column, today: Column) -> Column:
    return F.coalesce(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(v, "yyyy-MM-dd").isNotNull() & (v >= C.FIRST_SEEN) & (v <= today), F.lit(False))


def rules(today: Column) -> list[tuple[str, str, Callable[[Column], Column], str]]:
    """Check, field, whether a value passes, and what is said if it doesn't."""
    return [
        ("C5", "identifier", lambda v: v.rlike("^[A-Za-z0-9_]{1,15}$"), "must be 1-15 ASCII letters, digits, or underscores"),
        ("C5", "identifier", lambda v: ~v.rlike("^[A-Za-z0-9_]{1,15}$") | ~_reserved(v), "matches a reserved X route"),
        ("C7", "topic", _topic, "does not satisfy the single-line length and character policy"),
        ("C4", "language", lambda v: v.rlike(C.LANGUAGE_TAG), "must match xx or xx-YY"),
        ("C4", "submitted_by", lambda v: v.rlike(C.GITHUB_LOGIN), "is not a valid GitHub login"),
        ("C4", "first_seen", lambda v: _day(v, today), f"must be a real UTC date from {C.FIRST_SEEN} through today"),
    ]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def validated(files: DataFrame, today: Column | None = None) -> DataFrame:
    """(name, identifier, failures) of each file; ``failures`` is an array of structs (check, path, detail), empty if the file passes.

    Size, encoding and syntax come first, then the fields and their kinds, then the rules of each field, the
    file's name, and other files of the same identifier, whatever its case.  What comes first hides what comes after.
    """
    today = F.date_format(F.current_timestamp(), "yyyy-MM-dd") if today is None else today
    said = lambda check, path, detail: F.struct(F.lit(check).alias("check"), F.lit(path).alias("path"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    clean = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.withColumn("_text", F.when(clean, F.decode("content", "UTF-8"))).withColumn("_v", F.try_parse_json("_text"))
    raw = (
        F.when(F.octet_length("content") > C.SOURCE_FILE_BYTES, said("C4", "file", f"exceeds {C.SOURCE_FILE_BYTES} bytes")).when(F.startswith(F.hex("content"), F.lit("EFBBBF")), said("C4", "file", "UTF-8 BOM is not allowed"))
        .when(~clean, said("C4", "file", "is not valid UTF-8")).when(F.col("_v").isNull(), said("C4", "file", "is not valid JSON"))
    )
    is_object = variants.kind(F.col("_v")) == "object"
    found = {k: variants.at(F.col("_v"), f"$.{k}") for k in FIELDS}
    wrong = []
    for k, (kind, only) in FIELDS.items():
        right = variants.kind(found[k]) == kind
        if only is not None:
            right = right & (F.try_variant_get(F.col("_v"), f"$.{k}", "double" if kind == "number" else "string") == only)
        wrong.append(F.when(~F.coalesce(right, F.lit(False)), said("C4", k, f"must be {only}" if only is not None else f"must be a {kind}")))
    extra = F.array_except(F.coalesce(F.map_keys(F.try_variant_get(F.col("_v"), "$", "map<string,variant>")), F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS)))
    wrong.append(F.when(F.size(extra) > 0, said("C4", "root", F.concat(F.lit("unrecognized keys: "), F.array_join(F.array_sort(extra), ", ")))))
    shape = F.when(~is_object, F.array(said("C4", "root", "must be an object"))).otherwise(F.array_compact(F.array(*wrong)))
    rows = rows.withColumn("_raw", raw).withColumn("_shape", F.when(F.col("_raw").isNull(), shape))
    sound = F.col("_raw").isNull() & (F.size("_shape") == 0)
    rows = rows.withColumn("_sound", sound).withColumn("identifier", F.when(sound, variants.string_at(F.col("_v"), "$.identifier")))
    # Only identifiers that are there are grouped; the others have no twins.
    twins = rows.filter("identifier is not null").groupBy(F.lower("identifier").alias("_twin")).agg(F.count("*").alias("_twins"))
    rows = rows.join(twins, F.lower("identifier") == F.col("_twin"), "left")
    value = lambda k: F.try_variant_get(F.col("_v"), f"$.{k}", "string")
    broken = [F.when(~passes(value(k)), said(check, k, detail)) for check, k, passes, detail in rules(today)]
    named = F.concat(F.lit("x--"), F.lower("identifier"), F.lit(".json"))
    broken += [F.when(F.col("name") != named, said("C4", "name", F.concat(F.lit("filename must be "), named))), F.when(F.col("_twins") > 1, said("C6", "identifier", "duplicate identifier already exists"))]
    failures = F.when(F.col("_raw").isNotNull(), F.array("_raw")).when(F.size("_shape") > 0, F.col("_shape")).otherwise(F.array_compact(F.array(*broken)))
    return rows.select("name", "identifier", failures.alias("failures"))
