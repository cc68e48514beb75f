"""Reading, writing and fingerprinting labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemask.schemas import MANIFEST, SAMPLES


def ddl(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a JSON-lines file or folder: value, file, and the line's place as (block, row): where its split of the file
    begins, and a number that grows within the split. `located` turns places into line numbers."""
    return _all_lines(spark, path).where(~F.col("value").rlike(r"\A\s*\z"))


def _all_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def located(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Adds `line_no`, the line's number in its file from 1, blank lines counted, to rows of `lines`.

    Files are split freely; a row per split says how many lines it holds, and the splits before it are added up per file. Only places
    are read for that, and only `rows` are joined."""
    splits = _all_lines(spark, path).groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    return rows.join(shifts, ["file", "block"]).withColumn("line_no", F.col("row") + F.col("_shift")).drop("_shift", "block", "row")


def unknown_fields(json_text: Column, schema: T.StructType) -> Column:
    """Names (dotted) of fields in the text that the schema does not have, at every level of objects."""
    none = F.array().cast("array<string>")

    def under(prefix: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.concat(F.lit(prefix), n))

    def in_items(inner: Column, name: str, element: T.StructType) -> Column:
        items = F.coalesce(F.from_json(inner, "array<string>"), none)
        return F.flatten(F.transform(items, lambda item: under(f"{name}[].", unknown_fields(item, element))))

    known = F.array(*[F.lit(n) for n in schema.names])
    found = [F.array_except(F.coalesce(F.json_object_keys(json_text), none), known)]
    for field in schema.fields:
        inner = F.get_json_object(json_text, f"$.{field.name}")
        if isinstance(field.dataType, T.StructType):
            found.append(under(f"{field.name}.", unknown_fields(inner, field.dataType)))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            found.append(in_items(inner, field.name, field.dataType.elementType))
    return F.concat(*found)


def checked(df: DataFrame, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Splits `lines` into typed rows and rejected lines with their place and a reason.

    Strict schemas also reject fields they do not know; lenient ones drop them."""
    shape = ddl(schema)
    corrupt = T.StructType(shape.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn(
        "_row", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ).withColumn("_unknown", unknown_fields(F.col("value"), shape) if strict else F.array().cast("array<string>"))
    reason = F.when(F.col("_row._corrupt").isNotNull() | F.col("_row").isNull(), "does not parse").when(
        F.size("_unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join("_unknown", ", "))
    )
    marked = parsed.withColumn("reason", reason)
    good = marked.where("reason is null").select("_row.*").drop("_corrupt")
    bad = marked.where("reason is not null").select("file", "block", "row", "value", "reason")
    return good, bad


def read_samples(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Samples, and rejected lines `(file, line_no, value, reason)`."""
    good, bad = checked(lines(spark, path), SAMPLES, strict)
    return good, located(bad, spark, path).select("file", "line_no", "value", "reason")


def first_rejected(rejected: DataFrame) -> DataFrame:
    """The first bad line per file."""
    return rejected.groupBy("file").agg(F.min_by(F.struct("line_no", "reason"), "line_no").alias("r")).select("file", "r.*")


def row_digest(samples: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*samples.columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(samples: DataFrame) -> DataFrame:
    """One row `(sample_count, fingerprint)` that does not depend on row order or file layout.

    Four sums of 12-hex-digit pieces of each row's digest: partial sums only, nothing is gathered or sorted, and
    a 38-digit decimal cannot overflow."""
    hexes = samples.select(row_digest(samples).alias("h"))
    sums = [
        F.coalesce(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}")
        for i in range(5)
    ]
    return hexes.agg(F.count(F.lit(1)).alias("sample_count"), *sums).select(
        "sample_count",
        F.sha2(F.concat_ws("/", F.col("sample_count").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)]), 256).alias("fingerprint"),
    )


def manifest(samples: DataFrame, version: str, seed: int, per_template: int, generator_version: str) -> DataFrame:
    return fingerprint(samples).select(
        F.lit(version).alias("version"), F.lit(seed).alias("seed"), F.lit(per_template).alias("per_template"),
        F.lit(generator_version).alias("generator_version"), "sample_count", "fingerprint",
    )


class VersionConflict(ValueError):
    """A published version exists with other content."""


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{directory}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_dataset(samples: DataFrame, directory: str, version: str, seed: int, per_template: int, generator_version: str) -> bool:
    """Writes samples as JSON lines with a manifest; returns whether anything was written.

    Writing the same content again does nothing; other content under the same version is an error. The samples
    are written first and fingerprinted from the files, so they are built once; the manifest makes them count."""
    spark = samples.sparkSession
    made = samples.select(*ddl(SAMPLES).names)
    if _exists(spark, f"{directory}/manifest"):
        found = read_manifest(spark, directory).select("fingerprint").first()[0]
        if found != fingerprint(made).first()["fingerprint"]:
            raise VersionConflict(f"{directory} already holds version {version} with other content")
        return False
    # Samples without a manifest are not ours to replace.
    made.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{directory}/samples")
    written = spark.read.schema(SAMPLES).json(f"{directory}/samples")
    manifest(written, version, seed, per_template, generator_version).coalesce(1).write.mode("errorifexists").json(
        f"{directory}/manifest"
    )
    return True


def check_dataset(spark: SparkSession, directory: str) -> DataFrame:
    """One row: what the manifest says, what is there, and whether they agree."""
    found = fingerprint(spark.read.schema(SAMPLES).json(f"{directory}/samples")).select(
        F.lit(0).alias("_k"), F.col("sample_count").alias("found_count"), F.col("fingerprint").alias("found_fingerprint")
    )
    said = read_manifest(spark, directory).withColumn("_k", F.lit(0))
    return said.join(found, "_k").drop("_k").withColumn(
        "ok", (F.col("sample_count") == F.col("found_count")) & (F.col("fingerprint") == F.col("found_fingerprint"))
    )
