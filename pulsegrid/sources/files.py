"""File sources: CSV, JSON, multi-file and recursive scans, columns taken from file names."""

from __future__ import annotations

import csv
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.temporal import date_and_time, parse_timestamp
from pulsegrid.session import freeze

# File-name keywords of room sensors and their categories; the first hit wins.
SENSOR_CATEGORIES = {
    "Nodo_Oficina": "Nodo",
    "Nodo_3SP": "Nodo",
    "Puerta_3SP": "Prueba 3SP",
    "Lab_3SP": "Sensor Lab 3SP",
    "Puerta_C006": "Radar",
    "Sensirion_C006": "Ambiental",
    "Puerta_106": "ESFM_Puerta",
    "Contrario_106": "ESFM_Contrario",
}
# Substrings of a time column's name, file patterns of the sources and their names.
TIME_WORDS = ("date", "time", "timestamp", "datetime")
SOURCE_PATTERNS = {
    "estimated_oxygen_variation-*.csv": "oxygen_variation",
    "heart_rate-*.json": "heart_rate_global",
    "sleep-*.json": "sleep_global",
    "Daily Heart Rate Variability Summary*.csv": "daily_hrv_summary",
    "Daily Respiratory Rate Summary*.csv": "daily_respiratory_rate",
    "Heart Rate Variability Details*.csv": "hrv_details",
    "Respiratory Rate Summary*.csv": "respiratory_rate_summary",
    "Daily SpO2*.csv": "daily_spo2",
    "Minute SpO2*.csv": "minute_spo2",
    "active_minutes_*.csv": "active_minutes",
    "activity_level_*.csv": "activity_level",
    "heart_rate_*.csv": "heart_rate_activity",
    "heart_rate_variability_*.csv": "hrv_activity",
    "oxygen_saturation_*.csv": "spo2_activity",
    "steps_*.csv": "steps",
    "sleep_score.csv": "sleep_score",
    "Stress Score.csv": "stress_score",
}


def file_headers(
    spark: SparkSession, path: str | Sequence[str], recursive: bool = False, pattern: str | None = None
) -> DataFrame:
    """``path, length, header`` of every file: its first line, NULL where it has none or cannot be read.

    One distributed pass over the files as lines; nothing is parsed.
    """
    options = {"recursiveFileLookup": recursive} | ({"pathGlobFilter": pattern} if pattern else {})
    paths = path if isinstance(path, str) else list(path)
    place = F.col("_metadata.file_path").alias("__file")
    binary = spark.read.format("binaryFile").options(**options).load(paths)
    # a scan passes over empty files, the list of its files does not
    name = F.regexp_replace("name", "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
    listed = spark.createDataFrame([(n,) for n in binary.inputFiles()], "name string").select(name.alias("__file"))
    plain = F.url_decode(F.regexp_replace("__file", r"\+", "%2B"))
    files = listed.join(binary.select(place, "path", "length"), "__file", "left").select(
        "__file", F.coalesce("path", plain).alias("path"), F.coalesce("length", F.lit(0)).alias("length")
    )
    lines = (
        spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True, **options)
        .text(paths)
        .select(place, F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"), "value")
        .where("__block = 0")
    )
    first = lines.groupBy("__file").agg(F.min_by("value", "__row").alias("header"))
    return files.join(first, "__file", "left").drop("__file")


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header line; empty and repeated ones get their position."""
    names = next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep), [])
    lower = [n.strip().lower() for n in names]
    return [f"_c{i}" if not n.strip() else f"{n.strip()}{i}" if lower.count(lower[i]) > 1 else n.strip() for i, n in enumerate(names)]


def _scans(spark: SparkSession, files: DataFrame, sep: str, types: Mapping[str, T.DataType], **options: str) -> list[DataFrame]:
    """One scan per distinct header, its columns named by the header. ``types`` by lower-case name; others are text.

    The driver sees one row per file, as it does when Spark lists them.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in files.where("header is not null").orderBy("path").collect():
        by_header.setdefault(tuple(_names(row["header"], sep)), []).append(row["path"])
    reader = spark.read.options(header=True, sep=sep, mode="PERMISSIVE", quote='"', escape='"', **options)
    return [
        reader.schema(T.StructType([T.StructField(n, types.get(n.lower(), T.StringType())) for n in names])).csv(paths)
        for names, paths in by_header.items()
    ]


def _schema(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def _by_name(
    spark: SparkSession, files: DataFrame, schema: T.StructType, sep: str, extra: Mapping[str, Column], **options: str
) -> DataFrame:
    """The files stacked by column name; columns that a file lacks are NULL, further ones are left out."""
    types = {f.name.lower(): f.dataType for f in schema.fields}
    out = None
    for scan in _scans(spark, files, sep, types, **options):
        own = {c.lower(): c for c in scan.columns}
        picked = [
            F.col(f"`{own[f.name.lower()]}`").alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        part = scan.select(*picked, *[c.alias(n) for n, c in extra.items()])
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast("string").alias(n) for n in extra])
    return out


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    **options: str,
) -> DataFrame:
    """CSV with a header. A schema saves the pass that infers the types.

    The columns of a schema are found by name in each file's own header, whatever their
    order; what a file lacks is NULL, what the schema does not name is left out.
    Without a schema the files are taken to share one header.
    """
    if schema is not None:
        return _by_name(spark, file_headers(spark, path), _schema(spark, schema), sep, {}, **options)
    reader = spark.read.options(header=True, sep=sep, mode="PERMISSIVE", quote='"', escape='"', **options)
    return reader.option("inferSchema", True).csv(path if isinstance(path, str) else list(path))


def read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    flatten: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """JSON files that hold a list of records or one object; nested objects become dotted columns.

    ``multi_line=False`` reads one record per line, which Spark can split within a file.
    """
    reader = spark.read.options(multiLine=multi_line, mode="PERMISSIVE")
    if schema:
        reader = reader.schema(schema)
    df = reader.json(path if isinstance(path, str) else list(path))
    return flatten_structs(df) if flatten else df


def flatten_structs(df: DataFrame) -> DataFrame:
    """All struct fields as columns named ``a.b``; arrays and maps are kept."""

    def leaves(prefix: list[str], dtype: T.DataType) -> list[list[str]]:
        if not isinstance(dtype, T.StructType):
            return [prefix]
        return [leaf for f in dtype.fields for leaf in leaves([*prefix, f.name], f.dataType)]

    paths = [p for f in df.schema.fields for p in leaves([f.name], f.dataType)]
    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(".".join(p)) for p in paths])


def time_column(df: DataFrame) -> Column | None:
    """Parsed timestamp of the first column whose name speaks of time.

    A date and a time column are put together where no single column can be
    parsed. None when no column qualifies.
    """
    named = [c for c in df.columns if any(w in c.lower() for w in TIME_WORDS)]
    if not named:
        return None
    tried = [parse_timestamp(F.col(f"`{c}`").cast("string")) for c in named]
    day = next((c for c in named if "date" in c.lower()), None)
    clock = next((c for c in named if "time" in c.lower() and c != day and "date" not in c.lower()), None)
    if day and clock:
        tried.append(date_and_time(F.col(f"`{day}`"), F.col(f"`{clock}`")))
    return F.coalesce(*tried)


def read_source(
    spark: SparkSession,
    path: str,
    pattern: str,
    source: str,
    schema: str | None = None,
    path_levels: Mapping[str, int] | None = None,
) -> DataFrame | None:
    """All files of one pattern: ``timestamp``, ``source`` and the value columns.

    Files are stacked by column name, one scan per distinct header; what a file
    lacks is NULL. Files without a time column are left out (``skipped_files`` names them).
    ``path`` may hold wildcards. ``path_levels`` adds columns that name a part of
    the file's path (``{"user": -4}``) and ``row_seq``, which orders the rows by
    file and position. None if no file matches or the files have no time column.
    """
    files = f"{path.rstrip('/')}/{pattern}"
    try:
        if pattern.endswith(".json"):
            reader = spark.read.schema(schema) if schema else spark.read
            scans = [flatten_structs(reader.options(multiLine=True).json(files))]
        else:
            types = {f.name.lower(): f.dataType for f in _schema(spark, schema).fields} if schema else {}
            scans = _scans(spark, file_headers(spark, files), ",", types)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    stacked = None
    for df in scans:
        ts = time_column(df)
        if ts is None or not df.columns:
            continue
        drop = {"timestamp", "source", "date", "time", "datetime"}
        kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in drop]
        if path_levels:
            kept += [file_name(level).alias(c) for c, level in path_levels.items()]
            place = ("file_path", "file_block_start")
            kept.append(
                F.struct(*[F.col(f"_metadata.{p}") for p in place], F.monotonically_increasing_id().alias("row")).alias("row_seq")
            )
        part = df.select(ts.alias("timestamp"), F.lit(source).alias("source"), *kept)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def read_sources(
    spark: SparkSession,
    path: str,
    patterns: Mapping[str, str] = SOURCE_PATTERNS,
    schemas: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """One scan per file pattern; patterns without usable files are left out.

    Patterns may overlap: a file that matches two of them is read as both.
    """
    found = {}
    for pattern, source in patterns.items():
        df = read_source(spark, path, pattern, source, (schemas or {}).get(source))
        if df is not None:
            found[source] = df
    return found


def read_tree(
    spark: SparkSession, path: str, schema: str, pattern: str = "*.csv", sep: str = ",", with_file: bool = False
) -> DataFrame:
    """Recursive scan of a directory tree; columns are found by each file's header, bad fields are NULL.

    Files that ``skipped_files`` reports give no rows. ``with_file`` adds ``file_path``.
    """
    wanted = _schema(spark, schema)
    files = _judged(spark, path, wanted, pattern, sep).where("reason is null")
    extra = {"file_path": F.col("_metadata.file_path")} if with_file else {}
    return _by_name(spark, files, wanted, sep, extra, ignoreMissingFiles="true")


def skipped_files(
    spark: SparkSession, path: str, schema: str, pattern: str = "*.csv", sep: str = ","
) -> DataFrame:
    """``path, length, reason`` of the files that ``read_tree`` leaves out."""
    judged = _judged(spark, path, _schema(spark, schema), pattern, sep)
    return judged.where("reason is not null").select("path", "length", "reason")


def _judged(spark: SparkSession, path: str, schema: T.StructType, pattern: str, sep: str) -> DataFrame:
    files = file_headers(spark, path, recursive=True, pattern=pattern)
    names = F.transform(F.split(F.regexp_replace("header", '["\\uFEFF]', ""), f"\\Q{sep}\\E"), lambda n: F.lower(F.trim(n)))
    known = F.arrays_overlap(names, F.array(*[F.lit(f.name.lower()) for f in schema.fields]))
    reason = (
        F.when(F.col("length") == 0, "empty")
        .when(F.col("header").isNull(), "unreadable")
        .when(~known, "no known column")
    )
    return files.withColumn("reason", reason)


def file_name(level: int = -1) -> Column:
    """Name of the file a row comes from; ``level=-2`` names its directory."""
    return F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), level))


def with_file_columns(df: DataFrame, level: int = -1) -> DataFrame:
    """Adds ``source_file``, ``file_user`` (first integer of the name) and ``file_date`` (last ``_`` token).

    Needs a column ``file_path`` (``read_tree`` with ``with_file``), which it drops.
    """
    name = F.url_decode(F.element_at(F.split("file_path", "/"), level))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return df.withColumns(
        {
            "source_file": name,
            "file_user": F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"),
            "file_date": F.element_at(F.split(stem, "_"), -1),
        }
    ).drop("file_path")


def category_of(name: Column, keywords: Mapping[str, str] = SENSOR_CATEGORIES) -> Column:
    """Category of the first keyword that a file name contains, else ``Unknown``."""
    out = F.lit("Unknown")
    for word, category in reversed(keywords.items()):
        out = F.when(name.contains(word), F.lit(category)).otherwise(out)
    return out


@dataclass
class Checked:
    """``rows``: the good records, typed. ``bad``: ``path, line, reason, record`` of all others and, without a line, of whole files."""

    rows: DataFrame
    bad: DataFrame


def read_checked(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv*", sep: str = ",") -> Checked:
    """Like ``read_tree``, but a record that does not fit its header or the schema is set aside with the reason.

    Files are read as lines, one record a line, and every line is parsed by the
    header of its own file. Reasons are a wrong number of fields, values that are
    no number or time (the columns are named), and bytes that are no UTF-8. An
    empty field is a NULL and no fault. Files that are empty, cannot be read or
    have no known column are listed without a line, and so are compressed files
    whose body breaks off, of which the rows before the break are kept. Blank
    lines are no records. Line numbers count the header as line 1.
    """
    wanted = _schema(spark, schema)
    judged = freeze(_judged(spark, path, wanted, pattern, sep))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in judged.where("reason is null").orderBy("path").collect():  # a row per file, as when Spark lists them
        layouts.setdefault(tuple(_names(row["header"], sep)), []).append(row["path"])
    whole = judged.where("reason is not null").select("path", F.lit(None).cast("bigint").alias("line"), "reason", F.lit(None).cast("string").alias("record"))
    bad = whole.unionByName(_broken_off(spark, judged))
    rows = None
    for names, paths in layouts.items():
        parsed = _parsed_lines(spark, paths, names, {f.name.lower(): f.dataType for f in wanted.fields}, sep)
        own = {c.lower(): c for c in names}
        picked = [F.col("rec")[own[f.name.lower()]].alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields]
        good = parsed.where("reason is null").select(*picked)
        rows = good if rows is None else rows.unionByName(good)
        bad = bad.unionByName(parsed.where("reason is not null").select("path", "line", "reason", F.col("value").alias("record")))
    return Checked(rows if rows is not None else spark.createDataFrame([], wanted), bad)


def _parsed_lines(spark: SparkSession, paths: list[str], names: tuple[str, ...], types: Mapping[str, T.DataType], sep: str) -> DataFrame:
    """``path, line, value, rec, reason`` of the records of files with one header; ``rec`` has the fields by name."""
    mid = F.monotonically_increasing_id()
    lines = spark.read.options(ignoreCorruptFiles=True).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), mid.alias("mid"), "value"
    )
    # a row per part of a file: its first line's place, and the lines of the parts before it
    parts = lines.groupBy("path", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.join(parts, ["path", "block"]).withColumn("line", F.col("before") + F.col("mid") - F.col("first") + 1)
    records = numbered.where((F.col("line") > 1) & (F.trim("value") != "")).select("path", "line", "value")
    typed = [T.StructField(n, types.get(n.lower(), T.StringType())) for n in names]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    ddl = lambda s: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s)
    as_typed, as_text = ddl([*typed, T.StructField("__corrupt", T.StringType())]), ddl([T.StructField(n, T.StringType()) for n in names])
    valid = F.is_valid_utf8("value")
    clean = F.when(valid, F.col("value"))
    out = records.withColumn("rec", F.from_csv(clean, as_typed, options)).withColumn("raw", F.from_csv(clean, as_text, options))
    fields = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), f"\\Q{sep}\\E"))
    faults = F.array_compact(F.array(*[
        F.when(F.col("rec")[f.name].isNull() & (F.trim(F.col("raw")[f.name]) != ""), F.lit(f.name)) for f in typed if not isinstance(f.dataType, T.StringType)
    ] or [F.lit(None).cast("string")]))
    reason = (
        F.when(~valid, "not UTF-8")
        .when(fields != len(names), F.concat(fields.cast("string"), F.lit(f" fields of {len(names)}")))
        .when(F.size(faults) > 0, F.concat(F.lit("unreadable "), F.array_join(faults, ", ")))
        .when(F.col("rec")["__corrupt"].isNotNull(), "malformed")
    )
    return out.select("path", "line", "value", "rec", reason.alias("reason"))


def _broken_off(spark: SparkSession, judged: DataFrame) -> DataFrame:
    """Compressed files whose body cannot be read to its end. A task holds one such file at a time."""
    schema = "path string, line bigint, reason string, record string"
    packed = [r["path"] for r in judged.where("reason is null and path like '%.gz'").collect()]
    if not packed:
        return spark.createDataFrame([], schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            broken = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rest, ended = content.as_buffer().to_pybytes(), False
                try:
                    while rest:
                        unpack = zlib.decompressobj(31)
                        while rest and not unpack.eof:
                            unpack.decompress(rest, 1 << 20)
                            rest = unpack.unconsumed_tail
                        ended, rest = unpack.eof, unpack.unused_data
                except zlib.error:
                    ended = False
                if not ended:
                    broken.append(path)
            yield pa.RecordBatch.from_pylist([{"path": p, "line": None, "reason": "breaks off", "record": None} for p in broken], schema=_BROKEN)

    return spark.read.format("binaryFile").load(packed).select("path", "content").mapInArrow(judge, schema)


_BROKEN = pa.schema([("path", pa.string()), ("line", pa.int64()), ("reason", pa.string()), ("record", pa.string())])
