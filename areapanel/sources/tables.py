"""Readers. Every text source is read with a declared schema."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.sources.schemas import AREA_NAMES, FEATURES, YEAR_NAMES


def files_by_header(spark: SparkSession, path, encoding: str = "UTF-8") -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` (a file, folder, pattern, or list of these) by the column names in their first line.

    Only first lines are read, on the driver, by any file system and compression that Spark reads. Files without a line are left
    out, and so are hidden ones.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def listed(place) -> list:
        fs = place.getFileSystem(conf)
        found = []
        for status in fs.globStatus(place) or []:
            root, own = status.getPath().toString().rstrip("/"), status.getPath().getName()
            if own.startswith(("_", ".")) and own != place.getName():  # matched by a pattern, not given
                continue
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                file = files.next().getPath()
                below = file.toString()[len(root):].split("/")
                if not any(part.startswith(("_", ".")) for part in below if part):
                    found.append(file)
        return found

    def header(file) -> tuple[str, ...]:
        stream = file.getFileSystem(conf).open(file)
        try:
            codec = codecs.getCodec(file)
            source, data = codec.createInputStream(stream) if codec else stream, b""
            while part := bytes(source.readNBytes(1 << 16)):
                data += part
                if re.search("[\r\n].", data.decode(encoding, "ignore").lstrip("\r\n")):
                    break
        finally:
            stream.close()
        lines = data.decode(encoding, "replace").replace("\ufeff", "").lstrip("\r\n").splitlines()
        return tuple(next(csv.reader(lines[:1]), ()))

    files = [f for p in ([path] if isinstance(path, str) else path) for f in listed(jvm.org.apache.hadoop.fs.Path(str(p)))]
    with ThreadPoolExecutor(16) as pool:
        found = list(zip(pool.map(header, files), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for names, file in sorted(((n, f.toString()) for n, f in found if n), key=lambda x: x[1]):
        out.setdefault(names, []).append(file)
    return out


def _by_position(spark: SparkSession, files, header: tuple[str, ...], columns: Mapping[str, str], encoding: str) -> DataFrame:
    """Named columns of files that share a header, which may hold a name twice: the first counts. Bad text becomes NULL."""
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    df = spark.read.schema(raw).option("header", True).option("encoding", encoding).option("enforceSchema", True).csv(files)
    return df.select(*[F.col(f"c{header.index(c)}").try_cast(t).alias(c) for c, t in columns.items()])


def _checked(groups: Mapping[tuple[str, ...], list[str]], names: Sequence[str]) -> None:
    for header, files in groups.items():
        missing = [c for c in names if c not in header]
        if missing:
            raise ValueError(f"no column {missing} in the header {list(header)} of {files[0]}" + f" and {len(files) - 1} more" * (len(files) > 1))


def read_table(
    spark: SparkSession, path, schema: T.StructType | str, encoding: str = "UTF-8", dates: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV with header lines. Line ends may be LF, CRLF or CR alone; a byte-order mark does no harm.

    Each file's own header decides: where it is the schema's, the file is read with it; otherwise its columns are found by
    name, whatever their order. A file without one of them is an error that names it; further columns are ignored.
    ``dates`` maps text columns to their format; a bad date becomes NULL.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    groups = files_by_header(spark, path, encoding)
    _checked(groups, wanted.names)
    parts = []
    for header, files in groups.items():
        files = path if len(groups) == 1 else files  # one header: Spark lists the files itself
        if list(header) == wanted.names:
            parts.append(spark.read.schema(wanted).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
                         .option("enforceSchema", True).csv(files).select(*[F.col(f"`{c}`") for c in wanted.names]))
        else:
            parts.append(_by_position(spark, files, header, {f.name: f.dataType.simpleString() for f in wanted}, encoding))
    df = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], wanted)
    return df.withColumns({c: F.try_to_date(F.col(f"`{c}`"), fmt) for c, fmt in (dates or {}).items()})


def read_named_table(spark: SparkSession, path, columns: Mapping[str, str], encoding: str = "UTF-8") -> DataFrame:
    """CSV whose column order is not known: columns are found by the header of each file, and only those named are read.

    ``columns`` maps header name -> type; text that is not of the type becomes NULL.
    """
    groups = files_by_header(spark, path, encoding)
    _checked(groups, list(columns))
    parts = [_by_position(spark, path if len(groups) == 1 else files, header, columns, encoding) for header, files in groups.items()]
    empty = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)


def normalize_keys(df: DataFrame) -> DataFrame:
    """Rename whichever key names the source uses to ``area`` and ``year``, as whole numbers."""
    names = {c: "area" for c in df.columns if c in AREA_NAMES} | {c: "year" for c in df.columns if c in YEAR_NAMES}
    if len(set(names.values())) != len(names):
        raise ValueError(f"more than one area or year column: {sorted(names)}")
    df = df.withColumnsRenamed(names)
    # A key with gaps is stored as a decimal text such as 10453.0, so it passes through double.
    return df.withColumns({k: F.col(k).try_cast("double").cast("int") for k in set(names.values())})


def _feature_rows(collections: DataFrame, features) -> DataFrame:
    return collections.select(F.explode(features).alias("f")).select(
        F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def read_features(spark: SparkSession, path) -> DataFrame:
    """One row per feature of the collection in each file: its properties as a map, and the geometry as it is."""
    return _feature_rows(spark.read.schema(FEATURES).option("multiLine", True).json(path), "features")


def flatten_features(df: DataFrame, json_col: str) -> DataFrame:
    """The same for collections held as text in a column."""
    return _feature_rows(df, F.from_json(json_col, FEATURES)["features"])


def feature_property(features: DataFrame, name: str, alias: str) -> DataFrame:
    return features.withColumn(alias, F.try_element_at("properties", F.lit(name)))


def read_lines(spark: SparkSession, path, line_sep: str = "\n") -> DataFrame:
    """Text lines with what is needed to put them in file order: (file, block, line, text).

    A block is one split of the scan; lines are numbered inside it, so (block, line) is the order of a file.
    """
    raw = spark.read.option("lineSep", line_sep).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("text"),
    )


def read_sections(spark: SparkSession, path, fmt: str = "M/d/yy", line_sep: str = "\r") -> DataFrame:
    """A sectioned series file: a 'name,' line, then 'date,value' lines. Result: (section, day, value)."""
    from areapanel.operators.reshape import fill_sections

    lines = read_lines(spark, path, line_sep)
    parts = F.split("text", ",")
    lines = lines.withColumns({"_first": F.trim(parts[0]), "_second": F.trim(F.try_element_at(parts, F.lit(2)))})
    lines = lines.withColumn("day", F.try_to_date("_first", fmt))
    head = F.when(F.col("day").isNull() & (F.col("_first") != ""), F.col("_first"))
    filled = fill_sections(lines.withColumn("_head", head), "_head", ["block", "line"], file=["file"])
    return filled.filter(F.col("day").isNotNull()).select(
        "section", "day", F.col("_second").try_cast("double").alias("value"))


def by_year(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.col("year") == year)
