"""Line-oriented sources: manifests, attempt logs with a torn tail, dictionaries and file listings."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSONL manifest; blank lines are skipped, a missing file is an empty table, a bad line is fatal."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As :func:`read_jsonl`, but a missing file is fatal."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, line``: the non-blank lines that the schema can't read."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where("length(trim(line)) > 0")
    parsed = F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(parsed["_corrupt"].isNotNull())


def read_torn_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, torn)`` of an append-only log whose last line may be cut off; any other bad line is fatal.

    Only the text after the last line end can be torn: a complete append ends its line. Such a tail is read as one if
    it parses. ``torn`` has the lost text, for a sidecar. Blank lines are skipped.
    """
    whole = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = whole.where("length(trim(value)) > 0").withColumn("row", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    last = parsed.groupBy("file").agg(F.max("at").alias("last"))
    # a log has one last line per file
    marked = parsed.join(F.broadcast(last), "file").withColumn("bad", F.col("row._corrupt").isNotNull())
    fatal = marked.where(F.col("bad") & (F.col("at") < F.col("last"))).select("value").head(1)
    if fatal:
        raise ValueError(f"a line before the last can't be read: {fatal[0].value[:200]}")
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return marked.where("NOT bad").select(*(F.col(f"row.{n}").alias(n) for n in names)), marked.where("bad").select("file", "value")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, plain or compressed, read by an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def with_dictionary(rows: DataFrame, dictionary: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """``rows`` with ``name`` from a dictionary where it has a non-blank entry, else the default; a repeated key is fatal."""
    twice = dictionary.groupBy(key).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"repeated dictionary key {twice[0][0]}")
    side = dictionary.select(F.col(key).alias("_k"), F.nullif(F.trim(F.col(name)), F.lit("")).alias("_v"))
    joined = rows.drop(name).join(side, rows[key] == F.col("_k"), "left")
    return joined.withColumn(name, F.coalesce("_v", default)).drop("_k", "_v")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, modified, digest`` of each file, to prove later that inputs did not change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, state`` of files that were added, removed or changed between two snapshots."""
    a, b = before.select("path", F.col("digest").alias("a")), after.select("path", F.col("digest").alias("b"))
    joined = a.join(b, "path", "full").where("a IS NULL OR b IS NULL OR a <> b")
    return joined.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("state"))


def paired_files(listing: DataFrame, path: str, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """``stem, left_path, right_path, state``: files paired by their path without suffix, letter case ignored.

    ``state`` is ``paired``, ``unpaired`` or ``ambiguous`` where a side has the stem more than once.
    """
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    rows = listing.select(F.col(path).alias("p"), F.lower(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")).alias("stem"), suffix.isin(list(left)).alias("l"), suffix.isin(list(right)).alias("r"))
    per = rows.where("l OR r").groupBy("stem").agg(
        F.min(F.when(F.col("l"), F.col("p"))).alias("left_path"), F.min(F.when(F.col("r"), F.col("p"))).alias("right_path"), F.count_if("l").alias("ln"), F.count_if("r").alias("rn")
    )
    state = F.when((F.col("ln") > 1) | (F.col("rn") > 1), "ambiguous").when((F.col("ln") == 1) & (F.col("rn") == 1), "paired").otherwise("unpaired")
    return per.select("stem", "left_path", "right_path", state.alias("state"))


def first_existing(candidates: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    """``key, path``: of an ordered array ``paths`` of candidates, the first that the listing has."""
    each = candidates.select(key, F.posexplode("paths").alias("at", "path"))
    return each.join(listing.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "at").alias("path"))


def flat_fields(raw: Column) -> Column:
    """A JSON object as a map of lower-case keys to texts; unreadable text is null."""
    return F.transform_keys(F.from_json(raw, "map<string,string>"), lambda k, v: F.lower(k))


def read_arrays(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``file, row, vector`` of float32 arrays stored raw in files of rows of ``width`` values, little-endian."""
    import numpy as np
    import pandas as pd

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                values = np.frombuffer(content, "<f4").reshape(-1, width)
                yield pd.DataFrame({"file": os.path.basename(name), "row": np.arange(len(values)), "vector": list(values)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, row long, vector array<float>")
