"""Scans: text tables, path entities, JSON payloads, markers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.functions.exprs import col, group_label, to_number


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, sep: str = "\t",
    glob: str | None = None, provenance: bool = False,
) -> DataFrame:
    """TSV or CSV, plain or gzip, one or many files or folders; the schema is never inferred. NaN is read as null.

    gzip files cannot be split: convert such a drop to parquet once.
    """
    r = spark.read.option("sep", sep).option("header", True).option("recursiveFileLookup", True)
    r = r.option("nullValue", "").option("nanValue", "NaN")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.schema(schema).csv(list(paths) if not isinstance(paths, str) else paths)
    df = df.withColumns({f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    return with_provenance(df) if provenance else df


def with_provenance(df: DataFrame, skip_suffix: str = ".bak.tsv") -> DataFrame:
    """Add ``source_path`` and drop the rows of backup files."""
    out = df.withColumn("source_path", F.col("_metadata.file_path"))
    return out.filter(~F.col("source_path").endswith(skip_suffix))


def part_below(path, folder: str) -> Column:
    """The file or folder directly below ``folder`` that a path leads through: a table's name, however many files it has."""
    name = quote(folder.rstrip("/").rsplit("/", 1)[-1], safe="!$&'()*+,;=:@~")
    return F.split(F.substring_index(col(path), f"/{name}/", -1), "/")[0]


def path_entities(path) -> dict[str, Column]:
    """session, task (T0..T4), participant (P1..P4) and group from a file path."""
    p = col(path)
    group = F.regexp_extract(p, r"(?i)(grp[_-]?\d+)", 1)
    return {
        "session_id": F.nullif(F.regexp_extract(p, r"(ses[-_][A-Za-z0-9]+)", 1), F.lit("")),
        "task_id": F.nullif(F.regexp_extract(p, r"[_/-](T[0-4])(?:[_./-]|$)", 1), F.lit("")),
        "participant_id": F.nullif(F.regexp_extract(p, r"[_/-](P[1-4])(?:[_./-]|$)", 1), F.lit("")),
        "group_id": F.when(group != "", group_label(group)),
    }


def only_sessions(df: DataFrame, session_col: str, allowed: Sequence[str] | None) -> DataFrame:
    """Keep the listed sessions; a filter on a partition column prunes whole folders."""
    return df if allowed is None else df.filter(F.col(session_col).isin(*allowed))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in cols})


def json_field(payload, field: str, fallback=None) -> Column:
    """A field of a JSON text; empty and n/a count as missing."""
    v = F.get_json_object(col(payload), f"$.{field}")
    v = F.when(~F.lower(F.trim(v)).isin("", "n/a"), v)
    return v if fallback is None else F.coalesce(v, col(fallback))


def payload_items(df: DataFrame, payload: str, keep: Sequence[str], drop_keys: Sequence[str] = ()) -> DataFrame:
    """Questionnaire payload to long rows (item_key, item_value); nested objects are opened one level."""
    m = F.from_json(F.col(payload), "map<string,string>")
    if drop_keys:
        m = F.map_filter(m, lambda k, v: ~k.isin(*drop_keys))
    flat = df.select(*keep, F.explode(F.map_entries(m)).alias("_e"))
    inner = F.from_json(F.col("_e.value"), "map<string,string>")
    opened = F.when(F.col("_e.value").startswith("{"), F.map_entries(inner)).otherwise(F.array(F.col("_e")))
    return flat.select(*keep, F.explode(opened).alias("_i")).select(
        *keep, F.col("_i.key").alias("item_key"), F.col("_i.value").alias("item_value")
    )


def response_items(df: DataFrame, payload: str, keep: Sequence[str], meta: Sequence[str]) -> DataFrame:
    """Questionnaire payload to long rows (item_key, item_value), by the payload's ``type``.

    vad: valence, arousal and dominance where given; postblock: the entries of ``responses``; probe: the probe's
    name and all keys outside ``meta``; any other type: the entries of ``responses``, then all keys outside
    ``meta``. A payload that is no JSON object gives no rows.
    """
    text = "map<string,string>"
    d = df.select(*keep, F.from_json(F.col(payload), text).alias("_m"))
    kind = F.lower(F.trim(F.coalesce(F.col("_m")["type"], F.lit(""))))
    answers = F.coalesce(F.map_entries(F.from_json(F.col("_m")["responses"], text)), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.filter(F.map_entries("_m"), lambda e: ~e["key"].isin(*meta))
    mood = F.filter(F.map_entries("_m"), lambda e: e["key"].isin("valence", "arousal", "dominance") & e["value"].isNotNull())
    name = F.filter(F.map_entries("_m"), lambda e: (e["key"] == "probe_name") & e["value"].isNotNull())
    rest = F.filter(own, lambda e: e["key"] != "responses")
    items = F.when(kind == "vad", mood).when(kind == "postblock", answers).when(kind == "probe", F.concat(name, own)).otherwise(F.concat(answers, rest))
    return d.select(*keep, F.explode(items).alias("_i")).select(*keep, F.col("_i.key").alias("item_key"), F.col("_i.value").alias("item_value"))


def to_ndjson(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One JSON text per row in column ``line``."""
    return df.select(F.to_json(F.struct(*(cols or df.columns))).alias("line"))


def from_ndjson(df: DataFrame, schema: str, line: str = "line") -> DataFrame:
    return df.select(F.from_json(line, schema).alias("_r")).select("_r.*")


def strip_padding(df: DataFrame) -> DataFrame:
    """Trim fixed-width padding from headers and text cells."""
    df = df.toDF(*[c.strip() for c in df.columns])
    text = {f.name: F.regexp_replace(f.name, r"^\s+|\s+$", "") for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(text) if text else df


def demultiplex(df: DataFrame, stream_name: str, modality: Mapping[str, str], participant_pattern: str) -> DataFrame:
    """One table with ``modality`` and ``participant_id`` columns instead of one file per stream."""
    m = None
    for token, name in modality.items():
        hit = F.lower(F.col(stream_name)).contains(token)
        m = F.when(hit, name) if m is None else m.when(hit, name)
    pid = F.regexp_extract(F.col(stream_name), participant_pattern, 1)
    return df.withColumns({"modality": m.otherwise("other"), "participant_id": F.when(pid != "", pid)})


def channels(df: DataFrame, values: str, names: Mapping[str, int]) -> DataFrame:
    """Project named channels out of a ragged sample array; absent ones are null."""
    return df.withColumns({n: F.get(F.col(values), F.lit(i)).cast("double") for n, i in names.items()})


def marker_events(df: DataFrame, text: str, t: str, schema: str, task_pattern: str = r"\b(T[0-4])\b") -> DataFrame:
    """Marker text to event fields: JSON when it parses, else the task found in the text."""
    j = F.from_json(F.col(text), schema)
    task = F.nullif(F.regexp_extract(F.col(text), task_pattern, 1), F.lit(""))
    fields = T._parse_datatype_string(schema).fieldNames()
    out = df.withColumn("_j", j)
    cols = {f"marker_{f}": F.col(f"_j.{f}") for f in fields}
    if "task" in fields:
        cols["marker_task"] = F.coalesce(F.col("_j.task"), task)
    if "wall_clock" in fields:
        cols["marker_wall_clock"] = F.coalesce(F.col("_j.wall_clock"), F.col(t))
    return out.withColumns(cols).drop("_j")


def feature_dictionary(df: DataFrame, definitions: Mapping[str, str]) -> DataFrame:
    """(feature, definition, type) for the columns of a feature table."""
    spark = df.sparkSession
    rows = [(f.name, definitions.get(f.name, ""), f.dataType.simpleString()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "feature string, definition string, type string")
