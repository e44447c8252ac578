"""Readers: JSON documents, TOML manifests, rosters, XLSX sheets, retrieval indexes and pluggable collectors."""

from __future__ import annotations

import glob
import json
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import parse_ids
from tessera.operators.checks import ContractError
from tessera.schemas import VERSIONS


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A multi-line JSON document under an explicit schema; None where it is missing or unreadable."""
    try:
        return read_strict(spark, path, schema)
    except (AnalysisException, ContractError):
        return None


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but a malformed document is an error at once (the envelope is one row)."""
    df = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    held = df.cache()  # Spark wants the parsed rows kept before it is asked for the corrupt ones
    if held.where("_corrupt is not null").limit(1).collect():
        raise ContractError(f"{path} is no JSON document")
    return held.drop("_corrupt")


def child_rows(document: DataFrame, array: str) -> DataFrame:
    """One row for each element of a document's list."""
    return document.select(F.explode(array).alias("_r")).select("_r.*")


def check_version(meta: DataFrame, kind: str) -> None:
    """meta: one row with document_type and schema_version."""
    row = meta.select("document_type", "schema_version").first()
    if row is None or row[0] != kind or row[1] != VERSIONS[kind]:
        raise ContractError(f"expected {kind} version {VERSIONS[kind]}, found {row}")


def read_documents(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Several documents of a folder: {name: schema} to {name: rows}; details can be re-joined with history.join_details."""
    return {name: read_strict(spark, f"{folder}/{name}.json", schema) for name, schema in schemas.items()}


def read_toml(path: str | Path, known: set[str] | None = None) -> dict:
    """A TOML table; with known, other keys are an error. Small dimension data, on the driver."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    if known is not None and (extra := set(data) - known):
        raise ContractError(f"unknown keys in {path}: {sorted(extra)}")
    return data


def toml_rows(spark: SparkSession, path: str | Path, table: str, schema: str) -> DataFrame:
    """The records of a list of tables as rows; missing fields are null."""
    names = [f.split()[0].split(":")[0] for f in _fields(schema)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in read_toml(path).get(table, [])], schema)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:k].strip())
            start = k + 1
    return [*out, schema[start:].strip()]


def toml_overrides(spark: SparkSession, path: str | Path, table: str, allowed: list[str]) -> DataFrame:
    """id and, for each allowed field, its value and has_<field>; ids in lower case; other fields are an error."""
    rows = []
    for key, fields in read_toml(path).get(table, {}).items():
        if extra := set(fields) - set(allowed):
            raise ContractError(f"override {key} has unknown fields {sorted(extra)}")
        rows.append((key.lower(), *[None if fields.get(a) is None else str(fields[a]) for a in allowed], *[a in fields for a in allowed]))
    schema = ", ".join(["id string", *[f"{a} string" for a in allowed], *[f"has_{a} boolean" for a in allowed]])
    return spark.createDataFrame(rows, schema)


def toml_profiles(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One organisation per file, in order of the file names, the disabled ones left out."""
    names = [f.split()[0] for f in _fields(schema)]
    found = [read_toml(p) for p in sorted(glob.glob(pattern))]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in found if r.get("enabled", True)], schema)


def read_xlsx(spark: SparkSession, path: str | Path, columns: int = 5) -> DataFrame:
    """c1..cn of the first sheet after its header, padded or cut to columns, as text; rows without the first two go."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells = [None] * columns
        for c in row.findall("m:c", ns):
            at = 0
            for ch in "".join(x for x in c.get("r", "A") if x.isalpha()):
                at = at * 26 + ord(ch) - 64
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            if 0 < at <= columns:
                cells[at - 1] = (text or "").strip() or None
        rows.append(tuple(cells))
    return spark.createDataFrame([r for r in rows[1:] if r[0] and r[1]], ", ".join(f"c{k + 1} string" for k in range(columns)))


def trainee_roster(sheet: DataFrame) -> DataFrame:
    """last, first, degree, program, aliases of a sheet's five columns; the address only gives an alias and is dropped.

    The alias is the address's given part, if it is a name of its own with at least two letters.
    """
    given = F.initcap(F.regexp_extract(F.lower("c5"), r"^([a-z]{2,})[._]", 1))
    alias = F.when((given != "") & (F.lower(given) != F.lower(F.element_at(F.split("c2", " "), 1))), F.array(given)).otherwise(F.array().cast("array<string>"))
    return sheet.select(F.col("c1").alias("last"), F.col("c2").alias("first"), F.coalesce("c3", F.lit("")).alias("degree"), F.coalesce("c4", F.lit("")).alias("program"), F.coalesce(alias, F.array().cast("array<string>")).alias("aliases"))


def flatten_people(organizations: DataFrame) -> DataFrame:
    """Organisation columns (org_id, org_name) with one row for each researcher."""
    return organizations.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), F.explode("researchers").alias("_r")).select("org_id", "org_name", "_r.*")


def scholar_sources(people: DataFrame) -> DataFrame:
    """A source row for each researcher with a scholar_author_id."""
    return people.where(F.coalesce("scholar_author_id", F.lit("")) != "").select("org_id", F.lit("scholar").alias("type"), F.col("scholar_author_id").alias("author"), F.concat(F.lit("Scholar: "), F.col("name")).alias("label"))


def requested_ids(spark: SparkSession, text: str) -> DataFrame:
    """id, in order; anything but u-numbers is an error."""
    ids = spark.range(1).select(F.explode(parse_ids(F.lit(text))).alias("id"))
    rows = [r[0] for r in ids.collect()]  # a command line's worth
    if not rows or any(not (r.startswith("u") and r[1:].isdigit()) for r in rows):
        raise ContractError(f"no faculty ids: {text!r}")
    return ids


def read_index(spark: SparkSession, folder: str, chunk_schema: str) -> DataFrame:
    """Chunks joined with their int8 vectors (bytes) by id."""
    chunks = spark.read.schema(chunk_schema).option("mode", "FAILFAST").json(f"{folder}/chunks.jsonl")
    vectors = spark.read.schema("id string, v string").option("mode", "FAILFAST").json(f"{folder}/vectors.jsonl")
    return chunks.join(vectors.select("id", F.unbase64("v").alias("vector")), "id", "left")


class AdapterRegistry:
    """One adapter per division: a function from a page's HTML to cards."""

    def __init__(self) -> None:
        self.adapters: dict[str, Callable[[str], list[dict]]] = {}

    def register(self, division: str, adapter: Callable[[str], list[dict]]) -> None:
        if division in self.adapters:
            raise ContractError(f"two adapters for {division}")
        self.adapters[division] = adapter

    def check(self, divisions: set[str]) -> None:
        if set(self.adapters) != divisions:
            raise ContractError(f"adapters and divisions differ: {sorted(set(self.adapters) ^ divisions)}")


def collect(sources: DataFrame, collector: Callable[[dict], list[dict]], partitions: int = 8) -> DataFrame:
    """source_id, status, message, item (JSON): rows of each source, or one status row where it failed.

    The collector is injected (an HTTP client in production, a fake in tests); a failing source is no failing job.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    items = collector(r)
                    out.append((r["source_id"], "ok", "", None))
                    out += [(r["source_id"], "item", "", json.dumps(x, sort_keys=True)) for x in items]
                except PermissionError as e:
                    out.append((r["source_id"], "blocked", str(e), None))
                except Exception as e:  # noqa: BLE001  isolation is what this operator is for
                    out.append((r["source_id"], "error", str(e), None))
            yield pd.DataFrame(out, columns=["source_id", "status", "message", "item"])
    return sources.repartition(partitions).mapInPandas(run, "source_id string, status string, message string, item string")


class RecordsSource(DataSource):
    """A Python data source over an injected collector: spark.read.format("records").option("collector", "pkg:func")."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "source_id string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordsReader(dict(self.options))


class _RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options.get("sources", "").split(",") if s]

    def read(self, partition):
        import importlib

        module, name = self.options["collector"].split(":")
        for item in getattr(importlib.import_module(module), name)(partition.value):
            yield partition.value, json.dumps(item, sort_keys=True)
