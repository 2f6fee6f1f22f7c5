"""Runs, price tables and call logs as files that Spark reads and writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import front_matter_stripped, slug
from tidemark.operators.series import clean

RUN = "run_id string, saved_at timestamp, label string, model string, config map<string,string>, summary map<string,double>"


def run_id(saved_at, label):
    """YYYYmmdd-HHMMSS_slug."""
    return F.concat(F.date_format(saved_at, "yyyyMMdd-HHmmss"), F.lit("_"), slug(label))


def save_runs(runs: DataFrame, path: str) -> None:
    """Append runs (saved_at, label, model, config, summary) as JSON lines, with their ids."""
    runs.withColumn("run_id", run_id(F.col("saved_at"), F.col("label"))).select("run_id", "saved_at", "label", "model", "config", "summary").write.mode("append").json(path)


def list_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stored runs, newest first; lines that aren't runs are passed over."""
    raw = spark.read.schema(RUN + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter(F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull()).drop("_corrupt_record").orderBy(F.desc("saved_at"), "run_id")


def load_run(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """The run of this id: no row if there is none."""
    return list_runs(spark, path).filter(F.col("run_id") == wanted)


def delete_run(spark: SparkSession, path: str, wanted: str) -> bool:
    """Whether there was a run of this id. The files that hold it are written anew, one for one, and only then deleted; files without it are left as they are, so that
    what is appended meanwhile stays, and a crash between leaves runs twice and loses none. Lines that aren't runs go with their file. RunStore
    (tidemark.sources.runs) keeps runs as partitions, where deleting one is dropping its folder."""
    rows = spark.read.schema(RUN).json(path).select("run_id", F.col("_metadata.file_path").alias("file"))
    held = [r.file for r in rows.filter(F.col("run_id") == wanted).select("file").distinct().collect()]
    if not held:
        return False
    rest = list_runs(spark, held).filter(F.col("run_id") != wanted)
    rest.write.mode("append").json(path)
    for file in held:
        fs, at = _files(spark, file)
        fs.delete(at, False)
    return True


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save_states(states: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ("asset",)) -> None:
    """States (raw, filtered, probability, fold, price) as files by asset; replaces what is there. kind: parquet or csv."""
    out = states.repartition(*by).write.mode("overwrite").partitionBy(*by)
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def record_manifest(prices: DataFrame, dataset: str, path: str) -> None:
    """Append what a price table holds to a manifest; the last entry of a dataset counts (read_manifest)."""
    manifest_of(prices, dataset).withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each dataset."""
    rows = spark.read.schema("n_rows long, actual_start date, actual_end date, dataset string, recorded_at timestamp").json(path)
    last = F.max_by(F.struct("n_rows", "actual_start", "actual_end"), "recorded_at").alias("e")
    return rows.groupBy("dataset").agg(last).select("dataset", "e.*")


def load_prompt(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, sha16): the file without its front matter and the blanks around it, and the first 16 hex digits of the sha256 of the file as it is. A missing file is an error."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    text = F.regexp_replace(front_matter_stripped(F.decode("content", "UTF-8")), r"^\s+|\s+$", "")
    digest = F.substring(F.sha2("content", 256), 1, 16)
    return spark.read.format("binaryFile").load(path).select(text.alias("prompt"), digest.alias("sha16"))


def read_prices(spark: SparkSession, path: str, names: Mapping[str, str], day: str = "Date") -> DataFrame:
    """(d, *names) from CSV with a column for each ticker; `names` gives ticker -> name, in the order of the result. Rows that lack a price go."""
    raw = spark.read.option("header", True).csv(path)
    if missing := [t for t in names if t not in raw.columns]:
        raise KeyError(f"no such tickers: {missing}")
    rows = raw.select(F.to_date(F.substring(day, 1, 10)).alias("d"), *[F.expr(f"try_cast(`{t}` AS DOUBLE)").alias(n) for t, n in names.items()])
    return rows.select("d", *[clean(n).alias(n) for n in names.values()]).na.drop("any")


def _header(lines: list[list[str]], symbols: Sequence[str], field: str) -> dict[str, int]:
    """Which column holds `field` of each symbol, from the rows above the data: one row of symbols, one of fields (of a single symbol), or two, the one over the other."""
    clean_ = [[c.strip() for c in row] for row in lines]
    fields = [row for row in clean_ if field.lower() in [c.lower() for c in row]]
    named = [row for row in clean_ if set(row) & set(symbols) and row not in fields]
    if not fields and named:
        return {t: named[0].index(t) for t in symbols if named[0].count(t) == 1}
    if fields and not named and len(symbols) == 1:
        return {symbols[0]: [c.lower() for c in fields[0]].index(field.lower())}
    if fields and named:
        # Merged cells: a name holds for the columns after it, up to the next.
        filled = []
        for row in (fields[0], named[0]):
            own, last = [], ""
            for c in row:
                last = c or last
                own.append(last)
            filled.append(own)
        pairs = list(zip(*filled))
        return {t: k for t in symbols for k, (f, name) in enumerate(pairs) if f.lower() == field.lower() and name == t}
    return {}


def read_vendor_prices(spark: SparkSession, path: str, names: Mapping[str, str], field: str = "Close") -> DataFrame:
    """(d, *names) from a vendor's CSV, in whatever layout it came: a column for each ticker, the fields of a single ticker, or two rows of headings, fields over tickers or
    tickers over fields (merged cells may be empty). Of the fields `field` is taken. names gives ticker -> name. The headings are what comes before the first row
    whose first cell is a day; rows that lack a price go. Tickers that aren't there, or layouts that aren't known, are a KeyError."""
    raw = spark.read.option("header", False).csv(path)
    day = F.to_date(F.try_to_timestamp(F.substring(raw.columns[0], 1, 10), F.lit("yyyy-MM-dd")))
    head = [[c or "" for c in r] for r in raw.filter(day.isNull()).limit(8).collect()]
    found = _header(head, list(names), field)
    if missing := [t for t in names if t not in found]:
        raise KeyError(f"no column {field} of {missing} under the headings {head}")
    price = lambda t: F.nanvl(F.expr(f"try_cast(`{raw.columns[found[t]]}` AS DOUBLE)"), F.lit(None).cast("double"))
    return raw.select(day.alias("d"), *[price(t).alias(n) for t, n in names.items()]).na.drop("any")


#: Named sets of tickers, and what each is called: fixed values. The first is what models are fitted on; the others are indices that played no part in it.
DATASETS = {
    "universe": {"SPY": "spy", "TLT": "tlt", "GLD": "gld", "^VIX": "vix", "HYG": "hyg"},
    "nikkei": {"^N225": "nikkei"},
    "hang_seng": {"^HSI": "hang_seng"},
    "dax": {"^GDAXI": "dax"},
}


def load_dataset(spark: SparkSession, folder: str, dataset: str, datasets: Mapping[str, Mapping[str, str]] = DATASETS, field: str = "Close") -> DataFrame:
    """(d, *names) of a named set, from the file (or folder) of its name with .csv under folder."""
    if dataset not in datasets:
        raise KeyError(f"no such dataset: {dataset}; there are {sorted(datasets)}")
    return read_vendor_prices(spark, f"{folder.rstrip('/')}/{dataset}.csv", datasets[dataset], field)


def long_prices(wide: DataFrame, day: str = "d") -> DataFrame:
    """(asset, d, px) of a table with a column for each asset."""
    assets = [c for c in wide.columns if c != day]
    return wide.unpivot(day, assets, "asset", "px").select("asset", day, "px")


def manifest_of(prices: DataFrame, dataset: str, by: Sequence[str] = ()) -> DataFrame:
    """What a price table holds: rows and range (null where it is empty)."""
    return prices.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min("d").alias("actual_start"), F.max("d").alias("actual_end")).withColumn("dataset", F.lit(dataset))


def tail_calls(spark: SparkSession, path: str, columns: Sequence[str], most: int = 200) -> DataFrame:
    """The last entries of a JSON call log, with those of the columns that it has."""
    raw = spark.read.json(path)
    have = [c for c in columns if c in raw.columns]
    order = "timestamp_utc" if "timestamp_utc" in raw.columns else have[0]
    return raw.orderBy(F.desc(order)).limit(most).select(*have)


NARRATIVE = "driver_identified boolean, confidence string, summary string, mechanism string, claims array<struct<claim string, item_ids array<string>>>, primary_item_ids array<string>, competing_explanation string, insufficient_evidence_reason string"


def parse_narratives(responses: DataFrame, text: str = "response_text") -> DataFrame:
    """Stored responses with their parsed fields: an outer code fence goes, the text from the first to the last brace is read as JSON, missing fields get defaults; parse_ok says
    whether there was an object."""
    inner = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(text))
    inner = F.coalesce(F.nullif(F.regexp_extract(inner, r"(?s)(\{.*\})", 1), F.lit("")), inner)
    parsed = F.from_json(inner, NARRATIVE, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(inner).isNotNull() & F.startswith(F.trim(inner), F.lit("{"))
    out = responses.withColumns({"_n": parsed, "parse_ok": F.coalesce(ok, F.lit(False))})
    default = {"driver_identified": F.lit(False), "confidence": F.lit("none"), "summary": F.lit(""), "mechanism": F.lit(""), "competing_explanation": F.lit(""), "insufficient_evidence_reason": F.lit("")}
    fields = {c: F.coalesce(F.when(F.col("parse_ok"), F.col(f"_n.{c}")), d) for c, d in default.items()}
    fields["confidence"] = F.lower(fields["confidence"])
    for c, kind in (("claims", "array<struct<claim:string,item_ids:array<string>>>"), ("primary_item_ids", "array<string>")):
        fields[c] = F.coalesce(F.when(F.col("parse_ok"), F.col(f"_n.{c}")), F.array().cast(kind))
    out = out.withColumns(fields).drop("_n")
    return out.withColumn("is_confident", F.col("driver_identified") & F.col("confidence").isin("high", "medium"))
