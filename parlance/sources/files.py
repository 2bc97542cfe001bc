"""Tables from and to files: golden sets, corpora, documents, audio, audit segments, intents and summaries."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: results depend on them ---------------------------------------
ENCODINGS = ("utf-8", "cp949", "euc-kr", "utf-16")
MAX_UNZIPPED = 512 << 20
PDF, OLE, ZIP = b"%PDF", bytes.fromhex("d0cf11e0a1b11ae1"), b"PK"
INTENT_COLUMNS = ("node_id", "name", "description", "patterns", "examples", "next_node", "slot")
SEGMENT = "audit-%s.jsonl"
# -------------------------------------------------------------------------------


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, one object a line, as struct `row`, with their file and line number.

    Blank lines, and headers (objects whose keys all start with _), are left
    out. A line that is no object comes with a null row: see `broken`. For its
    line numbers a file is read as one row, so a file may have 2 GB at most:
    larger sets are many files.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = lines.withColumn("value", F.trim(F.regexp_replace("value", "\r$", ""))).where("value <> ''")
    keys = F.json_object_keys("value")
    header = (F.size(keys) > 0) & F.forall(keys, lambda k: k.startswith("_"))
    row = F.when(keys.isNotNull(), F.from_json("value", schema))
    return lines.where(~F.coalesce(header, F.lit(False))).select("file", (F.col("line") + 1).alias("line"), "value", row.alias("row"))


def broken(rows: DataFrame, *needed: str) -> DataFrame:
    """(file, line, problem) of rows that are no object or lack a needed field; empty lists count as lacking."""
    problems = [F.when(F.col("row").isNull(), "no object")]
    for field in needed:
        kind = rows.select(f"row.{field}").schema[field].dataType.typeName()
        absent = F.col(f"row.{field}").isNull() | ((F.size(f"row.{field}") == 0) if kind == "array" else F.lit(False))
        problems.append(F.when(F.col("row").isNotNull() & absent, f"lacks {field}"))
    return rows.select("file", "line", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


#: Fields of the golden sets, and those that a case must have.
GOLDEN = {
    "retrieval": ("case_id string, query string, expected array<string>", ("case_id", "query", "expected")),
    "pii": ("case_id string, text string, expect_types array<string>, must_not_contain array<string>, known_limitation boolean", ("case_id", "text")),
    "tts": ("case_id string, text string, expect string", ("case_id", "text", "expect")),
    "grounding": ("case_id string, answer string, evidence array<string>, accept boolean, known_limitation boolean", ("case_id", "accept")),
    "intent": ("case_id string, utterance string, expect string, intents array<struct<name:string,description:string,patterns:array<string>,examples:array<string>>>", ("case_id", "utterance", "intents")),
    "asr": ("case_id string, audio string, reference string", ("case_id", "audio", "reference")),
}


def golden(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cases of a golden set of a kind, one column a field; broken lines are an error that names file and line."""
    schema, needed = GOLDEN[kind]
    rows = json_lines(spark, path, schema)
    bad = broken(rows, *needed).groupBy("file", "line").agg(F.concat_ws(", ", F.collect_list("problem")).alias("problem"))
    checked = rows.join(bad, ["file", "line"], "left")
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("problem"))
    checked = checked.withColumn("row", F.when(F.col("problem").isNotNull(), F.raise_error(where)).otherwise(F.col("row")))
    return checked.select("row.*")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of Markdown files: a line "## id title" opens an article; what stands before the first is left out. A file is read as one row, 2 GB at most."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    head = F.col("value").startswith("## ")
    number = F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("line"))
    rows = lines.withColumn("number", number).where("number > 0").withColumn("head", head)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "value")))), lambda x: x["value"])
    made = rows.groupBy("file", "number").agg(F.max(F.when(F.col("head"), F.trim(F.substring("value", 4, 1 << 20)))).alias("title"), F.trim(F.regexp_replace(F.array_join(ordered, "\n"), r"^\s+|\s+$", "")).alias("text"))
    return made.select(F.split("title", r"\s+")[0].alias("doc_id"), "title", "text")


def sniffed(content: Column, name: Column) -> Column:
    """Kind of a document by its first bytes, else by its name, else plain; zip archives by their entries' names."""
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    # names of a zip archive's entries stand uncompressed in it
    hwpx = F.decode(content, "ISO-8859-1").contains("Contents/")
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(starts(PDF), "pdf").when(starts(OLE), "hwp").when(starts(ZIP), F.when(hwpx, "hwpx").otherwise("docx")).when(ending.isin("pdf", "hwp", "hwpx", "docx"), ending).otherwise("plain")


def _plain(content: bytes) -> tuple[str, str]:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).removeprefix("﻿"), "" if encoding == "utf-8" else f"read as {encoding}"
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def _zipped(content: bytes, kind: str) -> tuple[str, str]:
    """Paragraphs of the XML parts: names of elements decide, their namespaces don't."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > MAX_UNZIPPED:
            raise ValueError("too large when unpacked")
        names = archive.namelist()
        parts = sorted(n for n in names if re.fullmatch(r"Contents/section\d+\.xml", n)) if kind == "hwpx" else ["word/document.xml"]
        local = lambda e: e.tag.rpartition("}")[2]
        out = []
        for part in parts:
            for paragraph in (e for e in ElementTree.fromstring(archive.read(part)).iter() if local(e) == "p"):
                text = "".join(e.text or "" for e in paragraph.iter() if local(e) == "t")
                if text.strip():
                    out.append(text)
        header = kind == "docx" and any(n.startswith("word/header") for n in names)
    return "\n".join(out), "headers are left out" if header else ""


def parsed(files: DataFrame) -> DataFrame:
    """Documents (path, content) as (path, kind, text, warning, error): one broken document doesn't stop the others.

    Plain texts in four encodings, DOCX and HWPX are read; kinds that need
    further libraries, and documents without text, come with an error.
    """
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("warning", pa.string()), ("error", pa.string())])

    def one(path: str, kind: str, content: bytes) -> dict:
        try:
            if kind in ("pdf", "hwp"):
                raise ValueError(f"{kind} needs a library that isn't here")
            text, warning = _plain(content) if kind == "plain" else _zipped(content, kind)
            if not text.strip():
                raise ValueError("no text")
            return {"path": path, "kind": kind, "text": text, "warning": warning, "error": None}
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as fault:
            return {"path": path, "kind": kind, "text": None, "warning": None, "error": str(fault)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for path, kind, content in zip(b.column("path").to_pylist(), b.column("kind").to_pylist(), b.column("content")):
                out.append(one(path, kind, content.as_py()))
                size += len(out[-1]["text"] or "")
                if len(out) >= 256 or size >= 16 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    rows = files.select("path", sniffed(F.col("content"), F.col("path")).alias("kind"), "content")
    return rows.mapInArrow(run, "path string, kind string, text string, warning string, error string")


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, pcm) of WAV files; anything but 16-bit mono is an error."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import wave

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with wave.open(io.BytesIO(content)) as sound:
                    if (sound.getnchannels(), sound.getsampwidth()) != (1, 2):
                        raise ValueError(f"{name}: not 16-bit mono")
                    yield pa.record_batch([pa.array([name]), pa.array([sound.getframerate()], pa.int32()), pa.array([sound.readframes(sound.getnframes())])], names=["path", "rate", "pcm"])

    return rows.mapInArrow(run, "path string, rate int, pcm binary")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"))


def segment_name(day: Column) -> Column:
    return F.concat(F.lit("audit-"), F.date_format(day, "yyyyMMdd"), F.lit(".jsonl"))


def write_segments(records: DataFrame, path: str, work: str | None = None) -> None:
    """Add audit records (with recorded_at) as JSON lines, a folder a day and in it one for each piece of work.

    work names what is written: done again, as after a crash, it replaces its
    own records instead of doubling them. Without a name it is work of its own.
    """
    named = records.withColumns({"segment": segment_name(F.col("recorded_at")), "work": F.lit(work or uuid.uuid4().hex)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "work").json(path)


def read_segments(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, undecodable lines) of audit segments."""
    segment = F.regexp_extract("_metadata.file_path", "/segment=([^/]+)/", 1).alias("segment")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(segment, "value").where("trim(value) <> ''")
    rows = lines.select("segment", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("segment", "r.*")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("segment", "_bad")


def intents_csv(nodes: DataFrame) -> DataFrame:
    """Lines of a CSV file of intents, one a row: nodes has node_id and intents (array of structs). Lists are joined by |."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    rows = nodes.select("node_id", F.posexplode("intents").alias("place", "i"))
    text = lambda k: F.coalesce(F.concat_ws("|", f"i.{k}"), F.lit(""))
    cells = [F.col("node_id"), *(text(k) for k in INTENT_COLUMNS[1:])]
    return rows.select("node_id", "place", F.concat_ws(",", *map(quoted, cells)).alias("line"))


def read_intents(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """node_id and its intents of a CSV file with a header line; a missing column, or a node that nodes lacks, is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.removeprefix("﻿").strip() for c in rows.columns))
    if lost := [c for c in INTENT_COLUMNS if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")
    order = rows.withColumn("place", F.monotonically_increasing_id())
    if nodes is not None:
        known = order.join(nodes.select("node_id", F.lit(True).alias("known")).distinct(), "node_id", "left")
        order = known.withColumn("node_id", F.when(F.col("known"), F.col("node_id")).otherwise(F.raise_error(F.concat(F.lit("unknown node "), "node_id"))))
    cells = [parts(F.col(c)).alias(c) if c in ("patterns", "examples") else F.coalesce(c, F.lit("")).alias(c) for c in INTENT_COLUMNS[1:]]
    intents = F.transform(F.array_sort(F.collect_list(F.struct("place", *cells))), lambda x: F.struct(*(x[c].alias(c) for c in INTENT_COLUMNS[1:])))
    return order.groupBy("node_id").agg(intents.alias("intents"))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Summaries (tenant_id, created_at, session_id, ...) as Parquet, one folder a tenant and day."""
    summaries.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).write.mode("append").partitionBy("tenant_id", "day").parquet(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Each session's newest summary, whatever day it stands under: later writes replace earlier ones."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("day")))
    return spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("_k", rank).where("_k = 1").drop("_k")


def newest_summaries(rows: DataFrame, tenant_id: str, k: int) -> DataFrame:
    """A tenant's k newest summaries; only its folders are read."""
    return rows.where(F.col("tenant_id") == tenant_id).orderBy(F.desc("created_at"), "session_id").limit(k)


def unexpired(rows: DataFrame, today: Column, keep_days: int) -> DataFrame:
    """Rows whose day isn't before today less keep_days; 0 keeps all."""
    return rows.where(F.col("day") >= F.date_format(F.date_sub(today, keep_days), "yyyy-MM-dd")) if keep_days else rows


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(suite, metric, value) of a JSON file of suites."""
    rows = spark.read.option("multiLine", True).schema("suites map<string, map<string, double>>").json(path)
    return rows.select(F.explode("suites").alias("suite", "m")).select("suite", F.explode("m").alias("metric", "value"))
