"""File sources: a tolerant bundle of CSV and XLSX tables, packed CSV, row locators, manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path, PurePath
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concordat.functions import kinds as K
from concordat.session import materialize

# Suffixes, encodings in the order they are tried, and separators.
SUFFIXES = (".xlsx", ".xlsm", ".csv")
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
SEPARATORS = ";,\t"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def stem_key(name: str) -> str:
    """A file stem without case, accents, blanks and punctuation."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]", "", plain)


def pick(names: Sequence[str], wanted: str) -> str | None:
    """Of a folder's file names: the wanted one, else the same stem with another suffix, else a stem that is alike."""
    stem, usable = PurePath(wanted).stem, sorted(n for n in names if PurePath(n).suffix.lower() in SUFFIXES and not n.startswith("."))
    tests = (lambda n: n == wanted, lambda n: PurePath(n).stem == stem, lambda n: stem_key(PurePath(n).stem) == stem_key(stem))
    return next((n for fits in tests for n in usable if fits(n)), None)


def listed(spark: SparkSession, folder: str | Path) -> list[str]:
    """Names of the files of a folder on any file system Spark can read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(folder))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isFile())


def resolve(folder: str | Path, wanted: str) -> Path | None:
    """The file of a local folder that pick() takes."""
    name = pick([p.name for p in Path(folder).iterdir()], wanted)
    return Path(folder) / name if name else None


def decoding(content: bytes) -> str:
    """The first of ENCODINGS that reads all of a file."""
    for encoding in ENCODINGS:
        try:
            content.decode(encoding)
        except UnicodeDecodeError:
            continue
        return encoding
    return ENCODINGS[-1]


def separator(text: str) -> str:
    """The separator most frequent in the first line that isn't blank; a comma where there is none."""
    line = next((x for x in text.splitlines() if x.strip()), "")
    best = max(SEPARATORS, key=line.count)
    return best if line.count(best) else ","


def sniff(content: bytes) -> tuple[str, str]:
    """(encoding, separator) of a whole CSV file."""
    encoding = decoding(content)
    return encoding, separator(content.decode(encoding))


def _described(spark: SparkSession, path: str) -> tuple[str, str, list[str]]:
    """(encoding, separator, column names) of a CSV file, found where it lies: one task reads all of it."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                encoding, sep = sniff(content)
                names = next(csv.reader(io.StringIO(content.decode(encoding), newline=""), delimiter=sep), [])
                yield pd.DataFrame({"encoding": [encoding], "sep": [sep], "names": [[n.strip() for n in names]]})

    r = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "encoding string, sep string, names array<string>").first()
    return r["encoding"], r["sep"], list(r["names"])


def read_csv(spark: SparkSession, path: str | Path, lines: bool = False) -> DataFrame:
    """All columns as text, "" as NULL, names stripped, `_row` = number of the record, the header being record 1. Blank lines
    count as lines but give no row. The encoding is the first of ENCODINGS that reads the whole file.

    Quoted fields may hold line breaks, so one task reads the file. With `lines`, each record is one line: the file is
    split over all tasks and its lines are numbered by counts per split.
    """
    path = str(path)
    encoding, sep, names = _described(spark, path)
    if lines:
        return _read_lines(spark, path, encoding, sep, names)
    schema = "`_row` int" + "".join(f", `{n}` string" for n in names)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                reader = csv.reader(io.StringIO(content.decode(encoding), newline=""), delimiter=sep)
                next(reader, None)
                rows = [[i, *[(x if x != "" else None) for x in (r + [None] * len(names))[: len(names)]]] for i, r in enumerate((r for r in reader if r), 2)]
                yield pd.DataFrame(rows, columns=["_row", *names]).astype({n: object for n in names})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _read_lines(spark: SparkSession, path: str, encoding: str, sep: str, names: Sequence[str]) -> DataFrame:
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    if encoding == "utf-8-sig":
        text = F.regexp_replace("value", "^\ufeff", "")
    else:  # Spark decodes Latin-1; the 27 other characters of Windows-1252 follow by a table
        text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
        if encoding == "cp1252":
            text = F.translate(text, "".join(map(chr, K.CP1252_BYTES)), K.CP1252_CHARS)
    kept = materialize(raw.select(text.alias("t"), "_b", "_i").where("t <> ''"), "lines")
    # a split lies in one task, whose ids rise along it
    per = kept.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("_o", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_o")  # one row a split
    numbered = kept.join(F.broadcast(before), "_b").withColumn("_row", (F.row_number().over(Window.partitionBy("_b").orderBy("_i")) + F.col("_o")).cast("int"))
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = F.from_csv("t", schema, {"sep": sep, "nullValue": "", "quote": '"', "escape": '"'})
    return numbered.where("_row > 1").select("_row", cells.alias("_p")).select("_row", "_p.*")


def xlsx_rows(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """Rows of a sheet as text, by the standard library only. sheet: name or position."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(f"{{{_NS['r']}}}id")) for s in book.find("m:sheets", _NS)]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    rid = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
    target = rels[rid].lstrip("/")
    target = target if target.startswith("xl/") else "xl/" + target
    for row in ElementTree.fromstring(z.read(target)).iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.findall("m:c", _NS)):
            ref = re.match(r"[A-Z]+", c.get("r") or "")
            at = k
            if ref:
                at = 0
                for ch in ref[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "s":
                text = shared[int(v.text)] if v is not None else None
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif kind == "b":
                text = {"1": "True", "0": "False"}.get(v.text) if v is not None else None
            else:
                text = v.text if v is not None else None
            cells[at] = text if text else None
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


@dataclass
class _Part(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path, self.sheet = options["path"], options.get("sheet", "0")

    def partitions(self):
        return [_Part(self.path)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            rows = xlsx_rows(f.read(), int(self.sheet) if self.sheet.isdigit() else self.sheet)
        header = [(h or "").strip() for h in next(rows, [])]
        at = [header.index(n) if n in header else None for n in self.names]
        for i, r in enumerate(rows, 2):
            if any(x is not None for x in r):
                yield tuple(i if n == "_row" else (r[k] if k is not None and k < len(r) else None) for n, k in zip(self.names, at))


class XlsxSource(DataSource):
    """spark.read.format("xlsx").option("sheet", 0).load(path): all columns as text, `_row` the spreadsheet's line."""

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        sheet = self.options.get("sheet", "0")
        with open(self.options["path"], "rb") as f:
            header = next(xlsx_rows(f.read(), int(sheet) if sheet.isdigit() else sheet), [])
        return "`_row` int" + "".join(f", `{(h or '').strip()}` string" for h in header)

    def reader(self, schema):
        return XlsxReader(schema, self.options)


def sheet_names(content: bytes) -> list[str]:
    book = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("xl/workbook.xml"))
    return [x.get("name") for x in book.find("m:sheets", _NS)]


def read_sheets(spark: SparkSession, path: str | Path, sheets: Sequence[str | int] | None = None) -> dict[str, DataFrame]:
    """Sheets of a workbook on any file system by name, all of them if none are named: columns as text, `_row` the
    spreadsheet's line."""
    file = spark.read.format("binaryFile").load(str(path)).select("content")

    def look(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                for i, name in enumerate(sheet_names(content)):
                    if sheets is None or i in sheets or name in sheets:
                        yield pd.DataFrame({"name": [name], "header": [[(h or "").strip() for h in next(xlsx_rows(content, name), [])]]})

    found = file.mapInPandas(look, "name string, header array<string>").collect()  # a row a sheet
    missing = [x for x in sheets or [] if isinstance(x, str) and x not in {r["name"] for r in found}]
    if missing:
        raise ValueError(f"{path}: no sheet {', '.join(missing)}")

    def rows(name: str, header: list[str]):
        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for b in batches:
                for content in b["content"]:
                    it = xlsx_rows(content, name)
                    next(it, None)
                    out = [[i, *(r + [None] * len(header))[: len(header)]] for i, r in enumerate(it, 2) if any(x is not None for x in r)]
                    yield pd.DataFrame(out, columns=["_row", *header]).astype({n: object for n in header})

        return run

    return {r["name"]: file.mapInPandas(rows(r["name"], list(r["header"])), "`_row` int" + "".join(f", `{h}` string" for h in r["header"])) for r in found}


def read_xlsx(spark: SparkSession, path: str | Path, sheet: str | int = 0) -> DataFrame:
    return next(iter(read_sheets(spark, path, [sheet]).values()))


def unpack(df: DataFrame) -> DataFrame:
    """A table of one column whose header holds commas is a packed CSV: each cell is parsed into the header's columns."""
    names = [c for c in df.columns if c != "_row"]
    if len(names) != 1 or "," not in names[0]:
        return df
    inner = [n.strip() for n in names[0].split(",")]
    schema = ", ".join(f"`{n}` string" for n in inner)
    parsed = F.from_csv(F.col(f"`{names[0]}`"), schema, {"sep": ",", "nullValue": ""})
    return df.select(*(["_row"] if "_row" in df.columns else []), parsed.alias("_p")).select(*(["_row"] if "_row" in df.columns else []), "_p.*")


def read_table(spark: SparkSession, path: str | Path, sheet: str | int = 0, lines: bool = False) -> DataFrame:
    return unpack(read_csv(spark, path, lines) if str(path).lower().endswith(".csv") else read_xlsx(spark, path, sheet))


def load_bundle(spark: SparkSession, folder: str | Path, tables: dict[str, dict]) -> dict[str, DataFrame]:
    """tables: name -> {file, columns (required), optional, sheet, lines}. All missing files and columns are reported
    together. The folder may lie on any file system."""
    out, bad, names = {}, [], listed(spark, folder)
    for name, t in tables.items():
        found = pick(names, t["file"])
        if found is None:
            if not t.get("optional"):
                bad.append(f"{name}: no file {t['file']}")
            continue
        df = read_table(spark, f"{folder}/{found}", t.get("sheet", 0), t.get("lines", False))
        gone = [c for c in t.get("columns", []) if c not in df.columns]
        if gone:
            bad.append(f"{name}: no columns {', '.join(gone)}")
        out[name] = df
    if bad:
        raise ValueError("\n".join(bad))
    return out


def digests(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(name, bytes, sha256) of every file of a folder."""
    b = spark.read.format("binaryFile").load(str(folder))
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_status(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(name, status): CONFORME, DIFFERENT, SANS (no entry) or ABSENT (no file) against manifest.json; a malformed
    manifest counts as none."""
    try:
        text = spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0]
        files = json.loads(text)["files"]
        entries = [(Path(f["path"]).name, f["sha256"].lower()) for f in files]
    except (AnalysisException, ValueError, KeyError, TypeError, AttributeError):
        entries = []
    m = spark.createDataFrame(entries, "name string, want string")
    have = digests(spark, folder).where("name <> 'manifest.json'")
    status = F.when(F.col("sha256").isNull(), "ABSENT").when(F.col("want").isNull(), "SANS").when(F.col("sha256") == F.col("want"), "CONFORME").otherwise("DIFFERENT")
    return have.join(m, "name", "full_outer").select("name", status.alias("status"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, status): INCHANGE, MODIFIE or ABSENT of the files of `before`."""
    a = after.select("name", F.col("sha256").alias("now"))
    return before.join(a, "name", "left").select("name", F.when(F.col("now").isNull(), "ABSENT").when(F.col("now") == F.col("sha256"), "INCHANGE").otherwise("MODIFIE").alias("status"))


def stage_upload(folder: str | Path, name: str, content: bytes) -> str:
    """Keep an uploaded file; only plain names with a known suffix. Returns its sha256."""
    if Path(name).name != name or name.startswith(".") or Path(name).suffix.lower() not in (*SUFFIXES, ".json", ".yaml"):
        raise ValueError(f"refused name {name!r}")
    (Path(folder) / name).write_bytes(content)
    return hashlib.sha256(content).hexdigest()
