"""Files to spans: text in several encodings, office documents, paragraphs; the registry of parsers by extension."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.files import extension
from brindle.functions.text import strip
from brindle.sources.html import page_rows

ENCODINGS = ("utf-8", "latin-1", "cp1252")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SPANS = "path string, ordinal int, type string, level int, href string, text string, span_start long, span_end long"


def decode(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text in the first encoding that reads it, with line ends as ``\\n``; UTF-16 by its byte order mark only."""
    for e in ("utf-16",) * content.startswith((b"\xff\xfe", b"\xfe\xff")) + encodings:
        try:
            return content.decode(e).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding reads the content")


def text_rows(content: bytes) -> list[tuple]:
    return [("text", None, None, decode(content))]


def html_rows(content: bytes) -> list[tuple]:
    return page_rows(decode(content, ("utf-8", "latin-1")))


def docx_rows(content: bytes) -> list[tuple]:
    """All paragraphs outside of tables, then all table rows with their cells joined by `` | ``; blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    join = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    rows = [("paragraph", None, None, join(p).strip()) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        for tr in table.findall(f"{_W}tr"):
            cells = ["\n".join(join(p) for p in tc.findall(f"{_W}p")).strip() for tc in tr.findall(f"{_W}tc")]
            rows.append(("table_row", None, None, " | ".join(c for c in cells if c)))
    return [r for r in rows if r[3]]


def json_rows(content: bytes) -> list[tuple]:
    """A list gives a span per element, anything else one span; strings as they are, the rest as JSON with sorted keys."""
    whole = json.loads(decode(content))
    text = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)
    return [("json", None, None, text(x)) for x in (whole if isinstance(whole, list) else [whole]) if text(x)]


@dataclass(frozen=True)
class Parser:
    name: str
    extensions: tuple[str, ...]
    rows: Callable[[bytes], list[tuple]]
    #: Signs between two texts in the offsets.
    gap: int = 0
    #: A content that the parser must read, for health checks.
    sample: bytes = b"<p>test</p>"


@dataclass
class Registry:
    """Parsers by name and extension; registering is all or nothing."""

    parsers: dict[str, Parser] = field(default_factory=dict)

    def register(self, parser: Parser) -> None:
        new = [self._key(e) for e in parser.extensions]
        taken = {e for p in self.parsers.values() for e in map(self._key, p.extensions)}
        if parser.name in self.parsers or taken & set(new) or len(set(new)) < len(new):
            raise ValueError(f"{parser.name}: the name or an extension is taken")
        self.parsers[parser.name] = parser

    def unregister(self, name: str) -> None:
        del self.parsers[name]

    @staticmethod
    def _key(ext: str) -> str:
        return ("" if ext.startswith(".") else ".") + ext.lower()

    def get(self, ext: str) -> Parser | None:
        key = self._key(ext)
        return next((p for p in self.parsers.values() if key in map(self._key, p.extensions)), None)

    def health(self) -> dict[str, bool]:
        """Whether each parser reads its sample; one that raises isn't healthy."""

        def reads(p: Parser) -> bool:
            try:
                return len(p.rows(p.sample)) > 0
            except Exception:
                return False

        return {name: reads(p) for name, p in self.parsers.items()}

    def extensions(self) -> list[str]:
        return sorted(self._key(e) for p in self.parsers.values() for e in p.extensions)


def _sample_docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body><w:p><w:t>test</w:t></w:p></w:body></w:document>')
    return out.getvalue()


def default_registry() -> Registry:
    r = Registry()
    r.register(Parser("text", (".txt", ".md", ".csv", ".log"), text_rows))
    r.register(Parser("html", (".html", ".htm"), html_rows, gap=1))
    r.register(Parser("docx", (".docx",), docx_rows, sample=_sample_docx()))
    r.register(Parser("json", (".json",), json_rows, sample=b"[1]"))
    return r


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, content`` of files, folders read to any depth; Spark lists no files of zero length."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def parse_files(files: DataFrame, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans of the files that a parser knows, and ``path, error`` of the others and of those that can't be read."""
    registry = registry or default_registry()
    known = files.withColumn("ext", extension(F.col("path")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPANS.split(", ")] + ["error"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for path, content, ext in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "ext"))):
                parser, offset = registry.get(ext) if ext else None, 0
                try:
                    if parser is None:
                        raise ValueError("no parser")
                    rows = [(path, n, *r) for n, r in enumerate(parser.rows(content))]
                except Exception as e:
                    for column, x in zip(out, (path, *[None] * 7, str(e) or type(e).__name__)):
                        column.append(x)
                    continue
                for *start, text in rows:
                    for column, x in zip(out, (*start, text, offset, offset + len(text), None)):
                        column.append(x)
                    offset += len(text) + parser.gap
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    parsed = known.mapInArrow(parse, SPANS + ", error string")
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null").select("path", "error")


def text_paragraphs(files: DataFrame) -> DataFrame:
    """``path, ordinal, text``: UTF-8 files cut at blank lines; blank paragraphs are left out."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    rows = files.select("path", F.posexplode(F.split(text, "\n\n")).alias("ordinal", "text"))
    return rows.select("path", "ordinal", strip("text").alias("text")).filter("text <> ''")


def uploads(rows: DataFrame, name: str, content: str) -> tuple[DataFrame, DataFrame]:
    """``path, content`` of files sent as base 64, and ``path, error`` of those that can't be decoded or have no name."""
    read = rows.select(F.col(name).alias("path"), F.try_to_binary(F.col(content), F.lit("base64")).alias("content"))
    good = F.col("path").isNotNull() & F.col("content").isNotNull()
    return read.filter(good), read.filter(~good).select("path", F.when(F.col("path").isNull(), "no name").otherwise("not base 64").alias("error"))


def download_tasks(spark: SparkSession, path: str, known: tuple[str, ...] = ("http", "ftp", "local", "s3", "sftp")) -> tuple[DataFrame, DataFrame]:
    """``source_id, source_type, address`` of JSON files that hold lists of ``{id, type, source}``, and the entries of an unknown type."""
    rows = spark.read.schema("id string, type string, source string").option("multiLine", True).json(path)
    tasks = rows.select("id", F.lower("type").alias("source_type"), F.col("source").alias("address"))
    tasks = tasks.select(F.coalesce("id", F.concat(F.lit("source_"), F.substring(F.sha2(F.col("address"), 256), 1, 16))).alias("source_id"), "source_type", "address")
    good = F.coalesce(F.col("source_type").isin(*known), F.lit(False)) & F.col("address").isNotNull()
    return tasks.filter(good), tasks.filter(~good)
