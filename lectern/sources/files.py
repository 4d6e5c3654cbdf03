"""Files of any known format: routed by extension, bounded by size, imported into one library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..storage import written
from .epub import import_epub
from .html import import_html
from .kindle import import_kindle
from .markdown import import_markdown
from .model import Book, import_with, unnested
from .schema import Library
from .text import import_text

MIB = 1 << 20
# The extensions of each format and the largest file that is read.
FORMATS = {
    "text": (("txt", "text"), 32 * MIB), "markdown": (("md", "markdown"), 32 * MIB), "html": (("html", "htm", "xhtml"), 32 * MIB),
    "epub": (("epub",), 512 * MIB), "kindle": (("mobi", "azw3"), 128 * MIB),
}
IMPORTERS = {"html": import_html, "markdown": import_markdown, "epub": import_epub, "kindle": import_kindle}


#: Files that an importer's batch holds: they may be as large as their format's limit.
BATCH_FILES = 8
LARGEST = max(most for _, most in FORMATS.values())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``book_id, path, content, length`` of files. Contents are read only where they are asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("path", 256).alias("book_id"), "path", "content", "length")


def hashes(files: DataFrame) -> DataFrame:
    """``book_id, sha256`` of the contents of files that aren't too large to be read."""
    return files.filter(F.col("length") <= LARGEST).select("book_id", F.sha2("content", 256).alias("sha256"))


def routed(files: DataFrame) -> DataFrame:
    """``files`` with ``kind`` and a ``reason`` to reject: unknown types and files above their limit. Reads no content."""
    extension = ascii_lower(F.regexp_extract("path", r"\.([^./]*)\z", 1))
    limits = F.create_map(*[F.lit(x) for endings, most in FORMATS.values() for e in endings for x in (e, most)])
    kinds = F.create_map(*[F.lit(x) for name, (endings, _) in FORMATS.items() for e in endings for x in (e, name)])
    marked = files.withColumn("kind", F.element_at(kinds, extension)).withColumn("limit", F.element_at(limits, extension))
    unknown, large = F.concat(F.lit("files of type "), extension, F.lit(" are not read")), F.format_string("the file is larger than %d bytes", "limit")
    return marked.withColumn("reason", F.when(F.col("kind").isNull(), unknown).when(F.col("length") > F.col("limit"), large))


def import_any(path: str, content: bytes) -> Book:
    """The book of a file, by the importer of its extension."""
    extension = path.rsplit(".", 1)[-1].lower()
    return next(IMPORTERS[kind] for kind, (endings, _) in FORMATS.items() if extension in endings)(path, content)


def import_files(files: DataFrame) -> Library:
    """The library of ``files(book_id, path, content, length)``.

    Rejects come from names and lengths alone. The bound on the length is a plain comparison, which the source applies
    before it opens a file, so files that no batch could hold are never read. One pass hands all formats that need
    Python to their importers, a few files a batch; its rows are written.
    """
    spark = files.sparkSession
    rejected = routed(files.select("book_id", "path", "length")).filter("reason is not null").select("book_id", "path", "reason")
    good = routed(files.filter(F.col("length") <= LARGEST)).filter("reason is null")
    texts = import_text(good.filter("kind = 'text'").select("book_id", "path", F.try_validate_utf8(F.col("content")).alias("text")), keep=written)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_FILES))
    try:
        made = written(import_with(good.filter("kind <> 'text'"), import_any), "imported")
    finally:
        spark.conf.set(name, before)
    parsed = unnested(made)
    tables = {name: getattr(texts, name).unionByName(getattr(parsed, name)) for name in ("books", "sections", "blocks", "pages", "rejects")}
    return Library(**tables | {"rejects": tables["rejects"].unionByName(rejected)})
