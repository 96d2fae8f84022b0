"""File trees: listing filters, charset decoding and per-file errors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsentry.functions.text import extension, megabytes
from textsentry.schemas import FILE_SCHEMA
from textsentry.sources.listing import list_files

# Tried on content that is not UTF-8, in this order.
DEFAULT_CHARSETS = ("GB18030",)

# Byte order marks as hex digits, and what follows them.
_MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
# How the names of charsets with one byte a character start.
_ONE_BYTE = ("ISO-8859-", "WINDOWS-125", "KOI8-", "CP125", "IBM8")
_REPLACEMENT = "�"
_DECODE_SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def exclude_extensions(files: DataFrame, extensions: list[str], path_col: str = "path") -> DataFrame:
    """Drop paths with any of the extensions; the leading dot is optional, case does not count."""
    wanted = [("." + e.strip().lstrip(".")).lower() for e in extensions if e.strip()]
    return files.where(~extension(F.col(path_col)).isin(wanted)) if wanted else files


def exclude_paths(files: DataFrame, words: list[str], path_col: str = "path") -> DataFrame:
    """Drop paths holding any of the words."""
    for word in words:
        if word:
            files = files.where(~F.contains(F.col(path_col), F.lit(word)))
    return files


def limit_size(files: DataFrame, limit_mb: float, size: Column | None = None) -> DataFrame:
    """Drop entries above ``limit_mb``; zero keeps all."""
    if limit_mb <= 0:
        return files
    return files.where((F.col("length") if size is None else size) <= megabytes(limit_mb))


def size_errors(
    files: DataFrame, id_cols: list[str], limit_mb: float, size: Column | None = None
) -> DataFrame:
    """One row for every entry :func:`limit_size` drops."""
    above = (F.col("length") if size is None else size) > megabytes(limit_mb)
    rows = files.where(above if limit_mb > 0 else F.lit(False))
    return rows.select(*id_cols, F.lit("is above the size limit").alias("error"))


def read_files(
    spark: SparkSession,
    path: str,
    *,
    exclude_ext: list[str] | None = None,
    exclude_path: list[str] | None = None,
    limit_mb: float = 0,
) -> DataFrame:
    """All files below ``path`` as binaryFile rows; the size limit is pushed into the listing.

    Spark's file source never yields a row for an empty file; :func:`listing_errors` reports those.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(FILE_SCHEMA.fieldNames())
    )
    files = limit_size(files, limit_mb)
    return exclude_paths(exclude_extensions(files, exclude_ext or []), exclude_path or [])


def listing_errors(
    spark: SparkSession, path: str, *, exclude_ext: list[str] | None = None, exclude_path: list[str] | None = None
) -> DataFrame:
    """``path, error`` of empty files and of folders that cannot be listed."""
    listed = exclude_paths(exclude_extensions(list_files(spark, path), exclude_ext or []), exclude_path or [])
    error = F.coalesce("error", F.when(F.col("length") == 0, "is empty"))
    return listed.select("path", error.alias("error")).where("error IS NOT NULL")


def require_files(files: DataFrame) -> DataFrame:
    """Raise when no file is left to scan."""
    if files.select("path").isEmpty():
        raise ValueError("no files to scan")
    return files


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Let expressions built inside use any Java charset and mark bad bytes with U+FFFD.

    Spark reads both settings when it analyses the expression, so they are put
    back right after.
    """
    before = {key: spark.conf.get(key) for key in _DECODE_SETTINGS}
    for key in _DECODE_SETTINGS:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _guess_utf16(files: DataFrame, content: Column) -> DataFrame:
    """Add ``__guess`` and ``__guessed``: name and text of UTF-16 without a mark, null where bytes do not look like it.

    Text in UTF-16 has zero bytes, be it for line ends and blanks only, all on one
    side of their units. Both readings are made where there is a zero byte; the one
    with more ASCII letters, signs and blanks is taken if it is sound and holds no
    zero character. Bytes that are valid UTF-8 must read as control characters there
    by a quarter at least, as in plain text a stray zero byte is no second charset.
    """
    zero = F.contains(content, F.lit(b"\x00")) & (F.octet_length(content) % 2 == 0)
    plain = F.try_validate_utf8(content.cast("string"))
    controls = F.regexp_count(plain, F.lit(r"[\x00-\x08\x0E-\x1F]"))
    likely = F.when(zero, plain.isNull() | (4 * controls >= F.octet_length(content)))

    def ascii_count(column: str) -> Column:
        return F.regexp_count(column, F.lit(r"[\t\n\r -~]"))

    # Step by step, so that no reading is made twice.
    tried = files.withColumn("__likely", F.coalesce(likely, F.lit(False)))
    tried = tried.withColumns({f"__{x}": F.when(F.col("__likely"), F.decode(content, f"UTF-16{x}")) for x in ("LE", "BE")})
    tried = tried.withColumn("__lead", ascii_count("__LE") - ascii_count("__BE"))
    tried = tried.withColumn("__read", F.when(F.col("__lead") > 0, F.col("__LE")).when(F.col("__lead") < 0, F.col("__BE")))
    sound = ~F.contains("__read", F.lit(_REPLACEMENT)) & ~F.contains("__read", F.lit("\x00"))
    tried = tried.withColumn("__guessed", F.when(sound, F.col("__read")))
    name = F.when(F.col("__guessed").isNotNull(), F.when(F.col("__lead") > 0, "UTF-16LE").otherwise("UTF-16BE"))
    return tried.withColumn("__guess", name).drop("__likely", "__LE", "__BE", "__lead", "__read")


def _single_bytes(content: Column) -> Column:
    """Whether bytes above 127 mostly stand alone, as accented letters of a one-byte charset do.

    In multi-byte charsets they come in pairs.
    """
    letters = F.decode(content, "ISO-8859-1")
    alone = F.regexp_count(letters, F.lit("(?<![\x80-\xff])[\x80-\xff](?![\x80-\xff])"))
    return alone > F.regexp_count(letters, F.lit("[\x80-\xff]{2}"))


def _one_byte(charset: str) -> bool:
    return charset.upper().startswith(_ONE_BYTE)


def decode_text(
    files: DataFrame,
    content_col: str = "content",
    charsets: tuple[str, ...] = DEFAULT_CHARSETS,
) -> DataFrame:
    """Add ``text`` and ``charset``: by the byte order mark if there is one, else UTF-16 if the bytes
    look like it (:func:`_guess_utf16`), else UTF-8 when valid, else the first charset that fits, else
    null. Where bytes above 127 mostly stand alone, charsets of one byte a character are tried before
    the others. The mark is not part of the text.
    """
    content = F.col(content_col)
    with java_charsets(files.sparkSession):
        mark = F.hex(F.substring(content, 1, 3))
        named = F.lit(None).cast("string")
        marked = F.lit(None).cast("string")
        for digits, name in _MARKS.items():
            body = F.substring(content, len(digits) // 2 + 1, 2**31 - 1)
            here = mark.startswith(digits)
            named = F.when(here, name).otherwise(named)
            marked = F.when(here, F.decode(body, name)).otherwise(marked)
        out = files.withColumn("__mark", named).withColumn("__marked", marked)
        out = _guess_utf16(out, F.when(F.col("__mark").isNull(), content))
        sound = F.when(~F.contains("__marked", F.lit(_REPLACEMENT)), F.col("__marked"))
        plain = F.when(F.col("__mark").isNull(), F.try_validate_utf8(content.cast("string")))
        out = out.withColumn("__utf8", F.coalesce(sound, "__guessed", plain))
        charset = F.when(F.col("__utf8").isNotNull(), F.coalesce("__mark", "__guess", F.lit("UTF-8")))
        # Each charset once, or, if both kinds are listed, twice: one-byte charsets first where they are likely.
        chain = [(name, F.lit(True)) for name in charsets]
        if len({_one_byte(name) for name in charsets}) > 1:
            first = F.when(F.col("__utf8").isNull(), _single_bytes(content))
            out = out.withColumn("__first", F.coalesce(first, F.lit(False)))
            chain = [(name, F.col("__first")) for name in charsets if _one_byte(name)] + chain
        text = F.col("__utf8")
        for i, (name, when) in enumerate(chain):
            out = out.withColumn(f"__text{i}", F.when(text.isNull() & when, F.decode(content, name)))
            decoded = F.when(~F.contains(f"__text{i}", F.lit(_REPLACEMENT)), F.col(f"__text{i}"))
            charset = F.coalesce(charset, F.when(decoded.isNotNull(), name))
            text = F.coalesce(text, decoded)
        # Exploded, so that a test of the text does not move the whole decoding into a filter.
        read = F.explode_outer(F.array(F.struct(text.alias("text"), charset.alias("charset"))))
        return out.select(*files.columns, read.alias("__read")).select(*files.columns, "__read.text", "__read.charset")


def scan_errors(decoded: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Entries that cannot be scanned, one row each with the reason."""
    text = F.col(text_col)
    error = F.when(text.isNull(), "cannot be decoded").when(F.octet_length(text) == 0, "is empty")
    return decoded.select(*id_cols, error.alias("error")).where(F.col("error").isNotNull())


def scannable(decoded: DataFrame, text_col: str = "text") -> DataFrame:
    """Entries left after :func:`scan_errors`."""
    return decoded.where(F.octet_length(text_col) > 0)
