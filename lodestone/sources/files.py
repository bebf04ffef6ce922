"""Directories as tables: scan, statistics, changes since an earlier scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import predicates as P
from ..operators.changes import compare

#: First bytes, in hexadecimal form, of formats that are not text: pictures, documents,
#: archives, programs, sound, databases.
MAGIC = """89504E47 FFD8FF 47494638 49492A00 4D4D002A 00000100 25504446 D0CF11E0 504B0304 504B0506 504B0708 1F8B 425A68 FD377A585A00 377ABCAF271C 526172211A07 28B52FFD
7F454C46 4D5A9000 CAFEBABE CFFAEDFE FEEDFACE FEEDFACF 0061736D 52494646 494433 4F676753 664C6143 53514C69746520666F726D6174203300 50415231""".split()
#: Extensions of such files.
BINARY = """png jpg jpeg gif bmp ico tif tiff webp pdf doc docx xls xlsx ppt pptx zip gz tgz bz2 xz 7z rar zst tar jar war exe dll so dylib o a lib class pyc wasm mp3 mp4 avi mov mkv wav flac ogg
ttf otf woff woff2 eot db sqlite sqlite3 parquet bin dat""".split()
#: Files of more bytes are left out.
MOST_BYTES = 512_000


def scan(spark: SparkSession, root: str, ignore: str = "", most_bytes: int | None = MOST_BYTES, hidden: bool = False) -> DataFrame:
    """``path, name, extension, language, size, modified, hash, is_binary, text`` of every
    file below ``root``. ``ignore`` holds rules as in an ignore file, the last match wins.
    Spark lists the files and reads each in a task; sizes are judged before the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rows = files.withColumn("path", F.substring(path, F.length(base) + 2, F.length(path)))
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    rules = P.ignore_rules(ignore)
    if rules:
        rows = rows.where(~P.is_ignored(F.col("path"), rules))
    head = F.substring(F.col("content"), 1, 1024)
    is_binary = looks_binary(head, T.extension(F.col("path")))
    return rows.select(
        "path", T.base_name(F.col("path")).alias("name"), T.extension(F.col("path")).alias("extension"), T.language(F.col("path")).alias("language"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), is_binary.alias("is_binary"), F.when(~is_binary, F.col("content").cast("string")).alias("text"),
    )


def looks_binary(head: Column, extension: Column | None = None) -> Column:
    """By the extension, by the first bytes of known formats, or by their kinds: too many
    zeros or control characters, or bad UTF-8 with many high bytes. Shares are taken from
    the hexadecimal form, so no Python runs."""
    digits = F.hex(head)
    n = F.greatest(F.octet_length(head), F.lit(1))
    share = lambda pattern: F.size(F.filter(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda b: b.rlike(pattern))) / n
    broken = F.is_valid_utf8(head.cast("string")) == F.lit(False)
    known = digits.rlike("^(?:" + "|".join(MAGIC) + ")")
    if extension is not None:
        known = extension.isin(BINARY) | known
    return F.coalesce(known | (share("^00$") > 0.001) | (share("^(0[1-8BCEF]|1.)$") > 0.03) | ((share("^[89A-F].$") > 0.1) & broken), F.lit(False))


def statistics(files: DataFrame) -> DataFrame:
    """``language, files, bytes`` and, in the row of a null language, the whole."""
    return files.rollup("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def largest(files: DataFrame, k: int = 10) -> DataFrame:
    return files.select("path", "size").orderBy(F.desc("size"), "path").limit(k)


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that ``known`` (path, hash) lacks or has with another hash."""
    return compare(known, files, "path").where("change in ('added', 'modified')")


def file_groups(files: DataFrame, path_col: str = "path", size_col: str = "size") -> DataFrame:
    """``grp, n, total_size, mean_size, complexity, languages, priority, millis`` of groups of
    files by language, most urgent first: small and simple groups come before others, the
    time grows with size, complexity and the slowest language. A file without a size (null)
    has 0; paths that are null go. One partial aggregate a task, a row a group."""
    lang, size = T.language(F.col(path_col)), F.coalesce(F.col(size_col), F.lit(0))
    rows = files.where(F.col(path_col).isNotNull()).select(lang.alias("lang"), size.cast("long").alias("size"))
    rows = rows.select(T.language_group(F.col("lang")).alias("grp"), "lang", "size", T.file_complexity(F.col("lang"), F.col("size")).alias("c"))
    held = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"), F.avg("size").alias("mean_size"), F.avg("c").alias("_c"), F.sort_array(F.collect_set("lang")).alias("languages"))
    held = held.withColumn("complexity", F.round("_c", 6))
    simple = F.when(F.col("complexity") <= 0.3, 20).when(F.col("complexity") <= 0.7, 10).otherwise(0)
    small = F.when(F.col("mean_size") <= 50 * 1024, 15).when(F.col("mean_size") <= 100 * 1024, 5).otherwise(0)
    priority = F.least(F.lit(100), 50 + T.lookup(T.GROUP_PRIORITY, F.col("grp"), 0) + simple + small)
    slowest = F.array_max(F.concat(F.array(F.lit(1.0)), F.transform("languages", lambda x: T.lookup(T.LANGUAGE_TIME, x, 1.0))))
    millis = F.round(F.col("total_size") / 1024 * 10 * (1 + F.col("_c")) * slowest).cast("long")
    return held.select("*", priority.cast("int").alias("priority"), millis.alias("millis")).drop("_c").orderBy(F.desc("priority"), "grp")
