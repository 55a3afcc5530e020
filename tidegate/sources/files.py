"""Corpora, lexicons, rules and manifests from files, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.operators.corpus import pool_of
from tidegate.operators.images import image_pool
from tidegate.sources import records

MANIFEST = "pool string, text string, category string, source string, image_path string"
IMAGES = "*.{png,jpg,jpeg,gif,webp,bmp,PNG,JPG,JPEG,GIF,WEBP,BMP}"


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Rows of which at least one cell isn't blank, of files in UTF-8 or GBK; columns are named as in the first file, or c0, c1 and so on."""
    if not header:
        rows = records.read_cells(spark, path)
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        return rows.select(*(F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(width)))
    top = records.read_cells(spark, path).orderBy("path", "record_no").limit(1).collect()
    names = [c.strip() for c in top[0]["cells"]] if top else []
    return records.read_table(spark, path, names).drop("path", "record_no")


def read_corpus(spark: SparkSession, path: str, text: str, category: str | None, source: str) -> DataFrame:
    """(text, category, source): trimmed texts that aren't blank; a missing category is empty. Files may be UTF-8 or GBK."""
    rows = records.read_table(spark, path, [text, *([category] if category else [])], required=(text,))
    kind = F.coalesce(F.trim(F.col(category)), F.lit("")) if category else F.lit("")
    return rows.select(F.trim(F.col(text)).alias("text"), kind.alias("category"), F.lit(source).alias("source")).where("text <> ''")


def read_corpora(spark: SparkSession, safe: list[tuple[str, str]] = (), violating: list[tuple[str, str, str | None]] = (), classed: list[tuple[str, str, str]] = (), normal: str = "normal") -> DataFrame:
    """(text, category, source, pool) of several corpora: the pool is white or black by the file, or by its rows' class.

    ``safe`` has (path, text column), ``violating`` (path, text column, category column or null), ``classed`` (path, text column,
    class column), whose class ``normal`` is white and all others black. The source is the file's name.
    """
    name = lambda path: path.rstrip("/").rsplit("/", 1)[-1]
    parts = [read_corpus(spark, p, t, None, name(p)).withColumn("pool", F.lit("white")) for p, t in safe]
    parts += [read_corpus(spark, p, t, c, name(p)).withColumn("pool", F.lit("black")) for p, t, c in violating]
    parts += [read_corpus(spark, p, t, c, name(p)).withColumn("pool", pool_of(F.col("category"), normal)) for p, t, c in classed]
    if not parts:
        return spark.createDataFrame([], "text string, category string, source string, pool string")
    return reduce(DataFrame.unionByName, parts)


def _stem():
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category, word): a word a line of *.txt files below the path, in UTF-8 or GBK, those beginning with # or // left out; the file's stem is the category."""
    rows = records.decoded_lines(spark, path, "*.txt")
    word = F.trim(F.col("line"))
    return rows.select(_stem().alias("category"), word.alias("word")).where((F.col("word") != "") & ~F.col("word").rlike("^(#|//)"))


def read_lexicon_csv(spark: SparkSession, path: str, word: str = "word", kind: str = "type") -> DataFrame:
    """(category, word) of *.csv files below the path, in UTF-8 or GBK; without a type the file's stem is the category."""
    rows = records.read_table(spark, path, [word, kind], "*.csv", required=(word,))
    own = F.coalesce(F.nullif(F.trim(F.col(kind)), F.lit("")), _stem())
    return rows.select(own.alias("category"), F.trim(F.col(word)).alias("word")).where("word <> ''")


def read_keyword_import(spark: SparkSession, path: str, header: tuple[str, ...] = ("category", "word", "keyword", "类别", "分类", "关键词")) -> DataFrame:
    """(category, word, source) of CSV files of two columns; a first filled row of a file that names columns is passed over."""
    cell = lambda k: F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    rows = records.read_cells(spark, path).select("path", "record_no", cell(0).alias("category"), cell(1).alias("word")).where("category <> '' AND word <> ''")
    tops = rows.groupBy("path").agg(F.min("record_no").alias("top"))
    named = F.lower("category").isin(*header) & F.lower("word").isin(*header)
    rows = rows.join(tops, "path").where((F.col("record_no") != F.col("top")) | ~named)
    return rows.select("category", "word", F.lit("admin_import").alias("source"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(category, pattern, action): rows with a pattern; an action that isn't given is exempt.

    JSON has an object a line or one list of objects; anything else in it, or an action that isn't violate or exempt, raises an error.
    """
    if path.rstrip("/").endswith((".json", ".jsonl")):
        lines = spark.read.option("multiLine", str(path.rstrip("/").endswith(".json")).lower()).json(path, schema="category string, pattern string, action string, _bad string", columnNameOfCorruptRecord="_bad")
        rows = lines.select("category", "action", F.when(F.col("_bad").isNull(), F.col("pattern")).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.col("_bad"))).cast("string")).alias("pattern"))
    else:
        rows = spark.read.csv(path, header=True)
    action = F.coalesce(F.nullif(F.lower(F.trim("action")), F.lit("")), F.lit("exempt"))
    action = F.when(action.isin("violate", "exempt"), action).otherwise(F.raise_error(F.concat(F.lit("not an action: "), action)).cast("string"))
    return rows.select(F.coalesce(F.trim("category"), F.lit("")).alias("category"), F.trim("pattern").alias("pattern"), action.alias("action")).where("pattern <> ''")


def read_keyword_lines(spark: SparkSession, path: str, category: str) -> DataFrame:
    """(category, word, source): a word a line of text files; blank lines and those beginning with # or // left out."""
    word = F.trim("value")
    return spark.read.text(path).select(F.lit(category).alias("category"), word.alias("word"), F.lit("admin_import").alias("source")).where((F.col("word") != "") & ~F.col("word").rlike("^(#|//)"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files in UTF-8 or GBK, numbered from 0 in each file."""
    return records.decoded_lines(spark, path).select("path", "line_no", "line")


def read_chats(spark: SparkSession, path: str, text: str = "content", sender: str = "sender", time: str = "time") -> DataFrame:
    """(text, sender, time) of group chats as CSV in UTF-8 or GBK: trimmed messages that aren't blank; a missing sender or time is null.

    Names of columns count in any case; a file without the column of messages raises an error.
    """
    rows = records.read_table(spark, path, [text, sender, time], required=(text,))
    return rows.select(F.trim(F.col(text)).alias("text"), F.nullif(F.trim(F.col(sender)), F.lit("")).alias("sender"), F.nullif(F.trim(F.col(time)), F.lit("")).alias("time")).where("text <> ''")


def read_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(line_no, pool, text, category, source, image_path): lines that are JSON objects, numbered from 1 in file order, blank lines counted.

    Files follow one another by path. Other lines are passed over, or with ``strict`` raise an error that names the line.
    """
    lines = records.decoded_lines(spark, path)
    per = lines.groupBy("path").agg(F.count("*").alias("n"))
    first = per.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = lines.where(F.trim("line") != "").join(first, "path").select((F.col("before") + F.col("line_no") + 1).alias("line_no"), "line")
    rows = rows.withColumn("x", F.from_json("line", f"{MANIFEST}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.coalesce(F.col("x").isNotNull() & F.col("x._corrupt").isNull() & F.trim("line").startswith("{"), F.lit(False))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": not a JSON object"))).cast("boolean")
        good = F.when(good, True).otherwise(wrong)
    return rows.where(good).select("line_no", "x.pool", "x.text", "x.category", "x.source", "x.image_path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, pool, length): image files below the path in order, with the pool that their folders name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGES).load(path)
    return files.select("path", image_pool(F.col("path")).alias("pool"), "length").where("pool IS NOT NULL").orderBy("path")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lexicon(words: DataFrame, path: str) -> None:
    """A folder of CSV for each category, its words in order."""
    words.select("category", "word").distinct().repartition("category").sortWithinPartitions("category", "word").write.mode("overwrite").partitionBy("category").csv(path, header=True)


def write_corpus(rows: DataFrame, path: str) -> None:
    rows.select("text", F.when(F.col("pool") == "white", 0).otherwise(1).alias("label"), "category", "source").write.mode("overwrite").csv(path, header=True, escape='"')


def save_pools(pools: DataFrame, path: str) -> None:
    pools.write.mode("overwrite").partitionBy("pool").parquet(path)


def load_pools(spark: SparkSession, path: str, dim: int | None = None, rows: dict[str, int] | None = None) -> DataFrame:
    """The pools as saved; vectors of another length than ``dim`` raise an error when they are read.

    With ``rows``, how many vectors each pool should have, pools that have another number raise one at once.
    """
    saved = spark.read.parquet(path)
    if rows is not None:
        found = {r["pool"]: r["n"] for r in saved.groupBy("pool").agg(F.count("*").alias("n")).collect()}
        if found != rows:
            raise ValueError(f"pools of {found} vectors, not {rows}")
    if dim is None:
        return saved
    wrong = F.raise_error(F.lit(f"a vector has not {dim} components")).cast("array<float>")
    return saved.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong))


def write_log_export(logs: DataFrame, path: str) -> None:
    """The nine columns of a log as CSV with a header, each file beginning with a UTF-8 mark so that spreadsheets read it as such."""
    from tidegate.operators.logs import export

    rows = export(logs)
    first, *rest = rows.columns
    rows.select(*(F.col(c).alias("\ufeff" + c if c == first else c) for c in (first, *rest))).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)
