"""Readers: each gives a DataFrame and leaves parsing to the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.text import attribute, attributes

GTF_SCHEMA = "chromosome string, source string, feature string, start int, end int, score string, strand string, frame string, attribute string"


def block_gzip_lines(spark: SparkSession, path: str, split_bytes: int | None = None, header: str | None = None) -> DataFrame:
    """(path, line) of block-gzipped files, ranges of which go to different tasks; with header, each file's first line that begins so."""
    from lociforge.sources.bgzip import BlockGzipLines

    spark.dataSource.register(BlockGzipLines)
    options = {"splitBytes": split_bytes, "header": header}
    return spark.read.format("block_gzip_lines").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def read_vcf(spark: SparkSession, path: str, partitions: int | None = None, block_gzip: bool | None = None, split_bytes: int | None = None) -> DataFrame:
    """Long genotypes (contig, pos, variant_id, alleles, sample_id, call) of VCF files: plain, gzipped or block-gzipped.

    Each file has its own header line with the names of its samples: its calls get these, whatever other files of the path
    hold. A line with another number of samples than its file's header is an error, as is a file without a header that has
    lines. Calls are taken from where each line's FORMAT says GT stands; a line without it gives null calls.
    block_gzip (true by default for paths that end in .bgz; set it for block-gzipped .gz files) reads ranges of
    split_bytes compressed bytes of each file in tasks of their own. A file in plain gzip is one task: `partitions` deals its
    lines out before they are parsed. One file's header is found by a scan that stops there, several files' by a scan over them.
    """
    blocks = path.endswith(".bgz") if block_gzip is None else block_gzip
    lines = block_gzip_lines(spark, path, split_bytes) if blocks else spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    heads = block_gzip_lines(spark, path, header="#CHROM") if blocks else lines.where(F.col("line").startswith("#CHROM"))
    if not blocks and len(lines.inputFiles()) == 1:
        heads = heads.limit(1)
    heads = heads.groupBy("path").agg(F.min("line").alias("line")).select("path", F.slice(F.split("line", "\t"), 10, F.size(F.split("line", "\t"))).alias("samples"))
    body = lines.where(~F.col("line").startswith("#") & (F.length("line") > 0))
    body = (body.repartition(partitions) if partitions else body).join(heads, "path", "left")
    f, n = F.split("line", "\t"), F.size("samples")
    lacks = F.raise_error(F.concat(F.lit("no #CHROM line in "), F.col("path"))).cast("array<string>")
    other = F.raise_error(F.format_string("a line of %d samples where the header names %d", F.size(f) - 9, n)).cast("array<string>")
    rows = body.select("samples", F.when(F.col("samples").isNull(), lacks).when((n > 0) & (F.size(f) != 9 + n), other).otherwise(f).alias("f"))
    alleles = F.concat(F.array(F.get("f", F.lit(3))), F.split(F.get("f", F.lit(4)), ","))
    called = F.arrays_zip("samples", F.slice("f", 10, n).alias("calls"))
    rows = rows.select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).cast("int").alias("pos"), alleles.alias("alleles"), F.array_position(F.split(F.get("f", F.lit(8)), ":"), "GT").cast("int").alias("at"), F.explode(called).alias("c"))
    call = F.when(F.col("at") > 0, F.get(F.split("c.calls", ":"), F.col("at") - 1))
    return rows.select("contig", "pos", F.concat_ws(":", "contig", F.col("pos").cast("string")).alias("variant_id"), "alleles", F.col("c.samples").alias("sample_id"), call.alias("call"))


def read_gtf(spark: SparkSession, path: str, keys: list[str] | None = None, contigs: list[str] | None = None) -> DataFrame:
    """Annotations: the nine columns and one for each attribute key. Without a list of keys, a scan finds them all."""
    rows = spark.read.schema(GTF_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    if contigs:
        rows = rows.where(F.col("chromosome").isin(contigs))
    if keys is None:
        found = rows.select(F.explode(attributes(F.col("attribute"))).alias("e")).select("e.key").distinct()
        keys = sorted(r.key for r in found.collect())
    return rows.select(*[F.col(c) for c in rows.columns if c != "attribute"], *[attribute(F.col("attribute"), k).alias(k) for k in keys])


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets (set, genes); the description is left out, as are empty genes."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(F.get(f, F.lit(0)).alias("set"), F.filter(F.slice(f, 3, F.size(f)), lambda g: g != "").alias("genes"))


def read_split_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tables in split orientation ({columns, index, data}), a file each; adds path. schema names the wanted columns with types.

    Columns are found by name in each file, so files may order them differently.
    """
    files = spark.read.schema("columns array<string>, data array<array<string>>").option("multiLine", True).json(path)
    rows = files.select(F.input_file_name().alias("path"), "columns", F.explode("data").alias("row"))
    fields = spark.createDataFrame([], schema).schema.fields
    value = lambda n: F.get("row", F.array_position("columns", n).cast("int") - 1)
    return rows.select("path", *[F.when(F.array_contains("columns", x.name), value(x.name)).try_cast(x.dataType).alias(x.name) for x in fields])


def read_table(spark: SparkSession, path: str, sheet: str | None = None, index: list[str] | None = None) -> DataFrame:
    """A table by its ending: csv, tsv, txt, xlsx sheets, parquet; another ending is an error.

    index names the columns (one or more) that tell rows apart: they come first, and rows that lack one of them are left out.
    """
    df = _table(spark, path, sheet)
    return df if not index else df.dropna(subset=index).select(*[F.col(f"`{c}`") for c in [*index, *[c for c in df.columns if c not in index]]])


def _table(spark: SparkSession, path: str, sheet: str | None) -> DataFrame:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if ending in ("tsv", "txt"):
        return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t").csv(path)
    if ending == "xlsx":
        from lociforge.sources.xlsx import read_xlsx

        return read_xlsx(spark, path, sheet)
    if ending == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for files ending in .{ending}")


def read_gene_set_json(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets (set, genes) of a JSON object that maps names to lists."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("set", "genes"))


def read_by_folder(spark: SparkSession, pattern: str, schema: str, **parts: str) -> DataFrame:
    """CSV files with a header under a path pattern; each of `parts` names a column and the regular expression whose group it takes from the path."""
    rows = spark.read.schema(schema).option("header", True).csv(pattern).withColumn("_path", F.col("_metadata.file_path"))
    return rows.withColumns({k: F.regexp_extract("_path", v, 1) for k, v in parts.items()}).drop("_path")


def select_samples(df: DataFrame, ids: list | DataFrame, columns: list[str] | None = None, key: str = "sample_id") -> DataFrame:
    """Rows of the given ids and the given columns: a list becomes a filter that Parquet scans push down, a table a semi join."""
    rows = df.join(ids.select(key).distinct(), key, "left_semi") if isinstance(ids, DataFrame) else df.where(F.col(key).isin(ids))
    return rows.select(key, *columns) if columns is not None else rows


def read_synonyms(spark: SparkSession, path: str, key: str, synonym: str, sep: str = "\t") -> DataFrame:
    """(key, synonyms) of a delimited export with a header: the distinct known names of each id, sorted; ids without any have none."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path).select(key, synonym).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.nullif(F.trim(synonym), F.lit("")))).alias("synonyms"))


def feature_count(spark: SparkSession, path: str, keys: int = 1) -> int:
    """How many columns a Parquet table has besides its keys: from the footers, no rows are read."""
    return len(spark.read.parquet(path).columns) - keys
