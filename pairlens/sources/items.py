"""Item tables from the driver's tables, and readers and writers for manifests, vectors and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record: what every item table has; ``content`` is optional.
RECORD = T.StructType(
    [
        T.StructField("item", T.LongType(), False),
        T.StructField("subject", T.LongType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("condition", T.StringType(), False),
        T.StructField("split", T.StringType(), False),
    ]
)
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_items(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """(item, subject, category, condition, split, vec, norm) from ``embeddings``; subjects belong to one split."""
    from pairlens.functions.vectors import norm

    raw = table(spark, sf_dir, "embeddings")
    items = raw.select(
        F.col("vec_id").alias("item"),
        (F.col("vec_id") % 25).alias("subject"),
        F.col("label").cast("long").alias("category"),
        F.floor(F.col("vec_id") / 250).alias("condition"),
        F.when(F.col("vec_id") % 25 < 8, "calibration").otherwise("evaluation").alias("split"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    if split:
        items = items.where(F.col("split") == split)
    return items.withColumn("norm", norm("vec", DIM))


def proxy_items(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """``vector_items`` with ``proxy``, a second view of the same items from another table: seven measurements of the order of that number."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(*((F.avg(F.col(c).cast("double")) / by).alias(c) for c, by in (("l_quantity", 50), ("l_extendedprice", 1e5), ("l_discount", 0.1), ("l_tax", 0.1), ("l_linenumber", 7))), (F.count("*") / 7).alias("lines"))
    total = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_totalprice").cast("double") / 5e5).alias("total"))
    views = total.join(lines, "item", "left").select("item", F.array("total", *(F.coalesce(c, F.lit(0.0)) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "lines"))).alias("proxy"))
    return vector_items(spark, sf_dir, split).join(views, "item")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, subject, category, condition, split, value) from ``orders``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("condition"),
        F.when(F.col("o_custkey") % 5 == 0, "calibration").otherwise("evaluation").alias("split"),
        F.col("o_totalprice").cast("double").alias("value"),
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, subject, category, content, target) from ``documents`` and ``labels``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("subject"), F.col("lang").alias("category"), F.sha2("text", 256).alias("content"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("toxic").alias("target"))
    return docs.join(labels, "item", "left")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a text file, each line split once at blanks; lines of one field are left out; the last line of a key wins."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    parts = lines.select(F.split("line", r"\s+", 2).alias("p"), "at").where(F.size("p") == 2)
    return parts.groupBy(F.col("p")[0].alias("key")).agg(F.max_by(F.col("p")[1], "at").alias("value"))


def optional(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, bool]:
    """(table, present): an absent Parquet source gives an empty table and False."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    return (spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)), there


def manifest(spark: SparkSession, path: str, field: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON manifest, {"<field>": [rows]} or a bare list of rows."""
    whole = T.StructType([T.StructField(field, T.ArrayType(schema))])
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
    rows = F.when(F.col("j").startswith("["), F.from_json("j", T.ArrayType(schema))).otherwise(F.from_json("j", whole)[field])
    return text.select(F.explode(rows).alias("r")).select("r.*")


def union_by_model(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet files of one shape, one per model, with the column ``model_name``."""
    frames = [spark.read.parquet(p).withColumn("model_name", F.lit(m)) for m, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def task_records(files: DataFrame, subjects: DataFrame, categories: DataFrame, early: DataFrame, late: DataFrame, transcripts: DataFrame | None = None, discourse: DataFrame | None = None) -> DataFrame:
    """(item, path, subject, category, early_condition, late_condition[, content][, discourse]) of the key-value tables of one task, as ``corpus`` takes them: every file
    with the subject, category and condition of its key, the condition from the table of its phase. Raises if a file lacks one of these, or a transcript or discourse
    where such a table is given; with several incomplete files the least is named."""
    from pairlens.operators.validate import Rejected

    named = lambda f, name: f.select(F.col("key").alias("item"), F.col("value").alias(name))
    rows = named(files, "path")
    asked = [(subjects, "subject"), (categories, "category"), (early, "early_condition"), (late, "late_condition")]
    asked += [(t, n) for t, n in ((transcripts, "transcript"), (discourse, "discourse")) if t is not None]
    for other, name in asked:
        rows = rows.join(named(other, name), "item", "left")
    is_late = F.col("path").contains("/phase2/")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    tests = {"subject": blank(F.col("subject")), "category": blank(F.col("category")), "condition": blank(F.when(is_late, F.col("late_condition")).otherwise(F.col("early_condition")))}
    tests |= {n: F.col(n).isNull() for _, n in asked[4:]}
    lacking = F.coalesce(*(F.when(t, F.lit(n)) for n, t in tests.items()))
    if (bad := rows.where(lacking.isNotNull()).agg(F.min(F.struct("item", lacking.alias("what"))).alias("b")).first()["b"]) is not None:
        raise Rejected(f"{bad['item']} has no {bad['what']}")
    if transcripts is not None:
        from pairlens.functions.text import content_hash

        rows = rows.withColumn("content", content_hash(F.col("transcript"))).drop("transcript")
    return rows


def corpus(tasks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Records of several tasks, task -> (its joined rows, split); a phase's condition is the later phase's where the path says so."""
    out = None
    for name, (rows, split) in sorted(tasks.items()):
        late = F.col("path").contains("/phase2/")
        one = rows.withColumn("condition", F.when(late, F.col("late_condition")).otherwise(F.col("early_condition"))).withColumn("split", F.lit(split)).withColumn("task", F.lit(name)).drop("late_condition", "early_condition")
        out = one if out is None else out.unionByName(one)
    return out


def write_json(frame: DataFrame, path: str) -> None:
    """The committer renames finished files into place, so a reader sees all or nothing."""
    frame.write.mode("overwrite").json(path)


def missing_cells(grid: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The cells of ``grid`` that the store at ``path`` does not hold yet."""
    done, there = optional(spark, path, T.StructType([f for f in grid.schema if f.name in keys]))
    return grid.join(done.select(*keys).distinct(), keys, "left_anti") if there else grid


def write_cells(cells: DataFrame, path: str, keys: list[str]) -> None:
    cells.write.mode("append").partitionBy(*keys).parquet(path)


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def record_hash(columns: list[str]) -> F.Column:
    """SHA-256 of the row as compact JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def json_field(column: str, path: str) -> F.Column:
    """The value at a path such as ``models[0].references[0].name`` of a JSON text, as text; null where the path ends early."""
    return F.get_json_object(column, f"$.{path}")


def list_digest(frame: DataFrame, column: str) -> DataFrame:
    """One row: the digest of the sorted values joined by newlines. The values are digests of a manifest, of fixed width."""
    return frame.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), "\n"), 256).alias("digest"))


def last_per_key(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return frame.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
