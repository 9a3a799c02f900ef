"""Reading and writing of records, pairs and graphs."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.operators.ranks import with_position

#: Column names taken for the text and for the id, in any case.
TEXT_NAMES = ("affil1", "affiliation", "affil", "text", "affil_clean", "affiliation_text", "name")
ID_NAMES = ("id1", "id", "record_id", "row_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, infer: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header line. Without a schema all columns are text; infer reads the files once more for their types.

    multi_line lets fields span lines, and then a file can't be split: use it only where fields do.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)


def read_headerless_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("src", "cand")) -> DataFrame:
    """Two columns without a header line, as a gold mapping comes."""
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).option("header", False).csv(path)


def read_first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the CSV files that exists, in any store that Spark reads."""
    for path in paths:
        try:
            return read_csv(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, each with the header, in place of what was there."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def detect_columns(columns: list[str], text_col: str | None = None, id_col: str | None = None) -> tuple[str, str]:
    """(text, id): what is given, else the first column of a known name, else the first for the text and the second for the id."""
    if not columns:
        raise ValueError("a table without columns has no text")

    def first(names: tuple[str, ...], other: str) -> str:
        return next((c for c in columns if c.lower() in names), other)

    return text_col or first(TEXT_NAMES, columns[0]), id_col or first(ID_NAMES, columns[min(1, len(columns) - 1)])


def filled_text(c: Column | str) -> Column:
    """Text with null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def as_records(df: DataFrame, text_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(id1, affil1), one row per id: of repeated ids the greatest text stays."""
    text, key = detect_columns(df.columns, text_col, id_col)
    return df.select(F.col(key).alias("id1"), filled_text(text).alias("affil1")).groupBy("id1").agg(F.max("affil1").alias("affil1"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of any length: the whole documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id1"), filled_text("text").alias("affil1"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records: the whole turns of the conversations. id1 holds the conversation and, in its last four digits, the turn."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).cast("long").alias("id1"), filled_text("text").alias("affil1"))


def profile(records: DataFrame, text_col: str = "affil1") -> DataFrame:
    """One row: records, columns, records without text, least text."""
    return records.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(records.columns)).cast("long").alias("n_cols"),
        F.sum((F.trim(text_col) == "").cast("long")).alias("n_blank"),
        F.min(text_col).alias("first_text"),
    )


def _attribute(c: str) -> Column:
    """A value in quotes, as XML has it."""
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, at, line): the nodes (id, ...) and edges (u, v, weight) of a GEXF file, in the order of part and at."""
    extra = [c for c in nodes.columns if c != "id"]
    values = [F.concat(F.lit(f'<attvalue for="{i}" value='), _attribute(c), F.lit("/>")) for i, c in enumerate(extra)]
    node = F.concat(F.lit("<node id="), _attribute("id"), F.lit(" label="), _attribute("id"), F.lit("><attvalues>"), *values, F.lit("</attvalues></node>"))
    edge = F.concat(F.lit("<edge id="), _attribute("at"), F.lit(" source="), _attribute("u"), F.lit(" target="), _attribute("v"), F.lit(" weight="), _attribute("weight"), F.lit("/>"))
    placed = [with_position(nodes, "id", name="at").select(F.lit(1).alias("part"), "at", node.alias("line")), with_position(edges, "u", "v", name="at").select(F.lit(3).alias("part"), "at", edge.alias("line"))]
    titles = "".join(f'<attribute id="{i}" title={quoteattr(c)} type="string"/>' for i, c in enumerate(extra))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="undirected">\n<attributes class="node">' + titles + "</attributes>\n<nodes>"
    frame = nodes.sparkSession.createDataFrame([(0, 0, head), (2, 0, "</nodes>\n<edges>"), (4, 0, "</edges>\n</graph>\n</gexf>")], "part int, at long, line string")
    return placed[0].unionByName(placed[1]).unionByName(frame)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GEXF for graph viewers, one file in any store that Spark writes: the lines are written by the executors, and their files put one after another."""
    spark = nodes.sparkSession
    parts = f"{path}.parts"
    gexf_lines(nodes, edges).orderBy("part", "at").select("line").write.mode("overwrite").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path
    store = file(parts).getFileSystem(conf)
    out = store.create(file(path), True)
    for status in sorted(store.listStatus(file(parts)), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().startswith("part-"):
            stream = store.open(status.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    out.close()
    store.delete(file(parts), True)
