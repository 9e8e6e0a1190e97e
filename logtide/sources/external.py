"""Files outside the stored streams, to be joined with them."""

from pyspark.sql import DataFrame, SparkSession

_BY_ENDING = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}


def external(spark: SparkSession, path: str, schema: str | None = None, kind: str | None = None, **options: str) -> DataFrame:
    """Rows of a file, folder or pattern that Spark can reach; ``kind`` by the ending, compression endings aside.

    CSV has a header line. Without ``schema`` the types of CSV and JSON are inferred, which reads the files once more.
    """
    if kind is None:
        parts = [p for p in path.rstrip("/").lower().rsplit("/", 1)[-1].split(".") if p not in ("gz", "bz2", "zst", "zstd", "snappy")]
        kind = _BY_ENDING.get(parts[-1])
        if kind is None:
            raise ValueError(f"say what kind of file {path} is")
    if kind == "csv":
        options = {"header": "true", "inferSchema": "false" if schema else "true"} | ({"sep": "\t"} if path.lower().split(".")[-1] == "tsv" else {}) | options
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
