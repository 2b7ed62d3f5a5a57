"""The engine: tables by name, statements of the dialect, and what the shell offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .dialect import parse
from .dialect.tokens import DialectError
from .harness import Measure, measure
from .plans import lower
from .sources import CsvResult, read_arrow, read_csv, spans_lines


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the shell."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillon")
    base = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Engine:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or local_session()
        self.names: list[str] = []

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        if name not in self.names:
            self.names.append(name)
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self.names and not self.spark.catalog.tableExists(name):
            raise DialectError(f"no table {name}")
        return self.spark.table(name)

    def load_parquet(self, path: str, name: str) -> DataFrame:
        return self.register(name, self.spark.read.parquet(path))

    def load_arrow(self, path: str, name: str) -> DataFrame:
        return self.register(name, read_arrow(self.spark, path))

    def load_csv(self, path: str, name: str, schema: T.StructType | None = None, **options) -> CsvResult:
        """Without a schema, the header names the columns and their types are inferred (int, bigint,
        double, string)."""
        if options.get("multi_line") is None:
            options["multi_line"] = spans_lines(self.spark, path, options.get("quote", '"'))
        if schema is None:
            seen = self.spark.read.csv(path, header=True, inferSchema=True, sep=options.get("delimiter", ","), quote=options.get("quote", '"'), escape=options.get("quote", '"'), multiLine=options["multi_line"], ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).schema
            known = (T.IntegerType, T.LongType, T.DoubleType, T.StringType)
            schema = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, known) else T.StringType()) for f in seen])
        result = read_csv(self.spark, path, schema, **options)
        self.register(name, result.rows)
        return result

    def sql(self, statement: str) -> DataFrame:
        """The DataFrame of a SELECT or ASOF statement."""
        return lower(parse(statement), self.table)

    def explain(self, statement: str, mode: str = "formatted") -> str:
        """The statement's clauses and Spark's plan."""
        q = parse(statement)
        df = lower(q, self.table)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return f"{q}\n\n{plan}"

    def bench(self, statement: str, warm_up: int = 5, runs: int = 10) -> Measure:
        df = self.sql(statement)
        return measure(lambda: df.write.format("noop").mode("overwrite").save(), statement, warm_up, runs)

    def tables(self) -> list[tuple[str, int, list[str]]]:
        """Name, rows and columns of each registered table."""
        return [(n, self.spark.table(n).count(), self.spark.table(n).columns) for n in self.names]

    def devices(self) -> dict[str, str]:
        sc = self.spark.sparkContext
        return {"master": sc.master, "parallelism": str(sc.defaultParallelism), "executors": str(sc._jsc.sc().getExecutorMemoryStatus().size()), "spark": sc.version}
