"""Pages of search results as a data source of Spark: a folder of JSON lines, each a page with its results.

Folders are named by the month in which results were posted (posted_month=2001-05, or none). Every file is a partition. Filters on
whole values (naics, type, set_aside, is_active) are applied while pages are read; dates, which only choose folders, stay with
Spark as residual filters. An option posted_from or posted_to also chooses folders, but keeps that of undated results.

Files are read by pyarrow's file systems, so the path can be any URI that these know.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.search import has_all_terms, within

SCHEMA = "notice_id string, title string, naics string, set_aside string, type string, is_active boolean, posted date, page int"
_RESULT = pa.struct([("notice_id", pa.string()), ("title", pa.string()), ("naics", pa.string()), ("set_aside", pa.string()), ("type", pa.string()), ("is_active", pa.bool_()), ("posted", pa.string())])
_WHOLE = ("naics", "type", "set_aside", "is_active")
#: Results of a page, and of a search at most.
PAGE, MOST = 100, 100
FORMAT = "notice_pages"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    where, root = _system(path)
    infos = where.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(i.path for i in infos if i.is_file and i.size and not i.base_name.startswith(("_", ".")))


def _month(path: str) -> str:
    return next((part.split("=", 1)[1] for part in path.split("/") if part.startswith("posted_month=")), "none")


class NoticePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.equal: list[tuple[str, tuple]] = []
        self.present: list[str] = []
        self.first, self.last, self.dated = options.get("posted_from", "")[:7], options.get("posted_to", "9999-99")[:7], False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on whole values; what is left to Spark is returned."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _WHOLE and isinstance(f, IsNotNull):
                self.present.append(column)
                continue
            if column in _WHOLE and isinstance(f, (EqualTo, In)):
                self.equal.append((column, tuple(f.value) if isinstance(f, In) else (f.value,)))
                continue
            if column == "posted" and isinstance(getattr(f, "value", None), (date, datetime)):
                month = f.value.isoformat()[:7]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first, self.dated = max(self.first, month), True
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last, self.dated = min(self.last, month), True
            yield f

    def partitions(self) -> list[InputPartition]:
        wanted = lambda m: not self.dated if m == "none" else self.first <= m <= self.last
        return [InputPartition(f) for f in _files(self.path) if wanted(_month(f))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        how = json.ParseOptions(explicit_schema=pa.schema([("page", pa.int32()), ("results", pa.list_(_RESULT))]), unexpected_field_behavior="ignore")
        with _system(self.path)[0].open_input_stream(partition.value) as stream:
            for batch in json.open_json(stream, read_options=json.ReadOptions(block_size=4 << 20), parse_options=how):
                results = batch.column("results")
                columns = dict(zip(_RESULT.names, results.flatten().flatten()))
                columns |= {"posted": columns["posted"].cast(pa.date32()), "page": batch.column("page").take(pc.list_parent_indices(results))}
                out = pa.RecordBatch.from_pydict(columns)
                for column in self.present:
                    out = out.filter(out.column(column).is_valid())
                for column, values in self.equal:
                    out = out.filter(pc.is_in(out.column(column), pa.array(values, out.column(column).type)))
                yield out


def written(notices: DataFrame, path: str, page: int = PAGE) -> None:
    """Writes notices (the columns of SCHEMA but page) as pages of `page` results, in folders by month."""
    month = F.coalesce(F.date_format("posted", "yyyy-MM"), F.lit("none"))
    fields = [F.col("posted").cast("string").alias("posted") if n == "posted" else F.col(n) for n in _RESULT.names]
    dealt = notices.withColumn("posted_month", month)
    n = F.count("*").over(Window.partitionBy("posted_month"))
    dealt = dealt.withColumn("page", F.pmod(F.xxhash64("notice_id"), F.ceil(n / page)).cast("int"))
    pages = dealt.groupBy("posted_month", "page").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("results"))
    pages.select("posted_month", F.to_json(F.struct("page", "results")).alias("value")).write.partitionBy("posted_month").text(path)


def pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The results in a folder of pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NoticePages)
    return spark.read.format(FORMAT).options(path=path, **options).load()


def search(spark: SparkSession, path: str, query: str, *, naics: list[str] | None = None, posted_from: date | None = None, posted_to: date | None = None, limit: int = 25, active_only: bool = True) -> DataFrame:
    """The newest results whose title has all words of the query, at most 100: industries and activity are asked of the source, the window of
    dates is residual and keeps undated results."""
    first, last = posted_from or date.min, posted_to or date.max
    options = {k: v.isoformat() for k, v in (("posted_from", posted_from), ("posted_to", posted_to)) if v}
    found = pages(spark, path, **options)
    if active_only:
        found = found.where(F.col("is_active") == F.lit(True))
    if naics:
        found = found.where(F.col("naics").isin(*naics))
    if posted_from or posted_to:
        found = found.where(within(F.col("posted"), F.lit(first), F.lit(last)))
    return found.where(has_all_terms(F.col("title"), F.lit(query))).orderBy(F.desc("posted"), "notice_id").limit(max(1, min(limit, MOST)))
