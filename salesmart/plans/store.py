"""Staged sets that are written once and found again, by any session.

A set is known by its filter and by the files its tables are read from: path, length and
time of change of each. With the same of both, a session reads the staged set and no line
table; with another filter or a changed file it stages anew, beside what is there.

The set is written first, partitioned by month, and its entry last: one without an entry
is not there, so a writer that is lost leaves nothing to be found. Of two writers at a
time each leaves a whole set, and either is read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesmart.functions.dates import month_of
from salesmart.operators.filters import SalesFilter
from salesmart.operators.staging import staged_sales
from salesmart.sources.model import SalesModel
from salesmart.sources.shared import exists, input_files

MONTH = "staged_month"


@dataclass(frozen=True)
class StagedSets:
    """The sets below a folder that all sessions share."""

    folder: str

    def key(self, model: SalesModel, flt: SalesFilter) -> str:
        """What a set is known by. Runs no job."""
        frames = [f for f in (model.invoice, model.line, model.item, model.homes) if f is not None]
        files = sorted({f for frame in frames for f in input_files(frame)})
        dates = flt.dates and [flt.dates.month_aligned().start.isoformat(), flt.dates.month_aligned().end.isoformat()]
        chosen = [sorted(set(flt.countries)), sorted(set(flt.genres)), sorted(set(flt.artists)), dates]
        plans = [frame.schema.simpleString() for frame in frames]
        return hashlib.sha256(json.dumps([chosen, plans, files]).encode()).hexdigest()

    def find(self, spark: SparkSession, key: str) -> DataFrame | None:
        """The set of a key, if it is there."""
        if not exists(spark, self._entry(key)):
            return None
        told = json.loads(spark.read.text(self._entry(key)).first()[0])
        return spark.read.schema(StructType.fromJson(told["schema"])).parquet(told["path"])

    def staged(self, model: SalesModel, flt: SalesFilter) -> DataFrame:
        """The staged set with its line totals and its month: found, or made and written."""
        spark, key = model.invoice.sparkSession, self.key(model, flt)
        found = self.find(spark, key)
        if found is not None:
            return found
        path = f"{self.folder.rstrip('/')}/sets/{key}-{uuid.uuid4().hex}"
        rows = staged_sales(model, flt).withColumn(MONTH, month_of("dt"))
        # A month may hold much: as many tasks write it as hold rows of it.
        rows.write.partitionBy(MONTH).parquet(path)
        entry = json.dumps({"path": path, "schema": json.loads(rows.schema.json())})
        spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("overwrite").text(self._entry(key))
        return self.find(spark, key)

    def _entry(self, key: str) -> str:
        return f"{self.folder.rstrip('/')}/entries/{key}"
