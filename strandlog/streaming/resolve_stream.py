"""State kept up to date from a stream of ops.

Last-writer-wins by position doesn't depend on arrival order, so each micro-batch is appended to the log and only
what it touches is resolved again from its whole history: late ops change what they should. Touched are the batch's ids
and the reified entities of relations with these ids; to judge a reified entity, the relations that claim it count, too. Value refs
go by slot: touched are all refs that were ever bound to a slot of the batch, and to judge these, all slots they were
bound to. Tables are Parquet folders: `log`, `state` (entities with values, relations with fields) and `refs` (the
reverse index: a ref's slot), by batch; the newest batch of an id is its state. A batch that runs again overwrites its own
folders, so the result is exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlog import model as M
from strandlog.operators import resolve as R

SLOT = ["space", "entity", "property", "language", "slot_space"]


class LiveState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, schema=None) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.path}/{name}")
        return (read.schema(schema) if schema else read).parquet(f"{self.path}/{name}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        batch.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        log = self.table("log", batch.schema).drop("batch")
        new = self.spark.read.schema(batch.schema).parquet(f"{self.path}/log/batch={batch_id}")
        created = log.where(F.col("op_type") == M.CREATE_RELATION).select("space", "id", R.reified_id().alias("entity"))
        given = new.select(*R.KEY).distinct()
        touched = given.union(created.join(given, R.KEY, "left_semi").select("space", F.col("entity").alias("id"))).distinct()
        claiming = created.join(touched.withColumnRenamed("id", "entity"), ["space", "entity"], "left_semi").select(*R.KEY)
        state = R.State(log.join(touched.union(claiming).distinct(), R.KEY, "left_semi"))
        values = state.values_all.groupBy(*R.KEY).agg(F.collect_list(F.struct("property", "language", "value", "set_at")).alias("values"))
        fields = [c for c in state.relations_all.columns if c not in (*R.KEY, "status")]
        relations = state.relations_all.select(*R.KEY, F.struct(*fields).alias("relation"))
        # an id that exists no more, as its relation's id turned out to be another's, stays as a row without a kind
        out = touched.join(state.objects, R.KEY, "left").join(values, R.KEY, "left").join(relations, R.KEY, "left")
        out.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
        self.update_refs(log, new).write.mode("overwrite").parquet(f"{self.path}/refs/batch={batch_id}")

    def update_refs(self, log: DataFrame, new: DataFrame) -> DataFrame:
        """The bindings (space, ref_id, slot) of all refs that the batch can have changed; without a slot, null."""

        def bound(ops: DataFrame) -> DataFrame:
            refs = ops.where(F.col("op_type") == M.CREATE_VALUE_REF)
            return refs.withColumns({"entity": F.col("value_ref.entity"), "property": F.col("value_ref.property"), "language": F.col("value_ref.language"), "slot_space": F.coalesce(F.col("value_ref.space").cast(refs.schema["space"].dataType), F.col("space"))})

        def within(ops: DataFrame, slots: DataFrame) -> DataFrame:
            s = slots.select(*(F.col(c).alias(f"_{c}") for c in SLOT)).distinct()
            same = F.lit(True)
            for c in SLOT:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            return ops.join(s, same, "left_semi")

        every = bound(log)
        refs = within(every, bound(new)).select(*R.KEY).distinct()
        # another claim of a ref's id may have come late and owns it now, so a touched id counts as well
        refs = refs.union(every.join(new.select(*R.KEY), R.KEY, "left_semi").select(*R.KEY)).distinct()
        ops = within(every, every.join(refs, R.KEY, "left_semi"))
        state = R.State(log.join(ops.select(*R.KEY).distinct(), R.KEY, "left_semi"))
        found = state.value_refs.withColumnRenamed("ref_id", "id")
        return refs.join(found, R.KEY, "left")

    def start(self, ops: DataFrame, **trigger):
        """ops: a streaming DataFrame of the op schema."""
        return ops.writeStream.foreachBatch(self.update).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def newest(self, name: str) -> DataFrame:
        last = F.row_number().over(Window.partitionBy(*R.KEY).orderBy(F.desc("batch")))
        return self.table(name).withColumn("last", last).where("last = 1").drop("last", "batch")

    def state(self) -> DataFrame:
        """(space, id, kind, created, status, values, relation)."""
        return self.newest("state").where("kind IS NOT NULL")

    def value_refs(self) -> DataFrame:
        """The reverse index: (space, ref_id, entity, property, language, slot_space)."""
        return self.newest("refs").where("entity IS NOT NULL").withColumnRenamed("id", "ref_id")
