"""What cores did over the last samples: as a plan over stored samples, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Samples of a window (fixed value).
SAMPLES = 600
SUMS = ("gas_used", "da_load", "imports", "extrinsic_count", "extrinsic_size")
_STATE = "slot long, popularity long, " + ", ".join(f"{n} long" for n in SUMS)
WINDOW = "source string, core_index int, " + ", ".join(f"{n} long" for n in SUMS) + ", popularity_avg double, active_blocks long, window_blocks long, last_active_slot long"


def core_window(samples: DataFrame, blocks: int = SAMPLES) -> DataFrame:
    """Sums and activity by source and core over the last ``blocks`` samples (source, arrival, slot, core_index, what the core did).

    A sample of the slot that the one before it had does not count; a core is active in a sample with gas, popularity or load.
    Of every core's samples the window sorts those that a partial limit left.
    """
    by = Window.partitionBy("source", "core_index")
    new = samples.withColumn("_before", F.lag("slot").over(by.orderBy("arrival", "slot"))).where("_before IS NULL OR slot <> _before")
    last = new.withColumn("_age", F.row_number().over(by.orderBy(F.desc("arrival"), F.desc("slot")))).where(F.col("_age") <= blocks)
    active = (F.col("gas_used") > 0) | (F.col("popularity") > 0) | (F.col("da_load") > 0)
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n)
    return last.groupBy("source", "core_index").agg(
        *map(total, SUMS),
        F.coalesce(F.avg(F.when(active, F.col("popularity"))), F.lit(0.0)).alias("popularity_avg"),
        F.count_if(active).alias("active_blocks"),
        F.count(F.lit(1)).alias("window_blocks"),
        F.coalesce(F.max_by("slot", F.when(active, F.struct("arrival", "slot"))), F.lit(0)).alias("last_active_slot"),
    )


class _Window(StatefulProcessor):
    """The state of a core is its last samples; each batch of them adds to the list, drops what is too old, and tells the sums."""

    def __init__(self, blocks: int):
        self.blocks = blocks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["slot", "popularity", *SUMS]
        held = [tuple(row) for row in self.samples.get()]
        came = pd.concat(rows).sort_values(["arrival", "slot"])
        for row in came[names].fillna(0).astype("int64").itertuples(index=False, name=None):
            if not held or held[-1][0] != row[0]:
                held.append(row)
        held = held[-self.blocks :]
        self.samples.put(held)
        frame = pd.DataFrame(held, columns=names)
        active = frame[(frame["gas_used"] > 0) | (frame["popularity"] > 0) | (frame["da_load"] > 0)]
        told = {"source": key[0], "core_index": key[1], **{n: int(frame[n].sum()) for n in SUMS}}
        told |= {"popularity_avg": float(active["popularity"].mean()) if len(active) else 0.0, "active_blocks": len(active), "window_blocks": len(frame), "last_active_slot": int(active["slot"].iloc[-1]) if len(active) else 0}
        yield pd.DataFrame([told])

    def close(self) -> None:
        pass


def core_window_stream(samples: DataFrame, blocks: int = SAMPLES) -> DataFrame:
    """The same on a stream of samples: after each micro-batch the rows of the cores that it had.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), so a core's samples need not fit in memory with all others'.
    """
    kinds = {n: "long" for n in ("arrival", "slot", "popularity", *SUMS)}
    typed = samples.select("source", F.col("core_index").cast("int").alias("core_index"), *(F.col(n).cast(k).alias(n) for n, k in kinds.items()))
    return typed.groupBy("source", "core_index").transformWithStateInPandas(_Window(blocks), outputStructType=WINDOW, outputMode="Update", timeMode="None")
