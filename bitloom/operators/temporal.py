"""Fault histories over rounds: accumulated errors, measured syndromes, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.codes import CHECKS_18, LOGICALS_18

#: Check rows that the three-round histories keep (fixed values).
KEPT = (0, 1, 2, 5, 6, 7, 8)
ROUNDS, QUBITS = 3, 18


def rounds(histories: DataFrame) -> DataFrame:
    """(idx, t, f, m) for rounds 1-3 and a perfect last one: data faults and measurement faults of each, as masks.

    A history's places a and b are 0-53 (data, 18 for each round) and 54-74 (measurements, 7 for each round).
    """
    t = F.explode(F.sequence(F.lit(1), F.lit(ROUNDS + 1)))
    r = histories.select("idx", "a", "b", t.alias("t"))
    one = F.lit(1).cast("long")
    power = lambda n: F.call_function("shiftleft", one, n.cast("int"))
    data = lambda p: F.when((p >= (F.col("t") - 1) * QUBITS) & (p < F.least(F.col("t"), F.lit(ROUNDS)) * QUBITS), power(p - (F.col("t") - 1) * QUBITS)).otherwise(F.lit(0).cast("long"))
    start = ROUNDS * QUBITS + (F.col("t") - 1) * len(KEPT)
    read = lambda p: F.when((F.col("t") <= ROUNDS) & (p >= start) & (p < start + len(KEPT)), power(p - start)).otherwise(F.lit(0).cast("long"))
    a, b = F.coalesce("a", F.lit(-1)), F.coalesce("b", F.lit(-1))
    return r.select("idx", "t", data(a).bitwiseXOR(data(b)).alias("f"), read(a).bitwiseXOR(read(b)).alias("m"))


def detectors(histories: DataFrame) -> DataFrame:
    """(idx, detectors, terminal): running XOR of faults, syndromes with read errors, change from round to round."""
    w = Window.partitionBy("idx").orderBy("t")
    r = rounds(histories).withColumn("e", F.bit_xor("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("y", bits.syndrome("e", [CHECKS_18[i] for i in KEPT]).bitwiseXOR(F.col("m")))
    r = r.withColumn("d", F.col("y").bitwiseXOR(F.coalesce(F.lag("y").over(w), F.lit(0).cast("long"))))
    packed = F.sum(F.col("d") * F.element_at(F.array(*[F.lit(1 << 7 * i).cast("long") for i in range(ROUNDS + 1)]), F.col("t")))
    return r.groupBy("idx").agg(packed.alias("detectors"), F.max_by("e", "t").alias("terminal"))


def fibers(found: DataFrame) -> DataFrame:
    """For each detector vector its histories and the different logical classes among them."""
    label = F.struct(bits.syndrome("terminal", CHECKS_18).alias("s"), bits.syndrome("terminal", LOGICALS_18).alias("l"))
    return found.groupBy("detectors").agg(F.count("*").alias("histories"), F.count_distinct(label).alias("classes"))


def chained_digest(records: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """(stream, digest): a digest chained over the ordered records of each stream.

    Streams are sorted within tasks and folded as they pass, so a stream of any length takes constant memory.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        now, digest = None, ""
        for b in batches:
            done = []
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != now:
                    if now is not None:
                        done.append((now, digest))
                    now, digest = s, ""
                digest = hashlib.sha256((digest + (t or "")).encode()).hexdigest()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], b.schema.field(0).type), pa.array([x for _, x in done])], [stream, "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field(0).type), pa.array([digest])], [stream, "digest"])

    kind = records.schema[stream].dataType.simpleString()
    ordered = records.where(f"{stream} is not null").select(stream, text, order).repartition(stream).sortWithinPartitions(stream, order)
    return ordered.select(stream, text).mapInArrow(run, f"{stream} {kind}, digest string")
