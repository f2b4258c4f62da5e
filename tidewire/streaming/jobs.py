"""Running streams: sinks that survive a replay, side outputs, live rollups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.decode import decode_frames, ip_packets, quarantine_malformed
from tidewire.operators import enrich
from tidewire.operators.boosting import BoostedTrees
from tidewire.operators.features import arp_flows
from tidewire.operators.metrics import finish_sums, window_sums
from tidewire.operators.ml_models import flow_verdict
from tidewire.operators.ml_prep import BASE_FEATURES, log_clip, prepare
from tidewire.operators.sessionize import FlowRules
from tidewire.session import materialize
from tidewire.sources.readers import envelope_packets
from tidewire.sources.sinks import write_flows
from tidewire.streaming import sessions
from tidewire.streaming.commits import read_batches, write_once

PARTITIONS = "spark.sql.shuffle.partitions"
STORES_PER_CORE = 2


def overwrite_parquet(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


@contextmanager
def few_stores(spark: SparkSession) -> Iterator[None]:
    """A stream that begins in here keeps its state in at most ``STORES_PER_CORE`` parts per core.

    Every part is a store and a Python worker that each batch opens, however few keys it has. The number is written in
    the checkpoint: later starts keep it."""
    parts = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(parts), STORES_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, parts)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  write: Callable[[DataFrame, str], None] = overwrite_parquet) -> StreamingQuery:
    """Process all input there is, each batch written once, and stop."""
    with few_stores(stream.sparkSession):  # a stream copies the settings when it starts
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write_once(write, path)).start()
        )
    query.awaitTermination()
    return query


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """Number of the last finished batch of a stream, from its checkpoint."""
    files = spark.read.format("binaryFile").load(f"{checkpoint}/commits").select(
        F.regexp_extract("path", r"/(\d+)$", 1).alias("n")).where("n <> ''")
    return files.agg(F.max(F.col("n").cast("int"))).first()[0]


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key among updates written batch by batch."""
    rows = read_batches(spark, path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def stream_packets(records: DataFrame) -> DataFrame:
    """Decoded IP packets of an envelope stream."""
    return ip_packets(decode_frames(envelope_packets(records)))


def split_malformed(good_path: str, bad_path: str) -> Callable[[DataFrame, int], None]:
    """A batch function with a side output for malformed frames. A batch is decoded once for both."""
    def run(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_frames(batch).persist()
        try:
            good, bad = quarantine_malformed(decoded)
            write_once(overwrite_parquet, good_path)(good.drop("frame"), batch_id)
            write_once(overwrite_parquet, bad_path)(bad, batch_id)
        finally:
            decoded.unpersist()
    return run


def write_metric_sums(window: str = "1 second") -> Callable[[DataFrame, str], None]:
    """A store for a stream of samples: each batch leaves its sums per window.

    ``read_metrics`` adds them up. No window is ever closed and none is kept in state, so a sample counts
    however late it comes."""
    def write(batch: DataFrame, path: str) -> None:
        overwrite_parquet(window_sums(batch, window), path)
    return write


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows per window of all batches stored so far."""
    return finish_sums(read_batches(spark, path).drop("batch_id"))


def stream_rollup(flows: DataFrame, *keys: str) -> DataFrame:
    """Counts per key, kept live."""
    return flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("flows"))


def enrich_and_score(tables: dict[str, DataFrame], score: Callable[[DataFrame], DataFrame],
                     store: Callable[[DataFrame, str], None] = overwrite_parquet) -> Callable[[DataFrame, str], None]:
    """Enrich a batch of closed flows, label it and ``store`` it.

    ``score`` adds ``probability``, null for a flow it cannot judge: that flow alone reads UNKNOWN, and a flow
    without facts N/A. Any other failure, of a task, a table or the store, fails the batch, which is then replayed:
    no flow is stored with less than it should have. The address ranges are made ready once, not for every batch."""
    ready: dict[str, enrich.Prefixes] = {}

    def write(batch: DataFrame, path: str) -> None:
        for name, value in (("geo", "country"), ("asn", "org")):
            if name not in ready:
                ready[name] = enrich.prefixes(tables[name], value)
        facts = enrich.enrich_flows(batch, ready["geo"], ready["asn"], tables["rdns"], tables["whois"])
        scored = score(facts)
        store(scored.withColumn("label", flow_verdict(F.col("probability"), F.col("protocol"))), path)
    return write


def closed_flows(records: DataFrame, rules: FlowRules, lateness_ms: int = 0) -> DataFrame:
    """Envelope records of a stream to flows: those that close, with their features, and every ARP frame as one."""
    decoded = decode_frames(envelope_packets(records))
    flows = sessions.state_to_flows(sessions.stream_sessionize(ip_packets(decoded), rules, lateness_ms))
    arp = arp_flows(decoded).withColumnRenamed("packet_id", "first_packet_id").drop("label")
    return flows.unionByName(arp, allowMissingColumns=True)


def judged_flows(tables: dict[str, DataFrame], model: BoostedTrees) -> Callable[[DataFrame, str], None]:
    """A store of a batch of flows, enriched and labelled, in the published columns.

    The batch is written down first: it is used several times, and its flows come out of the state once."""
    enriched = enrich_and_score(tables, by_model(model), partial(write_flows, mode="overwrite"))
    return lambda batch, path: enriched(materialize(batch, "closed"), path)


def flush_live(spark: SparkSession, checkpoint: str, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """After the end of input: the flows that are still live go the way of the closed ones, as a batch of their own."""
    live = sessions.state_to_flows(sessions.live_flows(spark, checkpoint))
    write_once(write, path)(live, last_batch(spark, checkpoint) + 1)


def by_model(model: BoostedTrees) -> Callable[[DataFrame], DataFrame]:
    """Scores by a fitted model, on features prepared as for its fit; a flow that lacks one of the published base
    features has none."""
    def score(rows: DataFrame) -> DataFrame:
        known = [F.col(c).isNotNull() for c in BASE_FEATURES if c in rows.columns]
        whole = reduce(and_, known, F.lit(True))
        judged = log_clip(prepare(rows.withColumns({"__whole": whole, "__row": F.struct(*[f"`{c}`" for c in rows.columns])})))
        probability = F.when(F.col("__whole"), model.probability(*[F.col(c) for c in model.columns]))
        return judged.select("__row.*", probability.alias("probability"))
    return score
