"""ST1: online scoring as a stateless Structured Streaming job.

Applications land as files; ``readStream`` with a declared schema picks them
up, each micro-batch is scored by the same column expressions as the batch
job (template overrides inlined as literals, features, PD, tier, policy), and
results are appended to a Parquet sink. The checkpoint location lives in the
shared checkpoint folder, so a restarted query resumes exactly where it
stopped; the job keeps no state, so there is no watermark to manage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pdforge.operators import scoring as SC
from pdforge.session import scratch_path


def scoring_stream(spark: SparkSession, source_dir: str, template, schema=SC.APPLICATION_SCHEMA,
                   max_files_per_trigger: int = 1000, pd_fn=None) -> DataFrame:
    """Streaming DataFrame of scored applications read from ``source_dir``; ``pd_fn`` gives the PD column of a model."""
    t = template if isinstance(template, dict) else template.first().asDict()  # one template row
    apps = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))
    return SC.score_applications(apps, t, pd_fn)


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, template,
                  available_now: bool = True, **kw):
    """Start the stream into a Parquet sink (append)."""
    q = (scoring_stream(spark, source_dir, template, **kw).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def score_application_files(spark: SparkSession, apps: DataFrame, template, pd_fn=None) -> DataFrame:
    """Land ``apps`` as files, run the stream to completion, return what the sink holds."""
    src = scratch_path(spark, "apps_in")
    apps.write.mode("overwrite").parquet(src)
    sink, chk = scratch_path(spark, "apps_scored"), scratch_path(spark, "apps_chk")
    schema = spark.read.parquet(src).schema
    q = start_scoring(spark, src, sink, chk, template, schema=schema, pd_fn=pd_fn)
    q.awaitTermination()
    return spark.read.parquet(sink)
