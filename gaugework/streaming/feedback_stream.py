"""Row-wise feedback steps on a stream: the same column expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gaugework.operators.enrich import sentiment_columns
from gaugework.operators.feedback_clean import Mapping, clean_rows, detect_mapping, with_status
from gaugework.operators.triage import COLLEGE, RoutingProfile, triage


def cleaned_stream(df: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Cleaning without duplicate search, which needs the whole data set."""
    return with_status(clean_rows(df, mapping or detect_mapping(df.columns)))


def triaged_stream(df: DataFrame, profile: RoutingProfile = COLLEGE, lexicon: dict | None = None) -> DataFrame:
    """Sentiment and decision per record; topics and keywords come from the input if present."""
    return triage(sentiment_columns(df, "cleaned_text", lexicon), profile)


def in_batches(df: DataFrame, run, checkpoint: str) -> DataStreamWriter:
    """Writer that hands each micro-batch to ``run(batch, id)``, for corpus-wide operators."""
    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
