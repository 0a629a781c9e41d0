from alertlift.sources.reader import load_alerts, load_predictions
from alertlift.sources.staging import drop_staged, stage
from alertlift.sources.writer import write_predictions, write_table

__all__ = ["drop_staged", "load_alerts", "load_predictions", "stage", "write_predictions", "write_table"]
