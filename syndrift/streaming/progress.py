"""A listener that keeps the newest progress reports of streaming queries: batches, rows, rates and times."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """``spark.streams.addListener(Progress())``; ``rows`` holds the last ``keep`` reports of all queries."""

    def __init__(self, keep: int = 1000):
        self.rows: deque[dict] = deque(maxlen=keep)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({"query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def summary(self) -> dict:
        """Frames, batches and mean rate so far."""
        total, ms = sum(r["rows"] for r in self.rows), sum(r["ms"] for r in self.rows)
        return {"rows": total, "batches": len(self.rows), "rows_per_second": total / ms * 1000 if ms else 0.0}
