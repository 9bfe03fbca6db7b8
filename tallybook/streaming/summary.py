"""A summary line of running streams."""

from __future__ import annotations

import logging
import time

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("tallybook.summary")
#: Fixed value: seconds between summaries.
SECONDS = 10.0


class Summary(StreamingQueryListener):
    """Adds up rows and batches of every stream and logs a line every SECONDS, and when a stream ends."""

    def __init__(self, seconds: float = SECONDS) -> None:
        super().__init__()
        self.seconds, self.last, self.rows, self.batches, self.failed = seconds, time.monotonic(), 0, 0, 0

    def line(self) -> str:
        return f"summary: batches={self.batches} rows={self.rows} failed={self.failed}"

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        self.batches += 1
        self.rows += event.progress.numInputRows
        if time.monotonic() - self.last >= self.seconds:
            self.last = time.monotonic()
            log.info(self.line())

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        self.failed += event.exception is not None
        log.info(self.line())
