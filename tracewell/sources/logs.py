"""Text logs: fields by pattern, first matching pattern wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STAMP = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"


@dataclass(frozen=True)
class LogPattern:
    """A line kind: marker text, action, subject pattern and message template."""

    marker: str
    action: str
    capture: str          # pattern whose group 1 fills the template
    template: str         # "{}" stands for the captured text
    subject: str | None = None   # fixed subject, else the captured text


# The kinds of watchdog lines.
WATCHDOG_PATTERNS = (
    LogPattern("LOADED", "reload", r"LOADED\s+(.*)$", "Reloaded {}"),
    LogPattern("DOWN:", "detected", r"DOWN:\s+(.*)$", "Detected {} down"),
    LogPattern("HEALED", "heal", r"HEALED (\d+)", "Healed {} daemon(s)", subject="watchdog"),
)


def parse_log(lines: DataFrame, patterns: Sequence[LogPattern], text: str = "line") -> DataFrame:
    """Stamped lines that match a pattern, with ts, action, subject and message."""
    stamped = lines.withColumn("ts", F.regexp_extract(text, _STAMP, 1)).filter(F.col("ts") != "")
    action = subject = message = F.lit(None).cast("string")
    for p in patterns:
        hit = F.col(text).contains(p.marker)
        got = F.trim(F.regexp_extract(text, p.capture, 1))
        before, after = p.template.split("{}")
        action = F.coalesce(action, F.when(hit, F.lit(p.action)))
        subject = F.coalesce(subject, F.when(hit, F.lit(p.subject) if p.subject else got))
        message = F.coalesce(message, F.when(hit, F.concat(F.lit(before), got, F.lit(after))))
    out = stamped.withColumns({"action": action, "subject": subject, "message": message})
    return out.filter(F.col("action").isNotNull()).drop(text)
