"""All registered queries: name -> (Spark function, SQL text or None)."""

from __future__ import annotations

from tidemark.plans import content, groups, logs, versions

QUERIES = {**versions.QUERIES, **content.QUERIES, **logs.QUERIES, **groups.QUERIES}
