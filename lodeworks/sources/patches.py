"""Patches of ``git log -p --unified=0`` as hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
SCHEMA = "sha string, path string, old_start int, old_count int, new_start int, new_count int, added array<string>, removed array<string>, changed_new_lines array<int>, is_file_creation boolean"


def parse_patch(text: str) -> Iterator[dict]:
    """The hunks of one commit's patch."""
    path, created, hunk, left, old = None, False, None, 0, 0
    for line in (text or "").split("\n"):
        if hunk is not None and (left or old) and line[:1] in "+-\\":
            if line[:1] == "+" and left:
                hunk["added"].append(line[1:])
                hunk["changed_new_lines"].append(hunk["new_start"] + len(hunk["added"]) - 1)
                left -= 1
            elif line[:1] == "-" and old:
                hunk["removed"].append(line[1:])
                old -= 1
            continue
        if line.startswith("diff --git "):
            if hunk:
                yield hunk
            path, created, hunk = None, False, None
        elif line.startswith("new file mode"):
            created = True
        elif line.startswith("+++ "):
            name = line[4:].strip().strip('"')
            path = None if name == "/dev/null" else name.removeprefix("b/")
        elif m := _HUNK.match(line):
            if hunk:
                yield hunk
            hunk = None
            if path:
                old, left = int(m[2] or 1), int(m[4] or 1)
                hunk = {"path": path, "old_start": int(m[1]), "old_count": old, "new_start": int(m[3]), "new_count": left, "added": [], "removed": [], "changed_new_lines": [], "is_file_creation": created}
    if hunk:
        yield hunk


def hunks(patches: DataFrame) -> DataFrame:
    """hunks of (sha, text): a commit's patch a row; a patch without hunks gives none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [{"sha": s} | h for s, t in zip(b["sha"], b["text"], strict=True) for h in parse_patch(t)]
            yield pd.DataFrame(rows, columns=names)

    return patches.select("sha", "text").mapInPandas(work, SCHEMA)


def last_commits(log: DataFrame) -> DataFrame:
    """(path, sha, ord): of (sha, log_pos, path) rows the newest commit of each path."""
    from lodeworks.operators.relations import newest

    return newest(log.select("path", "sha", F.col("log_pos").alias("ord")), "path", "ord")
