"""Reports that are kept as SQL files, named by a manifest."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Asset:
    display_name: str
    description: str
    file: str
    query: str

    def run(self, spark: SparkSession) -> DataFrame:
        """The report over the session's tables and views."""
        return spark.sql(self.query.strip().rstrip(";"))


def load(folder: str, manifest: str = "manifest.json", max_assets: int = 50, max_bytes: int = 100_000) -> list[Asset]:
    """The assets that folder's manifest lists: objects of display_name, description and file, each file a regular UTF-8 .sql file of the folder itself.

    Raises on any other shape, on blank fields, on names or files that come twice, on links and on what exceeds the bounds.
    """
    with open(os.path.join(folder, manifest), encoding="utf-8") as f:
        listed = json.load(f)
    if not isinstance(listed, list) or not 1 <= len(listed) <= max_assets:
        raise ValueError(f"a manifest lists from 1 to {max_assets} reports")
    out: list[Asset] = []
    for entry in listed:
        if not isinstance(entry, dict) or set(entry) != {"display_name", "description", "file"} or any(not isinstance(v, str) or not v.strip() for v in entry.values()):
            raise ValueError("a report has a display_name, a description and a file")
        file, path = entry["file"], os.path.join(folder, entry["file"])
        if file != file.strip() or os.path.basename(file) != file or not file.endswith(".sql"):
            raise ValueError(f"{file!r} is no .sql file of the folder")
        if os.path.islink(path) or not os.path.isfile(path):
            raise ValueError(f"{file} is no regular file")
        with open(path, "rb") as f:
            content = f.read(max_bytes + 1)
        if len(content) > max_bytes or not (query := content.decode("utf-8")).strip():
            raise ValueError(f"{file} is empty or larger than {max_bytes} bytes")
        name = entry["display_name"].strip()
        if any(a.file == file or a.display_name == name for a in out):
            raise ValueError(f"{name} or {file} comes twice")
        out.append(Asset(name, entry["description"].strip(), file, query))
    return out
