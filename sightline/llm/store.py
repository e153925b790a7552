"""Access of tasks to files in the shared store."""

from __future__ import annotations

import re

#: Schemes by which Spark names a store, and those of pyarrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


def store(folder: str):
    """(file system, path) of a folder, whatever store its URI names."""
    from pyarrow import fs

    scheme, _, rest = folder.partition("://")
    if rest and scheme in _SCHEMES:
        folder = f"{_SCHEMES[scheme]}://{rest}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
