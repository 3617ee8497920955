"""Files in the shared folder, opened from inside tasks.

The folder is an absolute path or a URI that pyarrow can open (file:, hdfs:, s3:, gs:),
taken from ``spark.checkpoint.dir`` by the driver; nothing machine-local is used."""
from __future__ import annotations

import re

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if m := re.match(r"file:/*(/.*)", uri):
        return fs.LocalFileSystem(), m.group(1)
    return fs.FileSystem.from_uri(uri)
