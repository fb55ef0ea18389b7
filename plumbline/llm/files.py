"""Files that tasks write to and read from the shared folder, by any scheme
that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str):
    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """A binary stream to ``uri`` that appears there only when it is complete.

    A retried or speculative task writes its own temporary file; the last
    rename wins, and all of them hold the same bytes.
    """
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary, compression=None) as out:
        yield out
    system.move(temporary, path)


@contextmanager
def opened(uri: str):
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        yield f
