"""Opening and creating files from inside tasks."""

from __future__ import annotations

import posixpath
import sys

from pyarrow import fs
from pyspark import cloudpickle


def ship_code() -> None:
    """Task code of this package travels with the job, so executors need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def create_file(path: str):
    system, inner = _resolve(path)
    try:
        return system.open_output_stream(inner)
    except FileNotFoundError:  # the folder is missing
        system.create_dir(posixpath.dirname(inner), recursive=True)
        return system.open_output_stream(inner)


def create_folder(path: str) -> None:
    system, inner = _resolve(path)
    system.create_dir(inner, recursive=True)


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes local paths as file:/x, which is not a URI pyarrow takes
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    system, inner = _resolve(path)
    return system.open_input_file(inner)
