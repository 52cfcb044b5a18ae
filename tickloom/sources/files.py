"""Files in a folder that driver and executors share, for Python tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a file or folder."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def put(path: str, data: bytes) -> None:
    """Write a file whole or not at all; an older one is replaced."""
    fs, at = opened(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, at)


def get(path: str) -> bytes:
    fs, at = opened(path)
    with fs.open_input_stream(at, compression=None) as src:
        return src.read()


def listed(folder: str) -> list[str]:
    """Names of the files of a folder, in order; none if there is no such folder. Names that begin with a dot are not told."""
    fs, at = opened(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))
