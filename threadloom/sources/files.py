"""Files of a shared store, from the driver or a task: local paths, file, hdfs, s3 and gs addresses."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def store(address: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of an address."""
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def below(address: str) -> list[fs.FileInfo]:
    """Every file below a folder; none where there is no such folder."""
    system, path = store(address)
    return [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]


def read(address: str) -> bytes | None:
    system, path = store(address)
    try:
        with system.open_input_stream(path) as source:
            return source.read()
    except FileNotFoundError:
        return None


def publish(address: str, data: bytes) -> None:
    """Write under another name and move: a reader sees the old content or the new, never a part."""
    system, path = store(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def remove(address: str) -> None:
    """Remove a file or a folder with all below it; what is not there is no error."""
    system, path = store(address)
    with contextlib.suppress(FileNotFoundError):
        (system.delete_dir if system.get_file_info(path).type == fs.FileType.Directory else system.delete_file)(path)
