"""Files of any file system that Arrow opens, for the Python data sources of this package."""

from __future__ import annotations

import uuid

from pyarrow import fs


class Files:
    """A folder, opened where it is used: on the driver to list, in a task to read."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def sizes(self, below: str = "") -> dict[str, int]:
        """Files and their bytes, by name; names that begin with a dot or an underscore are none."""
        at = fs.FileSelector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True)
        return {f.base_name: f.size for f in self.system.get_file_info(at) if f.is_file and f.base_name[0] not in "._"}

    def folders(self, below: str = "") -> list[str]:
        at = fs.FileSelector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True)
        return sorted(f.base_name for f in self.system.get_file_info(at) if f.type == fs.FileType.Directory and f.base_name[0] not in "._")

    def read(self, below: str) -> bytes | None:
        path = f"{self.root}/{below}"
        if self.system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_file(path) as file:
            return file.read()

    def open(self, below: str):
        return self.system.open_input_file(f"{self.root}/{below}")

    def write(self, below: str, content: bytes) -> None:
        """The whole file or none: written under another name, then renamed."""
        folder, _, name = f"{self.root}/{below}".rpartition("/")
        self.system.create_dir(folder, recursive=True)
        hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(hidden) as out:
            out.write(content)
        self.system.move(hidden, f"{folder}/{name}")
