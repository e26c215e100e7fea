"""Rows as files: a data source that Spark writes to under a commit protocol.

A task writes its rows (path, text, and ``front`` where the text is a body to be rendered under it) below a folder of its attempt, and moves them to their names once all are
written; what it moved is listed in a journal. The driver gets one journal's name and a count from each task,
never rows or names: it commits by writing ``manifest.json`` last, or aborts by removing what the journals
list. A task that fails removes its own folder; one that is run again writes the same names.

Files of the same name that were there before are replaced, so an aborted job may leave such a name empty.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: What a refused path's error begins with.
REFUSED = "INVALID_PATH"
ATTEMPTS, MANIFEST = "_attempts", "manifest.json"


def file_system(root: str):
    """The file system of a folder, local or by its scheme, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def inside(path: str) -> bool:
    """Whether a relative path stays in its folder."""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/") and path.split("/")[0] != ATTEMPTS


def counted(root: str) -> int:
    """The files that the last commit's manifest counts."""
    fs, base = file_system(root)
    with fs.open_input_stream(f"{base.rstrip('/')}/{MANIFEST}") as stream:
        return json.loads(stream.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    journal: str
    files: int


class Writer(DataSourceWriter):
    def __init__(self, root: str, manifest: str, key_id: str | None = None):
        self.root, self.manifest, self.key_id, self.job = root, manifest, key_id, uuid.uuid4().hex

    def _text(self, row) -> str:
        if row["front"] is None:
            return row["text"] or ""
        from corpusgrid.operators.export import rendered_text

        return rendered_text(row["front"], row["text"] or "", self.key_id)

    def _place(self):
        fs, base = file_system(self.root)
        return fs, base.rstrip("/"), f"{base.rstrip('/')}/{ATTEMPTS}/{self.job}"

    def write(self, iterator):
        fs, base, attempts = self._place()
        own = f"{attempts}/{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        try:
            n = 0
            with fs.open_output_stream(f"{own}.journal") as journal:
                for row in iterator:
                    if not inside(row["path"]):
                        raise ValueError(f"{REFUSED}: {row['path']!r} leaves the folder")
                    with fs.open_output_stream(f"{own}/{n}") as file:
                        file.write(self._text(row).encode())
                    journal.write((json.dumps(row["path"]) + "\n").encode())
                    n += 1
            made = set()
            for i, name in enumerate(_names(fs, f"{own}.journal")):
                target = f"{base}/{name}"
                if posixpath.dirname(target) not in made:
                    made.add(posixpath.dirname(target))
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                fs.move(f"{own}/{i}", target)
        finally:
            fs.delete_dir(own)
        return Written(f"{own}.journal", n)

    def commit(self, messages):
        fs, base, attempts = self._place()
        said = json.loads(self.manifest) | {"files": sum(m.files for m in messages if m)}
        with fs.open_output_stream(f"{base}/{MANIFEST}") as file:
            file.write(json.dumps(said, sort_keys=True).encode())
        self._clear(fs, base, attempts)

    def abort(self, messages):
        fs, base, attempts = self._place()
        for message in filter(None, messages):
            for name in _names(fs, message.journal):
                if fs.get_file_info(f"{base}/{name}").is_file:
                    fs.delete_file(f"{base}/{name}")
        self._clear(fs, base, attempts)

    @staticmethod
    def _clear(fs, base, attempts):
        from pyarrow.fs import FileSelector

        if fs.get_file_info(attempts).type.name == "Directory":
            fs.delete_dir(attempts)
        above = f"{base}/{ATTEMPTS}"
        if fs.get_file_info(above).type.name == "Directory" and not fs.get_file_info(FileSelector(above)):
            fs.delete_dir(above)


def _names(fs, journal: str):
    """A journal's names, one line at a time."""
    import io

    with fs.open_input_stream(journal) as stream:
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            yield json.loads(line)


class FileSink(DataSource):
    """``df.write.format("corpus_files").option("manifest", "{}").save(folder)`` for rows (path, text, front)."""

    @classmethod
    def name(cls):
        return "corpus_files"

    def schema(self):
        return "path string, text string, front string"

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], self.options.get("manifest", "{}"), self.options.get("key_id"))
