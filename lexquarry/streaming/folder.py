"""A folder of small files on any Hadoop file system, with names that only one writer can take."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Names and contents of the files directly below a path. Contents appear whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self.path = self._fs.makeQualified(self.path)
        self._fs.mkdirs(self.path)
        self.local = self.path.toUri().getPath() if self._fs.getUri().getScheme() == "file" else None

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, content: str) -> bool:
        """Writes a new file; False, and nothing changes, if there is one of that name."""
        draft = f".{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self.local:  # a link is one step on local disks, a rename that keeps what is there isn't
                os.link(os.path.join(self.local, draft), os.path.join(self.local, name))
            else:
                self._context.rename(self._at(draft), self._at(name), self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE"))
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._fs.exists(self._at(name)):
                return False
            raise
        finally:
            self._fs.delete(self._at(draft), False)

    def remove(self, name: str) -> None:
        """A file, or a folder with all that is in it; nothing, if there is none."""
        self._fs.delete(self._at(name), True)
