"""Small metadata files on any file system that Spark can reach."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(p) else []

    def age_ms(self, path: str) -> int:
        p, fs = self._at(path)
        return self.jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()

    def read(self, path: str):
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, path: str, value, overwrite: bool = True) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def create(self, path: str, value) -> bool:
        """The file appears whole, under a name that nothing had, or not at all; False if the name is taken.

        It is written aside (readers skip names with a leading dot) and moved into place by what the file system does in
        one step: a hard link on a local disk, a rename without overwrite elsewhere.
        """
        folder, _, name = path.rpartition("/")
        aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.write(aside, value)
        p, fs = self._at(path)
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(fs.makeQualified(p)), local(fs.makeQualified(self._at(aside)[0])))
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                array = self.jvm._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
                array[0] = none
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(self._at(aside)[0], p, array)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(self._at(aside)[0], False)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)
