"""Small files and folder lists on the storage of the tables, through Spark's own file systems."""

import uuid


class Folder:
    """A folder of a table on any storage that Spark can write to."""

    def __init__(self, spark, path):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = path

    def _at(self, name):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self._conf), path

    def exists(self, name=""):
        system, path = self._at(name)
        return system.exists(path)

    def names(self, name=""):
        """Names in a folder, sorted; none if there is no folder."""
        system, path = self._at(name)
        if not system.exists(path):
            return []
        return sorted(status.getPath().getName() for status in system.listStatus(path))

    def finished(self, name):
        """Whether Spark has finished writing a folder."""
        return self.exists(f"{name}/_SUCCESS")

    def read_text(self, name):
        system, path = self._at(name)
        stream = system.open(path)
        try:
            return self._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except TypeError:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name, text):
        """Put a whole file in place at once; False if there is one of that name already."""
        system, path = self._at(name)
        _, draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        system.mkdirs(path.getParent())
        if system.exists(path) or not system.rename(draft, path):
            system.delete(draft, False)
            return False
        return True

    def remove(self, name):
        system, path = self._at(name)
        system.delete(path, True)
