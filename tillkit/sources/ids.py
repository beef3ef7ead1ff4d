"""Ranges of ids handed out to batches (W2), without reading the target table.

A register is a folder of small files, one per range, numbered from 0: each
says who took it, its first id and how many. The high-water mark is the end of
the last one. A range is taken by writing the next file under a name of its
own and renaming it to the next number, which fails if that number exists: of
two batches that ask at the same time one gets the number and the other looks
again, so ranges never overlap. A batch that asks twice gets what it holds.

The rename must not replace a file, as on HDFS and local disks; on a store
whose rename does, batches must ask one after the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class IdRegister:
    """The register under ``path`` (shared storage on a cluster)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._io = jvm.org.apache.commons.io.IOUtils
        self._root = self._hadoop.Path(path)
        self._fs = self._root.getFileSystem(conf)
        root = self._fs.makeQualified(self._root)
        self._files = self._hadoop.FileContext.getFileContext(root.toUri(), conf)
        rename = getattr(self._hadoop, "Options$Rename")
        self._keep = spark.sparkContext._gateway.new_array(rename, 1)
        self._keep[0] = rename.NONE

    def ranges(self) -> list[tuple[str, int, int]]:
        """(owner, first id, number of ids) of every range, in order."""
        if not self._fs.exists(self._root):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._root))
        out = []
        for name in names:
            if name.isdigit():
                stream = self._fs.open(self._hadoop.Path(self._root, name))
                owner, first, count = self._io.toString(stream, "UTF-8").rsplit(" ", 2)
                stream.close()
                out.append((owner, int(first), int(count)))
        return out

    def reserve(self, owner: str, count: int) -> int:
        """The first of ``count`` ids in a row that belong to ``owner`` alone.

        ``owner`` names one request for ids: asked again with as many or fewer,
        it gets the same.
        """
        while True:
            taken = self.ranges()
            for who, first, held in taken:
                if who == owner and held >= count:
                    return first
            first = taken[-1][1] + taken[-1][2] if taken else 1
            mine = self._hadoop.Path(self._root, f"_{uuid.uuid4().hex}")
            out = self._fs.create(mine, False)
            out.write(bytearray(f"{owner} {first} {count}".encode()))
            out.close()
            try:
                self._files.rename(self._fs.makeQualified(mine),
                                   self._fs.makeQualified(self._hadoop.Path(self._root, f"{len(taken):012d}")), self._keep)
                return first
            except Exception as e:  # noqa: BLE001 - the gateway wraps every Java exception
                if "FileAlreadyExists" not in str(e):
                    raise
                self._fs.delete(mine, False)
