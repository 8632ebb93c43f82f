"""Which micro-batches a sink holds, and who writes it, as small files in a folder that all drivers share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Entries that are kept; older batches are never repeated.
KEPT = 100


class BatchLog:
    """The log of one query's sink. A file is created only if it is absent, which the file system does in one step."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._folder = folder.rstrip("/")
        self._fs = self._path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(folder))
        self._mine = -1

    def _names(self) -> set[str]:
        return {f.getPath().getName() for f in self._fs.listStatus(self._path(self._folder))}

    def _create(self, name: str) -> bool:
        """Whether the file was created by this call."""
        place = self._path(f"{self._folder}/{name}")
        try:
            self._fs.create(place, False).close()
        except Exception:
            if self._fs.exists(place):
                return False
            raise
        return True

    def _owners(self) -> list[int]:
        return sorted(int(n.removeprefix("owner-")) for n in self._names() if n.startswith("owner-"))

    def take_over(self) -> None:
        """Become the writer: whoever was before is noticed by ``still_mine``."""
        while True:
            number = max(self._owners(), default=-1) + 1
            if self._create(f"owner-{number}"):
                self._mine = number
                return

    def still_mine(self) -> None:
        newest = max(self._owners(), default=-1)
        if newest != self._mine:
            raise RuntimeError(f"writer {newest} has taken over the sink of {self._folder}; this one is {self._mine}")

    def state(self, batch: int) -> str:
        """``written``, ``begun``, ``first`` (nothing is known of any batch) or ``new``."""
        names = self._names()
        if f"written-{batch}" in names:
            return "written"
        if f"begun-{batch}" in names:
            return "begun"
        return "new" if any(n.startswith("written-") for n in names) else "first"

    def unsure(self) -> bool:
        """Whether rows of the next batch may have been written: nothing is known, or a batch was begun and not finished."""
        names = self._names()
        begun = {n.removeprefix("begun-") for n in names if n.startswith("begun-")}
        written = {n.removeprefix("written-") for n in names if n.startswith("written-")}
        return not written or bool(begun - written)

    def begin(self, batch: int) -> None:
        self._create(f"begun-{batch}")

    def written(self, batch: int) -> None:
        self._create(f"written-{batch}")
        for old in (f"{kind}-{batch - KEPT}" for kind in ("begun", "written")):
            self._fs.delete(self._path(f"{self._folder}/{old}"), False)
