"""Label counts that are kept up to date: a new, replaced or withdrawn set is counted alone.

Counts are kept per (`source`, `batch`, `head`, `label`) and add up, so space, frequency, coverage and
weights of any choice of sources follow from them without another look at the notes. A version lists
the folders whose counts hold; the catalog publishes it as a whole, so readers never see half a change,
and a change that starts from an old version is refused and made again.
"""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.operators import labels
from notecode.sources.catalog import Catalog, Outdated

_INDEX = "source string, batch string, folder string"
_COUNTS = "source string, batch string, head string, label string, n long"
MOST_TRIES = 20


class LabelStatistics:
    """The label counts of the sets of a catalog."""

    def __init__(self, catalog: Catalog, name: str = "label-statistics"):
        self.catalog, self.name, self.spark = catalog, name, catalog.spark

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        return max(self.catalog.versions(self.name), default=0)

    def _index(self, version: int) -> list[tuple[str, str, str]]:
        """(source, batch, folder) of all sets: one row for each, whatever the number of notes."""
        if not version:
            return []
        return [tuple(row) for row in self.catalog.read(self.name, version).select("source", "batch", "folder").collect()]

    def _change(self, change: Callable[[list], list]) -> int:
        for _ in range(MOST_TRIES):
            version = self.version()
            index = self.spark.createDataFrame(sorted(change(self._index(version))), _INDEX)
            try:
                return self.catalog.publish(index, self.name, partitions=1, after=version)
            except Outdated:
                continue
        raise Outdated(f"{self.name!r} was changed by others {MOST_TRIES} times")

    def _write(self, counts: DataFrame) -> str:
        folder = uuid.uuid4().hex
        counts.select("source", "batch", "head", "label", "n").write.parquet(self._path(folder))
        return folder

    def _path(self, folder: str) -> str:
        return f"{self.catalog.root}/{self.name}.counts/{folder}"

    def put(self, source: str, notes: DataFrame, batch: str = "", heads: Sequence[str] = labels.HEADS) -> int:
        """Count the notes of a set, or of one batch of it, in place of what was known of it.

        Only these notes are read. To put the same batch again changes nothing, so a job that failed can
        be run again. Returns the version in which the counts appear.
        """
        counted = labels.label_frequency(notes, heads)
        folder = self._write(counted.withColumns({"source": F.lit(source), "batch": F.lit(batch)}))
        return self._change(lambda index: [e for e in index if e[:2] != (source, batch)] + [(source, batch, folder)])

    def withdraw(self, source: str, batch: str | None = None) -> int:
        """Forget a set, or one batch of it; no notes are read. One that is not known is an error."""

        def without(index: list) -> list:
            kept = [e for e in index if e[0] != source or (batch is not None and e[1] != batch)]
            if len(kept) == len(index):
                raise KeyError(f"no counts of {source!r}" + (f", batch {batch!r}" if batch is not None else ""))
            return kept

        return self._change(without)

    def compact(self) -> int:
        """Write all counts that hold to one folder, so that many small batches are read fast."""
        version = self.version()
        folder = self._write(self.counts(version))
        index = [(source, batch, folder) for source, batch, _ in self._index(version)]
        published = self.spark.createDataFrame(sorted(index), _INDEX)
        return self.catalog.publish(published, self.name, partitions=1, after=version)

    def counts(self, version: int | None = None) -> DataFrame:
        """(`source`, `batch`, `head`, `label`, `n`) as of a version, by default the last."""
        version = self.version() if version is None else version
        paths = sorted({self._path(folder) for _, _, folder in self._index(version)})
        if not paths:
            return self.spark.createDataFrame([], _COUNTS)
        read = self.spark.read.schema(_COUNTS).parquet(*paths)
        # A compacted folder also holds batches that were replaced or withdrawn afterwards.
        folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
        listed = read.withColumn("folder", folder)
        return listed.join(self.catalog.read(self.name, version), ["source", "batch", "folder"], "left_semi").drop("folder")

    def frequency(self, sources: Sequence[str], version: int | None = None) -> DataFrame:
        """(`head`, `label`, `n`) over sources, as `labels.label_frequency` over all their notes."""
        counts = self.counts(version).filter(F.col("source").isin(list(sources)))
        return counts.groupBy("head", "label").agg(F.sum("n").alias("n"))

    def sources(self, names: Sequence[str], version: int | None = None) -> DataFrame:
        """One boolean per source, for `labels.union_label_space` and `labels.label_coverage`."""
        return labels.label_sources(self.counts(version).filter(F.col("source").isin(list(names))), names)

    def weights(self, sources: Sequence[str], version: int | None = None) -> DataFrame:
        """Class weights of sources, as `labels.class_weights` over all their notes."""
        return labels.class_weights(self.frequency(sources, version))

    def changes(self, sources: Sequence[str], old: int, new: int | None = None) -> DataFrame:
        """(`head`, `label`, `n_before`, `n_after`) of the labels whose count differs between versions."""
        before, after = self.frequency(sources, old), self.frequency(sources, new)
        both = before.withColumnRenamed("n", "n_before").join(
            after.withColumnRenamed("n", "n_after"), ["head", "label"], "full"
        )
        both = both.fillna(0, ["n_before", "n_after"])
        return both.filter("n_before != n_after")


def extend_numbering(space: DataFrame, found: DataFrame) -> DataFrame:
    """`space` (`head`, `label`, `label_id`) with the labels it lacks numbered behind its own.

    Known labels keep their ids, so what was trained on them stays valid; new ones follow the highest id
    of their head in label order. Labels that are not found any more stay.
    """
    new = found.select("head", "label").distinct().join(space, ["head", "label"], "left_anti")
    offsets = space.groupBy("head").agg((F.max("label_id") + 1).alias("_first"))
    numbered = labels.number_labels(new).join(offsets, "head", "left")
    ids = F.col("label_id") + F.coalesce("_first", F.lit(0))
    return space.select("head", "label", "label_id").unionByName(
        numbered.select("head", "label", ids.cast(space.schema["label_id"].dataType).alias("label_id"))
    )
