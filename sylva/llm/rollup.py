"""Token counts: totals by source, language and tokenizer version, kept up by signed deltas."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import exists
from sylva.llm.tokens import BYTE_BPE, BYTE_BPE_MULTI, encoder

KEY = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, documents long, tokens long"

#: Tokenizer versions: the rank file of each.
VERSIONS: Mapping[str, str] = {"byte_bpe_50k": BYTE_BPE, "byte_bpe_multi_50k": BYTE_BPE_MULTI}


def token_counts(docs: DataFrame, versions: Mapping[str, str] = VERSIONS, keep: Sequence[str] = ("source", "lang")) -> DataFrame:
    """The ``keep`` columns, and for each version, under its name, the number of its ids in the whole text (null: 0)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(v, T.LongType()) for v in versions)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(len(keep))]
            counts = [pa.array([len(encoder(ranks).encode_ordinary(t)) for t in texts], pa.int64()) for ranks in versions.values()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[: len(keep)], arrow)), *counts], schema=arrow)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def signed(counts: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    """A change of ``sign`` (1 inserts, -1 deletes) for each row of counts (source, lang, a token column)."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("documents"), (F.col(tokens) * sign).cast("long").alias("tokens"))


def revised(counts: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Takes back counts under one version and adds those under another: (version, token column) each."""
    return signed(counts, *old, -1).unionByName(signed(counts, *new, 1))


class TokenRollup:
    """Totals in a folder that driver and executors share.

    A batch of changes is summed by key and written below ``batches`` in one move, under its id:
    a batch that is there is committed, and to apply it again changes nothing. A batch that
    failed half-way left nothing that counts and can be applied again. Totals are the sum of the
    snapshot and the batches since. One writer at a time.

    Null sources and languages are keys of their own. Totals that come to no documents and no tokens
    vanish; others may be negative if deletes come first, and are right once the inserts arrive.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _names(self, part: str) -> list[str]:
        if not exists(self.spark, f"{self.folder}/{part}"):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(part)))

    def _move_in(self, df: DataFrame, part: str, name: str) -> None:
        """Writes to a folder that nobody reads and moves it to its place."""
        df.write.mode("overwrite").parquet(f"{self.folder}/_pending/{part}-{name}")
        self._fs().mkdirs(self._path(part))
        if not self._fs().rename(self._path("_pending", f"{part}-{name}"), self._path(part, name)):
            raise OSError(f"can't commit {part}/{name}")

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot and the batches that it holds."""
        done = self._names("snapshots")
        if not done:
            return None, set()
        return done[-1], {r.batch for r in self.spark.read.parquet(f"{self.folder}/folded/{done[-1]}").collect()}

    def committed(self, batch: str) -> bool:
        return exists(self.spark, f"{self.folder}/batches/{batch}") or batch in self._snapshot()[1]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits the changes (source, lang, version, documents, tokens) once; False if they were already."""
        if not batch or any(c in batch for c in "/\\:*?{}[]") or batch[0] in "._":
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        # Summed in each task first: a hot key brings a row from each.
        self._move_in(changes.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")), "batches", batch)
        return True

    def totals(self) -> DataFrame:
        snapshot, folded = self._snapshot()
        paths = [f"{self.folder}/batches/{b}" for b in self._names("batches") if b not in folded]
        paths += [f"{self.folder}/snapshots/{snapshot}"] if snapshot else []
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        out = rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return out.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds the committed batches into a snapshot, which keeps their ids."""
        last, folded = self._snapshot()
        batches = sorted(folded | set(self._names("batches")))
        name = f"{int(last or 0) + 1:012d}"
        totals = self.totals()
        # The list goes first: without its snapshot it counts for nothing.
        self._fs().delete(self._path("folded", name), True)
        self._move_in(self.spark.createDataFrame([(b,) for b in batches], "batch string"), "folded", name)
        self._move_in(totals, "snapshots", name)
        for b in self._names("batches"):
            self._fs().delete(self._path("batches", b), True)
