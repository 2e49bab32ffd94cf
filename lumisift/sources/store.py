"""The index on disk: a manifest and a vector table that grow by versions.

    <root>/manifest/version=N/run=R   rows that run R wrote for version N
    <root>/vectors/version=N/run=R    its vectors
    <root>/voids/version=N/run=R      bitmaps of the images whose older vectors are void since then
    <root>/commits/N.parquet          one row: which run's version N it is

A version counts only once its file is in ``commits``, which is put there last, and only where none is. Runs
have folders of their own, so of two runs that write the same version one gets its commit in, the other
one stops, and neither touches what the other wrote. What a stopped or dead run leaves is looked at by no
reader. A ``delta`` version holds changed rows only, so that adding a few files to a large index writes a few
rows; :meth:`IndexStore.compact` writes a ``full`` version with everything in it.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumisift.operators.ingest import live_rows
from lumisift.schema import COMMITS, MANIFEST, VECTORS, require, small_table

_VERSIONED = [T.StructField("version", T.LongType()), T.StructField("run", T.StringType())]
# Rows of the manifest folders: ``voids`` marks an image whose older vector is void.
_STAGED = T.StructType([*MANIFEST.fields, T.StructField("voids", T.BooleanType())])


# Images with a bit set in ``bits`` have the numbers ``64 * word`` to ``64 * word + 63``.
_VOIDS = T.StructType([T.StructField("word", T.LongType()), T.StructField("bits", T.LongType())])
# Up to as many void vectors are left out by the scan itself, more of them by a join.
FEW_VOIDS = 20_000


@dataclass(frozen=True)
class State:
    """What a committed version means for readers; ``runs`` wrote the versions up to it."""

    version: int = 0
    base: int = 0
    max_image_id: int = 0
    first_vectors: int = 0
    voided: int = 0
    runs: tuple[str, ...] = ()


def put_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file to ``target`` unless there is one; whether it was moved.

    As safe as the file system's rename without overwriting: one step on HDFS, a look and a step on local disks.
    """
    files = spark._jvm.org.apache.hadoop.fs
    rename = getattr(files, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    source, target = files.Path(source), files.Path(target)
    context = files.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.toString()):
            raise
        return False
    return True


class IndexStore:
    """Reads and commits of one index folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        # The run that staged a version through this object.
        self._staged: dict[int, str] = {}

    def commits(self) -> DataFrame:
        """One row per committed version; none for a new index."""
        return self._read("commits", COMMITS)

    def state(self, version: int | None = None) -> State:
        commits = self.commits()
        if version is not None:
            commits = commits.where(F.col("version") <= version)
        full = F.when(F.col("kind") == "full", F.col("version"))
        # One row, however many commits there are.
        row = commits.agg(
            F.max("version").alias("version"),
            F.coalesce(F.max(full), F.lit(0)).alias("base"),
            F.max_by("max_image_id", "version").alias("max_image_id"),
            F.max_by("first_vectors", "version").alias("first_vectors"),
            F.max_by("voided", "version").alias("voided"),
            F.array_sort(F.collect_list("run")).alias("runs"),
        ).first()
        return State() if row["version"] is None else State(**row.asDict() | {"runs": tuple(row["runs"])})

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return small_table(self.spark, [], schema)

    def _versions(self, table: str, schema: T.StructType, first: int, state: State) -> DataFrame:
        """Committed rows of the versions from ``first`` on."""
        rows = self._read(table, T.StructType([*schema.fields, *_VERSIONED]))
        runs = ", ".join(f"'{run}'" for run in state.runs) or "''"
        return rows.where(F.expr(f"version BETWEEN {first} AND {state.version} AND run IN ({runs})")).drop("run")

    def _at(self, at: State | int | None) -> State:
        return at if isinstance(at, State) else self.state(at)

    def manifest(self, at: State | int | None = None) -> DataFrame:
        """All rows, removed ones included, as of a version; an absent index has none."""
        state = self._at(at)
        rows = self._versions("manifest", MANIFEST, state.base, state)
        if state.version == state.base:
            return rows.drop("version")
        row = F.struct(*[c for c in MANIFEST.fieldNames() if c != "image_id"])
        newest = (
            rows.where(F.col("version") > state.base)
            .groupBy("image_id").agg(F.max_by(row, "version").alias("row"))
            .select("image_id", "row.*")
        )
        base = rows.where(F.col("version") == state.base).drop("version")
        # Only the changes move: the base is not shuffled unless they are many.
        return base.join(newest.select("image_id"), "image_id", "left_anti").unionByName(newest)

    def vectors(self, at: State | int | None = None) -> DataFrame:
        """``(image_id, embedding)``; of a re-embedded image the newest vector only.

        The ids of a few void vectors go into the scan as a condition; many are joined: compact then.
        """
        state = self._at(at)
        rows = self._versions("vectors", VECTORS, state.first_vectors, state)
        if state.voided == 0:
            return rows.drop("version")
        voids = self._versions("voids", _VOIDS, state.first_vectors, state)
        if state.voided <= FEW_VOIDS:
            return rows.where(~self._void(voids)).drop("version")
        one = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)"))
        newest = voids.select("word", one.alias("bit"), "version").select(
            (F.col("word") * 64 + F.col("bit")).alias("image_id"), "version").groupBy("image_id").agg(
            F.max("version").alias("_newest"))
        return (
            rows.join(newest, "image_id", "left")
            .where(F.col("_newest").isNull() | (F.col("version") >= F.col("_newest")))
            .select(*VECTORS.fieldNames())
        )

    def _void(self, voids: DataFrame) -> Column:
        """Whether a vector is older than its image's newest; for so few images that a condition holds them."""
        newest: dict[int, int] = {}
        for version, word, bits in voids.select("version", "word", "bits").orderBy("version").collect():
            for bit in np.flatnonzero(np.unpackbits(np.array([bits], "<i8").view(np.uint8), bitorder="little")):
                newest[64 * word + int(bit)] = version
        if not newest:
            return F.lit(False)
        ids = ", ".join(f"{i}L" for i in newest)
        since = ", ".join(f"{v}L" for v in newest.values())
        return F.expr(f"image_id IN ({ids}) AND version < map_from_arrays(array({ids}), array({since}))[image_id]")

    def added_vectors(self, after: int, upto: State | int) -> DataFrame:
        """Vectors that the versions after one and up to another appended."""
        return self._versions("vectors", VECTORS, after + 1, self._at(upto)).drop("version")

    def read_vectors(self, ids: DataFrame) -> DataFrame:
        """Vectors of ``ids(image_id)``."""
        return ids.select("image_id").join(self.vectors(), "image_id")

    def missing_vectors(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids(image_id)`` that have no vector."""
        return ids.select("image_id").join(self.vectors(), "image_id", "left_anti")

    def _require_next(self, state: State) -> None:
        newest = self.state().version
        if newest != state.version:
            raise ValueError(f"version {state.version + 1} cannot be written: the index is at {newest}")

    def stage(self, rows: DataFrame, state: State) -> DataFrame:
        """Write manifest ``rows`` of the version after ``state``, not yet committed; those rows.

        A true ``voids`` marks images among them that come with a new vector.
        """
        self._require_next(state)
        if "voids" not in rows.columns:
            rows = rows.withColumn("voids", F.lit(False))
        self._staged[state.version + 1] = run = uuid.uuid4().hex
        folder = f"{self.root}/manifest/version={state.version + 1}/run={run}"
        require(rows, _STAGED).write.parquet(folder)
        return self.spark.read.schema(_STAGED).parquet(folder)

    def commit(
        self,
        state: State,
        vectors: DataFrame | None = None,
        full: bool = False,
        max_image_id: int | None = None,
        voided: int = 0,
        indexed: int = 0,
        removed: int = 0,
        source: str = "",
    ) -> State:
        """Commit the version after ``state`` with its staged rows and ``vectors(image_id, embedding)``.

        ``full`` says that the rows are the whole manifest and the vectors, if given, the whole vector table. If
        another run has committed this version in the meantime, nothing of this one counts and it is an error.
        """
        self._require_next(state)
        version = state.version + 1
        run = self._staged.pop(version, None)
        if run is None:
            raise ValueError(f"version {version} has no staged rows")
        place = f"version={version}/run={run}"
        after = replace(
            state, version=version, voided=state.voided + voided, runs=tuple(sorted({*state.runs, run})))
        if max_image_id is not None:
            after = replace(after, max_image_id=max_image_id)
        if full:
            after = replace(after, base=version)
        if full and vectors is not None:
            after = replace(after, first_vectors=version, voided=0)
        if vectors is not None:
            require(vectors, VECTORS).write.parquet(f"{self.root}/vectors/{place}")
        if voided:
            staged = self.spark.read.schema(_STAGED).parquet(f"{self.root}/manifest/{place}").where("voids")
            bits = F.expr("bit_or(shiftleft(1L, CAST(pmod(image_id, 64) AS INT)))")
            staged.groupBy(F.expr("image_id DIV 64").alias("word")).agg(bits.alias("bits")).write.parquet(f"{self.root}/voids/{place}")
        row = {name: value for name, value in asdict(after).items() if name != "runs"} | {
            "kind": "full" if full else "delta", "indexed": indexed, "removed": removed, "source": source, "run": run}
        waiting = f"{self.root}/_waiting/{run}"
        small_table(self.spark, [row], COMMITS).coalesce(1).write.parquet(waiting)
        (file,) = self.spark.read.schema(COMMITS).parquet(waiting).inputFiles()
        self._commit_folder()
        if not put_if_absent(self.spark, file, f"{self.root}/commits/{version:012d}.parquet"):
            raise ValueError(f"version {version} cannot be written: another run has committed it")
        return after

    def _commit_folder(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def write_manifest(self, rows: DataFrame, vectors: DataFrame | None = None) -> State:
        """Replace the whole manifest by ``rows``, and with ``vectors`` the whole vector table."""
        state = self.state()
        staged = self.stage(rows, state)
        last = staged.agg(F.coalesce(F.max("image_id"), F.lit(0))).first()[0]
        return self.commit(state, vectors, True, max(state.max_image_id, last))

    def append_vectors(self, vectors: DataFrame) -> State:
        """Add ``vectors(image_id, embedding)``."""
        state = self.state()
        self.stage(small_table(self.spark, [], MANIFEST), state)
        return self.commit(state, vectors)

    def compact(self, vectors: bool = True) -> State:
        """Write the current manifest, and the vectors of its live rows, as a full version.

        ``vectors=False`` folds the manifest alone, which is cheap: do it now and then
        during long streams of small batches.
        """
        state = self.state()
        manifest = self.manifest(state)
        kept = None
        if vectors:
            live = live_rows(manifest).select("image_id")
            kept = self.vectors(state).join(live, "image_id", "left_semi")
        self.stage(manifest, state)
        return self.commit(state, kept, full=True)

    def reset(self) -> State:
        """Drop all rows and vectors of every directory; ids start from 1 again."""
        state = self.state()
        self.stage(small_table(self.spark, [], MANIFEST), state)
        return self.commit(state, small_table(self.spark, [], VECTORS), full=True, max_image_id=0)
