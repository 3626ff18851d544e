"""Versioned store of keyed objects: Parquet data per commit, and a log whose entry is published last and only once.

A commit's data is invisible until its log entry exists. The entry is written under a private name and then linked to its own
(see `publication`), so a reader never sees a part of it, and of two writers of one sequence one fails and the other's commit
stands. Data files are never changed; a rewrite goes to another store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.session import written
from keyloom.operators import graph, history
from keyloom.sources.publication import HadoopBackend, publish, read


class Conflict(RuntimeError):
    """Another writer published the sequence first, or it is not known whether this one did."""


class SourceChanged(RuntimeError):
    """The log isn't what it was when a reading began."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _log(self, seq: int) -> str:
        return f"{self.root}/_log/{seq:020d}.json"

    def sequences(self) -> list[int]:
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def token(self) -> tuple:
        """The version of the log: its entries with their lengths and times."""
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return ()
        return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in self._fs.listStatus(folder) if not x.getPath().getName().startswith(".")))

    def check(self, token: tuple) -> None:
        if self.token() != token:
            raise SourceChanged(self.root)

    def commit(self, changes: DataFrame) -> int:
        """Write changes (object_id, op, kind, payload) as the next sequence; fails if the batch breaks a rule or another writer was first."""
        seq = len(self.sequences())
        changes = written(changes.select("object_id", "op", "kind", "payload"), "changes")
        n = changes.agg(F.count("*"), F.count_distinct("object_id"), F.count_if((F.col("object_id") <= 0) | ((F.col("op") == "put") & (F.coalesce("kind", F.lit(0)) == 0))), F.count_if(~F.coalesce(F.col("op").isin("put", "delete"), F.lit(False))), F.count_if(F.col("op") == "put")).first()
        if n[0] == 0:
            raise ValueError("an empty batch")
        if n[1] < n[0]:
            raise ValueError("one operation per object")
        if n[2] or n[3]:
            raise ValueError("zero id or kind, or an unknown operation")
        if n[4] < n[0]:
            gone, state = changes.filter("op = 'delete'").select("object_id"), self.state()
            if not gone.join(state, "object_id", "left_anti").isEmpty():
                raise ValueError("delete of a missing object")
            if not n[4] and state.join(gone, "object_id", "left_anti").isEmpty():
                raise ValueError("the result would be empty")
        part = f"{self.root}/data/seq={seq}-{uuid.uuid4().hex}"
        changes.withColumn("seq", F.lit(seq).cast("long")).repartitionByRange("object_id").sortWithinPartitions("object_id").write.mode("error").parquet(part)
        self._fs.mkdirs(self._path(f"{self.root}/_log"))
        outcome = publish(HadoopBackend(self.spark, self._log(seq)), json.dumps({"seq": seq, "data": part, "rows": n[0]}).encode())
        if outcome.name != "PublishedAndDurable":
            raise Conflict(f"sequence {seq}: {outcome.name} {outcome.stage or ''}".strip())
        return seq

    def genesis(self, objects: DataFrame) -> int:
        """The first commit, of objects (object_id, kind, payload); a store that has commits refuses it."""
        if self.sequences():
            raise Conflict("the store isn't empty")
        return self.commit(objects.select("object_id", F.lit("put").alias("op"), "kind", "payload"))

    def append(self, objects: DataFrame) -> int:
        """A commit of new objects only: one that is there already is an error."""
        if not objects.select("object_id").join(self.state(), "object_id", "left_semi").isEmpty():
            raise ValueError("duplicate object")
        return self.commit(objects.select("object_id", F.lit("put").alias("op"), "kind", "payload"))

    def _data(self, seq: int) -> str:
        path = self._log(seq)
        return json.loads(read(HadoopBackend(self.spark, path), self._path(path)))["data"]

    def log(self, upto: int | None = None) -> DataFrame:
        """All changes up to a sequence: object_id, op, kind, payload, seq."""
        known = [k for k in self.sequences() if upto is None or k <= upto]
        if not known:
            return self.spark.createDataFrame([], "object_id long, op string, kind int, payload binary, seq long")
        return self.spark.read.parquet(*[self._data(k) for k in known])

    def state(self, seq: int | None = None) -> DataFrame:
        """The live objects as of a sequence (default: the newest): object_id, kind, payload, seq."""
        last = self.log(seq).groupBy("object_id").agg(F.max_by(F.struct("op", "kind", "payload", "seq"), "seq").alias("x"))
        return last.filter("x.op = 'put'").select("object_id", "x.kind", "x.payload", "x.seq")

    def inventory(self, seq: int | None = None) -> DataFrame:
        """The live objects without payloads, which aren't read: object_id, kind, seq, under one version of the log."""
        token = self.token()
        last = self.log(seq).select("object_id", "op", "kind", "seq").groupBy("object_id").agg(F.max_by(F.struct("op", "kind", "seq"), "seq").alias("x"))
        found = written(last.filter("x.op = 'put'").select("object_id", "x.kind", "x.seq"), "inventory")
        self.check(token)
        return found

    def identity(self, seq: int | None = None) -> tuple[int, str]:
        """Number of live objects, and a digest of their contents that doesn't depend on order."""
        s = self.state(seq).select(F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("object_id").cast("string"), F.col("kind").cast("string"), F.hex("payload")), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
        r = s.agg(F.count("*"), F.sum("h")).first()
        return r[0], str(r[1])

    # ---- rewrites to another store; signatures over the bytes of the former files never hold for the new ones

    def rewrite(self, target: Store, seq: int | None = None, ids: DataFrame | None = None, edges: DataFrame | None = None, roots: DataFrame | None = None, max_bytes: int | None = None) -> dict:
        """A state as another store's genesis: all of it, the objects of ids, or what roots reach along edges.

        Ids have to be there, each once; a dependency has to be there; the copies may be limited in bytes. The source is
        compared before and after. -> sequence, objects, byte_scoped_signatures_preserved (False).
        """
        token, state = self.token(), self.state(seq)
        if ids is not None:
            state = graph.projected(state, ids)
        if roots is not None:
            nodes = state.select(F.col("object_id").alias("id"), F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size"))
            state = state.join(graph.kept_objects(nodes, edges, roots, max_bytes).select(F.col("id").alias("object_id")), "object_id", "left_semi")
        elif max_bytes is not None and (state.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) > max_bytes:
            raise ValueError("the copies would exceed the limit")
        made = target.genesis(state.select("object_id", "kind", "payload"))
        self.check(token)
        return {"sequence": made, "objects": target.inventory().count(), "byte_scoped_signatures_preserved": False}

    def copy(self, target: Store, tail: DataFrame | None = None) -> int:
        """Every commit to an empty store, and a tail after them; the identity is compared before and after."""
        token, before = self.token(), self.identity()
        for seq in self.sequences():
            target.commit(self.spark.read.parquet(self._data(seq)).select("object_id", "op", "kind", "payload"))
        if target.identity() != before:
            raise SourceChanged("the copy differs")
        self.check(token)
        return target.commit(tail) if tail is not None else len(target.sequences()) - 1

    def reissue(self, target: Store, sequences: list[int], max_bytes: int | None = None) -> int:
        """The chosen states as the commits 0, 1, ... of another store; what they add up to may be limited in bytes."""
        log = self.log(max(sequences)).withColumn("digest", F.sha2(F.concat_ws("|", F.col("kind").cast("string"), F.hex("payload")), 256))
        batches = written(history.reissued(log, sequences), "batches")
        content = log.filter("op = 'put'").select("object_id", "digest", "kind", "payload").groupBy("object_id", "digest").agg(F.first("kind").alias("kind"), F.first("payload").alias("payload"))
        whole = written(batches.join(content, ["object_id", "digest"], "left").select("reissue", "object_id", "op", "kind", "payload"), "batches")
        if max_bytes is not None and (whole.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) > max_bytes:
            raise ValueError("the chain would exceed the limit")
        for k in range(len(sequences)):
            target.commit(whole.filter(F.col("reissue") == k).drop("reissue"))
        return len(sequences)
