"""Sealed stages that resume (survey X01-X03, X06): what was done stays done, and what changed is refused.

A ledger is a folder that the cluster shares. Before the first stage runs, the protocol is frozen: the content of the
sources, the parameters, and the names and code of the stages in order. Each stage writes its table under a name of its
own and is then sealed by a document with the digest of what it was made from and of what it holds. A later run checks the
protocol, skips the sealed stages after checking their tables, and goes on with the first that isn't sealed; seals must
be a prefix of the plan. A run that breaks leaves a table that no seal names; :meth:`Ledger.sweep` removes those.

Digests of tables don't depend on the order of rows or on partitions: the number of rows and two sums of 64-bit hashes, by
one aggregation. Stages must be deterministic functions of their inputs.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.sources.documents import names_in, read_document, remove, write_document


class LedgerError(ValueError):
    """What a ledger refuses."""


class ProtocolChanged(LedgerError):
    """A source, a parameter or the plan isn't what was frozen."""


class Tampered(LedgerError):
    """A sealed table isn't what was sealed."""


class OutOfOrder(LedgerError):
    """The sealed stages aren't the first ones of the plan."""


class NotSealed(LedgerError):
    """Something needs a stage that isn't sealed."""


@dataclass(frozen=True)
class Stage:
    """``make(spark, inputs)`` gets the tables that it ``needs`` by name (sources or stages before it)."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)

    def code(self) -> str:
        """The digest of the function's source, of its byte code where there is no source."""
        try:
            text = inspect.getsource(self.make)
        except (OSError, TypeError):
            text = repr((self.make.__code__.co_code, self.make.__code__.co_consts))
        return _digest(text)


def _digest(value: object) -> str:
    return hashlib.sha256((value if isinstance(value, str) else json.dumps(value, sort_keys=True)).encode()).hexdigest()


def table_digest(df: DataFrame) -> dict[str, object]:
    """Rows, schema and content of a table; equal for the same rows in any order. Floats count by value, maps by their text."""
    plain = [F.to_json(c).alias(c) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes]
    rows = df.select(*plain)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    total = lambda *more: F.sum(F.xxhash64(*more, *columns).cast("decimal(38,0)")).cast("string")
    r = rows.agg(F.count("*").alias("rows"), total().alias("a"), total(F.lit(1)).alias("b")).first()
    return {"rows": r["rows"], "schema": df.schema.simpleString(), "content": _digest(f"{r['a']}|{r['b']}")}


class Ledger:
    """The stages of a plan in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        #: What the last run did with each stage: ``ran`` or ``sealed``.
        self.did: dict[str, str] = {}

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _document(self, *parts: str) -> dict | None:
        text = read_document(self.spark, self._path(*parts))
        return None if text is None else json.loads(text)

    def freeze(self, stages: Sequence[Stage], sources: dict[str, DataFrame], params: dict | None = None) -> dict:
        """The protocol, written once; afterwards it must be the same."""
        known = set(sources)
        for s in stages:
            if s.name in known or not set(s.needs) <= known:
                raise LedgerError(f"stage {s.name} is named twice or needs what comes later")
            known.add(s.name)
        protocol = {
            "sources": {n: table_digest(df) for n, df in sorted(sources.items())}, "params": params or {},
            "plan": [[s.name, s.code(), list(s.needs), s.params] for s in stages],
        }
        protocol = json.loads(json.dumps(protocol))
        frozen = self._document("protocol.json")
        if frozen is None:
            write_document(self.spark, self._path("protocol.json"), json.dumps(protocol, sort_keys=True))
        elif frozen != protocol:
            moved = [f"source {n}" for n in sorted({*frozen["sources"], *protocol["sources"]}) if frozen["sources"].get(n) != protocol["sources"].get(n)]
            moved += ["parameters"] * (frozen["params"] != protocol["params"])
            was, now = ({x[0]: x for x in p["plan"]} for p in (frozen, protocol))
            moved += [f"stage {n}" for n in sorted({*was, *now}) if was.get(n) != now.get(n)]
            raise ProtocolChanged(f"changed since it was frozen: {', '.join(moved or ['order of stages'])}")
        return protocol

    def seal_of(self, stage: str) -> dict | None:
        return self._document("seals", f"{stage}.json")

    def table(self, stage: str, check: bool = True) -> DataFrame:
        """The table of a sealed stage, checked against its seal."""
        seal = self.seal_of(stage)
        if seal is None:
            raise NotSealed(f"stage {stage} is not sealed")
        try:
            df = self.spark.read.parquet(self._path("tables", seal["table"]))
            same = not check or table_digest(df) == seal["holds"]
        except Exception as e:  # a file that is gone or can't be read
            raise Tampered(f"the table of stage {stage} can't be read: {str(e).splitlines()[0]}") from e
        if not same:
            raise Tampered(f"the table of stage {stage} is not what was sealed")
        return df

    def run(self, stages: Sequence[Stage], sources: dict[str, DataFrame], params: dict | None = None) -> dict[str, DataFrame]:
        """The tables of all stages; sealed ones are checked and skipped, the others run in order."""
        protocol = self.freeze(stages, sources, params)
        sealed = [self.seal_of(s.name) is not None for s in stages]
        if sealed != sorted(sealed, reverse=True):
            raise OutOfOrder(f"sealed without what comes before: {[s.name for s, done in zip(stages, sealed, strict=True) if done]}")
        tables, self.did = dict(sources), {}
        digests = {n: d["content"] for n, d in protocol["sources"].items()}
        for stage, done in zip(stages, sealed, strict=True):
            made_from = _digest({"protocol": protocol["params"], "stage": [stage.name, stage.code(), stage.params], "inputs": {n: digests[n] for n in stage.needs}})
            if done:
                if self.seal_of(stage.name)["made_from"] != made_from:
                    raise Tampered(f"stage {stage.name} was sealed from other inputs")
                tables[stage.name] = self.table(stage.name)
            else:
                name = f"{stage.name}-{made_from[:16]}-{uuid.uuid4().hex[:8]}"
                stage.make(self.spark, {n: tables[n] for n in stage.needs}).write.parquet(self._path("tables", name))
                written = self.spark.read.parquet(self._path("tables", name))
                seal = {"stage": stage.name, "made_from": made_from, "table": name, "holds": table_digest(written)}
                write_document(self.spark, self._path("seals", f"{stage.name}.json"), json.dumps(seal, sort_keys=True))
                tables[stage.name] = written
            self.did[stage.name] = "sealed" if done else "ran"
            digests[stage.name] = self.seal_of(stage.name)["holds"]["content"]
        return {s.name: tables[s.name] for s in stages}

    def sweep(self) -> list[str]:
        """Remove the tables that no seal names, such as those of broken runs; their names."""
        seals = [self._document("seals", n) for n in names_in(self.spark, self._path("seals"))]
        named = {s["table"] for s in seals if s}
        gone = [n for n in names_in(self.spark, self._path("tables")) if n not in named]
        for n in gone:
            remove(self.spark, self._path("tables", n))
        return gone
