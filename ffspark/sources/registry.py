"""Models on shared storage: each save is a folder of its own, seen once it is committed.

Layout under the registry's path: ``data/<model>/<version>/<save>/params`` and ``/history`` hold Parquet tables,
``commits/<model>/<version>/<number>`` names the save that holds since then, and ``claims/<model>/<version>`` reserves a
new version for one writer. Readers look at commits only, so a save that broke off is never seen.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.functions.params import PARAM_SCHEMA, Params, from_frame, to_frame
from ffspark.sources.storage import claim, names_in, remove, text_of

HISTORY_SCHEMA = "model string, version int, iter int, cost double, l_rate double, best_cost double, elapsed_s double"


class ModelRegistry:
    """All models under one path, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, part: str, model: str, version: int | None = None) -> str:
        return f"{self.path}/{part}/{quote(model, safe='')}" + (f"/{version}" if version is not None else "")

    def versions(self, model: str) -> list[int]:
        """The committed versions, in order."""
        found = [int(v) for v in names_in(self.spark, self._at("commits", model))]
        return sorted(v for v in found if names_in(self.spark, self._at("commits", model, v)))

    def models(self) -> list[str]:
        return [unquote(m) for m in names_in(self.spark, f"{self.path}/commits") if self.versions(unquote(m))]

    def _saves(self, model: str | None = None, version: int | None = None) -> list[str]:
        """Folders of the saves that hold, of all models or one, all versions or one."""
        out = []
        for m in self.models() if model is None else [model]:
            for v in self.versions(m) if version is None else [version]:
                numbers = [n for n in names_in(self.spark, self._at("commits", m, v)) if n.isdigit()]
                if numbers:
                    out.append(f"{self._at('data', m, v)}/{text_of(self.spark, f'{self._at('commits', m, v)}/{max(numbers, key=int)}')}")
        return out

    def _table(self, part: str, schema: str, saves: list[str]) -> DataFrame:
        paths = [f"{s}/{part}" for s in saves if part in names_in(self.spark, s)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def params(self, model: str | None = None, version: int | None = None) -> DataFrame:
        """The parameter tables of all committed versions, or of those of one model, or of one version."""
        return self._table("params", PARAM_SCHEMA, self._saves(model, version))

    def histories(self, model: str | None = None, version: int | None = None) -> DataFrame:
        return self._table("history", HISTORY_SCHEMA, self._saves(model, version))

    def current_version(self, model: str) -> int:
        """The highest committed version, 0 if none."""
        return max(self.versions(model), default=0)

    def _claimed(self, model: str) -> int:
        """A version above all others, which no other writer gets."""
        taken = [int(v) for v in names_in(self.spark, self._at("claims", model))]
        version = max([self.current_version(model), *taken]) + 1
        while not claim(self.spark, self._at("claims", model, version)):
            version += 1
        return version

    def save(self, model: str, params: Params, overwrite: bool | int = True, history: list[tuple] | None = None) -> int:
        """Save the parameters (and trace). overwrite=True replaces the latest version, False adds one after it, a
        whole number replaces just that version; other versions stay. Returns the version.

        The tables are written first; one small file then makes the save visible as a whole. Writers that replace a
        version at once leave that of the later commit; writers that add one get a version each."""
        if not isinstance(overwrite, int):
            raise TypeError("overwrite must be True, False or a version")
        if overwrite is False or (overwrite is True and not self.versions(model)):
            version = self._claimed(model)
        else:
            version = self.current_version(model) if overwrite is True else overwrite
        if version < 1:
            raise ValueError("versions start at 1")
        tables = {"params": to_frame(self.spark, params, model, version)}
        if history:
            tables["history"] = self.spark.createDataFrame([(model, version, *r) for r in history], HISTORY_SCHEMA)
        self._commit(model, version, tables)
        return version

    def _commit(self, model: str, version: int, tables: dict[str, DataFrame]) -> None:
        own, commits = uuid.uuid4().hex, self._at("commits", model, version)
        for part, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{self._at('data', model, version)}/{own}/{part}")
        claim(self.spark, self._at("claims", model, version))
        number = max([int(n) for n in names_in(self.spark, commits) if n.isdigit()], default=0) + 1
        while not claim(self.spark, f"{commits}/{number}", own):
            number += 1

    def load(self, model: str, version: int | None = None) -> Params:
        """Parameters of a version, or of the latest; ValueError if there is none."""
        version = self.current_version(model) if version is None else version
        return from_frame(self._known(model, version))

    def _known(self, model: str, version: int) -> DataFrame:
        if not self._saves(model, version):
            raise ValueError(f"no version {version} of {model}")
        return self.params(model, version)

    def architecture(self, model: str, version: int) -> list[int]:
        """Layer widths from the table alone."""
        rows = self._known(model, version).where("kind = 'w'")
        sizes = rows.groupBy("layer").agg((F.max("i") + 1).alias("a"), (F.max("j") + 1).alias("b")).orderBy("layer").collect()
        return [sizes[0].a, *(r.b for r in sizes)]

    def clear(self, model: str, versions: list[int] | None = None) -> None:
        """Remove the given versions, or all: each is a folder of its own, and no other one is touched. A version is
        withdrawn before its tables go."""
        for part in ("commits", "data", "claims"):
            for path in [self._at(part, model)] if versions is None else [self._at(part, model, int(v)) for v in versions]:
                remove(self.spark, path)

    def tidy(self, model: str) -> None:
        """Remove the tables of saves that were replaced or broke off. No save may be under way."""
        for version in names_in(self.spark, self._at("data", model)):
            held = set(self._saves(model, int(version)))
            for save in names_in(self.spark, self._at("data", model, int(version))):
                path = f"{self._at('data', model, int(version))}/{save}"
                if path not in held:
                    remove(self.spark, path)

    def export_text(self, model: str, version: int, path: str) -> None:
        """Parameters as CSV, one value per line in long form."""
        rows = self._known(model, version).select("layer", "kind", "i", "j", "value", "model", "version")
        rows.orderBy("layer", "kind", "i", "j").coalesce(1).write.csv(path, header=True)

    def next_name(self) -> str:
        names = self.spark.createDataFrame([(m,) for m in self.models()], "name string")
        return f"model{next_free(names)}.model"


def model_file_name(name: str | None, used: DataFrame | None = None) -> str:
    """The given name with ``.model`` at its end, or without one the first free ``model<k>.model``."""
    if name:
        return name if name.endswith(".model") else f"{name}.model"
    if used is None:
        return "model0.model"
    return f"model{next_free(used)}.model"


def used_numbers(names: DataFrame, prefix: str = "model", suffix: str = ".model") -> DataFrame:
    """k for every name ``<prefix><k><suffix>`` with a whole number k of 0 or more; the rest is ignored."""
    quoted = lambda s: "".join(c if c.isalnum() else f"[{c}]" for c in s)
    k = F.try_to_number(F.regexp_extract("name", f"^{quoted(prefix)}([0-9]{{1,9}}){quoted(suffix)}$", 1), F.lit("999999999"))
    return names.select(k.cast("int").alias("k")).where("k IS NOT NULL").distinct()


def next_free_frame(names: DataFrame, prefix: str = "model", suffix: str = ".model") -> DataFrame:
    """One row: the smallest unused k of 0 or more. It is 0 or one more than a used number, so only those are tried."""
    used = used_numbers(names, prefix, suffix)
    tried = used.select((F.col("k") + 1).alias("k")).unionByName(names.sparkSession.range(1).select(F.col("id").cast("int").alias("k")))
    return tried.join(used, "k", "left_anti").agg(F.min("k").alias("k"))


def next_free(names: DataFrame, prefix: str = "model", suffix: str = ".model") -> int:
    return next_free_frame(names, prefix, suffix).first().k
