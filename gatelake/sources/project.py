"""A project: experiments, samples, populations and strategies in a folder of Parquet tables.

events/experiment_id=.../sample_id=.../source=... holds the matrices and membership/experiment_id=.../sample_id=.../population=.../members=... the members of
stored populations, so a sample or a population is read by its partition. Metadata are small tables.

A metadata table changes as a whole: its next state is written beside the present one and published under the next version number, which only one
writer can take; another one applies its change to what has been published meanwhile. Members are written first, to a folder of their own, which the
population's row names. So a change that is cut short leaves the old state, and nothing that is read is ever rewritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import transforms
from ..functions.transforms import compensate
from ..operators import populations as P
from ..operators import idsets, sampling
from ..operators.names import Panel, spill_matrix, standard_names
from ..plans import by_sample
from ..plans.strategy import Applied, Strategy

TABLES = {
    "experiments": "experiment_id string, panel string",
    "subjects": "subject_id string, attrs string",
    "samples": "experiment_id string, sample_id string, subject_id string, compensated boolean, valid boolean, notes string, controls array<string>, collected timestamp, processed timestamp, channels array<string>, markers array<string>",
    "populations": "experiment_id string, sample_id string, population string, parent string, source string, n long, frac_of_parent double, frac_of_root double, signature map<string,double>, members string",
    "strategies": "experiment_id string, name string, strategy string",
}

#: States of a table that are kept, for readers that are still at them; attempts at a change.
KEPT, ATTEMPTS = 10, 20


class Project:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def part(self, value: str) -> str:
        """A partition's value as Spark writes it in paths."""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def _path(self, table: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")

    def _fs(self, table: str):
        return self._path(table).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        return self._fs(table).exists(self._path(table))

    def _versions(self, name: str) -> list[int]:
        at = f"_versions/{name}"
        return sorted(int(f.getPath().getName()) for f in self._fs(at).listStatus(self._path(at))) if self.exists(at) else []

    def _folder_of(self, name: str, version: int) -> str:
        stream = self._fs(name).open(self._path(f"_versions/{name}/{version:012d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        """The present state of a metadata table."""
        return self._state(name)[1]

    def _state(self, name: str) -> tuple[int, DataFrame]:
        versions = self._versions(name)
        if not versions:
            return 0, self.spark.createDataFrame([], TABLES[name])
        return versions[-1], self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{self._folder_of(name, versions[-1])}")

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Publish change(table) as the table's next state; if another writer was first, the change is made again to its state."""
        for _ in range(ATTEMPTS):
            version, rows = self._state(name)
            fresh = f"tables/{name}/{uuid.uuid4().hex}"
            change(rows).coalesce(1).write.parquet(f"{self.folder}/{fresh}")
            if self._published(name, version + 1, fresh):
                for v in self._versions(name)[:-KEPT]:
                    old = self._folder_of(name, v)
                    self._fs(name).delete(self._path(f"_versions/{name}/{v:012d}"), False)
                    self._fs(name).delete(self._path(old), True)
                return
            self._fs(name).delete(self._path(fresh), True)
        raise RuntimeError(f"{name} was changed by others {ATTEMPTS} times")

    def _published(self, name: str, version: int, folder: str) -> bool:
        """Make `folder` the version's; False if the version is another writer's. The file appears with its content, or not at all."""
        at, draft = self._path(f"_versions/{name}/{version:012d}"), self._path(f"_drafts/{uuid.uuid4().hex}")
        fs = self._fs("_drafts")
        fs.mkdirs(at.getParent())
        stream = fs.create(draft, False)
        stream.write(folder.encode())
        stream.close()
        try:
            if fs.getScheme() == "file":  # where a rename would take the other one's place
                paths, files = self.spark._jvm.java.nio.file.Paths, self.spark._jvm.java.nio.file.Files
                files.createLink(paths.get(fs.makeQualified(at).toUri()), paths.get(fs.makeQualified(draft).toUri()))
                return True
            return fs.rename(draft, at)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)

    def _add(self, name: str, key: list[str], row: dict) -> None:
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.lit(row[k]))

        def more(old: DataFrame) -> DataFrame:
            if not old.where(same).isEmpty():
                raise ValueError(f"{name}: {', '.join(str(row[k]) for k in key)} exists")
            return old.unionByName(self.spark.createDataFrame([tuple(row.get(f) for f in old.schema.fieldNames())], old.schema))

        self._change(name, more)

    def add_experiment(self, experiment_id: str, panel: dict) -> Experiment:
        if problems := Panel.from_dict(panel).check():
            raise ValueError("; ".join(problems))
        self._add("experiments", ["experiment_id"], {"experiment_id": experiment_id, "panel": json.dumps(panel)})
        return Experiment(self, experiment_id)

    def experiment(self, experiment_id: str) -> Experiment:
        self._one("experiments", F.col("experiment_id") == experiment_id)
        return Experiment(self, experiment_id)

    def add_subject(self, subject_id: str, **attrs) -> None:
        self._add("subjects", ["subject_id"], {"subject_id": subject_id, "attrs": json.dumps(attrs)})

    def panel(self, experiment_id: str) -> Panel:
        return Panel.from_dict(json.loads(self._one("experiments", F.col("experiment_id") == experiment_id).panel))

    def subject(self, subject_id: str, missing_ok: bool = False) -> dict | None:
        row = self.table("subjects").where(F.col("subject_id") == subject_id).head()
        if row is None and not missing_ok:
            raise KeyError(subject_id)
        return None if row is None else json.loads(row.attrs)

    def _one(self, name: str, where: Column):
        row = self.table(name).where(where).head()
        if row is None:
            raise KeyError(f"nothing like this in {name}")
        return row

    def list_experiments(self) -> list[str]:
        return sorted(r[0] for r in self.table("experiments").select("experiment_id").collect())

    def list_subjects(self) -> list[str]:
        return sorted(r[0] for r in self.table("subjects").select("subject_id").collect())

    def list_samples(self, experiment_id: str, valid_only: bool = True) -> list[str]:
        rows = self.table("samples").where(F.col("experiment_id") == experiment_id)
        return sorted(r[0] for r in (rows.where("valid") if valid_only else rows).select("sample_id").collect())

    def samples_by_subject(self, experiment_id: str, query: Column) -> DataFrame:
        """Samples whose subject satisfies a condition on the subjects table (attrs is JSON)."""
        return samples_of_subjects(self.table("samples").where(F.col("experiment_id") == experiment_id), self.table("subjects"), query, "subject_id")

    def add_sample(self, experiment_id: str, sample_id: str, data: DataFrame, *, controls: dict[str, DataFrame] | None = None, subject_id: str | None = None, spill: tuple[list[str], list[list[float]]] | None = None, notes: str = "", channels: list[str] | None = None, markers: list[str] | None = None, collected: datetime | None = None, processed: datetime | None = None) -> Sample:
        """Store a sample's events and controls; columns of a spill matrix are compensated first. data may have event_id, else rows are numbered."""
        self._one("experiments", F.col("experiment_id") == experiment_id)
        if not self.table("samples").where((F.col("experiment_id") == experiment_id) & (F.col("sample_id") == sample_id)).isEmpty():
            raise ValueError(f"samples: {experiment_id}, {sample_id} exists")
        for source, df in {"primary": data, **(controls or {})}.items():  # what an addition that was cut short has left is written over
            self._write_events(experiment_id, sample_id, source, compensate(df, *spill) if spill else df)
        self._add("samples", ["experiment_id", "sample_id"], {"experiment_id": experiment_id, "sample_id": sample_id, "subject_id": subject_id, "compensated": spill is not None, "valid": True, "notes": notes, "controls": sorted(controls or {}), "collected": collected, "processed": processed, "channels": channels, "markers": markers})
        return Sample(self, experiment_id, sample_id)

    def _write_events(self, experiment_id: str, sample_id: str, source: str, df: DataFrame) -> None:
        df = df if "event_id" in df.columns else df.withColumn("event_id", F.monotonically_increasing_id())
        df.write.mode("overwrite").parquet(self.events_path(experiment_id, sample_id, source))

    def events_path(self, experiment_id: str, sample_id: str, source: str = "primary") -> str:
        return f"{self.folder}/events/experiment_id={self.part(experiment_id)}/sample_id={self.part(sample_id)}/source={self.part(source)}"

    def events(self, experiment_id: str, source: str = "primary") -> DataFrame:
        """All samples' events; partition filters on sample_id reach the scan."""
        root = f"{self.folder}/events"
        at = f"{root}/experiment_id={self.part(experiment_id)}"
        read = self.spark.read.option("basePath", root)
        found = read.option("mergeSchema", "true").parquet(at).schema
        names = ("experiment_id", "sample_id", "source")  # strings, whatever they look like
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in names else f for f in found.fields])
        return read.schema(schema).parquet(at).where(F.col("source") == source)

    def membership(self, experiment_id: str) -> DataFrame:
        """sample_id, population, event_id of all stored populations of an experiment."""
        schema = "event_id long, experiment_id string, sample_id string, population string, members string"
        root = f"{self.folder}/membership"
        if not self.exists(f"membership/experiment_id={self.part(experiment_id)}"):
            return self.spark.createDataFrame([], "sample_id string, population string, event_id long")
        known = self.table("populations").where(F.col("experiment_id") == experiment_id).select("sample_id", "population", "members")
        rows = self.spark.read.schema(schema).option("basePath", root).parquet(f"{root}/experiment_id={self.part(experiment_id)}")
        return rows.join(known, ["sample_id", "population", "members"], "left_semi").select("sample_id", "population", "event_id")

    def control_counts(self, experiment_id: str) -> DataFrame:
        return control_counts(self.table("samples").where(F.col("experiment_id") == experiment_id).select(F.explode("controls").alias("control")), self.table("samples").where(F.col("experiment_id") == experiment_id).count())

    def remove_sample(self, experiment_id: str, sample_id: str) -> None:
        gone = (F.col("experiment_id") == experiment_id) & (F.col("sample_id") == sample_id)
        for t in ("samples", "populations"):
            self._change(t, lambda rows: rows.where(~gone))
        for t in ("events", "membership"):
            self._fs(t).delete(self._path(f"{t}/experiment_id={self.part(experiment_id)}/sample_id={self.part(sample_id)}"), True)

    def drop_populations(self, experiment_id: str, gone: dict[str, list[str]]) -> None:
        """Forget populations, named by sample, in one change; then delete their members."""
        pairs = [F.struct(F.lit(s), F.lit(n)) for s, names in gone.items() for n in names]
        if not pairs:
            return
        self._change("populations", lambda rows: rows.where(~((F.col("experiment_id") == experiment_id) & F.struct("sample_id", "population").isin(pairs))))
        for s, names in gone.items():
            for n in names:
                self._fs("membership").delete(self._path(f"membership/experiment_id={self.part(experiment_id)}/sample_id={self.part(s)}/population={self.part(n)}"), True)

    def delete_experiment(self, experiment_id: str) -> None:
        for t in ("experiments", "samples", "populations", "strategies"):
            self._change(t, lambda rows: rows.where(F.col("experiment_id") != experiment_id))
        for t in ("events", "membership"):
            self._fs(t).delete(self._path(f"{t}/experiment_id={self.part(experiment_id)}"), True)


def samples_of_subjects(samples: DataFrame, subjects: DataFrame, query: Column, key: str) -> DataFrame:
    """Samples whose subject satisfies a condition."""
    return samples.join(subjects.where(query).select(key), key, "left_semi")


def control_counts(controls: DataFrame, total: int) -> DataFrame:
    """control, n: how many samples have each control, and all samples as 'total'."""
    each = controls.groupBy("control").agg(F.count("*").alias("n"))
    return each.unionByName(controls.sparkSession.createDataFrame([("total", total)], "control string, n long"))


def with_subject(events: DataFrame, subjects: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Events with fields of their subject; null where there is none."""
    return events.join(subjects.select(key, *fields), key, "left")


class Experiment:
    """Samples that share a panel."""

    def __init__(self, project: Project, experiment_id: str) -> None:
        self.project, self.id = project, experiment_id

    @property
    def panel(self) -> Panel:
        return self.project.panel(self.id)

    def sample(self, sample_id: str) -> Sample:
        self.project._one("samples", (F.col("experiment_id") == self.id) & (F.col("sample_id") == sample_id))
        return Sample(self.project, self.id, sample_id)

    def list_samples(self, valid_only: bool = True) -> list[str]:
        return self.project.list_samples(self.id, valid_only)

    def add_dataframes(self, sample_id: str, primary: DataFrame, mappings: list[tuple[str, str | None]], *, controls: dict[str, DataFrame] | None = None, spill: tuple[list[str], list[list[float]]] | None = None, missing: str = "raise", **more) -> Sample:
        """Store tables whose columns are the channels of `mappings`, after names are made standard by the panel; missing='warn' lets panel channels be absent."""
        names = standard_names(self.project.spark, mappings, self.panel, missing)
        fresh = {old: new for (old, _), (new, _) in zip(mappings, names, strict=True)}
        renamed = lambda df: df.withColumnsRenamed({o: n for o, n in fresh.items() if o in df.columns})
        channels, markers = [c for c, _ in names], [m or "" for _, m in names]
        own_spill = ([fresh.get(c, c) for c in spill[0]], spill[1]) if spill else None
        return self.project.add_sample(self.id, sample_id, renamed(primary), controls={k: renamed(v) for k, v in (controls or {}).items()}, spill=own_spill, channels=channels, markers=markers, **more)

    def add_fcs(self, sample_id: str, path: str, *, controls: dict[str, str] | None = None, compensated: bool = True, spill: tuple[list[str], list[list[float]]] | None = None, **more) -> Sample:
        """Read FCS files, compensate by their own spill matrix (or the given one), and store them as `add_dataframes` does."""
        from . import fcs

        spark = self.project.spark
        fcs.register(spark)

        def read(at: str) -> tuple[DataFrame, list[tuple[str, str]], str | None]:
            meta = spark.read.format("fcs").option("part", "meta").option("excludeCompensation", "false").load(at).head()
            if meta is None:
                raise ValueError(f"{at} can't be read")
            pairs = [tuple(c) for c in meta.channels]
            events = spark.read.format("fcs").option("excludeCompensation", "false").load(at)
            return events.select("event_id", *[F.col("values")[i].cast("double").alias(c) for i, (c, _) in enumerate(pairs)]), pairs, meta.spill

        data, pairs, keyword = read(path)
        if spill is None and compensated and keyword:
            spill = spill_matrix(keyword)
        return self.add_dataframes(sample_id, data, pairs, controls={k: read(v)[0] for k, v in (controls or {}).items()}, spill=spill if compensated else None, **more)

    def remove_sample(self, sample_id: str) -> None:
        self.project.remove_sample(self.id, sample_id)

    def delete_all_populations(self, sample_id: str | None = None) -> None:
        """Leave the root of one sample, or of all."""
        known = self.project.table("populations").where(F.col("experiment_id") == self.id)
        gone: dict[str, list[str]] = {}
        for r in (known if sample_id is None else known.where(F.col("sample_id") == sample_id)).select("sample_id", "population").collect():
            gone.setdefault(r.sample_id, []).append(r.population)
        self.project.drop_populations(self.id, gone)

    def population(self, name: str, *, transform: str | None = None, features: list[str] | None = None, transform_params: dict | None = None, fields: list[str] | None = None) -> DataFrame:
        """Events of a population over all samples with sample_id and subject_id (and JSON fields of the subject), features transformed."""
        events = self.project.events(self.id)
        events = P.load(events, self.project.membership(self.id), name)
        samples = self.project.table("samples").where(F.col("experiment_id") == self.id).select("sample_id", "subject_id")
        out = events.drop("experiment_id", "source").join(samples, "sample_id", "left")
        if fields:
            of = self.project.table("subjects").select("subject_id", *[F.get_json_object("attrs", f"$.{f}").alias(f) for f in fields])
            out = with_subject(out, of, "subject_id", fields)
        return transforms.apply(out, features, transform, transform_params) if transform and features else out

    def control_population(self, name: str, control: str, **kwargs) -> DataFrame:
        """Events of a control, over all samples that have it, that look like the members of a population; see operators.controls."""
        from ..operators.controls import control_populations

        there = [r.sample_id for r in self.project.table("samples").where((F.col("experiment_id") == self.id) & F.array_contains("controls", control)).collect()]
        own = F.col("sample_id").isin(there)
        primary, beside = (self.project.events(self.id, s).drop("experiment_id", "source").where(own) for s in ("primary", control))
        members = self.project.membership(self.id).where(own & (F.col("population") == name))
        return control_populations(primary, beside, members, **kwargs)

    def apply(self, strategy: Strategy, samples: list[str] | None = None, *, reference: str | None = None, control: str | None = None, normalise: bool = False, search: bool = False, params: dict[str, dict] | None = None) -> dict[str, str]:
        """Fit a strategy to each sample and store the populations; gives what went wrong, by sample, and goes on with the others.

        All samples are fitted in one plan and stored in one change, unless the strategy needs a plan a sample (see `by_sample.covers`).
        """
        wanted, out = list(samples or self.list_samples()), {}
        if not by_sample.covers(strategy, search):
            for s in wanted:
                try:
                    self.sample(s).apply(strategy, reference=reference, control=control, normalise=normalise, search=search, params=params)
                except (KeyError, ValueError) as e:
                    out[s] = str(e)
            return out
        new = [n for n, p in strategy.tree() if p is not None]
        known = self.project.table("populations").where((F.col("experiment_id") == self.id) & F.col("population").isin(new))
        for r in known.groupBy("sample_id").agg(F.array_sort(F.collect_list("population")).alias("names")).where(F.col("sample_id").isin(wanted)).collect():
            out[r.sample_id] = f"{r.sample_id} has {', '.join(r.names)} already"
        events = self.project.events(self.id).drop("experiment_id", "source")
        other = self.sample(reference).data() if reference else None
        beside = self.project.events(self.id, control).drop("experiment_id", "source") if control else None
        while left := [s for s in wanted if s not in out]:
            try:
                done = by_sample.fitted(strategy, events.where(F.col("sample_id").isin(left)), reference=other, control=beside, normalise=normalise, params=params)
            except by_sample.TooFew as e:
                out |= {s: str(e) for s in e.samples}
                continue
            self._store(done)
            break
        return out

    def _store(self, done: by_sample.Fitted) -> None:
        """Members by sample and population, then a row for each of both, in one change."""
        fresh, names = uuid.uuid4().hex, list(done.definitions)
        at = f"{self.project.folder}/membership/experiment_id={self.project.part(self.id)}"
        done.membership().select("event_id", "sample_id", "population", F.lit(fresh).alias("members")).write.mode("append").partitionBy("sample_id", "population", "members").parquet(at)
        schema = "event_id long, sample_id string, population string, members string"
        stored = self.project.spark.read.schema(schema).parquet(at).where(F.col("members") == fresh).select("sample_id", "population", "event_id")
        tree = self.project.spark.createDataFrame(P.tree_of(done.definitions), "population string, parent string")
        stats = P.stats(stored, tree, done.events.groupBy("sample_id").agg(F.count("*").alias("n"))).where(F.col("population") != P.ROOT)
        rows = stats.select(F.lit(self.id).alias("experiment_id"), "sample_id", "population", "parent", F.lit("gate").alias("source"), "n", "frac_of_parent", "frac_of_root", F.lit(None).cast("map<string,double>").alias("signature"), F.lit(fresh).alias("members"))

        def change(known: DataFrame) -> DataFrame:
            same = known.where((F.col("experiment_id") == self.id) & F.col("population").isin(names)).join(done.samples, "sample_id", "left_semi")
            if not same.isEmpty():
                raise ValueError(f"{same.head().sample_id} has {same.head().population} already")
            return known.unionByName(rows)

        self.project._change("populations", change)

    def statistics(self) -> DataFrame:
        """sample_id, population, parent, n and shares of every stored population in every sample; 0 where a sample has none."""
        events, members = self.project.events(self.id), self.project.membership(self.id)
        known = self.project.table("populations").where(F.col("experiment_id") == self.id)
        root = self.project.spark.createDataFrame([(P.ROOT, None)], "population string, parent string")
        return P.stats(members, root.unionByName(known.select("population", "parent").distinct()), events.groupBy("sample_id").agg(F.count("*").alias("n")))

    def merge_populations(self, mergers: dict[str, list[str]]) -> dict[str, list[str]]:
        """New populations as unions of others, in all samples that have them; gives the samples left out, by name.

        One plan and one change for each new population, whatever the number of samples. Later ones may be made of earlier ones.
        """
        out = {}
        for name, parts in mergers.items():
            able, parts = None, list(dict.fromkeys(parts))
            if len(parts) > 1 and name not in parts:
                known = self.project.table("populations").where(F.col("experiment_id") == self.id)
                there = known.where(F.col("population").isin([name, *parts])).groupBy("sample_id")
                of = F.col("population").isin(parts)
                able = there.agg(F.count_if(of).alias("k"), F.count_distinct(F.when(of, F.col("parent"))).alias("parents"), F.count_if(~of).alias("again"), F.min(F.when(of, F.col("parent"))).alias("parent"))
                able = able.where((F.col("k") == len(parts)) & (F.col("parents") == 1) & (F.col("again") == 0)).select("sample_id", "parent")
            done = self._combine(name, "or", parts, able, "merged") if able is not None else set()
            out[name] = [s for s in self.list_samples(False) if s not in done]
        return out

    def _combine(self, name: str, how: str, parts: list[str], able: DataFrame, source: str) -> set[str]:
        """Store a set of populations in the samples of able(sample_id, parent); gives these samples. Signatures are the means of the parts'."""
        samples = {r.sample_id: r.parent for r in able.collect()}
        if not samples:
            return set()
        spark, fresh = self.project.spark, uuid.uuid4().hex
        at = f"{self.project.folder}/membership/experiment_id={self.project.part(self.id)}"
        able = spark.createDataFrame(list(samples.items()), "sample_id string, parent string")
        members = self.project.membership(self.id).join(able, "sample_id", "left_semi")
        idsets.combined(members, {name: (how, parts)}).select("event_id", "sample_id", "population", F.lit(fresh).alias("members")).write.mode("append").partitionBy("sample_id", "population", "members").parquet(at)
        stored = spark.read.schema("event_id long, sample_id string, population string, members string").parquet(at).where((F.col("population") == name) & (F.col("members") == fresh))
        counts = stored.groupBy("sample_id").agg(F.count("*").alias("n"))
        totals = self.project.events(self.id).groupBy("sample_id").agg(F.count("*").alias("total"))

        def change(rows: DataFrame) -> DataFrame:
            own = rows.where(F.col("experiment_id") == self.id)
            if again := own.where(F.col("population") == name).join(able, "sample_id", "left_semi").head():
                raise ValueError(f"{again.sample_id}: {name!r} was changed by another writer")
            above = own.select("sample_id", F.col("population").alias("parent"), F.col("n").alias("above"))
            cells = own.where(F.col("population").isin(parts)).select("sample_id", F.explode("signature").alias("feature", "value")).groupBy("sample_id", "feature").agg(F.avg("value").alias("value"))
            signatures = cells.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("signature"))
            new = able.join(counts, "sample_id", "left").join(totals, "sample_id", "left").join(above, ["sample_id", "parent"], "left").join(signatures, "sample_id", "left")
            n, total = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("total", F.lit(0).cast("long"))
            share = lambda of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
            return rows.unionByName(new.select(F.lit(self.id).alias("experiment_id"), "sample_id", F.lit(name).alias("population"), "parent", F.lit(source).alias("source"), n.alias("n"), share(F.when(F.col("parent") == P.ROOT, total).otherwise(F.col("above"))).alias("frac_of_parent"), share(total).alias("frac_of_root"), "signature", F.lit(fresh).alias("members")))

        self.project._change("populations", change)
        return set(samples)

    def misplaced(self) -> DataFrame:
        """sample_id, population, n, n_outside of stored populations that have members their parent lacks (as when the parent was given new members)."""
        known = self.project.table("populations").where((F.col("experiment_id") == self.id) & (F.col("parent") != P.ROOT))
        members = self.project.membership(self.id)
        return idsets.outside(members, known.select("sample_id", "population", "parent")).where("n_outside > 0")

    def reference_sample(self, sample_id: str, *, size: int | float = 2500, population: str = P.ROOT, samples: list[str] | None = None, seed: int = 42) -> Sample:
        """Store a pool of a sample of each sample's events as a sample of its own; `original` and `original_id` say where an event is from."""
        known = self.list_samples(False)
        if samples and not set(samples) <= set(known):
            raise ValueError("not all samples are in the experiment")
        pool = self.population(population).where(F.col("sample_id").isin(samples or known)).drop("subject_id")
        some = sampling.uniform(pool.withColumn("_id", F.concat_ws(":", "sample_id", "event_id")), size, id_col="_id", by=["sample_id"], seed=seed).drop("_id")
        some = some.withColumnsRenamed({"sample_id": "original", "event_id": "original_id"})
        return self.project.add_sample(self.id, sample_id, some, notes="sampled data")

    def save_corrected(self, corrected: DataFrame, prefix: str = "Corrected_") -> list[str]:
        """Store batch-corrected events (sample_id, event_id, features) as new samples, each for the subject of its original."""
        subjects = {r.sample_id: r.subject_id for r in self.project.table("samples").where(F.col("experiment_id") == self.id).collect()}
        out = []
        for s in sorted(r.sample_id for r in corrected.select("sample_id").distinct().collect()):
            self.project.add_sample(self.id, f"{prefix}{s}", corrected.where(F.col("sample_id") == s).drop("sample_id"), subject_id=subjects.get(str(s)), notes="batch corrected")
            out.append(f"{prefix}{s}")
        return out

    def save_strategy(self, strategy: Strategy) -> None:
        """Keep a strategy by name; an older one of that name is replaced."""
        row = self.project.spark.createDataFrame([(self.id, strategy.name, strategy.to_json())], TABLES["strategies"])
        self.project._change("strategies", lambda rows: rows.where(~self._is(strategy.name)).unionByName(row))

    def _is(self, strategy: str) -> Column:
        return (F.col("experiment_id") == self.id) & (F.col("name") == strategy)

    def strategy(self, name: str) -> Strategy:
        return Strategy.from_json(self.project._one("strategies", self._is(name)).strategy)

    def delete_strategy(self, name: str, populations: bool = True) -> None:
        """Forget a strategy and, unless told otherwise, the populations that it has made in all samples, with all below them."""
        if populations:
            made = {n for n, p in self.strategy(name).tree() if p is not None}
            trees: dict[str, dict[str, str]] = {}
            for r in self.project.table("populations").where(F.col("experiment_id") == self.id).collect():  # a row a population
                trees.setdefault(r.sample_id, {})[r.population] = r.parent
            self.project.drop_populations(self.id, {s: [n for n in tree if n in made or any(P._is_below(n, m, tree) for m in made)] for s, tree in trees.items()})
        self.project._change("strategies", lambda rows: rows.where(~self._is(name)))


class Sample:
    """One sample's events, controls and populations."""

    def __init__(self, project: Project, experiment_id: str, sample_id: str) -> None:
        self.project, self.experiment_id, self.id = project, experiment_id, sample_id
        self._own = (F.col("experiment_id") == experiment_id) & (F.col("sample_id") == sample_id)

    def record(self):
        return self.project._one("samples", self._own)

    def data(self, source: str = "primary", *, size: int | float | None = None, prefer: str = "channels", seed: int = 42) -> DataFrame:
        """Events of the primary staining or a control: all, or a sample; columns named by channels, or by markers where there are any."""
        if not self.project.exists(f"events/experiment_id={self.project.part(self.experiment_id)}/sample_id={self.project.part(self.id)}/source={self.project.part(source)}"):
            raise KeyError(f"{self.id} has no {source}")
        df = self.project.spark.read.parquet(self.project.events_path(self.experiment_id, self.id, source)).withColumn("sample_id", F.lit(self.id))
        row = self.record()
        if prefer == "markers" and row.channels:
            df = df.withColumnsRenamed({c: m for c, m in zip(row.channels, row.markers, strict=True) if m and m.strip()})
        return sampling.uniform(df, size, seed=seed) if size is not None else df

    def _ids(self) -> DataFrame:
        """event_id of the primary events; no other column's schema is looked up."""
        at = self.project.events_path(self.experiment_id, self.id)
        if not self.project.exists(at.removeprefix(f"{self.project.folder}/")):
            raise KeyError(f"{self.id} has no primary")
        return self.project.spark.read.schema("event_id long").parquet(at)

    def add_control(self, name: str, data: DataFrame) -> None:
        """Store one more control."""
        row = self.record()
        if name in (row.controls or []):
            raise ValueError(f"{self.id} has a control {name!r} already")
        self.project._write_events(self.experiment_id, self.id, name, data)
        grown = F.when(self._own, F.array_sort(F.concat(F.coalesce("controls", F.array().cast("array<string>")), F.array(F.lit(name))))).otherwise(F.col("controls"))
        self.project._change("samples", lambda rows: rows.withColumn("controls", grown))

    # --- populations

    def known(self) -> dict:
        """The sample's populations' rows by name, in one read."""
        return {r.population: r for r in sorted(self.project.table("populations").where(self._own).collect(), key=lambda r: r.population)}

    def tree(self, known: dict | None = None) -> list[tuple[str, str | None]]:
        return [(P.ROOT, None), *((n, r.parent) for n, r in (self.known() if known is None else known).items())]

    def list_populations(self) -> list[str]:
        return [n for n, _ in self.tree()]

    def population(self, name: str):
        """The population's row: parent, source, n, shares, signature."""
        return self.project._one("populations", self._own & (F.col("population") == name))

    def children(self, parent: str) -> list[str]:
        return [n for n, p in self.tree() if p == parent]

    def downstream(self, name: str, known: dict | None = None) -> list[str]:
        """All populations below one, in depth-first order."""
        tree = self.tree(known)
        parents = dict(tree)
        if name not in parents:
            raise KeyError(f"no population {name!r}")
        return [n for n in P.preorder(tree) if P._is_below(n, name, parents)]

    def print_tree(self) -> str:
        return P.print_tree(self.tree())

    def _members_path(self, name: str, members: str) -> str:
        return f"membership/experiment_id={self.project.part(self.experiment_id)}/sample_id={self.project.part(self.id)}/population={self.project.part(name)}/members={members}"

    def members(self, name: str, known: dict | None = None) -> DataFrame | None:
        """event_id of a stored population; None if there is none."""
        if name == P.ROOT:
            return self._ids()
        row = (self.known() if known is None else known).get(name)
        if row is None:
            return None
        if not self.project.exists(self._members_path(name, row.members)):  # none in this sample
            return self.project.spark.createDataFrame([], "event_id long")
        return self.project.spark.read.schema("event_id long").parquet(f"{self.project.folder}/{self._members_path(name, row.members)}")

    def add_population(self, name: str, parent: str, members: DataFrame, source: str = "gate", signature: dict[str, float] | None = None) -> None:
        """Store a population by its members' event_id, which must be among its parent's."""
        self._store(name, parent, members.select("event_id").distinct(), source, signature, self.known())

    def update_population(self, name: str, members: DataFrame, signature: dict[str, float] | None = None) -> None:
        """New members for a population; what is below it stays as it is stored. Until the change is published the old ones are read."""
        known = self.known()
        if name not in known:
            raise KeyError(f"no population {name!r}")
        old = known[name]
        self._store(name, old.parent, members.select("event_id").distinct(), old.source, signature or old.signature, known, old.members)

    def _store(self, name: str, parent: str, ids: DataFrame, source: str, signature: dict | None, known: dict, instead_of: str | None = None) -> None:
        if instead_of is None and (name in known or name == P.ROOT):
            raise ValueError(f"{self.id} has a population {name!r} already")
        inside = self.members(parent, known)
        if inside is None:
            raise KeyError(f"no population {parent!r}")
        fresh = uuid.uuid4().hex
        path = f"{self.project.folder}/{self._members_path(name, fresh)}"
        ids.write.parquet(path)
        stored = self.project.spark.read.schema("event_id long").parquet(path)
        sides = stored.select("event_id", F.lit("own").alias("population")).unionByName(inside.select("event_id", F.lit("above").alias("population")))
        n, lacking = (r.n for r in idsets.sizes(sides, {"own": ("or", ["own"]), "lacking": ("not", ["own", "above"])}, ()).collect())
        if lacking:
            self.project._fs("membership").delete(self.project._path(self._members_path(name, fresh)), True)
            raise ValueError(f"{name} has events that {parent} hasn't")
        total = self._ids().count()
        above = total if parent == P.ROOT else known[parent].n
        row = self.project.spark.createDataFrame([(self.experiment_id, self.id, name, parent, source, n, n / above if above else 0.0, n / total if total else 0.0, signature, fresh)], TABLES["populations"])

        def change(rows: DataFrame) -> DataFrame:
            same = self._own & (F.col("population") == name)
            there = rows.where(same).head()
            if (there.members if there else None) != instead_of:
                raise ValueError(f"{self.id}: {name!r} was changed by another writer")
            return rows.where(~same).unionByName(row)

        self.project._change("populations", change)
        if instead_of:
            self.project._fs("membership").delete(self.project._path(self._members_path(name, instead_of)), True)

    def save(self, definitions: dict[str, tuple[str, Column]], source: str = "gate") -> None:
        """Store all populations of a strategy (or what it was applied as): one scan for the members, one row each with counts and shares."""
        if again := sorted(set(definitions) & set(self.known())):
            raise ValueError(f"{self.id} has {', '.join(again)} already")
        events = self.data()
        base = f"{self.project.folder}/membership/experiment_id={self.project.part(self.experiment_id)}/sample_id={self.project.part(self.id)}"
        fresh = uuid.uuid4().hex
        P.gated(events, definitions).select("event_id", "population", F.lit(fresh).alias("members")).write.mode("append").partitionBy("population", "members").parquet(base)
        stored = self.project.spark.read.schema("event_id long, population string, members string").parquet(base).where(F.col("members") == fresh).select(F.lit(self.id).alias("sample_id"), "population", "event_id")
        stats = P.stats(stored, self.project.spark.createDataFrame(P.tree_of(definitions), "population string, parent string"), events.groupBy("sample_id").agg(F.count("*").alias("n"))).where(F.col("population") != P.ROOT)
        rows = stats.select(F.lit(self.experiment_id).alias("experiment_id"), "sample_id", "population", "parent", F.lit(source).alias("source"), "n", "frac_of_parent", "frac_of_root", F.lit(None).cast("map<string,double>").alias("signature"), F.lit(fresh).alias("members"))

        def change(known: DataFrame) -> DataFrame:
            if again := [r.population for r in known.where(self._own & F.col("population").isin(list(definitions))).collect()]:
                raise ValueError(f"{self.id} has {', '.join(again)} already")
            return known.unionByName(rows)

        self.project._change("populations", change)

    def delete_populations(self, names: list[str]) -> list[str]:
        """Delete populations and all below them; ["all"] leaves the root. Gives what is gone."""
        known = self.known()
        gone = list(known) if names == ["all"] else sorted({*names, *(d for n in names for d in self.downstream(n, known))})
        if P.ROOT in gone:
            raise ValueError("the root stays")
        self.project.drop_populations(self.experiment_id, {self.id: gone})
        return gone

    def _combined(self, how: str, names: list[str], known: dict) -> DataFrame:
        parts = [self.members(n, known).withColumn("population", F.lit(n)) for n in dict.fromkeys(names)]
        return idsets.combined(reduce(DataFrame.unionByName, parts), {"set": (how, names)}, ()).select("event_id")

    def merge(self, names: list[str], name: str) -> None:
        """Store the union of populations of one parent; signatures are averaged."""
        known = self.known()
        if missing := [n for n in names if n not in known]:
            raise KeyError(f"no population {', '.join(missing)}")
        rows = [known[n] for n in names]
        if len({r.parent for r in rows}) != 1 or len(rows) < 2:
            raise ValueError("two populations or more of one parent are merged")
        ids = self._combined("or", names, known)
        kept = [r.signature for r in rows if r.signature]
        mean = {f: sum(s[f] for s in kept if f in s) / sum(f in s for s in kept) for f in sorted({f for s in kept for f in s})}
        self._store(name, rows[0].parent, ids, "merged", mean or None, known)

    def subtract(self, left: str, right: list[str], name: str) -> None:
        """Store the events of one population that are in none of the others, which have its parent or are below it."""
        known = self.known()
        if missing := [n for n in (left, *right) if n not in known]:
            raise KeyError(f"no population {', '.join(missing)}")
        own, below = known[left], self.downstream(left, known)
        if wrong := [n for n in right if n not in below and known[n].parent != own.parent]:
            raise ValueError(f"{', '.join(wrong)}: neither below {left} nor of its parent")
        ids = self._combined("not", [left, *right], known)
        self._store(name, own.parent, ids, "subtracted", None, known)

    def population_stats(self, name: str) -> dict:
        """n and its shares of parent and root; zeros for a population that isn't there."""
        if name == P.ROOT:
            return {"population": name, "n": self._ids().count(), "frac_of_parent": 1.0, "frac_of_root": 1.0}
        row = self.project.table("populations").where(self._own & (F.col("population") == name)).head()
        return {"population": name, "n": row.n if row else 0, "frac_of_parent": row.frac_of_parent if row else 0.0, "frac_of_root": row.frac_of_root if row else 0.0}

    def load_population(self, name: str, *, transform: str | None = "logicle", features: list[str] | None = None, transform_params: dict | None = None, label: bool = False) -> DataFrame:
        """Events of a population, features transformed; with `label`, each has in population_label the deepest population below it that it is in."""
        ids = self.members(name)
        if ids is None:
            raise KeyError(f"no population {name!r}")
        out = self.data() if name == P.ROOT else self.data().join(ids, "event_id", "left_semi")
        if label:
            out = P.deepest_label(out, self.project.membership(self.experiment_id).where(F.col("sample_id") == self.id), self.tree(), name)
        if transform:
            features = features or [c for c, t in out.dtypes if t in ("double", "float")]
            out = transforms.apply(out, features, transform, transform_params)
        return out

    def apply(self, strategy: Strategy, *, reference: str | None = None, control: str | None = None, normalise: bool = False, search: bool = False, params: dict[str, dict] | None = None) -> Applied:
        """Fit a strategy's gates anew to this sample and store the populations; see Strategy.applied. reference and control name a sample and a control."""
        other = Sample(self.project, self.experiment_id, reference).data() if reference else None
        beside = self.data(control) if control else None
        done = strategy.applied(self.data(), reference=other, control=beside, normalise=normalise, search=search, params=params)
        self.save(done.definitions)
        return done

    def control_population(self, control: str, name: str, **kwargs) -> DataFrame:
        """The control's events that look like the members of a population; see operators.controls."""
        from ..operators.controls import control_population

        members = self.members(name)
        if members is None:
            raise KeyError(f"no population {name!r}")
        return control_population(self.data(), self.data(control), members, **kwargs)

    def delete(self) -> None:
        self.project.remove_sample(self.experiment_id, self.id)
