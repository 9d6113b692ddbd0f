"""The star schema at rest, laid out for its joins and its deletes.

Every table is a folder a run, and within a run as many buckets as the star has, by the observation that rows belong to;
buckets are sorted by observation and by the order that exports show. So an export groups and joins satellites where they
lie, without an exchange, a run's filter reads that run's folders of every table, and a run goes by deleting folders: no
other file is rewritten. Observations carry Bloom filters on both domains, so a lookup of one domain reads the row groups
that may hold it.

Writing a run replaces that run's folders of that table only, so repeating a write gives the same table. Tables are
registered in a session of their own, whose settings suit them: sorted aggregation, bucket order as sort order, no
broadcasts (which would be exchanges), folders listed instead of catalogued.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators.export import ONES, SATELLITES, Colocated

RUN = "run_id"
SETTINGS = {
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.hive.manageFilesourcePartitions": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}
#: What a session of one's own does not inherit by itself.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")
BLOOM = ("initial_domain", "final_domain")


def sorted_by(name: str, columns: list[str]) -> list[str]:
    """The columns by which a satellite's rows lie within an observation: those that order its export, then the others it shows."""
    for table, kinds, order in [*SATELLITES.values(), *((t, k, []) for t, k in ONES.values())]:
        if table == name:
            return [c for c in [*order, *(k for k in kinds if k not in order)] if c in columns]
    return []


@dataclass
class Star:
    """A star's folder and its number of buckets, which is fixed when it is first written."""

    session: SparkSession
    root: str
    buckets: int
    by_run: bool

    @classmethod
    def at(cls, spark: SparkSession, root: str, buckets: int | None = None, by_run: bool = True) -> Star:
        """The star in a folder; a new one needs its number of buckets (a bucket of a run should be some 100 MB at most). A star that is
        always written and exported whole can do without folders by run: its buckets are one sorted file each."""
        own = spark.newSession()
        for key in INHERITED:
            if (value := spark.conf.get(key, None)) is not None:
                own.conf.set(key, value)
        for key, value in SETTINGS.items():
            own.conf.set(key, value)
        layout = f"{root}/_layout"
        if exists(own, layout):
            buckets, by_run = own.read.schema("buckets int, by_run boolean").json(layout).first()
        elif buckets:
            own.createDataFrame([(buckets, by_run)], "buckets int, by_run boolean").coalesce(1).write.json(layout)
        else:
            raise ValueError("a new star needs a number of buckets")
        return cls(own, root, buckets, by_run)

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Write the runs that the tables hold. Satellites get their observation's run from url_status (given, or stored already);
        rows of no observation are left out. Each table is dealt out to its buckets once."""
        facts = tables["url_status"] if "url_status" in tables else self.table("url_status")
        of = facts.select(F.col("id").alias("url_status_id"), RUN)
        for name, df in tables.items():
            key = key_of(name)
            if RUN not in df.columns:
                if name == "url_jwt_claims":
                    secrets = tables["url_exposed_secrets"].select(F.col("id").alias("exposed_secret_id"), "url_status_id")
                    df = df.join(secrets.join(of, "url_status_id"), "exposed_secret_id")  # claims lie with their secrets
                else:
                    df = df.join(of, "url_status_id")
            df = df.select(*(c for c in df.columns if c != RUN), F.coalesce(F.col(RUN).cast("string"), F.lit("")).alias(RUN))
            order = [key, *sorted_by(name, df.columns)]
            self.create(name, df, key, order)
            view = f"_new_{uuid.uuid4().hex}"
            df.repartition(self.buckets, key).createOrReplaceGlobalTempView(view)
            try:
                self.session.sql(f"INSERT OVERWRITE TABLE {self.named(name)} SELECT {', '.join(quoted(c) for c in df.columns)} FROM global_temp.{view}")
            finally:
                self.session.catalog.dropGlobalTempView(view)
            self.session.catalog.refreshTable(self.named(name))

    def named(self, name: str) -> str:
        """The table's name in the catalog, which stars in other folders don't share."""
        return f"star_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{name}"

    def create(self, name: str, df: DataFrame, key: str, order: list[str]) -> None:
        if self.session.catalog.tableExists(self.named(name)):
            return
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)
        bloom = {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOM if name == "url_status" and c in df.columns}
        options = f"OPTIONS ({', '.join(f"'{k}' '{v}'" for k, v in bloom.items())})" if bloom else ""
        by = ", ".join(quoted(c) for c in order)
        self.session.sql(f"CREATE TABLE {self.named(name)} ({columns}) USING parquet {options} {f"PARTITIONED BY ({RUN})" if self.by_run else ""} CLUSTERED BY ({quoted(key)}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def table(self, name: str) -> DataFrame:
        if not self.session.catalog.tableExists(self.named(name)):
            df = self.session.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
            df = df.select(*(c for c in df.columns if c != RUN), F.col(RUN).cast("string").alias(RUN))
            key = key_of(name)
            self.create(name, df, key, [key, *sorted_by(name, df.columns)])
        return self.session.table(self.named(name))

    def tables(self, *names: str) -> Colocated:
        """The stored tables, for export.wide(): their joins by observation need no exchange."""
        known = names or [t for t in ("url_status", "url_jwt_claims", *(t for t, *_ in (*SATELLITES.values(), *ONES.values()))) if exists(self.session, f"{self.root}/{t}")]
        return Colocated({name: self.table(name) for name in known})

    def drop_runs(self, *run_ids: str) -> int:
        """Cascade delete: every table's folders of these runs go, and nothing else is touched. Returns the number of folders."""
        if not self.by_run:
            raise ValueError("this star has no folders by run")
        jvm, gone = self.session._jvm, 0
        for table in listed(self.session, self.root):
            for run in run_ids:
                folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run) if run else "__HIVE_DEFAULT_PARTITION__"
                fs, path = located(self.session, f"{self.root}/{table}/{RUN}={folder}")
                gone += bool(fs.delete(path, True))
            if self.session.catalog.tableExists(self.named(table)):
                self.session.catalog.refreshTable(self.named(table))
        return gone


def key_of(name: str) -> str:
    return "id" if name == "url_status" else "url_status_id"


def quoted(name: str) -> str:
    return f"`{re.sub('`', '``', name)}`"


def located(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = located(spark, name)
    return bool(fs.exists(path))


def listed(spark: SparkSession, root: str) -> list[str]:
    """The tables of a star, by folder."""
    fs, path = located(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith("_"))
