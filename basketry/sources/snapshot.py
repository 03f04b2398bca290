"""All-or-nothing Parquet snapshots of the six tables.

The reference truncates and refills its tables in one transaction.  Parquet
has no multi-table transaction, so every load writes a NEW version folder
under the snapshot root; the version becomes visible only when its
``_PUBLISHED`` marker is written, after the audit of the written tables came
back empty.  Readers take the newest published version.  A failed or
rejected load leaves an unpublished folder that readers never see.

Writing first and auditing the written Parquet (instead of auditing the
lazy plan and writing it afterwards) computes the tables once and cuts their
lineage: a lost executor re-reads files, not the whole input.

A version may also be a change to another one (`publish_change`).  It then holds
only the rows that come and the keys of the rows that go; everything else is
named in its marker by reference, as a list of layers per table.  Readers take
the layers in order: rows are added, keys take what the layers before them hold.
So an edit writes as much as it changes, and `compact` folds the layers.

Publishing a version that follows another one claims its place first, with a
file that only one writer can create: of two changes to one version the second
is refused and has to be made anew on the version that came between.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.audit import ROW_COUNT, audit_with_counts
from basketry.schema import PRIMARY_KEYS, SCHEMAS, TABLE_ORDER
from basketry.session import plain_unions
from basketry.sources import name_index
from basketry.tables import Tables

MARKER = "_PUBLISHED"
CLAIM = "_NEXT"
#: A claim whose version was not published in this time is void: its writer is
#: gone.  Between claim and marker there is one small file to write.
CLAIM_SECONDS = 600


class SnapshotRejected(Exception):
    """The audit found violations; nothing was published."""

    def __init__(self, version: str, violations: list[tuple]):
        self.version, self.violations = version, violations
        lines = "\n".join(f"  {t}: {r}: {n}" for t, r, n in violations)
        super().__init__(f"snapshot {version} not published:\n{lines}")


class SnapshotConflict(Exception):
    """Another version follows the one that a change was made to."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears under ``path`` whole or not at
    all: under another name first, then renamed."""
    fs, p, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(part, p):
        raise OSError(f"could not rename {part} to {path}")


def _marker(spark: SparkSession, version: str) -> dict | None:
    """The publication record of a version; None if it has none, or one that
    is empty or cut off."""
    path = f"{version}/{MARKER}"
    if not _exists(spark, path):
        return None
    try:
        found = json.loads(_read_text(spark, path))
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("tables") == TABLE_ORDER else None


BUCKET_KEY = "order_id"  # orders and order_details are joined on it


def _catalog_name(version: str, name: str) -> str:
    return f"basketry_{hashlib.sha1(version.encode()).hexdigest()[:12]}_{name}"


def write_frames(frames: dict, version: str, buckets: dict | None = None) -> None:
    """Write each named table of ``frames`` under ``version`` (never overwriting).

    The writes are independent jobs, submitted from a small thread pool so
    Spark schedules them side by side instead of one after another.
    Tables named in ``buckets`` (name -> bucket count) are written bucketed
    and sorted on ``order_id``, so equal bucket counts let readers join
    orders and order lines without shuffling either side.  Bucketing needs a
    catalog entry while writing; it is dropped again (the table is external,
    the files stay) and readers re-register it from the marker.
    """
    from concurrent.futures import ThreadPoolExecutor

    def write(item):
        name, df = item
        path = f"{version}/{name}"
        n = (buckets or {}).get(name)
        if not n:
            df.write.mode("errorifexists").parquet(path)
            return
        table = _catalog_name(version, name) + "_w"
        (df.write.mode("errorifexists").bucketBy(n, BUCKET_KEY).sortBy(BUCKET_KEY)
         .option("path", path).format("parquet").saveAsTable(table))
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")

    with ThreadPoolExecutor(max_workers=max(1, min(4, len(frames)))) as pool:
        list(pool.map(write, frames.items()))


def write_tables(tables: Tables, version: str, buckets: dict | None = None) -> None:
    write_frames(dict(tables.conform().items()), version, buckets)


def _read_bucketed(spark: SparkSession, version: str, name: str, n: int) -> DataFrame:
    table = _catalog_name(version, name)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet "
              f"CLUSTERED BY ({BUCKET_KEY}) SORTED BY ({BUCKET_KEY}) INTO {int(n)} BUCKETS "
              f"LOCATION '{version}/{name}'")
    return spark.table(table)


def _root_of(version: str) -> str:
    return version.rstrip("/").rsplit("/", 1)[0]


def _layers(version: str, marker: dict) -> dict[str, list[dict]]:
    """Per table the layers of a version, with paths below its root."""
    own = version.rstrip("/").rsplit("/", 1)[1]
    return marker.get("layers") or {
        name: [{"rows": f"{own}/{name}", **({"buckets": n} if (n := (marker.get("buckets") or {}).get(name)) else {})}]
        for name in TABLE_ORDER}


def _read_layers(spark: SparkSession, root: str, name: str, layers: list[dict]) -> DataFrame:
    from basketry.operators.changes import without

    columns, out = [f.name for f in SCHEMAS[name].fields], None
    for layer in layers:
        if "gone" in layer:
            out = without(out, spark.read.parquet(f"{root}/{layer['gone']}").select(*layer["columns"]))
            continue
        if layer.get("buckets") and len(layers) == 1:
            rows = _read_bucketed(spark, f"{root}/{layer['rows'].rsplit('/', 1)[0]}", name, layer["buckets"])
        else:
            rows = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{layer['rows']}").select(*columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_tables(spark: SparkSession, version: str, buckets: dict | None = None,
                layers: dict | None = None) -> Tables:
    if layers:
        return Tables(**{name: _read_layers(spark, _root_of(version), name, layers[name]) for name in TABLE_ORDER})
    out = {}
    for name in TABLE_ORDER:
        n = (buckets or {}).get(name)
        out[name] = (_read_bucketed(spark, version, name, n) if n
                     else spark.read.parquet(f"{version}/{name}"))
    return Tables(**out)


def order_buckets(n: int | None) -> dict | None:
    """Bucket spec for co-locating orders and their lines on ``order_id``."""
    return {"orders": n, "order_details": n} if n else None


def new_version(root: str, after: str | None = None) -> str:
    """A fresh version folder, by name behind all that exist by now, and behind
    ``after`` whatever the clocks say."""
    now = int(time.time() * 1000)
    if after:
        now = max(now, 1 + int(after.rsplit("/", 1)[1][1:].split("-")[0]))
    return f"{root.rstrip('/')}/v{now:013d}-{uuid.uuid4().hex[:8]}"


def _claim(spark: SparkSession, base: str, version: str) -> None:
    """Take the place of ``base``'s successor, or raise `SnapshotConflict`."""
    path = f"{base}/{CLAIM}"
    fs, p, _ = _fs(spark, path)
    text = json.dumps({"version": version.rsplit("/", 1)[1], "claimed_ms": int(time.time() * 1000)})
    for attempt in range(2):
        try:
            out = fs.create(p, False)  # refused if it is there
        except Exception as e:
            if "already exists" not in str(e) and "AlreadyExists" not in str(e):
                raise
        else:
            out.write(bytearray(text.encode()))
            out.close()
            return
        try:
            held = json.loads(_read_text(spark, path))
        except ValueError:  # being written
            held = {"version": "", "claimed_ms": fs.getFileStatus(p).getModificationTime()}
        published = held["version"] and _marker(spark, f"{_root_of(base)}/{held['version']}")
        if published or attempt or time.time() * 1000 - held["claimed_ms"] < CLAIM_SECONDS * 1000:
            break
        fs.delete(p, False)
    raise SnapshotConflict(f"{base} is followed by {held['version'] or 'another version'}; read that and try again")


def _follow(spark: SparkSession, base: str, version: str) -> None:
    """Claim ``base``'s successor for ``version``, if ``base`` is the newest."""
    newest = latest_version(spark, _root_of(base))
    if newest != base:
        raise SnapshotConflict(f"{newest} was published after {base}; read that and try again")
    _claim(spark, base, version)


def _publish(spark: SparkSession, version: str, row_counts: dict, buckets: dict | None = None,
             layers: dict | None = None, base: str | None = None, cells: dict | None = None,
             names: list | None = None) -> None:
    _write_text(spark, f"{version}/{MARKER}",
                json.dumps({"tables": TABLE_ORDER, "row_counts": row_counts, "buckets": buckets or {},
                            "bucket_key": BUCKET_KEY, "layers": layers, "base": base and base.rsplit("/", 1)[1], "cells": cells, "names": names,
                            "published_ms": int(time.time() * 1000)}))


def publish(spark: SparkSession, version: str, buckets: dict | None = None) -> Tables:
    """Audit the written tables of ``version``; write the marker if clean."""
    written = read_tables(spark, version, buckets)
    found = [tuple(r) for r in audit_with_counts(written).collect()]  # bounded by the rule count
    violations = [r for r in found if r[1] != ROW_COUNT and r[2] > 0]
    if violations:
        raise SnapshotRejected(version, violations)
    # exact sizes from the audit's own scans, recorded for readers
    counts = {table: n for table, rule, n in found if rule == ROW_COUNT}
    _publish(spark, version, counts, buckets)
    return Tables(**dict(written.items()), audited=True, row_counts=counts)


def write_snapshot(tables: Tables, root: str, order_buckets_n: int | None = None) -> str:
    """Write, audit and publish ``tables`` as a new version under ``root``."""
    spark = tables.spark
    version = new_version(root)
    buckets = order_buckets(order_buckets_n)
    write_tables(tables, version, buckets)
    publish(spark, version, buckets)
    return version


def latest_version(spark: SparkSession, root: str) -> str:
    if _marker(spark, root.rstrip("/")):
        return root.rstrip("/")
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    for name in reversed(names):
        v = f"{root.rstrip('/')}/{name}"
        if name.startswith("v") and _marker(spark, v):
            return v
    raise FileNotFoundError(f"no published snapshot under {root}")


def read_snapshot(spark: SparkSession, root: str) -> Tables:
    """The six tables of the newest published version under ``root``.

    Only published versions are read, and publication requires a clean
    audit, so the result is marked ``audited``.
    """
    plain_unions(spark)
    version = latest_version(spark, root)
    marker = _marker(spark, version)
    t = read_tables(spark, version, marker.get("buckets") or None, marker.get("layers"))
    return Tables(**dict(t.items()), audited=True, row_counts=marker.get("row_counts"))


def publish_change(spark: SparkSession, root: str, steps: list, base: str | None = None) -> str:
    """Publish the newest version under ``root`` with ``steps``
    (`basketry.operators.changes.Step`) taken, as a version that follows it.

    The steps are written, the rows and keys of each table under the new version;
    the audit of what they change must come back clean, or nothing is published
    and `SnapshotRejected` is raised.  Name the version that the steps were made
    from as ``base`` if it may no longer be the newest: `SnapshotConflict` is
    raised if another version followed it, before the audit or at the last moment.
    ``row_counts`` of the marker are then upper bounds, as rows that go are not counted.
    """
    from basketry.operators.changes import Step, apply, audit_delta
    from basketry.plans.cells import after_change

    base = (base or latest_version(spark, root)).rstrip("/")
    root = _root_of(base)
    newest = latest_version(spark, root)
    if newest != base:
        raise SnapshotConflict(f"{newest} was published after {base}; read that and try again")
    before, marker = read_snapshot(spark, base), _marker(spark, base)
    version = new_version(root, base)
    own = version.rsplit("/", 1)[1]
    layers = {name: list(found) for name, found in _layers(base, marker).items()}
    counts, written = dict(marker["row_counts"]), []
    for i, step in enumerate(steps):
        parts = {"rows": step.added(), "gone": None if step.replace else step.gone}
        read = {}
        for kind, df in parts.items():
            if df is None:
                continue
            path = f"{own}/{step.table}-{i}-{kind}"
            df.write.mode("errorifexists").parquet(f"{root}/{path}")
            back = spark.read.schema(df.schema).parquet(f"{root}/{path}")
            n = back.count()  # from the footers
            if n:
                read[kind] = (path, back, n)
        if "rows" in read and step.replace:
            layers[step.table].append({"gone": read["rows"][0], "columns": PRIMARY_KEYS[step.table]})
        if "gone" in read:
            layers[step.table].append({"gone": read["gone"][0], "columns": read["gone"][1].columns})
        if "rows" in read:
            layers[step.table].append({"rows": read["rows"][0]})
            counts[step.table] += read["rows"][2]
        if read:
            written.append(Step(step.table, *(read[k][1] if k in read else None for k in ("rows", "gone")),
                                replace=step.replace))
    found = [tuple(r) for r in audit_delta(before, written).collect()]  # bounded by the rule count
    if found:
        raise SnapshotRejected(version, found)
    cells = _write_cells(after_change(read_cells(spark, base), before, apply(before, written), written),
                         version) if marker.get("cells") else None
    names = list(marker.get("names") or [])
    for i, step in enumerate(written if names else []):
        if step.table == "products" and step.rows is not None:
            names.append(f"{own}/names-{i}")
            name_index.write(step.rows, f"{root}/{names[-1]}")
    _follow(spark, base, version)
    _publish(spark, version, counts, layers=layers, base=base, cells=cells, names=names)
    return version


def _write_cells(cells, version: str) -> dict[str, str]:
    paths = {}
    for name, df in cells.items():
        paths[name] = f"{version.rsplit('/', 1)[1]}/cells-{name}"
        df.write.mode("errorifexists").parquet(f"{_root_of(version)}/{paths[name]}")
    return paths


def read_cells(spark: SparkSession, root: str):
    """The `basketry.plans.cells.Cells` of the newest version under ``root``, or
    of a version; refused if they are not maintained there."""
    from basketry.plans.cells import SCHEMAS as CELLS, Cells

    version = latest_version(spark, root)
    paths = _marker(spark, version).get("cells")
    if not paths:
        raise FileNotFoundError(f"{version} has no cells; see maintain_cells")
    return Cells(**{name: spark.read.schema(CELLS[name]).parquet(f"{_root_of(version)}/{path}")
                    for name, path in paths.items()})


def maintain_cells(spark: SparkSession, root: str) -> str:
    """Publish the newest version anew with its cells; the changes published
    after it keep them up to date, a full load starts without."""
    from basketry.plans.cells import cells_of

    base = latest_version(spark, root)
    marker = _marker(spark, base)
    if marker.get("cells"):
        return base
    version = new_version(_root_of(base), base)
    cells = _write_cells(cells_of(read_snapshot(spark, base)), version)
    _follow(spark, base, version)
    _publish(spark, version, marker["row_counts"], layers=_layers(base, marker), base=base, cells=cells,
             names=marker.get("names"))
    return version


def read_names(spark: SparkSession, root: str) -> name_index.NameIndex:
    """The trigram index of the newest version under ``root``, or of a version."""
    version = latest_version(spark, root)
    names = _marker(spark, version).get("names")
    if not names:
        raise FileNotFoundError(f"{version} has no index of names; see index_names")
    return name_index.NameIndex.read(spark, [f"{_root_of(version)}/{n}" for n in names])


def index_names(spark: SparkSession, root: str) -> str:
    """Publish the newest version anew with a trigram index of its product names
    in one layer; the changes published after it add theirs, a full load starts
    without."""
    base = latest_version(spark, root)
    marker = _marker(spark, base)
    if len(marker.get("names") or []) == 1:
        return base
    version = new_version(_root_of(base), base)
    name_index.write(read_snapshot(spark, base).products, f"{version}/names")
    _follow(spark, base, version)
    _publish(spark, version, marker["row_counts"], layers=_layers(base, marker), base=base,
             cells=marker.get("cells"), names=[f"{version.rsplit('/', 1)[1]}/names"])
    return version


def compact(spark: SparkSession, root: str) -> str:
    """Publish the newest version anew with one layer a table: tables that
    changes left in several are written, the others stay by reference."""
    base = latest_version(spark, root)
    root, marker = _root_of(base), _marker(spark, base)
    layers, before = _layers(base, marker), read_snapshot(spark, base)
    several = [name for name in TABLE_ORDER if len(layers[name]) > 1]
    if not several:
        return base
    version = new_version(root, base)
    write_frames({name: getattr(before, name) for name in several}, version)
    counts = dict(marker["row_counts"])
    for name in several:
        counts[name] = spark.read.parquet(f"{version}/{name}").count()
        layers[name] = [{"rows": f"{version.rsplit('/', 1)[1]}/{name}"}]
    _follow(spark, base, version)
    _publish(spark, version, counts, layers=layers, base=base, cells=marker.get("cells"), names=marker.get("names"))
    return version


def load_wide(wide: DataFrame, root: str, staging_partitions: int | None = None,
              order_buckets_n: int | None = None) -> str:
    """E1 end to end: typed wide rows -> staged Parquet -> six tables -> audit -> publish.

    The complete rows are materialised once as Parquet in the session's
    checkpoint folder (parsing the CSV, and reading every column to tell
    complete rows, happens once); the six projections then read only the
    columns they need.  Lines with unusable fields refuse the load; lines that
    the missing-value rule removes anyway do not.  The staged copy is removed.
    """
    from basketry.operators import load
    from basketry.session import scratch_path

    spark = wide.sparkSession
    version = new_version(root)
    path = scratch_path(spark, "staged-wide")  # shared checkpoint folder
    staged = load.stage(wide.repartition(staging_partitions) if staging_partitions else wide, path)
    try:
        if "_bad" in staged.columns:
            # bounded: one row per column
            bad = [("wide", f"parse {r[0]}", r[1]) for r in
                   staged.select(F.explode("_bad")).groupBy("col").count().orderBy("col").collect()]
            if bad:
                raise SnapshotRejected(version, bad)
            staged = staged.drop("_bad")
        buckets = order_buckets(order_buckets_n)
        write_tables(load.normalise(staged, staged=True), version, buckets)
    finally:
        fs, p, _ = _fs(spark, path)
        fs.delete(p, True)
    publish(spark, version, buckets)
    return version


def has_snapshot(spark: SparkSession, root: str) -> bool:
    try:
        latest_version(spark, root)
        return True
    except FileNotFoundError:
        return False


def create_if_absent(spark: SparkSession, root: str) -> str:
    """The schema exists after this call, like CREATE TABLE IF NOT EXISTS.

    If ``root`` has no published version, an empty one (six tables with their
    declared schemas) is published; otherwise the newest one is returned.
    """
    if has_snapshot(spark, root):
        return latest_version(spark, root)
    empty = Tables(**{name: spark.createDataFrame([], SCHEMAS[name]) for name in TABLE_ORDER})
    return write_snapshot(empty, root)
