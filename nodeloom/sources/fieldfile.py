"""Field files, probe files and solver logs as Spark sources and sinks.

A field file: a 132-byte text header, a 4-byte float that tells the byte order,
the element numbers, then a block per variable over all elements (vectors
element by element: all x, all y, all z). A field may lie in several files, each
with some of its elements; the header says how many there are in all.

Files are opened with pyarrow's file systems, so a path may be local or a URI of
any store that these know (file, hdfs, s3, gs ..). Only the header and the bytes
of the wanted variables and elements are read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from nodeloom.operators.statistics import filled

HEADER, ENDIAN = 132, 6.54321  # fixed values of the format


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The path itself, or the field files in a folder, by name."""
    from pyarrow import fs

    store, local = _store(path)
    info = store.get_file_info(local)
    if info.type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(local)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def header(wdsz: int, shape: tuple[int, int, int], elements: int, time: float, step: int, variables: str, total: int | None = None, number: int = 0, files: int = 0) -> bytes:
    lx, ly, lz = shape
    return f"#std {wdsz:1d} {lx:2d} {ly:2d} {lz:2d} {elements:10d} {elements if total is None else total:10d} {time:20.13E} {step:9d} {number:6d} {files:6d} {variables}".ljust(HEADER).encode()


def parse_header(raw: bytes) -> dict:
    """The header's values; order: the byte order that the tag behind it tells."""
    f = raw[:HEADER].decode("ascii", "replace").split()
    if not f or f[0] != "#std":
        raise ValueError("not a field file")
    code, variables = f[11], {}
    k = 0
    while k < len(code):
        if code[k] == "S":
            variables["s"] = int(code[k + 1 : k + 3])
            k += 3
        else:
            variables[{"X": "pos", "U": "vel", "P": "p", "T": "t"}[code[k]]] = 1
            k += 1
    tag = raw[HEADER : HEADER + 4]
    order = next((o for o in "<>" if len(tag) == 4 and abs(np.frombuffer(tag, f"{o}f4")[0] - ENDIAN) < 1e-4), None)
    if order is None:
        raise ValueError("the byte-order tag is not there")
    return {"wdsz": int(f[1]), "shape": tuple(int(x) for x in f[2:5]), "elements": int(f[5]), "total": int(f[6]), "time": float(f[7]), "step": int(f[8]), "number": int(f[9]), "files": int(f[10]), "variables": variables, "order": order}


def columns(h: dict) -> list[tuple[str, int]]:
    """(name, place) of the variables in file order."""
    dim = 3 if h["shape"][2] > 1 else 2
    names: list[str] = []
    for v in h["variables"]:
        names += {"pos": list("xyz")[:dim], "vel": list("uvw")[:dim], "p": ["p"], "t": ["t"]}.get(v) or [f"s{i}" for i in range(h["variables"]["s"])]
    return [(n, i) for i, n in enumerate(names)]


def groups_of(names: list[str], dim: int) -> tuple[list[list[str]], str]:
    """The blocks of a file of these variables, and their code in the header."""
    groups = [g for g in (list("xyz")[:dim], list("uvw")[:dim], ["p"], ["t"]) if g[0] in names]
    scalars = sorted((k for k in names if k[0] == "s" and k[1:].isdigit()), key=lambda k: int(k[1:]))
    code = "".join({"x": "X", "u": "U", "p": "P", "t": "T"}[g[0]] for g in groups) + (f"S{len(scalars):02d}" if scalars else "")
    return [*groups, *[[s] for s in scalars]], code


def bounds_of(arrays: dict[str, np.ndarray], group: list[str]) -> np.ndarray:
    """Least and largest value of each element, as they stand behind the blocks of a 3D file."""
    return np.stack([np.stack([arrays[c].min(axis=1), arrays[c].max(axis=1)], axis=1) for c in group], axis=1)


def encode(arrays: dict[str, np.ndarray], ids: np.ndarray, n: tuple[int, int, int], time: float = 0.0, step: int = 0, wdsz: int = 8, total: int | None = None, number: int = 0, files: int = 0, order: str = "<") -> bytes:
    """A field file of arrays: name -> (elements, nodes); groups x y z, u v w, p, t, s0 .. in file order."""
    dim = 3 if n[2] > 1 else 2
    every, code = groups_of(list(arrays), dim)
    kind = f"{order}f{wdsz}"
    out = [header(wdsz, n, len(ids), time, step, code, total, number, files), np.array([ENDIAN], f"{order}f4").tobytes(), np.asarray(ids).astype(f"{order}i4").tobytes()]
    out += [np.stack([arrays[c] for c in g], axis=1).astype(kind).tobytes() for g in every]
    if dim == 3:
        out += [bounds_of(arrays, g).astype(f"{order}f4").tobytes() for g in every if len(ids)]
    return b"".join(out)


def write(path: str, arrays: dict[str, np.ndarray], n: tuple[int, int, int], time: float = 0.0, step: int = 0, wdsz: int = 8, ids: np.ndarray | None = None, order: str = "<") -> None:
    """One field file, from arrays that the driver has."""
    count = len(next(iter(arrays.values())))
    store, local = _store(path)
    with store.open_output_stream(local) as f:
        f.write(encode(arrays, np.arange(1, count + 1) if ids is None else ids, n, time, step, wdsz, order=order))


ROWS = 1024  #: elements that a writing task turns into bytes together
WRITE_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 4 << 20  #: of a file, of a task that reads, of a batch


def per_element(h: dict, keys: list[str]) -> int:
    """Bytes of an element's values of these variables."""
    return int(np.prod(h["shape"])) * h["wdsz"] * len(keys)


class Range(InputPartition):
    def __init__(self, path: str, head: dict, first: int, count: int):
        self.path, self.head, self.first, self.count = path, head, first, count


def linear_ranges(elements: int, parts: int) -> list[tuple[int, int]]:
    """(first, count) of each part: equal shares, the larger ones first."""
    parts = max(1, min(parts, elements or 1))
    sizes = [(elements + parts - r - 1) // parts for r in range(parts)]
    return [(sum(sizes[:r]), s) for r, s in enumerate(sizes)]


class FieldFile(DataSource):
    """format("fieldfile"). Read: path (a file, or a folder of the files of a
    field), keys (comma-separated; other variables are skipped by offset),
    partitions (per file; 0: by bytes); rows have the element's own number, from 0, as e.
    Write: path (a folder), shape ("4,4,4"), elements (in all), files, time,
    step, wdsz (8 or 4): each task writes a file of its own."""

    @classmethod
    def name(cls) -> str:
        return "fieldfile"

    def _head(self) -> dict:
        return read_header(files_of(self.options["path"])[0])

    def _keys(self, h: dict) -> list[str]:
        names = [c for c, _ in columns(h)]
        return [k for k in self.options["keys"].split(",") if k in names] if self.options.get("keys") else names

    def schema(self) -> str:
        return "e long, time double, " + ", ".join(f"{k} array<double>" for k in self._keys(self._head()))

    def reader(self, schema):
        return FieldReader(self.options["path"], self._keys(self._head()), int(self.options.get("partitions", 0)))

    def writer(self, schema, overwrite):
        return FieldWriter(dict(self.options), [f.name for f in schema.fields], overwrite)


def read_header(path: str) -> dict:
    store, local = _store(path)
    with store.open_input_file(local) as f:
        return parse_header(f.read(HEADER + 4))


def read_block(f, h: dict, keys: list[str], first: int, count: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Numbers (from 0) and values of count elements of an open file, from the first on."""
    dim, n, size, order = 3 if h["shape"][2] > 1 else 2, int(np.prod(h["shape"])), h["wdsz"], h["order"]
    start, names, got = HEADER + 4 + 4 * h["elements"], [c for c, _ in columns(h)], {}
    f.seek(HEADER + 4 + 4 * first)
    ids = np.frombuffer(f.read(4 * count), f"{order}i4").astype(np.int64) - 1
    vectors: dict[str, np.ndarray] = {}
    for key in keys:
        k = names.index(key)
        group = next((g for g in ("xyz"[:dim], "uvw"[:dim]) if key in g), None)
        begin, width = (names.index(group[0]), dim) if group else (k, 1)
        if (group or key) not in vectors:
            f.seek(start + size * n * (h["elements"] * begin + first * width))
            vectors[group or key] = np.frombuffer(f.read(size * n * count * width), dtype=f"{order}f{size}").reshape(count, width, n)
        got[key] = vectors[group or key][:, k - begin].astype(float)
    return ids, got


def as_batch(h: dict, ids: np.ndarray, got: dict[str, np.ndarray], more: dict[str, np.ndarray] | None = None):
    """An Arrow batch: more, e, time and an array of nodal values per variable."""
    import pyarrow as pa

    ends = np.arange(len(ids) + 1, dtype=np.int32)
    lists = {k: pa.ListArray.from_arrays(pa.array(ends * v.shape[1]), pa.array(np.ascontiguousarray(v).ravel())) for k, v in got.items()}
    whole = {**{k: pa.array(v) for k, v in (more or {}).items()}, "e": pa.array(ids), "time": pa.array(np.full(len(ids), h["time"]))} | lists
    return pa.RecordBatch.from_arrays(list(whole.values()), names=list(whole))


class FieldReader(DataSourceReader):
    """Element ranges of the files, so many that each reads about READ_BYTES, or
    parts per file; a range comes in batches of about BATCH_BYTES."""

    def __init__(self, path: str, keys: list[str], parts: int):
        self.path, self.keys, self.parts = path, keys, parts

    def partitions(self):
        out = []
        for path in files_of(self.path):
            h = read_header(path)
            parts = self.parts or -(-h["elements"] * per_element(h, self.keys) // READ_BYTES)
            out += [Range(path, h, first, count) for first, count in linear_ranges(h["elements"], parts)]
        return out

    def read(self, part):
        store, local = _store(part.path)
        some = max(1, BATCH_BYTES // max(1, per_element(part.head, self.keys)))
        with store.open_input_file(local) as f:
            for at in range(part.first, part.first + part.count, some):
                yield as_batch(part.head, *read_block(f, part.head, self.keys, at, min(some, part.first + part.count - at)))


def steps_of(folder: str) -> dict[int, list[tuple[str, dict]]]:
    """Complete steps of a folder: number -> (file, header). Files lie in it or in
    folders of it; a step is complete when its files have all of its elements."""
    from pyarrow import fs

    store, local = _store(folder)
    found: dict[int, list[tuple[str, dict]]] = {}
    for f in store.get_file_info(fs.FileSelector(local, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.size >= HEADER + 4:
            path = folder.rstrip("/") + f.path[len(local.rstrip("/")) :]
            h = read_header(path)
            found.setdefault(h["step"], []).append((path, h))
    return {s: sorted(files, key=lambda x: x[0]) for s, files in sorted(found.items()) if sum(h["elements"] for _, h in files) >= files[0][1]["total"]}


class FieldSteps(DataSource):
    """format("fieldsteps"), a stream, or all steps at once. path: a folder of
    steps; keys as for fieldfile. Rows: step, e, time, an array per variable."""

    @classmethod
    def name(cls) -> str:
        return "fieldsteps"

    def schema(self) -> str:
        steps = steps_of(self.options["path"])
        if not steps:
            raise ValueError("no step is there yet to tell the variables")
        names = [c for c, _ in columns(next(iter(steps.values()))[0][1])]
        self.keys = [k for k in self.options["keys"].split(",") if k in names] if self.options.get("keys") else names
        return "step long, e long, time double, " + ", ".join(f"{k} array<double>" for k in self.keys)

    def streamReader(self, schema):
        return StepReader(self.options["path"], [f.name for f in schema.fields][3:])

    def reader(self, schema):
        return AllSteps(self.options["path"], [f.name for f in schema.fields][3:])


class StepReader(DataSourceStreamReader):
    """Offsets: the next step that is wanted. Only steps in a row are passed on, up to the first that is not complete."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def initialOffset(self) -> dict:
        return {"step": min(steps_of(self.path), default=0)}

    def latestOffset(self) -> dict:
        steps, n = steps_of(self.path), min(steps_of(self.path), default=0)
        while n in steps:
            n += 1
        return {"step": n}

    def partitions(self, start: dict, end: dict):
        out = []
        for step, files in steps_of(self.path).items():
            if start["step"] <= step < end["step"]:
                for path, h in files:
                    out += [Range(path, h, first, count) for first, count in linear_ranges(h["elements"], -(-h["elements"] * per_element(h, self.keys) // READ_BYTES))]
        return out

    def read(self, part):
        store, local = _store(part.path)
        some = max(1, BATCH_BYTES // max(1, per_element(part.head, self.keys)))
        with store.open_input_file(local) as f:
            for at in range(part.first, part.first + part.count, some):
                ids, got = read_block(f, part.head, self.keys, at, min(some, part.first + part.count - at))
                yield as_batch(part.head, ids, got, {"step": np.full(len(ids), part.head["step"], np.int64)})

    def commit(self, end: dict) -> None:
        pass


class AllSteps(DataSourceReader):
    """The same rows of all complete steps that are there."""

    def __init__(self, path: str, keys: list[str]):
        self.steps = StepReader(path, keys)

    def partitions(self):
        return self.steps.partitions({"step": -1}, {"step": float("inf")})

    def read(self, part):
        yield from self.steps.read(part)


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class FieldWriter(DataSourceArrowWriter):
    """A task's rows become one file, in their order, under a name of the task; files
    of failed or repeated attempts are removed when the job commits or aborts. The
    blocks lie in temporary files of the task until all rows are there, so that it
    holds a batch, whatever the file's size."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.o, self.names = options, names
        store, local = _store(options["path"])
        if overwrite and store.get_file_info(local).type.name == "Directory":
            store.delete_dir_contents(local)
        store.create_dir(local, recursive=True)
        self.before = {p.rsplit("/", 1)[-1] for p in files_of(options["path"])}

    def write(self, iterator):
        import shutil
        import tempfile
        from contextlib import ExitStack

        from pyspark import TaskContext

        context = TaskContext.get()
        number, names = context.partitionId(), [c for c in self.names if c not in ("e", "time")]
        shape = tuple(int(v) for v in self.o["shape"].split(","))
        dim, size, count = 3 if shape[2] > 1 else 2, int(self.o.get("wdsz", 8)), 0
        every, code = groups_of(names, dim)
        with ExitStack() as held:
            ids, *blocks = (held.enter_context(tempfile.TemporaryFile()) for _ in range(1 + 2 * len(every)))
            values, bounds = blocks[: len(every)], blocks[len(every) :]
            for whole in iterator:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    count += b.num_rows
                    ids.write((b.column("e").to_numpy(zero_copy_only=False) + 1).astype("<i4").tobytes())
                    for g, block, bound in zip(every, values, bounds, strict=True):
                        arrays = {c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in g}
                        block.write(np.stack([arrays[c] for c in g], axis=1).astype(f"<f{size}").tobytes())
                        if dim == 3:
                            bound.write(bounds_of(arrays, g).astype("<f4").tobytes())
            if not count and (number or int(self.o["elements"])):
                return Written("")
            name = f"{self.o['path'].rstrip('/')}/field-{number:06d}-{context.taskAttemptId()}.f{int(self.o.get('step', 0)):05d}"
            store, local = _store(name)
            with store.open_output_stream(local) as f:
                f.write(header(size, shape, count, float(self.o.get("time", 0.0)), int(self.o.get("step", 0)), code, int(self.o["elements"]), number, int(self.o["files"])))
                f.write(np.array([ENDIAN], "<f4").tobytes())
                for block in (ids, *blocks):
                    block.seek(0)
                    shutil.copyfileobj(block, f, BATCH_BYTES)
        return Written(name)

    def commit(self, messages):
        self._keep({m.path.rsplit("/", 1)[-1] for m in messages if m and m.path})

    def abort(self, messages):
        self._keep(set())

    def _keep(self, names: set[str]) -> None:
        for path in files_of(self.o["path"]):
            if path.rsplit("/", 1)[-1] not in names | self.before:
                store, local = _store(path)
                store.delete_file(local)


def write_field(df: DataFrame, path: str, shape: tuple[int, int, int], time: float = 0.0, step: int = 0, wdsz: int = 8, files: int | None = None, made: Callable | None = None) -> None:
    """Writes e and arrays of nodal values as the files of one field, in the order
    of the elements: each task a range of them. Without a number of files, so many
    that each holds about WRITE_BYTES. A field without elements is one file.
    made: makes the field from df row by row, once rows are where they are written."""
    spark = df.sparkSession
    spark.dataSource.register(FieldFile)
    count = df.count()
    files = files or max(1, -(-count * int(np.prod(shape)) * wdsz * len([c for c in (made(df) if made else df).columns if c not in ("e", "time")]) // WRITE_BYTES))
    out = df.repartitionByRange(files, "e").sortWithinPartitions("e") if count else df.coalesce(1)
    out = made(out) if made else out
    o = {"shape": ",".join(map(str, shape)), "elements": str(count), "files": str(files), "time": repr(time), "step": str(step), "wdsz": str(wdsz)}
    out.write.format("fieldfile").mode("overwrite").options(**o).save(path)


def read_field(spark, path: str, keys: str = "", partitions: int = 0) -> DataFrame:
    """partitions: per file; 0 for as many as the bytes of the wanted variables ask for."""
    spark.dataSource.register(FieldFile)
    reader = spark.read.format("fieldfile").option("path", path).option("partitions", partitions)
    return (reader.option("keys", keys) if keys else reader).load()


def read_steps(spark, folder: str, keys: str = "") -> DataFrame:
    """step, e, time and an array per variable of all complete steps in a folder."""
    spark.dataSource.register(FieldSteps)
    reader = spark.read.format("fieldsteps").option("path", folder)
    return (reader.option("keys", keys) if keys else reader).load()


def index_steps(spark, folder: str) -> DataFrame:
    """step, time, files and elements of the complete steps in a folder, from their headers."""
    rows = [(s, files[0][1]["time"], len(files), sum(h["elements"] for _, h in files)) for s, files in steps_of(folder).items()]
    return spark.createDataFrame(rows, "step long, time double, files int, elements long")


def read_probes_csv(lines: DataFrame) -> DataFrame:
    """lines: line_no (from 0), text, of a probe file: a header N,0,0,names..,
    N coordinate rows, then N rows per time. Gives probe_id, step, time, name, value."""
    head = lines.where("line_no = 0").select(F.split("text", ",").alias("h")).select(F.trim(F.col("h")[0]).cast("long").alias("n"), F.expr("slice(h, 4, size(h))").alias("names"))
    rows = lines.where("line_no > 0").crossJoin(F.broadcast(head))  # one row
    data = rows.where("line_no > n").select(((F.col("line_no") - 1) % F.col("n")).alias("probe_id"), F.expr("(line_no - 1) div n - 1").alias("step"), F.transform(F.split("text", ","), lambda x: F.trim(x).cast("double")).alias("v"), "names")
    pairs = data.withColumn("values", F.expr("slice(v, 2, size(v))")).select("probe_id", "step", F.col("v")[0].alias("time"), F.explode(F.arrays_zip("names", "values")).alias("x"))
    return pairs.select("probe_id", "step", "time", F.trim("x.names").alias("name"), F.col("x.values").alias("value"))


def read_lines(spark, path: str) -> DataFrame:
    """Lines of the text files in a folder with their places: log (the folder of
    the file), part (the file's name and where the block that a task read begins)
    and line_no, which grows within a block. A file of any size is many blocks."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start")
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    return lines.select(folder.alias("log"), F.struct("file_name", "file_block_start").alias("part"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


LINES_OF_PART = 100_000  #: lines of a log that one window holds, where lines come without blocks


def index_log(lines: DataFrame) -> DataFrame:
    """number, file and time (and log, if lines have it). lines: line_no, text.
    Every line with an output number becomes an index row with the last file name
    and time seen before it, in its log, which is one text that one solver wrote.
    Logs are filled by parts (a column part, or ranges of line_no), each of which
    goes on with the last values of those before."""
    one = lambda p: F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1))
    # Only the lines that say something are put in order.
    told = lines.where(F.col("text").rlike(r"File name\s*:|\bt\s*=|Output number\s*:"))
    group = ["log"] if "log" in lines.columns else []
    if "part" not in lines.columns:
        told = told.withColumn("part", F.floor(F.col("line_no") / LINES_OF_PART))
    told = told.select(*group, "part", "line_no", one(r"File name\s*:\s*(\S+)").alias("file"), one(r"\bt\s*=\s*([0-9.eE+-]+)").cast("double").alias("time"), one(r"Output number\s*:\s*(\d+)").cast("long").alias("number"))
    return filled(told, group, "part", "line_no", ["file", "time"]).where("number is not null").select(*group, "number", "file", "time")
