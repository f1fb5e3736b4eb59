"""Command lines: python -m nodeloom.cli index | subdomain | sequence.

index: the files of a folder, per series in order, with times and intervals, as
JSON lines. subdomain: the elements of a field whose box centres lie strictly
inside bounds, renumbered, as a new field. sequence: the text file that viewers
want beside a sequence of field files."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.spectral import interpolation
from nodeloom.operators import statistics as st
from nodeloom.operators.elements import tensor
from nodeloom.sources import fieldfile

NAME = re.compile(r"^(.*?)0?\.f(\d{5})$")  # a series' name, process digit, number


def parse_bounds(text: str) -> list[tuple[float, float]]:
    """x0,x1,y0,y1,z0,z1; an empty entry is no bound."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 6:
        raise ValueError("six numbers are needed")
    values = [float(p) if p else (float("-inf"), float("inf"))[k % 2] for k, p in enumerate(parts)]
    return [(values[2 * k], values[2 * k + 1]) for k in range(3)]


def parse_list(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def index_folder(spark: SparkSession, folder: str, start: float | None = None, statistics_start: float | None = None) -> DataFrame:
    """path, series, number, time, idx, time_prev, dt of the field files in a folder; only headers are read."""
    rows = []
    for path in fieldfile.files_of(folder):
        m = NAME.match(path.rsplit("/", 1)[-1])
        if m:
            rows.append((path, m[1], int(m[2]), fieldfile.read_header(path)["time"]))
    files = spark.createDataFrame(rows, "path string, series string, number int, time double")
    lit = lambda v: None if v is None else F.lit(float(v))
    return st.file_index(files, "series", ["number"], "time", lit(start), lit(statistics_start))


def subdomain(spark: SparkSession, path: str, out: str, bounds: list[tuple[float, float]], fields: list[str] | None = None, order: int | None = None) -> int:
    """Writes the elements inside bounds; how many they are. order: nodes per
    direction of the new field, if not those of the old one (in three dimensions)."""
    h = fieldfile.read_header(fieldfile.files_of(path)[0])
    df = fieldfile.read_field(spark, path)
    keep = F.lit(True)
    for c, (low, high) in zip("xyz", bounds, strict=True):
        if c in df.columns:
            centre = (F.array_min(c) + F.array_max(c)) / 2
            keep = keep & (centre > low) & (centre < high)
    kept = df.where(keep)
    wanted = [c for c in df.columns if c not in ("e", "time") and (not fields or c in fields or c in "xyz")]
    numbers = st.number_elements(kept.select("e")).withColumnsRenamed({"e": "old", "new_e": "e"})
    rows, shape = kept.withColumnRenamed("e", "old").join(numbers, "old").select("e", *wanted), h["shape"]
    if order and order != shape[0]:
        if shape[2] == 1:
            raise ValueError("the order of two-dimensional fields can't be changed")
        if wanted:
            rows = tensor(rows, wanted, interpolation(shape[0], order), wanted)
        shape = (order, order, order)
    fieldfile.write_field(rows, out, shape, h["time"], h["step"], h["wdsz"])
    return numbers.count()


def sequence(folder: str, series: str) -> str:
    """The viewer's text for a series in a folder."""
    numbers = sorted(int(m[2]) for p in fieldfile.files_of(folder) if (m := NAME.match(p.rsplit("/", 1)[-1])) and m[1] == series)
    if not numbers:
        raise FileNotFoundError(series)
    return f"filetemplate: {series}%01d.f%05d\nfirsttimestep: {numbers[0]}\nnumtimesteps: {len(numbers)}\n"


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="nodeloom")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("folder")
    i.add_argument("out")
    i.add_argument("--start", type=float)
    i.add_argument("--statistics-start", type=float)
    s = sub.add_parser("subdomain")
    s.add_argument("path")
    s.add_argument("out")
    s.add_argument("--bounds", required=True)
    s.add_argument("--fields", default="")
    s.add_argument("--order", type=int)
    v = sub.add_parser("sequence")
    v.add_argument("folder")
    v.add_argument("series")
    a = p.parse_args(args)
    if a.command == "sequence":
        print(sequence(a.folder, a.series), end="")
        return
    spark = SparkSession.builder.getOrCreate()
    if a.command == "index":
        index_folder(spark, a.folder, a.start, a.statistics_start).write.mode("overwrite").json(a.out)
    else:
        print(subdomain(spark, a.path, a.out, parse_bounds(a.bounds), parse_list(a.fields), a.order))


if __name__ == "__main__":
    main()
