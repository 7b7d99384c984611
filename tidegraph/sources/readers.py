"""Readers of graph files. Text formats are parsed by Spark; nothing but a header reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, normalize
from ..runtime import materialize

WEIGHTED_SUFFIXES = (".wel", ".gr", ".bin", ".wsg")
#: Fixed value: first word of the road format.
ROAD_MAGIC = 0x150842A7
#: Fixed value: centimetres in a radian at the earth's surface, as the road format has it.
ROAD_CM = 637100000.0


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))


def _pick(fields: DataFrame, first: int, weighted: bool, shift: int = 0) -> DataFrame:
    at = lambda i: F.col("f")[i]
    out = [(at(first).cast("long") - shift).alias("src"), (at(first + 1).cast("long") - shift).alias("dst")]
    if weighted:
        out.append(at(first + 2).cast("double").cast("int").alias("weight"))
    return fields.select(*out)


def edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """``u v`` (or ``u v w``) on each line, any blanks between."""
    return _pick(_fields(spark.read.text(path).where("trim(value) <> ''")), 0, weighted)


def dimacs(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``a u v w``; all others are comments. Ids stay as they are."""
    return _pick(_fields(spark.read.text(path).where("value like 'a %' or value like 'a\\t%'")), 1, True)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, _f, _at): lines with their file and the start of their split. Files of a folder follow by name."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_at"))


def numbered(placed: DataFrame, name: str) -> DataFrame:
    """Rows of :func:`_placed` lines with their place ``name``, from 0: a split's rows lie in order, so they are
    counted by split and shifted. Nothing is sorted and no row moves."""
    marked = materialize(placed.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = marked.groupBy("_f", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_low"))
    # a row a split
    shift = counts.select("_f", "_at", (F.sum("_n").over(Window.orderBy("_f", "_at")) - F.col("_n") - F.col("_low")).alias("_s"))
    return marked.join(F.broadcast(shift), ["_f", "_at"]).withColumn(name, F.col("_m") + F.col("_s")).drop("_f", "_at", "_m", "_s")


def metis(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(edges, n): header ``n m [fmt]``, then the 1-based neighbours (and weights, fmt 1) of vertex i in line i."""
    # comments do not count as vertices
    lines = numbered(_placed(spark, path).where("not ltrim(value) like '\\%%'"), "line")
    first = lines.where("line = 0").first()
    if first is None:
        raise ValueError("empty METIS file")
    head = first["value"].split()
    kind = head[2] if len(head) > 2 else "0"
    if kind not in ("0", "00", "000", "100", "1", "01", "001"):
        raise ValueError(f"unsupported METIS format {kind}")
    weighted = kind in ("1", "01", "001")
    body = lines.where("line > 0").withColumn("src", F.col("line") - 1)
    parts = F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x != "")
    numbers = body.select("src", F.transform(parts, lambda x: x.cast("long")).alias("f"))
    if weighted:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("f") / 2).cast("int") - 1), lambda i: F.struct((F.get("f", 2 * i) - 1).alias("dst"), F.get("f", 2 * i + 1).cast("int").alias("weight")))
        edges = numbers.where("size(f) > 1").select("src", F.explode(pairs).alias("e")).select("src", "e.dst", "e.weight")
    else:
        edges = numbers.select("src", F.explode("f").alias("dst")).select("src", (F.col("dst") - 1).alias("dst"))
    return edges, int(head[0])


def matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, bool]:
    """(edges, n, weighted): coordinate format, 1-based; symmetric matrices in both directions."""
    text = spark.read.text(path)
    head = text.where("value like '\\%\\%MatrixMarket%'").first()
    if head is None:
        raise ValueError("no MatrixMarket header")
    words = head["value"].lower().split()
    if len(words) < 5 or words[1] != "matrix" or words[2] != "coordinate":
        raise ValueError("only coordinate matrices are graphs")
    field, symmetry = words[3], words[4]
    if field not in ("pattern", "real", "double", "integer") or symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"unsupported matrix: {field} {symmetry}")
    lines = _placed(spark, path).withColumn("_m", F.monotonically_increasing_id()).where("not value like '\\%%' and trim(value) <> ''")
    first = lines.agg(F.min(F.struct("_f", "_at", "_m", "value")).alias("x")).first()["x"]
    rows, columns, _ = (int(x) for x in first["value"].split())
    if rows != columns:
        raise ValueError("the matrix is not square")
    weighted = field != "pattern"
    edges = _pick(_fields(lines.where((F.col("_f") != first["_f"]) | (F.col("_at") != first["_at"]) | (F.col("_m") != first["_m"]))), 0, weighted, 1)
    if symmetry == "symmetric":
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if weighted else [])))
    return edges, rows, weighted


def adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, int, bool]:
    """(edges, n, weighted): (Weighted)AdjacencyGraph text: name, n, m, n offsets, m targets[, m weights]."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x != "")
    ranked = numbered(_placed(spark, path).select("_f", "_at", F.explode(tokens).alias("t")), "i")
    head = {r["i"]: r["t"] for r in ranked.where("i < 3").collect()}
    if head.get(0) not in ("AdjacencyGraph", "WeightedAdjacencyGraph"):
        raise ValueError("not an adjacency graph")
    weighted, n, m = head[0].startswith("W"), int(head[1]), int(head[2])
    # the name is no number, wherever the plan casts
    number = F.when(F.col("i") > 0, F.col("t")).cast("long")
    offsets = ranked.where(f"i >= 3 and i < {3 + n}").select((F.col("i") - 3).alias("src"), number.alias("begin"))
    after = offsets.select((F.col("src") - 1).alias("src"), F.col("begin").alias("end"))
    ranges = offsets.join(after, "src", "left").select("src", "begin", F.coalesce("end", F.lit(m)).alias("end")).where("end > begin")
    slots = ranges.select("src", F.explode(F.sequence("begin", F.col("end") - 1)).alias("e"))
    edges = slots.join(ranked.where(f"i >= {3 + n} and i < {3 + n + m}").select((F.col("i") - 3 - n).alias("e"), number.alias("dst")), "e")
    if weighted:
        edges = edges.join(ranked.where(f"i >= {3 + n + m}").select((F.col("i") - 3 - n - m).alias("e"), number.cast("int").alias("weight")), "e")
    return edges.select("src", "dst", *(["weight"] if weighted else [])), n, weighted


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``i j v``."""
    return spark.read.csv(path, sep="\t", schema="src long, dst long, weight int")


def _binary(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """One binary file, decoded on an executor."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield from pa.Table.from_pydict(decode(blob.as_py())).to_batches(1 << 16)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _road(blob: bytes):
    magic, n = np.frombuffer(blob, "<u4", 2)
    if magic != ROAD_MAGIC:
        raise ValueError("not a road graph")
    at, coordinates, src, dst, weight = 8, [], [], [], []
    for v in range(int(n)):
        lat, lon = np.frombuffer(blob, "<f8", 2, at)
        (degree,) = np.frombuffer(blob, "<u4", 1, at + 16)
        coordinates.append((v, lat, lon))
        at += 20
        src.append(np.full(degree, v, np.int64))
        dst.append(np.frombuffer(blob, "<u4", degree, at).astype(np.int64))
        at += 4 * int(degree)
        weight.append((np.frombuffer(blob, "<f8", degree, at) * ROAD_CM).astype(np.int32))
        at += 8 * int(degree)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return coordinates, join(src, np.int64), join(dst, np.int64), join(weight, np.int32)


def road(spark: SparkSession, path: str) -> DataFrame:
    """Binary road graph: magic, n, then per vertex latitude, longitude, degree, ids and lengths in radians."""

    def decode(blob: bytes) -> dict:
        _, src, dst, weight = _road(blob)
        return {"src": src, "dst": dst, "weight": weight}

    return _binary(spark, path, decode, "src long, dst long, weight int")


def road_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lon) of the same file."""

    def decode(blob: bytes) -> dict:
        coordinates = _road(blob)[0]
        return {"id": [c[0] for c in coordinates], "lat": [float(c[1]) for c in coordinates], "lon": [float(c[2]) for c in coordinates]}

    return _binary(spark, path, decode, "id long, lat double, lon double")


def serialized(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Serialised CSR: directed flag, edges, vertices, offsets, neighbours (with int32 weights if weighted)."""

    def decode(blob: bytes) -> dict:
        m, n = (int(x) for x in np.frombuffer(blob, "<i8", 2, 1))
        offsets = np.frombuffer(blob, "<i8", n + 1, 17)
        row = np.frombuffer(blob, "<i4", m * (2 if weighted else 1), 17 + 8 * (n + 1)).reshape(m, -1)
        out = {"src": np.repeat(np.arange(n), np.diff(offsets)), "dst": row[:, 0].astype(np.int64)}
        return out | ({"weight": row[:, 1].astype(np.int32)} if weighted else {})

    return _binary(spark, path, decode, "src long, dst long" + (", weight int" if weighted else ""))


def read_graph(spark: SparkSession, path: str, weighted: bool | None = None, symmetrize: bool = False, clean: bool | None = None) -> Graph:
    """Load by suffix: .el .wel .gr .graph .mtx .bin .sg .wsg .tsv, Parquet, or adjacency text without suffix.

    Text formats are cleaned (no self-loops, no repeats, least weight); serialised graphs and Parquet are
    taken as they are unless ``clean`` says so. ``weighted=False`` drops weights.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[1] if "." in name else ""
    n = None
    raw = suffix in (".sg", ".wsg", ".parquet")
    if suffix == ".el":
        edges = edge_list(spark, path)
    elif suffix == ".wel":
        edges = edge_list(spark, path, True)
    elif suffix == ".gr":
        edges = dimacs(spark, path)
    elif suffix == ".graph":
        edges, n = metis(spark, path)
    elif suffix == ".mtx":
        edges, n, _ = matrix_market(spark, path)
    elif suffix == ".bin":
        edges = road(spark, path)
    elif suffix in (".sg", ".wsg"):
        edges = serialized(spark, path, suffix == ".wsg")
    elif suffix == ".tsv":
        edges = tsv(spark, path)
    elif suffix == ".parquet":
        edges = spark.read.parquet(path)
    elif not suffix:
        edges, n, _ = adjacency(spark, path)
    else:
        raise ValueError(f"unknown graph format: {suffix}")
    if weighted and "weight" not in edges.columns:
        raise ValueError(f"{suffix} files have no weights")
    if weighted is False:
        edges = edges.select("src", "dst")
    clean = not raw if clean is None else clean
    return Graph(normalize(edges, symmetrize) if clean or symmetrize else edges, n, symmetrize)
