"""Readers and writers: FITS light curves, score tables, arrays with names, download scripts."""

from __future__ import annotations

import io
import json
import re
import time as clock
import urllib.request
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import cut

SCORES = "tic long, filename string, anomaly_score double"
_KINDS = {"L": "b1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def fits_layout(read, hdu: int = 1) -> tuple[np.dtype, int, int]:
    """(row, rows, offset) of a binary-table extension: 2880-byte blocks of 80-character cards, then big-endian rows.

    read: (offset, length) -> bytes of the file; headers alone are read.
    """
    at = 0
    for number in range(hdu + 1):
        cards: dict[str, str] = {}
        while True:
            block = read(at, 2880)
            if len(block) < 2880:
                raise ValueError("the file ends within a header")
            at += 2880
            lines = [block[i : i + 80].decode("ascii", "replace") for i in range(0, 2880, 80)]
            for line in lines:
                if line[8:10] == "= ":
                    value = line[10:].strip()
                    cards[line[:8].strip()] = value[1 : value.index("'", 1)].strip() if value.startswith("'") else value.split("/")[0].strip()
            if any(line[:8].strip() == "END" for line in lines):
                break
        axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
        size = (abs(int(cards["BITPIX"])) // 8 * int(np.prod(axes)) + int(cards.get("PCOUNT", 0))) if axes else 0
        if number == hdu:
            break
        at += -(-size // 2880) * 2880
    fields = []
    for i in range(1, int(cards["TFIELDS"]) + 1):
        count, kind = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"]).groups()
        count = int(count or 1)
        name = cards.get(f"TTYPE{i}", f"f{i}")
        fields.append((name, f"S{count}") if kind == "A" else (name, _KINDS[kind], (count,)) if count != 1 else (name, _KINDS[kind]))
    row = np.dtype(fields)
    if row.itemsize != axes[0]:
        raise ValueError(f"rows of {axes[0]} bytes, and columns of {row.itemsize}")
    return row, axes[1], at


def fits_table(data: bytes, columns: list[str], hdu: int = 1) -> dict[str, np.ndarray]:
    """Columns of a binary-table extension that is in memory."""
    row, count, at = fits_layout(lambda at, n: data[at : at + n], hdu)
    rows = np.frombuffer(data, dtype=row, count=count, offset=at)
    return {c: rows[c].astype(float) for c in columns}


def light_curves(spark: SparkSession, path: str, time: str = "TIME", columns=("PDCSAP_FLUX",), pattern: str = "*.fits") -> DataFrame:
    """(filename, t, flux and further columns, error): a row a point; a file that can't be read is one row with its error.

    Files are read through Spark, so any store that it reaches will do; NaN and infinities are null.
    """
    names = ["t", "flux", *[c.lower() for c in columns[1:]]]

    def parse(batches):
        for pdf in batches:
            for file, data in zip(pdf["filename"], pdf["content"]):
                try:
                    found = fits_table(bytes(data), [time, *columns])
                    out = pd.DataFrame({n: found[c] for n, c in zip(names, [time, *columns])}).replace([np.inf, -np.inf], np.nan)
                    out.insert(0, "filename", file)
                    out["error"] = None
                except Exception as e:  # one bad file is one marked row
                    out = pd.DataFrame([{"filename": file, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}])
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    schema = "filename string, " + ", ".join(f"{n} double" for n in names) + ", error string"
    parsed = files.mapInPandas(parse, schema)
    return parsed.select("filename", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names], "error")


#: Columns of the centroid test, and the names that series.centroid_shift gives them.
CENTROIDS = {"PDCSAP_FLUX": "flux", "MOM_CENTR1": "mom_x", "MOM_CENTR2": "mom_y", "POS_CORR1": "pos_x", "POS_CORR2": "pos_y"}


def open_file(path: str):
    """A file of a local folder or a store, opened for reads at any place; only what is asked for is read."""
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def light_curve_ranges(
    spark: SparkSession, path: str, time: str = "TIME", columns: dict[str, str] | None = None, pattern: str = "*.fits", joint: bool = False, task_bytes: int = 64 << 20, opened=open_file
) -> DataFrame:
    """(filename, t, a column for each of ``columns``, error): as light_curves, for files of any size, read by ranges of rows.

    columns: names in the file to names of the result, the flux alone by default. Files are listed by Spark without their
    content, headers are read by tasks, and each file is dealt in ranges of about ``task_bytes`` to tasks that read these
    bytes alone, so that neither a large file nor many small ones load a task. NaN and infinities are null; ``joint``
    leaves out points that lack any of the columns. A file whose header can't be read, lacks a column, or promises more
    rows than there are is one row with its error; so is a range that can't be read, beside what was read of it.
    opened: path -> file with seek and read, for stores that pyarrow does not know.
    """
    columns = columns or {"PDCSAP_FLUX": "flux"}
    names = {time: "t", **columns}
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")

    def plan(batches):
        for pdf in batches:
            out = []
            for file, length in zip(pdf["path"], pdf["length"]):
                try:
                    with opened(file) as source:
                        row, count, start = fits_layout(lambda at, n, source=source: (source.seek(at), source.read(n))[1])
                    if lost := [c for c in names if c not in (row.names or ())]:
                        raise KeyError(", ".join(lost))
                    if start + count * row.itemsize > length:
                        raise ValueError(f"{count} rows do not fit into {length} bytes")
                    picked = {"names": list(names), "formats": [row.fields[c][0].str for c in names], "offsets": [row.fields[c][1] for c in names], "itemsize": row.itemsize}
                    step = max(1, task_bytes // row.itemsize)
                    out += [(file, start + at * row.itemsize, min(step, count - at), json.dumps(picked), None) for at in range(0, count, step)]
                except Exception as e:  # one bad file is one marked row
                    out.append((file, 0, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "at", "rows", "row", "error"])

    ranges = cut(listed.mapInPandas(plan, "path string, at long, rows long, row string, error string"))
    width = F.coalesce(F.get_json_object("row", "$.itemsize").cast("long"), F.lit(0))
    count, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("rows") * width), F.lit(0))).first()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))))

    def points(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                bad = dict.fromkeys(names.values()) | {"filename": r.path.rsplit("/", 1)[-1], "error": r.error}
                try:
                    if r.error is None:
                        row = np.dtype(json.loads(r.row))
                        with opened(r.path) as source:
                            source.seek(r.at)
                            for at in range(0, r.rows, 65536):
                                rows = np.frombuffer(source.read(min(65536, r.rows - at) * row.itemsize), dtype=row)
                                if len(rows) < min(65536, r.rows - at):
                                    raise ValueError("the file ends within its rows")
                                yield pd.DataFrame({n: rows[c].astype(float) for c, n in names.items()} | {"filename": bad["filename"], "error": None})
                except Exception as e:  # one range that can't be read is one marked row
                    bad["error"] = f"{type(e).__name__}: {e}"
                if bad["error"]:
                    yield pd.DataFrame([bad])

    schema = "filename string, " + ", ".join(f"{n} double" for n in names.values()) + ", error string"
    found = ranges.repartition(tasks).mapInPandas(points, schema)
    finite = lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))
    out = found.select("filename", *[finite(n).alias(n) for n in names.values()], "error")
    return out.filter(F.col("error").isNotNull() | F.expr(" AND ".join(f"{n} IS NOT NULL" for n in names.values()))) if joint else out


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SCORES, nullValue="None")


def read_csv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """Any CSV with a header; repeated names get .1, .2 and so on."""
    raw = spark.read.csv(path, header=True, inferSchema=True, **({"comment": comment} if comment else {}))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.filter(~F.startswith("value", F.lit(comment))).first() if comment else lines.first()
    if first is None:
        raise ValueError(f"no header in {path}")
    head = first["value"]
    seen: dict[str, int] = {}
    names = []
    for name in next(iter(pd.read_csv(io.StringIO(head), header=None, dtype=str).values)).tolist():
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return raw.toDF(*names)


def read_array_folder(spark: SparkSession, folder: str, time: str) -> DataFrame:
    """(filename, t, flux): a row a point of every .npy of the folder whose name lacks "time", at the times of the file ``time``.

    The times, one array, go along with each file; files are read by tasks. An array of another length is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    clock = found.filter(F.col("filename") == time).select(F.col("content").alias("clock"))
    if clock.isEmpty():
        raise FileNotFoundError(f"{folder}/{time}")

    def parse(batches):
        for pdf in batches:
            for name, data, ticks in zip(pdf["filename"], pdf["content"], pdf["clock"]):
                t, y = (np.load(io.BytesIO(bytes(b)), allow_pickle=False).astype(float).ravel() for b in (ticks, data))
                if len(t) != len(y):
                    raise ValueError(f"{name}: {len(y)} values at {len(t)} times")
                yield pd.DataFrame({"filename": name, "t": t, "flux": y})

    return found.filter(~F.col("filename").contains("time")).join(F.broadcast(clock)).mapInPandas(parse, "filename string, t double, flux double")  # a single array


def pick_random(spark: SparkSession, folder: str, pattern: str = "*.fits", seed: int = 42) -> str | None:
    """The path of one file at any depth, or None; the same seed picks the same file."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    row = paths.orderBy(F.xxhash64("path", F.lit(seed)), "path").first()
    return row["path"] if row else None


def with_folder(df: DataFrame) -> DataFrame:
    """Rows read from files, with input_dir: the name of the folder that each row's file lies in."""
    return df.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("input_dir"), *df.columns)


def read_arrays(spark: SparkSession, matrix: str, names: str) -> DataFrame:
    """(filename, vec) from a .npy matrix and a text file with one name a line; their lengths must agree.

    Both are read by tasks, and rows meet their names by position. A file is held by one task, so it must be under 2 GB.
    """

    def rows(batches):
        for pdf in batches:
            for data in pdf["content"]:
                x = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                for at in range(0, len(x), 1024):
                    part = x[at : at + 1024].astype(float)
                    yield pd.DataFrame({"at": np.arange(at, at + len(part)), "vec": list(part.reshape(len(part), -1))})

    def lines(batches):
        for pdf in batches:
            for data in pdf["content"]:
                found = bytes(data).decode().splitlines()
                yield pd.DataFrame({"at": np.arange(len(found)), "filename": found})

    file = spark.read.format("binaryFile")
    vectors = file.load(matrix).select("content").mapInPandas(rows, "at long, vec array<double>")
    keys = file.load(names).select("content").mapInPandas(lines, "at long, filename string")
    n, m = vectors.count(), keys.count()
    if n != m:
        raise ValueError(f"{n} rows and {m} names")
    return keys.join(vectors, "at").select("filename", "vec")


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header, by all tasks; append adds files to the folder, which needs no lock."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_cluster_report(labels: DataFrame, folder: str, algorithm: str, told: dict, run: str, key: str = "filename") -> None:
    """Labels (key, label) as CSV (filename, cluster_label), and a text of the model's numbers and the clusters' sizes.

    told: name -> number, three decimals, those that are None or NaN left out. run names both folders.
    """
    labels.select(F.col(key).alias("filename"), F.col("label").alias("cluster_label")).write.csv(f"{folder}/{algorithm}_results_{run}", header=True)
    head = [f"Clustering Algorithm: {algorithm}", *[f"{name}: {x:.3f}" if isinstance(x, float) else f"{name}: {x}" for name, x in told.items() if x is not None and x == x], "Cluster Sizes:"]
    lines = labels.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "at long, value string")
    title = F.when(F.col("label") == -1, F.lit("  Noise (label -1)")).otherwise(F.concat(F.lit("  Cluster "), F.col("label")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").cast("long").alias("at"), F.concat(title, F.lit(": "), "n", F.lit(" curves")).alias("value"))
    sizes = sizes.withColumn("at", F.col("at") + 1)  # noise comes first, after the head
    lines.unionByName(sizes).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{folder}/{algorithm}_metadata_{run}")  # a line a cluster


def write_vectors(df: DataFrame, path: str, key: str = "filename", vec: str = "vec") -> None:
    """(key, vec) as Parquet, the form that read_vectors and every operator take."""
    df.select(F.col(key).alias("filename"), F.col(vec).cast("array<double>").alias("vec")).write.mode("overwrite").parquet(path)


def write_array_parts(df: DataFrame, folder: str, key: str = "filename", vec: str = "vec", rows: int = 65536) -> DataFrame:
    """Writes pairs of files to ``folder``, a URI or a path that all tasks reach: a .npy matrix and a .txt of as many names, a line each.

    Each task writes a pair for every ``rows`` rows, so none holds more. Vectors must be of one length, without nulls, and
    names without line breaks. A file is moved to its name when it is whole: a task that runs again leaves the same files. Returns (part, rows).
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(_uri(folder))
        store.create_dir(base, recursive=True)
        for number, pdf in enumerate(_regrouped(batches, rows)):
            named = pdf["filename"].notna() & ~pdf["filename"].str.contains("\n", na=False)
            if pdf["vec"].isna().any() or pdf["vec"].map(len).nunique() > 1 or not named.all():
                raise ValueError("vectors that are null or of several lengths, or names that are null or of several lines")
            x = np.array(pdf["vec"].tolist(), dtype=float)
            body = io.BytesIO()
            np.save(body, x)
            name = f"part-{part:05d}-{number:05d}"
            for suffix, data in ((".txt", "\n".join(pdf["filename"]).encode()), (".npy", body.getvalue())):
                _put(store, base, name + suffix, [data])
            yield pd.DataFrame({"part": [name], "rows": [len(x)]})

    return cut(df.select(F.col(key).cast("string").alias("filename"), F.col(vec).cast("array<double>").alias("vec")).mapInPandas(run, "part string, rows long"))


def read_array_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, vec) of a folder that write_array_parts has filled; a matrix must have as many rows as its file has names."""
    found = spark.read.format("binaryFile").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.(npy|txt)$", 1).alias("stem")
    of = lambda suffix, name: found.filter(F.col("path").endswith(suffix)).select(stem, F.col("content").alias(name))

    def run(batches):
        for pdf in batches:
            for data, names in zip(pdf["x"], pdf["names"]):
                x, lines = np.load(io.BytesIO(bytes(data)), allow_pickle=False), bytes(names).decode().split("\n")
                if len(x) != len(lines):
                    raise ValueError(f"{len(x)} rows and {len(lines)} names")
                yield pd.DataFrame({"filename": lines, "vec": list(x.astype(float))})

    return of(".npy", "x").join(of(".txt", "names"), "stem").mapInPandas(run, "filename string, vec array<double>")


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _put(store, base: str, name: str, chunks) -> int:
    """Writes chunks to a name of this attempt's own, then moves them to ``name``; how many bytes there were."""
    attempt, size = f"{base}/.{uuid.uuid4().hex}", 0
    try:
        with store.open_output_stream(attempt, compression=None) as out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        store.move(attempt, f"{base}/{name}")
    except BaseException:
        if store.get_file_info(attempt).type != fs.FileType.NotFound:
            store.delete_file(attempt)
        raise
    return size


def _regrouped(batches, rows: int):
    """Frames of ``rows`` rows, the last one of fewer."""
    held, n = [], 0
    for pdf in batches:
        while len(pdf):
            take = min(rows - n, len(pdf))
            held.append(pdf.iloc[:take])
            pdf, n = pdf.iloc[take:], n + take
            if n == rows:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("filename", "vec")


def read_results(spark: SparkSession, path: str, suffix: str = "_results.csv", schema: str = SCORES, first: int | None = None) -> DataFrame:
    """(variant, columns) of all result files below ``path``; the variant is the file's name without the suffix.

    first: only the first so many variants by name. Rows that can't be read are dropped.
    """
    raw = spark.read.csv(path, header=True, schema=schema, nullValue="None", mode="DROPMALFORMED", pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
    out = raw.select(F.substring_index(F.col("_metadata.file_name"), suffix, 1).alias("variant"), *raw.columns)
    if first is None:
        return out
    return out.join(F.broadcast(out.select("variant").distinct().orderBy("variant").limit(first)), "variant", "left_semi")


def fetch(urls: DataFrame, get, done: DataFrame | None = None, start: int = 0, most: int | None = None, tasks: int = 4) -> DataFrame:
    """(url, content, error) for urls (url) in order from ``start``, those in ``done`` (url) left out; a failure is one row.

    get: url -> bytes, called by ``tasks`` tasks. Rows may go straight to a sink, so a batch that was written counts as done.
    """
    rows = urls.select("url").distinct().orderBy("url").offset(start)
    rows = rows if most is None else rows.limit(most)
    if done is not None:
        rows = rows.join(done.select("url"), "url", "left_anti")

    def run(batches):
        for pdf in batches:
            for url in pdf["url"]:
                try:
                    yield pd.DataFrame({"url": [url], "content": [bytes(get(url))], "error": [None]})
                except Exception as e:  # one failed address is one marked row
                    yield pd.DataFrame({"url": [url], "content": [None], "error": [f"{type(e).__name__}: {e}"]})

    return rows.repartition(tasks).mapInPandas(run, "url string, content binary, error string")


def over_http(url: str, timeout: float, chunk: int = 1 << 16):
    """The body of ``url`` in chunks; an answer that stays away for ``timeout`` seconds is an error."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        while data := answer.read(chunk):
            yield data


def download(
    urls: DataFrame, folder: str, get=over_http, start: int = 0, most: int | None = None, tasks: int = 8, timeout: float = 60.0, tries: int = 3, wait: float = 1.0
) -> DataFrame:
    """(url, filename, status, bytes, error) of urls (url) in order from ``start``, written to ``folder``, a URI or a path that all tasks reach.

    A file is named after its address up to a query; of addresses with one name the smallest counts. status: "done"; "there",
    if the folder has the file, which is then not fetched; "failed", after ``tries`` attempts with pauses that double
    from ``wait`` seconds. get: (url, timeout) -> chunks of bytes, which go straight to the store, so that a body of any
    size passes through; a file that breaks off is taken away again. Run once: the answer is kept in the shared folder.
    """
    name = F.element_at(F.split(F.substring_index("url", "?", 1), "/"), -1)
    rows = urls.select("url").filter("url IS NOT NULL").groupBy(name.alias("filename")).agg(F.min("url").alias("url")).filter("filename <> ''")
    rows = rows.orderBy("url").offset(start)
    rows = rows if most is None else rows.limit(most)

    def fetched(store, base: str, url: str, file: str) -> tuple:
        if store.get_file_info(f"{base}/{file}").type != fs.FileType.NotFound:
            return "there", None, None
        for attempt in range(tries):
            if attempt:
                clock.sleep(wait * 2 ** (attempt - 1))
            try:
                return "done", _put(store, base, file, get(url, timeout)), None
            except Exception as e:  # one address that fails is one marked row
                error = f"{type(e).__name__}: {e}"
        return "failed", None, error

    def run(batches):
        store, base = fs.FileSystem.from_uri(_uri(folder))
        store.create_dir(base, recursive=True)
        for pdf in batches:
            for url, file in zip(pdf["url"], pdf["filename"]):
                status, size, error = fetched(store, base, url, file)
                yield pd.DataFrame({"url": [url], "filename": [file], "status": [status], "bytes": pd.array([size], dtype="Int64"), "error": [error]})

    return cut(cut(rows).repartition(tasks).mapInPandas(run, "url string, filename string, status string, bytes long, error string"))


def script_urls(lines: DataFrame, line: str = "value") -> DataFrame:
    """(url) of each curl or wget line: its last word, without quotes."""
    text = F.trim(F.col(line))
    return lines.filter(text.rlike("^(curl|wget)")).select(F.regexp_replace(F.element_at(F.split(text, r"\s+"), -1), "['\"]", "").alias("url"))


def script_ids(lines: DataFrame, line: str = "value") -> DataFrame:
    """(tic): distinct ids in file names of download scripts."""
    found = F.regexp_extract(line, r"[0-9a-z\-]+-(\d{16})-", 1)
    return lines.select(found.alias("tic")).filter("tic <> ''").select(F.col("tic").cast("long")).distinct()
