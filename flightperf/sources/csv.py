"""On-time CSV sources: single files, directories, headered files and zip archives.

All readers take the positional 109-column layout as text (no inference) and type the
integer columns leniently, so ``1.00`` / ``-5.00`` / empty / junk become 1 / -5 / NULL / NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightperf.functions import exprs as X
from flightperf.session import scratch_path
from flightperf.sources.schema import INT_COLUMNS, ONTIME_COLUMNS, RAW_SCHEMA, WORKING_NAMES

# Excel-style quoting: fields in double quotes may hold commas; a doubled quote is a quote.
CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _reader(spark: SparkSession, header: bool, recursive: bool):
    r = spark.read.schema(RAW_SCHEMA).options(**CSV_OPTIONS)
    # with a header the schema still wins by position (files carry their own names)
    r = r.option("header", header).option("enforceSchema", True)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r


def read_raw_csv(spark: SparkSession, paths, header: bool = False, recursive: bool = False) -> DataFrame:
    """All 109 columns as text from one file, a list of files or a directory."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _reader(spark, header, recursive).csv(paths)


def type_columns(raw: DataFrame) -> DataFrame:
    """Lenient integer typing of the 17 integer columns; text stays text."""
    ints = set(INT_COLUMNS)
    return raw.selectExpr(*[f"{X.lenient_int_sql(f'`{c}`')} AS `{c}`" if c in ints else f"`{c}`"
                            for c in raw.columns])


def to_working(typed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 16 working columns under their working names; ``flight_date`` as DATE. Columns to ``keep`` come first."""
    cols = list(keep)
    for src, dst in WORKING_NAMES.items():
        expr = f"try_to_date(`{src}`, 'yyyy-MM-dd')" if dst == "flight_date" else f"`{src}`"
        cols.append(f"{expr} AS {dst}")
    return typed.selectExpr(*cols)


def read_flights_csv(spark: SparkSession, paths, header: bool = False, recursive: bool = False) -> DataFrame:
    """Flights (working columns) from on-time CSV. Only the 16 used columns are typed;
    the CSV parser still tokenizes each line but skips converting unused fields."""
    return to_working(type_columns(read_raw_csv(spark, paths, header, recursive)))


def read_flights_dir(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Every CSV file under ``path`` (nested folders included) is one relation."""
    return read_flights_csv(spark, path, header=header, recursive=True)


# --- zip archives ---------------------------------------------------------------

BLOCK_BYTES = 8 << 20   # inflate members in 8 MB blocks; one output batch per block
MAX_MEMBER_TASKS = 100_000


# Functions that run inside Python workers are self-contained (stdlib / pyarrow only, helpers
# nested): cloudpickle then ships them by value, so executors need no copy of this package.

def _opener():
    def opened(uri: str):
        """The archive as a seekable stream from the store it lies in."""
        import io

        from pyarrow import fs as pafs
        if "://" in uri:
            store, place = pafs.FileSystem.from_uri(uri)
        else:
            store, place = pafs.LocalFileSystem(), uri[len("file:"):] if uri.startswith("file:") else uri
        stream = store.open_input_file(place)
        # the zip reader looks for records before the start of a very short (empty) archive
        return io.BytesIO(stream.read()) if stream.size() < 1024 else stream
    return opened


def _list_members(opened):
    """(path) -> (archive, place, member, bytes) of every CSV member, from the central directory alone."""
    def run(batches):
        import zipfile

        import pyarrow as pa
        for rb in batches:
            for path in rb.column("path").to_pylist():
                with opened(path) as stream, zipfile.ZipFile(stream) as zf:
                    found = [(i, m.filename, m.file_size) for i, m in enumerate(zf.infolist()) if m.filename.lower().endswith(".csv")]
                if found:
                    place, member, size = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(found), pa.string()), pa.array(place, pa.int32()), pa.array(member, pa.string()),
                         pa.array(size, pa.int64())], names=["archive", "place", "member", "bytes"])
    return run


def _unzip_lines(opened, header: bool, block_bytes: int = BLOCK_BYTES):
    def member_lines(fh):
        """Lines of one zip member, block by block (a line split across blocks is carried)."""
        held, first = [], True          # pieces of a line that is not ended yet
        while True:
            block = fh.read(block_bytes)
            if not block:
                break
            cut = block.rfind(b"\n")
            if cut < 0:
                held.append(block)
                continue
            whole, held = b"".join([*held, block[:cut]]), [block[cut + 1:]]
            lines = whole.decode("utf-8", errors="replace").split("\n")
            if first:
                first = False
                if header and lines:
                    lines = lines[1:]
            yield [ln.rstrip("\r") for ln in lines if ln.strip("\r")]
        last = b"".join(held)
        if last.strip() and not (first and header):
            yield [last.decode("utf-8", errors="replace").rstrip("\r")]

    def run(batches):
        import zipfile

        import pyarrow as pa
        for rb in batches:
            for path, place in zip(rb.column("archive").to_pylist(), rb.column("place").to_pylist()):
                with opened(path) as stream, zipfile.ZipFile(stream) as zf, zf.open(zf.infolist()[place]) as fh:
                    for lines in member_lines(fh):
                        if lines:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())],
                                names=["archive", "line"])
    return run


def zip_members(spark: SparkSession, path) -> DataFrame:
    """The CSV members of every ``*.zip`` archive under ``path`` (one or several): archive, place (in
    the archive's directory), member, bytes (inflated). Only central directories are read."""
    archives = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
                .option("recursiveFileLookup", True).load(path).select("path"))
    return archives.mapInArrow(_list_members(_opener()), "archive string, place int, member string, bytes long")


def read_zip_lines(spark: SparkSession, path, header: bool = True, spread: bool = True) -> DataFrame:
    """CSV lines of every ``*.zip`` archive under ``path``: (archive, line).

    A zip member can only be inflated front to back, but a central directory says where each one
    starts: so a first small job lists the members (kept as a table in the shared scratch folder), and
    each is a task of its own, whatever archive it lies in. Such a task opens the archive in the shared
    store and inflates its member in 8 MB blocks, one Arrow batch of lines per block
    (``mapInArrow``, no pandas conversion), so a member of any size takes bounded memory. With ``spread``
    (default) the lines are then redistributed round robin into AQE-sized partitions, so parsing and
    aggregation of an oversized member - say a third of all rows - run on many tasks instead of one;
    inflating is the only per-member step left. ``spread=False`` saves that shuffle when members
    are known to be many and of even size.
    """
    listed = scratch_path(spark, "zip-members")
    zip_members(spark, path).write.parquet(listed)
    members = spark.read.schema("archive string, place int").parquet(listed)
    # dealt one by one from a single short list, so each task has one member (MAX_MEMBER_TASKS: several)
    dealt = members.coalesce(1).repartition(max(1, min(MAX_MEMBER_TASKS, members.count())))
    lines = dealt.mapInArrow(_unzip_lines(_opener(), header), "archive string, line string")
    return lines.hint("rebalance") if spread else lines


def read_flights_zip(spark: SparkSession, path, header: bool = True, spread: bool = True,
                     keep_archive: bool = False) -> DataFrame:
    """Flights from zipped monthly archives: unzip in Python (bounded chunks), parse the
    CSV lines JVM-side with ``from_csv`` and the positional text schema. ``keep_archive`` adds
    the archive of each row as the first column."""
    lines = read_zip_lines(spark, path, header, spread)
    ddl = ", ".join(f"`{c}` string" for c in ONTIME_COLUMNS)
    opts = {k: v for k, v in CSV_OPTIONS.items() if k != "mode"}
    parsed = lines.select("archive", F.from_csv("line", ddl, opts).alias("r")).select("archive", "r.*")
    return to_working(type_columns(parsed), ("archive",) if keep_archive else ())


# --- writing on-time text (fixtures, export) ----------------------------------------

NO_MONTH = "__HIVE_DEFAULT_PARTITION__"

def _num_text_sql(c: str) -> str:
    """Numbers as the published files write them: ``20.00``, ``-5.00``, empty for NULL."""
    return f"CASE WHEN {c} IS NULL THEN CAST(NULL AS STRING) ELSE format_string('%.2f', CAST({c} AS DOUBLE)) END"


def to_ontime_text(flights: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flights (working columns) -> the 109 text columns of an on-time file. Columns to ``keep`` come last."""
    plain_ints = {"Year", "Quarter", "Month", "DayofMonth", "DayOfWeek"}
    fixed = {
        "Carrier": "carrier",
        "OriginCityName": "'Dallas, TX'",       # exercises quoted commas
        "DestCityName": "'He said \"x\"'",      # exercises doubled quotes
    }
    cols = []
    for c in ONTIME_COLUMNS:
        dst = WORKING_NAMES.get(c)
        if dst is None:
            e = fixed.get(c, "CAST(NULL AS STRING)")
        elif dst == "flight_date":
            e = X.date_text_sql("flight_date")
        elif c in INT_COLUMNS and c not in plain_ints:
            e = _num_text_sql(dst)
        else:
            e = f"CAST({dst} AS STRING)"
        cols.append(f"{e} AS `{c}`")
    return flights.selectExpr(*cols, *keep)


def _to_write(flights: DataFrame, partition_col: str | None) -> DataFrame:
    """The text of ``flights``, dealt as it is to be written.

    The 109 text columns only exist in the task that writes them. For a folder a month, rows are dealt to months
    and sorted as working columns, and the month is never null (rows of no date go to Hive's default
    partition), so that the writer takes this order and doesn't sort the text."""
    if not partition_col:
        return to_ontime_text(flights)
    # AQE rebalance sizes the files (a big month is split, small ones are not scattered over every task)
    month = f"coalesce(substring({X.date_text_sql('flight_date')}, 1, 7), '{NO_MONTH}') AS _part"
    dealt = flights.selectExpr("*", month).hint("rebalance", "_part").sortWithinPartitions("_part")
    return to_ontime_text(dealt, ("_part",))


def write_ontime_csv(flights: DataFrame, path: str, header: bool = False,
                     partition_col: str | None = None, max_records_per_file: int = 0) -> None:
    text = _to_write(flights, partition_col)
    writer = (text.write.mode("overwrite").options(**{k: v for k, v in CSV_OPTIONS.items() if k != "mode"})
              .option("header", header).option("quoteAll", False).option("emptyValue", ""))
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_col:
        writer = writer.partitionBy("_part")
    writer.csv(path)


def _zip_files(out_dir: str):
    def filesystem(uri: str):
        """(pyarrow filesystem, path) for a Spark-style location: ``file:/x``, ``/x``,
        ``hdfs://…``, ``s3://…`` and the other schemes pyarrow resolves."""
        from pyarrow import fs as pafs
        if "://" not in uri:
            local = uri[len("file:"):] if uri.startswith("file:") else uri
            return pafs.LocalFileSystem(), local
        return pafs.FileSystem.from_uri(uri)

    def run(batches):
        import hashlib
        import io
        import zipfile

        import pandas as pd
        fs_, base = filesystem(out_dir)
        fs_.create_dir(base, recursive=True)
        for pdf in batches:
            names = []
            for path, content in zip(pdf["path"], pdf["content"]):
                parts = path.rstrip("/").split("/")
                member = parts[-1]
                # never start with "_" or ".": Spark's file listing skips such names; the whole
                # path tells apart files of the same name in different folders
                name = ("ontime_" + "_".join(p.strip("_") for p in parts[-2:] if p).replace("=", "-")
                        + "_" + hashlib.md5(path.encode()).hexdigest()[:12] + ".zip")
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                    zf.writestr(member, bytes(content))
                # same name on a task retry: the archive is simply written again
                with fs_.open_output_stream(f"{base}/{name}") as out:
                    out.write(buf.getvalue())
                names.append(name)
            yield pd.DataFrame({"archive": names})
    return run


def zip_csv_files(spark: SparkSession, csv_dir: str, zip_dir: str) -> int:
    """Pack every CSV part file under ``csv_dir`` into its own archive in ``zip_dir``
    (one archive per part file, written from the tasks); returns the number of archives."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", True).load(csv_dir).select("path", "content"))
    return files.mapInPandas(_zip_files(zip_dir), "archive string").count()
